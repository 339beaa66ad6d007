"""Queries of the corpus problems over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codelode.llm import authors, handwritten, leaks, quality, syntax, tokens
from codelode.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, folder, "file_info"))


def p3_layout(spark: SparkSession, folder: str) -> DataFrame:
    return handwritten.classify(table(spark, folder, "file_info"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.unparsable(table(spark, folder, "file_info"), table(spark, folder, "file_analysis_results"))


def p4_rates(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.syntax_rates(table(spark, folder, "file_info"), table(spark, folder, "file_analysis_results"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return authors.same_person_pairs(table(spark, folder, "commits"))


def p5_persons(spark: SparkSession, folder: str) -> DataFrame:
    return authors.persons(table(spark, folder, "commits"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_ids(table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leak_report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return quality.not_prose(table(spark, folder, "documents"), table(spark, folder, "doc_labels"))


def p9_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return quality.scored(table(spark, folder, "documents"), table(spark, folder, "doc_labels"))


QUERIES = {f.__name__: f for f in (p3_found, p3_layout, p4_found, p4_rates, p5_found, p5_persons, p7_ids, p8_found, p8_items, p9_found, p9_statistics)}
SQL: dict[str, str] = {}
