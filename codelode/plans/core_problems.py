"""Queries of the core data problems over the tables of a folder."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from codelode.operators import hierarchy, references, snapshots
from codelode.sources.tables import table
from codelode.staging import shared_dir


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return references.orphan_references(table(spark, folder, "commits"), table(spark, folder, "deleted_commits"))


def p1_orphan_counts(spark: SparkSession, folder: str) -> DataFrame:
    return references.orphan_report(table(spark, folder, "commits"), table(spark, folder, "deleted_commits"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    # the keys of one source keep their ordinals from one delivery to the next
    store = snapshots.OrdinalStore(spark, f"{shared_dir(spark)}/ordinals/{hashlib.sha256(folder.encode()).hexdigest()[:16]}/symbols")
    return snapshots.snapshot_changes(*(table(spark, folder, t) for t in ("symbols", "files", "analysis_runs")), store)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    found = hierarchy.unending_chains(table(spark, folder, "symbols"), "id", "parent_symbol_id")
    return found.withColumnRenamed("id", "symbol_id")


def p6_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    found = hierarchy.hierarchy(table(spark, folder, "symbols"), "id", "parent_symbol_id", "name")
    return found.withColumnRenamed("id", "symbol_id")


def p6_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.descendants(table(spark, folder, "symbols"), "id", "parent_symbol_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_orphan_counts, p2_found, p6_found, p6_hierarchy, p6_descendants)}
