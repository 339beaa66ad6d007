"""Test reports: JUnit XML and normalised JSON, one text for each report.

Both give (report_id, suite_name, test_name, class_name, full_name, outcome,
duration_ms, failure_message, failure_type, failure_stacktrace).  A text that
is neither gives no rows; the counters of a report are those of its cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions.text import milliseconds, truncated

MESSAGE_CHARS, TRACE_CHARS = 5_000, 50_000
_DETAIL = "struct<_VALUE: string, _message: string, _type: string>"
_CASE = f"struct<_name: string, _classname: string, _time: string, failure: array<{_DETAIL}>, error: array<{_DETAIL}>, skipped: array<{_DETAIL}>>"
_SUITE = f"struct<_name: string, testcase: array<{_CASE}>>"
_JSON_CASE = (
    "struct<suite_name: string, test_name: string, class_name: string, full_name: string, outcome: string, duration_ms: bigint, "
    "failure_message: string, failure_type: string, failure_stacktrace: string>"
)
COLUMNS = "suite_name test_name class_name full_name outcome duration_ms failure_message failure_type failure_stacktrace".split()


def report_format(text: Column) -> Column:
    """junit or json by the first character that is not blank; null for others."""
    first = F.left(F.ltrim(text), F.lit(1))
    return F.when(first == "<", "junit").when(first == "{", "json")


def junit_cases(reports: DataFrame) -> DataFrame:
    """Cases of the JUnit texts in (report_id, content), under one suite or several."""
    xml = reports.where(report_format(F.col("content")) == "junit")
    body = F.regexp_replace(F.col("content"), r"^\s*<\?xml[^>]*\?>", "")
    many = F.from_xml(body, f"testsuite array<{_SUITE}>")
    one = F.array(F.from_xml(body, f"_name string, testcase array<{_CASE}>"))
    suites = F.when(body.rlike(r"^\s*<testsuites[\s>]"), many["testsuite"]).otherwise(one)
    s = xml.select("report_id", F.explode(suites).alias("s")).select("report_id", F.coalesce("s._name", F.lit("unknown")).alias("suite_name"), F.explode("s.testcase").alias("c"))
    # an empty element is read as an array of one null
    has = lambda k: F.coalesce(F.size(f"c.{k}") > 0, F.lit(False))
    outcome = F.when(has("failure"), "failed").when(has("error"), "error").when(has("skipped"), "skipped").otherwise("passed")
    bad = F.coalesce(F.get("c.failure", F.lit(0)), F.get("c.error", F.lit(0)))
    owner = F.coalesce(F.nullif(F.col("c._classname"), F.lit("")), F.col("suite_name"))
    name = F.coalesce("c._name", F.lit("unknown"))
    return s.select(
        "report_id", "suite_name", name.alias("test_name"), F.col("c._classname").alias("class_name"), F.concat(owner, F.lit("."), name).alias("full_name"),
        outcome.alias("outcome"), milliseconds(F.col("c._time")).alias("duration_ms"),
        truncated(bad["_message"], MESSAGE_CHARS, "... [truncated]").alias("failure_message"), bad["_type"].alias("failure_type"),
        truncated(F.trim(bad["_VALUE"]), TRACE_CHARS, "... [truncated]").alias("failure_stacktrace"),
    )


def json_cases(reports: DataFrame) -> DataFrame:
    """Cases of the JSON texts in (report_id, content), with defaults for missing fields."""
    rows = reports.where(report_format(F.col("content")) == "json")
    c = rows.select("report_id", F.explode(F.from_json("content", f"test_cases array<{_JSON_CASE}>")["test_cases"]).alias("c"))
    unknown = F.lit("unknown")
    suite, name = F.coalesce("c.suite_name", unknown), F.coalesce("c.test_name", unknown)
    return c.select(
        "report_id", suite.alias("suite_name"), name.alias("test_name"), F.col("c.class_name"), F.coalesce("c.full_name", F.concat(suite, F.lit("."), name)).alias("full_name"),
        F.coalesce(F.lower("c.outcome"), F.lit("error")).alias("outcome"), F.coalesce("c.duration_ms", F.lit(0).cast("long")).alias("duration_ms"),
        truncated(F.col("c.failure_message"), MESSAGE_CHARS, "... [truncated]").alias("failure_message"), F.col("c.failure_type"),
        truncated(F.col("c.failure_stacktrace"), TRACE_CHARS, "... [truncated]").alias("failure_stacktrace"),
    )


def report_cases(reports: DataFrame) -> DataFrame:
    return junit_cases(reports).unionByName(json_cases(reports))
