"""Imported test runs: counters, fingerprints, idempotent import, classes of failures, trends.

``cases`` has repository_id, test_run_id, imported_at, full_name, outcome, duration_ms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions import predicates as P

FLAKY_RUNS, FLAKY_SHARE = 5, 0.2


def counters(cases: DataFrame, *by: str) -> DataFrame:
    """Outcomes and total duration of each run; a total of nothing is null."""
    is_ = lambda o: F.count_if(F.col("outcome") == o)
    return cases.groupBy(*(by or ("test_run_id",))).agg(
        F.count(F.lit(1)).alias("total_tests"), is_("passed").alias("passed_tests"), is_("failed").alias("failed_tests"),
        is_("skipped").alias("skipped_tests"), is_("error").alias("error_tests"), F.nullif(F.sum("duration_ms"), F.lit(0).cast("long")).alias("total_duration_ms"),
    )


def fingerprints(cases: DataFrame, source_format: str) -> DataFrame:
    """(test_run_id, content_fingerprint): a hash of names and outcomes that does not depend on their order."""
    listed = F.array_join(F.sort_array(F.collect_list(F.concat("full_name", F.lit(":"), "outcome"))), "|")
    head = F.concat(F.lit(f"format:{source_format}|total:"), F.count(F.lit(1)).cast("string"), F.lit("|"))
    return cases.groupBy("test_run_id").agg(F.sha2(F.concat(head, listed), 256).alias("content_fingerprint"))


def new_runs(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Runs whose (repository_id, content_fingerprint) is not there yet, the smallest id of each."""
    keys = ["repository_id", "content_fingerprint"]
    first = incoming.groupBy(*keys).agg(F.min("test_run_id").alias("test_run_id"))
    return first.join(existing.select(*keys), keys, "left_anti")


def classified(failures: DataFrame) -> DataFrame:
    """Failures with ``failure_class`` and ``confidence``."""
    c = P.failure_class(F.col("failure_type"), F.col("failure_message"), F.col("failure_stacktrace"))
    return failures.withColumn("_c", c).select(*failures.columns, "_c.failure_class", "_c.confidence")


def trends(cases: DataFrame, current: str, lookback_days: int = 30, max_runs: int = 50) -> DataFrame:
    """(repository_id, full_name, trend_type, runs): what changed in the current run of each repository.

    The history is every run of the repository before the current one, within
    the look-back, the newest ``max_runs``.  Counts, the last outcome and the
    upper median of durations come from one aggregate for each test.
    """
    now = F.lit(current).cast("timestamp_ntz")
    at = F.col("imported_at")
    cur = cases.where(at == now)
    runs = (
        cases.where((at < now) & (at >= now - F.expr(f"INTERVAL {lookback_days} DAYS")))
        .select("repository_id", "test_run_id", "imported_at").distinct()
        .withColumn("n", F.row_number().over(Window.partitionBy("repository_id").orderBy(F.desc("imported_at"), F.desc("test_run_id"))))
        .where(F.col("n") <= max_runs)
        .select("repository_id", "test_run_id")
    )
    past = cases.join(runs, ["repository_id", "test_run_id"])
    failed = lambda c: c.isin("failed", "error")
    durations = F.sort_array(F.collect_list(F.when(F.col("duration_ms") > 0, F.col("duration_ms"))))
    history = past.groupBy("repository_id", "full_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "passed").alias("n_passed"), F.count_if(failed(F.col("outcome"))).alias("n_failed"),
        F.max(F.struct("imported_at", "test_run_id", "outcome"))["outcome"].alias("last"), durations.alias("durations"),
    )
    j = cur.join(history, ["repository_id", "full_name"], "left")
    o, n, p, f = F.col("outcome"), F.col("n"), F.col("n_passed"), F.col("n_failed")
    median = F.get("durations", F.floor(F.size("durations") / 2).cast("int"))
    kinds = [
        ("new_test_failure", n.isNull() & (o == "failed")),
        ("repeated_failure", failed(o) & (f >= 2)),
        ("regression", failed(o) & (F.col("last") == "passed")),
        ("fixed", (o == "passed") & failed(F.col("last"))),
        ("potentially_flaky", (n >= FLAKY_RUNS) & (p + f >= FLAKY_RUNS) & (p / (p + f) >= FLAKY_SHARE) & (f / (p + f) >= FLAKY_SHARE)),
        ("duration_increase", (o == "passed") & (F.col("duration_ms") > 2 * median)),
    ]
    found = F.array_compact(F.array(*[F.when(c, k) for k, c in kinds]))
    return j.select("repository_id", "full_name", F.explode(found).alias("trend_type"), F.coalesce(n, F.lit(0).cast("long")).alias("runs"))
