"""Selection of analysis runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUCCESS = ("completed", "completed_with_warnings")
ACTIVE = ("running", "queued")


def latest_run(runs: DataFrame, statuses: tuple[str, ...] | None = SUCCESS, by: str = "started_at") -> DataFrame:
    """The latest run of each repository: one partial aggregate, no window over a repository's runs."""
    kept = runs if statuses is None else runs.where(F.col("status").isin(*statuses))
    cols = [c for c in runs.columns if c not in ("repository_id", by, "id")]
    row = F.struct(by, "id", *cols)
    return kept.where(F.col(by).isNotNull()).groupBy("repository_id").agg(F.max(row).alias("r")).select("repository_id", "r.*")


def stale_runs(runs: DataFrame, as_of: str, hours: float = 24) -> DataFrame:
    """Active runs that started more than ``hours`` before ``as_of``, with the hours since then."""
    now = F.lit(as_of).cast("timestamp_ntz")
    since = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 3.6e9
    return runs.where(F.col("status").isin(*ACTIVE)).withColumn("hours", F.round(since, 1)).where(since > hours)


def recovered(runs: DataFrame, as_of: str, hours: float = 24) -> DataFrame:
    """All runs, the stale ones failed with a message."""
    stale = stale_runs(runs, as_of, hours).select("id", "hours").distinct()
    message = F.concat(F.lit("Marked as failed after "), F.col("hours").cast("string"), F.lit(" hours without end"))
    is_stale = F.col("hours").isNotNull()
    return (
        runs.join(stale, "id", "left")
        .withColumn("status", F.when(is_stale, "failed").otherwise(F.col("status")))
        .withColumn("error_message", F.when(is_stale, message).otherwise(F.col("error_message")))
        .withColumn("completed_at", F.when(is_stale, F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("completed_at")))
        .drop("hours")
    )
