"""Continuous import.

Reports are parsed as they arrive; batches are appended only where their
(repository_id, key) is new, so a batch that is run again writes nothing twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codelode.sources.reports import report_cases, report_format
from codelode.sources.sinks import append_new_groups


def report_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(report_id, content, arrived) of every report file that appears in the folder."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(folder)
    return raw.select(F.sha2("content", 256).alias("report_id"), F.col("content").cast("string").alias("content"), F.col("modificationTime").alias("arrived"))


def import_reports(reports: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write the cases of new reports; equal reports are imported once."""

    def batch(df: DataFrame, _: int) -> None:
        # the report is what is new or not: cases of one name, as parametrised tests have, all stay
        append_new_groups(report_cases(df.select("report_id", "content").dropDuplicates(["report_id"])), target, "report_id")

    return reports.where(report_format(F.col("content")).isNotNull()).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outcome_windows(cases: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Outcomes in tumbling windows of event time, rows later than the watermark left out; works on streams and tables."""
    return (
        cases.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "outcome")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("duration_ms"))
        .select(F.col("w.start").alias("window_start"), "outcome", "n", "duration_ms")
    )


def outcome_sliding(events: DataFrame, late: str = "1 hour", width: str = "1 day", slide: str = "6 hours") -> DataFrame:
    """Outcomes in overlapping windows of event time, a new one every ``slide``."""
    w = F.window("ts", width, slide)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "outcome").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "outcome", "n")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, session_start, last_event, n): runs of events of a key with less than ``gap`` between neighbours."""
    w = F.session_window("ts", gap)
    found = events.withWatermark("ts", late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_event"))
    return found.select(key, F.col("w.start").alias("session_start"), "last_event", "n")


SILENT = "job_id string, status string, last_seen timestamp, n_events long"


def _watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State of one job: when it was last heard of; its end or too long a silence closes it."""
    (job,) = key
    if state.hasTimedOut:
        seen, n = state.get
        state.remove()
        yield pd.DataFrame({"job_id": [job], "status": ["silent"], "last_seen": [pd.Timestamp(seen, unit="ms")], "n_events": [n]})
        return
    seen, n = state.get if state.exists else (0, 0)
    ended = None
    silence = 0
    for df in batches:
        ts = df["ts"].astype("datetime64[ms]").astype("int64")
        n += len(df)
        seen = max(seen, int(ts.max()))
        silence = int(df["silence_ms"].iloc[0])
        done = df.loc[df["status"].isin(["completed", "completed_with_warnings", "failed", "cancelled"])]
        if len(done):
            ended = done.sort_values("ts")["status"].iloc[-1]
    if ended is not None:
        if state.exists:
            state.remove()
        yield pd.DataFrame({"job_id": [job], "status": [ended], "last_seen": [pd.Timestamp(seen, unit="ms")], "n_events": [n]})
        return
    state.update((seen, n))
    # a timeout must lie behind the watermark
    state.setTimeoutTimestamp(max(seen + silence, state.getCurrentWatermarkMs() + 1))


def silent_jobs(events: DataFrame, silence_minutes: int = 60, late: str = "10 minutes") -> DataFrame:
    """(job_id, status, last_seen, n_events) of a stream of (job_id, ts, status): jobs as they end, and those that fall silent.

    A job is silent when the watermark has passed its last event by more than
    the silence; one row of state is kept for each job that runs.
    """
    rows = events.withWatermark("ts", late).select("job_id", "ts", "status", F.lit(silence_minutes * 60_000).cast("long").alias("silence_ms"))
    return rows.groupBy("job_id").applyInPandasWithState(_watch, SILENT, "seen long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def distinct_events(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Events without repetitions of a key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
