"""Commit history: co-change, file history, ranges, churn, incremental import.

``commits`` has commit_id, repository_id, commit_hash, committed_at; ``changes``
has commit_id, path, change_type, additions, deletions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.functions import text as X
from codelode.operators.ordering import page


def co_changes(commits: DataFrame, changes: DataFrame, path: str, limit: int = 20) -> DataFrame:
    """Paths changed in the commits that touch ``path``, most shared commits first."""
    touching = changes.where(F.col("path") == path).select("commit_id").distinct()
    return (
        changes.where(F.col("path") != path)
        .join(touching, "commit_id", "left_semi")
        .join(commits.select("commit_id", "committed_at"), "commit_id")
        .groupBy("path")
        .agg(F.count("commit_id").alias("shared_commits"), F.max("committed_at").alias("last_changed"))
        .orderBy(F.desc("shared_commits"), "path")
        .limit(max(1, min(limit, 100)))
    )


def file_history(commits: DataFrame, changes: DataFrame, path: str, limit: int = 50) -> DataFrame:
    found = commits.join(changes.where(F.col("path") == path), "commit_id")
    return page(found, F.desc("committed_at"), F.col("commit_id"), *[F.col(c) for c in ("deletions", "additions")], size=limit, most=200)


def summaries(commits: DataFrame) -> DataFrame:
    """Subject, body, short hash and number of parents of each commit."""
    return commits.select(
        "repository_id", "commit_hash", F.left("commit_hash", F.lit(8)).alias("short_hash"),
        X.subject(F.col("commit_message")).alias("subject"), X.body(F.col("commit_message")).alias("body"),
        X.parent_count(F.col("parent_hashes")).alias("parent_count"), "committed_at",
    )


def totals(changes: DataFrame) -> DataFrame:
    """Changed files and lines of each commit."""
    return changes.groupBy("commit_id").agg(
        F.count(F.lit(1)).alias("files_changed"),
        F.sum(F.coalesce("additions", F.lit(0))).alias("additions"),
        F.sum(F.coalesce("deletions", F.lit(0))).alias("deletions"),
    )


def by_prefix(commits: DataFrame, prefix: str) -> DataFrame:
    """The commit a shortened hash stands for; the newest if several begin with it."""
    found = commits.where(F.startswith(F.lower("commit_hash"), F.lit(prefix.lower())))
    return found.orderBy(F.desc("committed_at"), "commit_hash", "repository_id").limit(1)


def in_range(commits: DataFrame, after: str, until: str) -> DataFrame:
    """Commits after the base and up to the head; literal bounds, so they reach the scan."""
    at = F.col("committed_at")
    return commits.where((at > F.lit(after).cast("timestamp_ntz")) & (at <= F.lit(until).cast("timestamp_ntz")))


def last_changes(commits: DataFrame, changes: DataFrame, after: str, until: str) -> DataFrame:
    """The last change of each path in a range of each repository."""
    joined = changes.join(in_range(commits, after, until).select("commit_id", "repository_id", "committed_at"), "commit_id")
    row = F.struct("committed_at", "commit_id", "deletions", "additions", "change_type")
    return joined.groupBy("repository_id", "path").agg(F.max(row).alias("r")).select("repository_id", "path", "r.*")


def churn(commits: DataFrame, changes: DataFrame, after: str, until: str) -> DataFrame:
    """Commits, distinct files and lines of a range of each repository, all changes counted."""
    joined = in_range(commits, after, until).select("commit_id", "repository_id").join(changes, "commit_id", "left")
    return joined.groupBy("repository_id").agg(
        F.count_distinct("commit_id").alias("commits_in_range"), F.count_distinct("path").alias("files_changed"),
        F.sum(F.coalesce("additions", F.lit(0))).alias("insertions"), F.sum(F.coalesce("deletions", F.lit(0))).alias("deletions"),
    )


def new_commits(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming commits whose (repository_id, commit_hash) is not there yet, each once."""
    keys = ["repository_id", "commit_hash"]
    return incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")
