"""Texts of ``git log`` and ``git log --numstat`` as commits and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELD, COMMIT = "\x1f", "\x1e"


def commits(logs: DataFrame) -> DataFrame:
    """Commits of (repository_id, content): seven fields hash, author, address, seconds, parents, subject, body; blocks with fewer are left out."""
    blocks = logs.select("repository_id", F.explode(F.split("content", COMMIT)).alias("block"))
    f = F.split(F.ltrim("block"), FIELD)
    rows = blocks.withColumn("f", f).where(F.size("f") >= 7)
    part = lambda i: F.trim(F.get("f", F.lit(i)))
    text = F.when(part(6) == "", part(5)).otherwise(F.concat(part(5), F.lit("\n\n"), part(6)))
    return rows.select(
        "repository_id", part(0).alias("commit_hash"), part(1).alias("author_name"), part(2).alias("author_email"), text.alias("commit_message"),
        F.timestamp_seconds(part(3).try_cast("bigint")).cast("timestamp_ntz").alias("committed_at"), F.array_join(F.split(part(4), " "), ",").alias("parent_hashes"),
    )


def _sides(path: Column) -> tuple[Column, Column, Column]:
    """Whether a path is a move, its old and its new side; ``dir/{a => b}/f`` included."""
    braces = path.rlike(r"\{.* => .*\}")
    piece = lambda g: F.regexp_replace(F.regexp_replace(path, r"\{(.*?) => (.*?)\}", f"${g}"), "//", "/")
    old = F.when(braces, piece(1)).otherwise(F.substring_index(path, " => ", 1))
    new = F.when(braces, piece(2)).otherwise(F.substring_index(path, " => ", -1))
    return path.contains(" => "), old, new


def changes(numstats: DataFrame) -> DataFrame:
    """Changes of (commit_hash, content): lines of added, removed, path; ``-`` counts as zero."""
    lines = numstats.select("commit_hash", F.explode(F.split("content", "\n")).alias("line"))
    f = F.split("line", "\t")
    rows = lines.where(F.size(f) >= 3).select(
        "commit_hash", F.coalesce(F.get(f, F.lit(0)).try_cast("int"), F.lit(0)).alias("additions"), F.coalesce(F.get(f, F.lit(1)).try_cast("int"), F.lit(0)).alias("deletions"), F.trim(F.get(f, F.lit(2))).alias("raw")
    )
    moved, old, new = _sides(F.col("raw"))
    a, d = F.col("additions"), F.col("deletions")
    kind = F.when(moved, "renamed").when((a > 0) & (d == 0), "added").when((a == 0) & (d > 0), "deleted").otherwise("modified")
    return rows.select(
        "commit_hash", F.when(moved, new).otherwise(F.col("raw")).alias("path"), kind.alias("change_type"), "additions", "deletions",
        F.when(moved, old).alias("old_path"), F.when(moved, new).alias("new_path"),
    )
