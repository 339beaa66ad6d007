"""Answers of a code hosting service as rows: metadata of repositories and pull requests, read from their JSON.

A missing field has its default; a body that is no JSON object gives a row of
nulls and defaults, which callers drop by the null name or number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPOSITORY = (
    "id string, owner struct<login string>, name string, full_name string, description string, default_branch string, language string, "
    "stargazers_count int, forks_count int, visibility string, html_url string, open_issues_count int"
)
PULL_REQUEST = (
    "number bigint, title string, state string, body string, draft boolean, merged boolean, user struct<login string>, head struct<ref string, sha string>, "
    "base struct<ref string, sha string>, additions int, deletions int, changed_files int, comments int"
)


def repositories(bodies: DataFrame) -> DataFrame:
    """The fields of a repository from the JSON texts in ``body``."""
    r = bodies.select(F.from_json("body", REPOSITORY).alias("r"))
    c = lambda field, default: F.coalesce(f"r.{field}", F.lit(default)).alias(field)
    return r.select(
        "r.id", F.col("r.owner.login").alias("owner"), "r.name", "r.full_name", c("description", ""), c("default_branch", "main"), "r.language",
        c("stargazers_count", 0).alias("stars"), c("forks_count", 0).alias("forks"), c("visibility", "public"), F.col("r.html_url").alias("url"), c("open_issues_count", 0).alias("open_issues"),
    )


def pull_requests(bodies: DataFrame) -> DataFrame:
    """The fields of a pull request from the JSON texts in ``body``."""
    r = bodies.select(F.from_json("body", PULL_REQUEST).alias("r"))
    c = lambda field, default: F.coalesce(f"r.{field}", F.lit(default)).alias(field)
    return r.select(
        "r.number", c("title", ""), c("state", "open"), c("body", ""), c("draft", False), c("merged", False), F.col("r.user.login").alias("author"),
        F.col("r.head.ref").alias("head"), F.col("r.head.sha").alias("head_sha"), F.col("r.base.ref").alias("base"), c("additions", 0), c("deletions", 0), c("changed_files", 0), c("comments", 0),
    )
