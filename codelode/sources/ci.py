"""Workflow files of continuous integration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions import constants as K
from codelode.functions import predicates as P


def commands(text: Column) -> Column:
    """Trimmed lines that run tests and are no comments, in order."""
    lines = F.transform(F.split(text, "\n"), lambda l: F.trim(l))
    pattern = "(?i)" + "|".join(f"(?:{p})" for p in K.TEST_COMMANDS)
    return F.filter(lines, lambda l: ~F.startswith(l, F.lit("#")) & l.rlike(pattern))


def jobs(text: Column) -> Column:
    """Names at the indent of jobs."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^  ([A-Za-z0-9_-]+):\s*$"), F.lit(1))


def triggers(text: Column) -> Column:
    names = F.array(*[F.lit(t) for t in ("push", "pull_request", "schedule", "workflow_dispatch")])
    return F.filter(names, lambda t: F.regexp_like(text, F.concat(F.lit(r"(?m)^\s*(?:on:.*\b)?"), t, F.lit(r"\b"))))


def ci_jobs(files: DataFrame) -> DataFrame:
    """(repository_id, path, job, commands, triggers) of the workflow files in (repository_id, path, content)."""
    found = files.where(P.is_ci_file(F.col("path"))).select(
        "repository_id", "path", F.explode(jobs(F.col("content"))).alias("job"), commands(F.col("content")).alias("commands"), triggers(F.col("content")).alias("triggers")
    )
    return found.where(~F.col("job").isin("push", "pull_request", "schedule", "workflow_dispatch"))


def relevant(jobs_: DataFrame, changed: DataFrame) -> DataFrame:
    """(repository_id, path, job, relevance): high if tests changed or a command fits a changed language."""
    facts = changed.groupBy("repository_id").agg(F.bool_or(P.is_changed_test(F.col("path"))).alias("tests"), F.collect_set("language").alias("languages"))
    runs = F.array_join("commands", "\n")
    fits = (
        (runs.contains("pytest") & F.array_contains("languages", "Python"))
        | (runs.rlike("npm|yarn|jest|vitest") & (F.array_contains("languages", "JavaScript") | F.array_contains("languages", "TypeScript")))
        | (runs.contains("go test") & F.array_contains("languages", "Go"))
    )
    return jobs_.join(facts, "repository_id").select("repository_id", "path", "job", F.when(F.col("tests") | fits, "high").otherwise("medium").alias("relevance"))
