"""References to records that do not exist.

``commits.parent_hashes`` names commits of the same repository.  A reference
is an orphan if no live commit of that repository has the hash it names.

Defined results
* A named parent is a maximal run of 7 to 40 hexadecimal digits other than
  forty zeros; a shortened one stands for every hash that begins with it.
* Hashes are compared in lower case without blanks.  Null, empty and blank
  ``parent_hashes`` name nothing; rows without repository or hash name nothing
  and are nobody's parent.
* Repeated rows of a commit count once; a commit names what any of its rows
  names.
* A commit is deleted if a removal is no earlier than the arrival of all its
  rows.  Rows without an arrival time never outlive a removal.
* Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shortest abbreviation of a hash; all abbreviations share at least so many digits with the hash.
MIN_DIGITS = 7


def clean_hash(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"\s+", ""))


def named_parents(c: Column) -> Column:
    """Array of the distinct hashes that a text of parents names."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"([0-9a-f]+)"), F.lit(1))
    return F.array_distinct(F.filter(runs, lambda h: F.length(h).between(MIN_DIGITS, 40) & (h != "0" * 40)))


def commit_states(commits: DataFrame, deleted: DataFrame) -> DataFrame:
    """One row per (repository_id, hash): first and last arrival, commit time, whether live."""
    rows = commits.select(
        "repository_id", clean_hash(F.col("commit_hash")).alias("hash"), "created_at", "committed_at"
    ).where(F.col("repository_id").isNotNull() & (F.col("hash") != ""))
    known = rows.groupBy("repository_id", "hash").agg(
        F.min("created_at").alias("first_arrival"),
        F.max("created_at").alias("last_arrival"),
        F.min("committed_at").alias("committed_at"),
    )
    gone = (
        deleted.select("repository_id", clean_hash(F.col("commit_hash")).alias("hash"), "deleted_at")
        .where(F.col("deleted_at").isNotNull())
        .groupBy("repository_id", "hash")
        .agg(F.max("deleted_at").alias("deleted_at"))
    )
    dead = F.col("deleted_at").isNotNull() & (
        F.col("last_arrival").isNull() | (F.col("deleted_at") >= F.col("last_arrival"))
    )
    return known.join(gone, ["repository_id", "hash"], "left").withColumn("live", ~dead).drop("deleted_at")


def parent_references(commits: DataFrame, states: DataFrame) -> DataFrame:
    """Distinct (repository_id, commit_hash, parent_hash) named by live commits, with the times of the commit."""
    named = (
        commits.select(
            "repository_id",
            clean_hash(F.col("commit_hash")).alias("commit_hash"),
            F.explode(named_parents(F.col("parent_hashes"))).alias("parent_hash"),
        )
        .where(F.col("repository_id").isNotNull() & (F.col("commit_hash") != ""))
        .distinct()
    )
    live = states.where("live").select(
        "repository_id", F.col("hash").alias("commit_hash"), "first_arrival", "committed_at"
    )
    return named.join(live, ["repository_id", "commit_hash"])


def _names(child: DataFrame, parent: DataFrame) -> Column:
    """Join condition: the equi part is spread over the hash space, so a hot repository is no hot key."""
    head = lambda c: F.substring(c, 1, MIN_DIGITS)
    return (
        (child["repository_id"] == parent["repository_id"])
        & (head(child["parent_hash"]) == head(parent["hash"]))
        & F.startswith(parent["hash"], child["parent_hash"])
    )


def orphan_keys(refs: DataFrame, states: DataFrame) -> DataFrame:
    """Left anti-join of the distinct foreign keys against the live parent keys."""
    keys = refs.select("repository_id", "parent_hash").distinct()
    live = states.where("live").select("repository_id", "hash")
    return keys.join(live, _names(keys, live), "left_anti")


def orphan_references(commits: DataFrame, deleted: DataFrame) -> DataFrame:
    """(repository_id, commit_hash, parent_hash) of every live commit and each parent it names in vain."""
    states = commit_states(commits, deleted)
    refs = parent_references(commits, states)
    return refs.join(orphan_keys(refs, states), ["repository_id", "parent_hash"], "left_semi").select(
        "repository_id", "commit_hash", "parent_hash"
    )


def orphan_report(commits: DataFrame, deleted: DataFrame) -> DataFrame:
    """References per repository and month of the commit, by what became of the parent.

    ``missing``: no commit has the hash.  ``deleted``: the commits that have it
    are deleted.  ``late``: a live one has it, but its first row arrived after
    the first row of the commit that names it.
    """
    states = commit_states(commits, deleted)
    refs = parent_references(commits, states)
    keys = refs.select("repository_id", "parent_hash").distinct()
    orphans = orphan_keys(refs, states)
    dead = states.where("not live").select("repository_id", "hash")
    fate = orphans.join(dead, _names(orphans, dead), "left").groupBy(
        orphans["repository_id"], orphans["parent_hash"]
    ).agg(F.when(F.count("hash") > 0, "deleted").otherwise("missing").alias("fate"))
    live = states.where("live").select("repository_id", "hash", F.col("first_arrival").alias("parent_arrival"))
    arrived = keys.join(live, _names(keys, live)).groupBy(
        keys["repository_id"], keys["parent_hash"]
    ).agg(F.min("parent_arrival").alias("parent_arrival"))
    both = ["repository_id", "parent_hash"]
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False))).alias
    return (
        refs.join(fate, both, "left")
        .join(arrived, both, "left")
        .groupBy(F.lit("commits").alias("table_name"), "repository_id", F.date_format("committed_at", "yyyy-MM").alias("month"))
        .agg(
            F.count(F.lit(1)).alias("n_references"),
            count(F.col("fate") == "missing")("n_missing"),
            count(F.col("fate") == "deleted")("n_deleted"),
            count(F.col("parent_arrival") > F.col("first_arrival"))("n_late"),
        )
    )
