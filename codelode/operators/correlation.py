"""Failed tests beside the changes that may have broken them, and the sources of a test.

``failed`` has repository_id, test_id, full_name, suite_name, metadata;
``imports`` has repository_id, path, source, imported_names; ``changed`` has
repository_id and path; ``symbols`` has repository_id, path and name.  All
rules are equi-joins: the end of a path is one of its suffixes of whole parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions import text as X
from codelode.operators import coverage

# Endings of the files that an imported module may name.
MODULE_ENDINGS = (".py", ".ts", ".js")


def test_path(suite: Column, metadata: Column) -> Column:
    """Path of the file of a test: the one its report names, else its suite, read as a dotted module unless it is a path."""
    named = F.get_json_object(metadata, "$.file")
    dotted = F.concat(F.replace(suite, F.lit("."), F.lit("/")), F.lit(".py"))
    return F.coalesce(named, F.when(suite != "", F.when(suite.contains("/"), suite).otherwise(dotted)))


def module_stem(source: Column) -> Column:
    """An imported module as the end of a path: dots of packages as slashes, marks of folders left out."""
    bare = F.regexp_replace(source, r"^[./@]+", "")
    return F.when(bare.contains("/"), bare).otherwise(F.replace(bare, F.lit("."), F.lit("/")))


def suffixes(path: Column) -> Column:
    """The path and what is left of it without its first parts."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def bare_stem(path: Column) -> Column:
    """Name of a file without ending and ``test_``."""
    return F.replace(F.regexp_replace(X.filename(path), r"\.[^.]*$", ""), F.lit("test_"), F.lit(""))


def imported_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repository_id, path, target, imported_names): files of the repository that an import may name."""
    stem = module_stem(F.col("source"))
    keys = imports.where(stem != "").select("repository_id", "path", "imported_names", F.explode(F.array(*[F.concat(stem, F.lit(e)) for e in MODULE_ENDINGS])).alias("key"))
    ends = files.select("repository_id", F.col("path").alias("target")).distinct().withColumn("key", F.explode(suffixes(F.col("target"))))
    return keys.join(ends, ["repository_id", "key"]).select("repository_id", "path", "target", "imported_names").distinct()


def failure_correlations(failed: DataFrame, files: DataFrame, imports: DataFrame, changed: DataFrame, symbols: DataFrame) -> DataFrame:
    """(test_id, full_name, correlation_type, confidence, changed_files, changed_symbols) of the failed tests with a related change.

    A test whose file is not in the listing is left out.  A change it imports
    counts before one of its stem; lists are sorted and joined by commas.
    """
    tests = failed.select("repository_id", "test_id", "full_name", test_path(F.col("suite_name"), F.col("metadata")).alias("path"))
    tests = tests.join(files.select("repository_id", "path").distinct(), ["repository_id", "path"], "left_semi")
    direct = tests.join(imported_files(imports, changed), ["repository_id", "path"])
    defined = symbols.select("repository_id", F.col("path").alias("target"), "name").distinct()
    names = X.csv_names(F.col("imported_names"))
    used = direct.join(defined, ["repository_id", "target"]).where((F.size(names) == 0) | F.array_contains(names, F.col("name")))
    used = used.groupBy("test_id").agg(F.array_join(F.sort_array(F.collect_set(F.concat("target", F.lit("::"), "name"))), ",").alias("changed_symbols"))
    by_import = direct.groupBy("test_id", "full_name").agg(F.array_join(F.sort_array(F.collect_set("target")), ",").alias("changed_files"))
    rest = tests.join(by_import.select("test_id"), "test_id", "left_anti").withColumn("key", bare_stem(F.col("path")))
    near = rest.join(changed.select("repository_id", F.col("path").alias("target"), bare_stem(F.col("path")).alias("key")).distinct(), ["repository_id", "key"])
    by_stem = near.groupBy("test_id", "full_name").agg(F.array_join(F.sort_array(F.collect_set("target")), ",").alias("changed_files"))
    head = lambda kind, sure: [F.lit(kind).alias("correlation_type"), F.lit(sure).alias("confidence")]
    return (
        by_import.select("test_id", "full_name", *head("direct_import", "high"), "changed_files").join(used, "test_id", "left")
        .unionByName(by_stem.select("test_id", "full_name", *head("module_sibling", "medium"), "changed_files"), allowMissingColumns=True)
        .withColumn("changed_symbols", F.coalesce("changed_symbols", F.lit("")))
    )


def failure_overview(failures: DataFrame, correlations: DataFrame, trends: DataFrame) -> DataFrame:
    """Failures with the type of their correlation, by id, and their trends, by name; both may be missing."""
    kinds = trends.groupBy("full_name").agg(F.array_join(F.sort_array(F.collect_set("trend_type")), ",").alias("trends"))
    why = correlations.groupBy("test_id").agg(F.min("correlation_type").alias("correlation_type"))
    return failures.join(why, "test_id", "left").join(kinds, "full_name", "left")


def sources_of_tests(tests: DataFrame, files: DataFrame, imports: DataFrame) -> DataFrame:
    """(repository_id, path, target, relationship, confidence): files a test imports, else those of its stem; ``tests`` and ``files`` have repository_id and path."""
    near = tests.join(imported_files(imports, files), ["repository_id", "path"]).where("path <> target").select("repository_id", "path", "target", F.lit(0).alias("rank"))
    key = coverage.sibling_key
    t = tests.select("repository_id", "path", key(F.col("path")).alias("key")).distinct()
    s = files.select("repository_id", F.col("path").alias("target"), key(F.col("path")).alias("key")).distinct()
    stem = t.join(s, ["repository_id", "key"]).where("path <> target").select("repository_id", "path", "target", F.lit(1).alias("rank"))
    best = near.unionByName(stem).groupBy("repository_id", "path", "target").agg(F.min("rank").alias("rank"))
    first = F.col("rank") == 0
    return best.select("repository_id", "path", "target", F.when(first, "direct_import").otherwise("sibling_module").alias("relationship"), F.when(first, "high").otherwise("medium").alias("confidence"))


def affected_tests(tests: DataFrame, imports: DataFrame, changed: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repository_id, path, relationship, confidence, n_targets) of unchanged test files near a change.

    A test that imports a changed symbol by name comes before one that imports
    a changed file, and that before one of the stem of a changed file.
    """
    kept = tests.join(changed, ["repository_id", "path"], "left_anti")
    used = kept.join(imported_files(imports, changed), ["repository_id", "path"])
    defined = symbols.select("repository_id", F.col("path").alias("target"), "name").distinct()
    by_name = used.join(defined, ["repository_id", "target"]).where(F.array_contains(X.csv_names(F.col("imported_names")), F.col("name")))
    key = coverage.sibling_key
    by_stem = kept.withColumn("key", key(F.col("path"))).join(changed.select("repository_id", F.col("path").alias("target"), key(F.col("path")).alias("key")).distinct(), ["repository_id", "key"])
    rows = (
        by_name.select("repository_id", "path", "target", F.lit(0).alias("rank"))
        .unionByName(used.select("repository_id", "path", "target", F.lit(1).alias("rank")))
        .unionByName(by_stem.select("repository_id", "path", "target", F.lit(2).alias("rank")))
        .distinct()
    )
    # the targets of the first rule that holds for the test
    counted = rows.groupBy("repository_id", "path", "rank").agg(F.count(F.lit(1)).alias("n_targets"))
    best = counted.groupBy("repository_id", "path").agg(F.min(F.struct("rank", "n_targets")).alias("r"))
    rank = F.col("r.rank")
    return best.select(
        "repository_id", "path", F.when(rank == 0, "direct_import").when(rank == 1, "indirect_import").otherwise("sibling_module").alias("relationship"),
        F.when(rank == 0, "high").otherwise("medium").alias("confidence"), F.col("r.n_targets").alias("n_targets"),
    )
