"""Which tests belong to which source files: by import, by module, by name, by place.

``tests`` has path, name, source, imported_names: one row for each test and
import of its file.  All rules are equi-joins on derived keys: a module is
named within another, or a symbol within the name of a test, as a run of whole
parts, and the runs of a name are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions import predicates as P
from codelode.functions import text as X

def test_inventory(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(file_id, path, framework, n_tests, n_imports) of the test files."""
    tests = files.where(P.is_test_file(F.col("path"))).select("file_id", "path", "language")
    cases = symbols.where(P.is_test_symbol(F.col("name"), F.col("symbol_type"))).groupBy("file_id").agg(F.count(F.lit(1)).alias("n_tests"))
    roots = imports.groupBy("file_id").agg(F.collect_set(P.root_module(F.col("source"))).alias("roots"), F.count(F.lit(1)).alias("n_imports"))
    none = F.array().cast("array<string>")
    return (
        tests.join(cases, "file_id", "left").join(roots, "file_id", "left")
        .select("file_id", "path", P.framework(F.coalesce("roots", none), F.col("language")).alias("framework"),
                F.coalesce("n_tests", F.lit(0).cast("long")).alias("n_tests"), F.coalesce("n_imports", F.lit(0).cast("long")).alias("n_imports"))
    )


def by_import(tests: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, name, target): tests whose file imports a symbol by name."""
    used = tests.select("path", "name", F.explode(X.csv_names(F.col("imported_names"))).alias("target"))
    return used.join(symbols.select(F.col("name").alias("target")).distinct(), "target", "left_semi").select("path", "name", "target").distinct()


def _segments(module: Column) -> Column:
    """The parts of a module name or import path between dots and slashes, without empty ones and marks of folders."""
    return F.filter(F.split(F.regexp_replace(module, r"\.(py|js|jsx|ts|tsx)$", ""), r"[./\\]+"), lambda x: x != "")


def _runs_of(parts: Column) -> Column:
    """All runs of neighbouring parts, joined by dots; a name of n parts has n (n + 1) / 2."""
    n = F.size(parts)
    every = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.transform(F.sequence(i, F.greatest(n, i)), lambda j: F.array_join(F.slice(parts, i, j - i + 1), ".")))
    return F.when(n > 0, F.array_distinct(F.flatten(every))).otherwise(F.array().cast("array<string>"))


def by_module(tests: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, target): test files one of whose imports holds the module of a source file as a run of whole parts, or the reverse.

    Either name that is part of the other is one of its runs, so both
    directions are equi-joins; no pair of names is compared.
    """
    mods = sources.select(F.col("path").alias("target"), _segments(X.module_of(F.col("path"))).alias("parts")).where(F.size("parts") > 0).distinct()
    used = tests.select("path", _segments(F.col("source")).alias("parts")).where(F.size("parts") > 0).distinct()
    whole = lambda df: df.withColumn("key", F.array_join("parts", ".")).drop("parts")
    runs = lambda df: df.withColumn("key", F.explode(_runs_of(F.col("parts")))).drop("parts").distinct()
    inside = runs(used).join(whole(mods), "key")
    around = whole(used).join(runs(mods), "key")
    return inside.select("path", "target").unionByName(around.select("path", "target")).distinct()


def sibling_key(path: Column) -> Column:
    return X.clean_stem(path)


def bare_directory(path: Column) -> Column:
    """Directory without the parts that only hold tests."""
    return F.array_join(F.filter(F.split(X.directory(path), "/"), lambda d: ~d.isin("tests", "test", "__tests__")), "/")


def by_sibling(tests: DataFrame, sources: DataFrame, same_directory: bool = False) -> DataFrame:
    """(path, target): a test file and a source file of equal stem, or of equal directories but for those of tests."""
    key = bare_directory if same_directory else sibling_key
    t = tests.select("path", key(F.col("path")).alias("key")).distinct()
    s = sources.select(F.col("path").alias("target"), key(F.col("path")).alias("key")).distinct()
    return t.join(s, "key").where("path <> target").select("path", "target").distinct()


def tests_of_sources(tests: DataFrame, symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, target, relationship, confidence): the first rule that holds for each test file and source file.

    ``symbols`` has name and path; ``sources`` has path.
    """
    direct = by_import(tests, symbols).join(symbols.select(F.col("name").alias("target"), F.col("path").alias("source_path")).distinct(), "target")
    direct = direct.join(sources.select(F.col("path").alias("source_path")).distinct(), "source_path", "left_semi")
    place = F.lower(X.clean_stem(F.col("target")))
    ranked = (
        direct.select("path", F.col("source_path").alias("target"), F.lit(0).alias("rank"))
        .unionByName(by_module(tests, sources).withColumn("rank", F.lit(1)))
        .unionByName(by_sibling(tests, sources).withColumn("rank", F.lit(2)))
        .unionByName(by_sibling(tests, sources, same_directory=True).where(F.contains(F.lower("path"), place)).withColumn("rank", F.lit(3)))
    )
    names = F.array(*[F.lit(x) for x in ("direct_import", "indirect_import", "sibling_module", "path_pattern")])
    level = F.array(*[F.lit(x) for x in ("high", "medium", "medium", "low")])
    return ranked.groupBy("path", "target").agg(F.min("rank").alias("rank")).select(
        "path", "target", F.get(names, F.col("rank")).alias("relationship"), F.get(level, F.col("rank")).alias("confidence")
    )


def name_words(name: Column) -> Column:
    """The words of a name at its case changes and signs, in lower case."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"), r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.filter(F.split(F.lower(spaced), r"[^a-z0-9]+"), lambda x: x != "")


def tests_of_symbols(tests: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, name, target, confidence): tests that import the symbol, else those whose name holds its words in a row."""
    direct = by_import(tests, symbols).withColumn("rank", F.lit(0))
    key = lambda c: F.array_join(name_words(c), "_")
    wanted = symbols.select(key(F.col("name")).alias("key"), F.col("name").alias("target")).where((F.length("name") > 2) & (F.col("key") != "")).distinct()
    words = tests.select("path", "name", name_words(F.col("name")).alias("parts")).distinct()
    runs = words.select("path", "name", F.explode(_runs_of(F.col("parts"))).alias("run")).select("path", "name", F.replace("run", F.lit("."), F.lit("_")).alias("key"))
    named = runs.join(wanted, "key").select("path", "name", "target", F.lit(1).alias("rank")).distinct()
    best = direct.unionByName(named).groupBy("path", "name", "target").agg(F.min("rank").alias("rank"))
    return best.withColumn("confidence", F.when(F.col("rank") == 0, "high").otherwise("low")).drop("rank")


def uncovered(symbols: DataFrame, covered: DataFrame) -> DataFrame:
    """(path, n_symbols, severity): symbols that no test imports, by file; ``covered`` has target."""
    left = symbols.join(covered.select(F.col("target").alias("name")).distinct(), "name", "left_anti")
    n = F.count_distinct("name")
    return left.groupBy("path").agg(n.alias("n_symbols"), F.when(n > 5, "high").when(n > 2, "medium").otherwise("low").alias("severity"))


def recommendations(tests: DataFrame) -> DataFrame:
    """(kind, n_files, directory, command): test files of each extension with their common directory; ``tests`` has path."""
    from codelode.functions.text import extension

    parts = F.split(X.directory(F.col("path")), "/")
    kinds = tests.select(extension(F.col("path")).alias("kind"), "path", parts.alias("parts"))
    # the common prefix of a set of paths is that of its smallest and largest
    ends = kinds.groupBy("kind").agg(F.count_distinct("path").alias("n_files"), F.min("parts").alias("a"), F.max("parts").alias("b"), F.min("path").alias("first"))
    same = F.zip_with("a", "b", lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, F.lit(False))
    prefix = F.array_join(F.when(at == 0, F.col("a")).otherwise(F.slice("a", 1, (at - 1).cast("int"))), "/")
    where = F.when(prefix == "", "tests/").otherwise(F.concat(prefix, F.lit("/")))
    return ends.select("kind", "n_files", where.alias("directory"), P.test_command(F.col("first")).alias("command"))
