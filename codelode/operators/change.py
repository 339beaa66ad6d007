"""What a change set touches: symbols, endpoints, evidence, risk signals.

``changed`` has path, old_path, change_type, additions, deletions, language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions import constants as K
from codelode.functions import predicates as P
from codelode.functions import text as X
from codelode.operators.ordering import top_of


def changed_symbols(changed: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, name, symbol_type, change_type, is_public): symbols of changed files; a renamed file counts as deleted and added.

    ``symbols`` has path, name, symbol_type.
    """
    moved = F.col("change_type") == "renamed"
    plain = changed.where(~moved).select("path", "change_type")
    gone = changed.where(moved).select(F.col("old_path").alias("path"), F.lit("deleted").alias("change_type"))
    new = changed.where(moved).select("path", F.lit("added").alias("change_type"))
    found = plain.unionByName(gone).unionByName(new).distinct().join(symbols.select("path", "name", "symbol_type"), "path")
    public = P.is_public_symbol(F.col("name"), F.col("symbol_type"))
    return found.select("path", "name", "symbol_type", "change_type", public.alias("is_public")).distinct()


def affected_endpoints(endpoints: DataFrame, changed: DataFrame, symbols: DataFrame) -> DataFrame:
    """Endpoints whose file changed or whose handler is a changed symbol: two semi-joins."""
    by_file = endpoints.join(changed.select("path").distinct(), endpoints["file_path"] == F.col("path"), "left_semi")
    by_handler = endpoints.join(symbols.select(F.col("name").alias("handler_name")).distinct(), "handler_name", "left_semi")
    return by_file.select(*endpoints.columns).unionByName(by_handler.select(*endpoints.columns)).distinct()


def likely_tests(changed: DataFrame) -> DataFrame:
    """(path, test_path): where tests of a changed source file usually stand, whether or not they exist."""
    path = F.col("path")
    name, folder = X.filename(path), X.directory(path)
    stem, ending = F.regexp_replace(name, r"\.[^.]*$", ""), F.substring_index(name, ".", -1)
    guesses = F.array(
        F.concat(F.lit("tests/test_"), name),
        F.when(folder == "", F.concat(F.lit("test_"), name)).otherwise(F.concat(folder, F.lit("/test_"), name)),
        F.concat(F.lit("__tests__/"), stem, F.lit(".test."), ending),
    )
    return changed.where(~P.is_changed_test(path)).select("path", F.explode(guesses).alias("test_path")).distinct()


def risk(changed: DataFrame, n_endpoints: Column, n_public: Column, n_workflows: Column, *by: str) -> DataFrame:
    """Score, level and signals of each change set; every signal counts once.

    The counts are columns of ``changed`` that are constant within a set.
    """
    path = F.col("path")
    lines = F.coalesce("additions", F.lit(0)) + F.coalesce("deletions", F.lit(0))
    # one row for each path of a set first: no distinct count, and each path is looked at once
    paths = changed.groupBy(*by, "path").agg(
        F.max("language").alias("language"), F.sum(lines).alias("n_lines"),
        F.max(n_endpoints).alias("n_endpoints"), F.max(n_public).alias("n_public"), F.max(n_workflows).alias("n_workflows"),
    )
    facts = paths.groupBy(*by).agg(
        F.max("n_endpoints").alias("n_endpoints"), F.max("n_public").alias("n_public"), F.max("n_workflows").alias("n_workflows"),
        F.bool_or(P.is_security_path(path)).alias("security"), F.bool_or(P.is_database_path(path)).alias("database"), F.bool_or(P.is_payment_path(path)).alias("payment"),
        F.count("path").alias("n_files"), F.sum("n_lines").alias("n_lines"),
        F.bool_or(P.is_source_file(path, F.col("language"))).alias("source"), F.bool_or(P.is_changed_test(path)).alias("tests"),
    )
    signals = {
        "public_api_change": F.col("n_endpoints") > 0, "high_fanout_symbol": F.col("n_public") >= 5, "workflow_entry_affected": F.col("n_workflows") > 0, "security_code_change": F.col("security"),
        "database_code_change": F.col("database"), "payment_code_change": F.col("payment"), "many_files_changed": F.col("n_files") > 10, "large_change_size": F.col("n_lines") > 500,
        "missing_test_changes": F.col("source") & ~F.col("tests"),
    }
    score = F.least(sum((F.when(c, K.RISK_WEIGHTS[k]).otherwise(0) for k, c in signals.items()), F.lit(0)), F.lit(100))
    level = F.lit("low")
    for least, name in reversed(K.RISK_LEVELS):
        level = F.when(score >= least, name).otherwise(level)
    raised = F.array_join(F.array_compact(F.array(*[F.when(c, k) for k, c in signals.items()])), ",")
    return facts.select(*by, score.alias("score"), level.alias("level"), raised.alias("signals"))


def evidence(changed: DataFrame, *by: str, files: int = 20) -> DataFrame:
    """(…, position, line): the first changed files of each set as text."""
    top = top_of(changed.distinct(), list(by), files, F.col("path"), F.col("change_type"), F.col("additions"), F.col("deletions"))
    line = F.format_string("%s %s (+%d, -%d)", F.initcap("change_type"), F.col("path"), F.coalesce("additions", F.lit(0)).cast("int"), F.coalesce("deletions", F.lit(0)).cast("int"))
    return top.select(*by, line.alias("line"))
