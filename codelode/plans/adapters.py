"""Tables of the engine made from those of a data folder, in Spark and in SQL.

Commits, files, symbols and documents are there as such.  Changes, calls, test
cases and failures are derived from orders, line items, parts and events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelode.sources.tables import table

#: Lines that import something, and what they import from where; and lines that define a name, in Python and scripts.
IMPORT = r"""(?m)^(?:from [\w.]+ import [\w, ]+|import [^;'"\n]+ from ['"][^'"\n]+|import [\w.]+)"""
FROM_TEXT, FROM_PYTHON, PLAIN = r"""from ['"]([^'"]+)""", r"^from ([\w.]+) import", r"^import ([\w.]+)"
NAMES_PYTHON, NAMES_SCRIPT = r"^from [\w.]+ import ([\w, ]+)", r"\{([^}]*)\}"
DEFINITION = r"(?m)^(?:export )?(?:default )?(?:async )?(?:def|class|function|const|interface) (\w+)"

_PIECE = lambda p: f"nullif(regexp_extract(x, $${p}$$, 1), '')"
#: SQL of each derived table, as a common table expression.
CTE = {
    "im": f"im AS (SELECT DISTINCT repository_id, path, coalesce({_PIECE(FROM_TEXT)}, {_PIECE(FROM_PYTHON)}, {_PIECE(PLAIN)}, '') AS source, coalesce({_PIECE(NAMES_PYTHON)}, {_PIECE(NAMES_SCRIPT)}, '') AS imported_names FROM (SELECT repository_id, path, unnest(regexp_extract_all(content, $${IMPORT}$$)) AS x FROM file_info))",
    "df": f"df AS (SELECT DISTINCT repository_id, path, unnest(regexp_extract_all(content, $${DEFINITION}$$, 1)) AS name FROM file_info)",
    "co": "co AS (SELECT o_orderkey AS commit_id, o_orderpriority AS repository_id, left(sha256(CAST(o_orderkey AS VARCHAR)), 40) AS commit_hash, o_orderdate AS committed_at FROM orders)",
    "ch": "ch AS (SELECT l_orderkey AS commit_id, 'src/' || lower(p_brand) || '/' || lower(p_type) || '.py' AS path, CASE l_returnflag WHEN 'A' THEN 'added' WHEN 'N' THEN 'modified' ELSE 'deleted' END AS change_type, CAST(l_quantity AS INTEGER) AS additions, l_linenumber AS deletions FROM lineitem JOIN part ON p_partkey = l_partkey)",
    "e": "e AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS dst, l_quantity AS q FROM lineitem) WHERE q >= 40 AND dst IS NOT NULL AND src <> dst)",
    "tc": "tc AS (SELECT 'all' AS repository_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS imported_at, strftime(ts, '%Y-%m-%d') AS test_run_id, 'user_' || user_id AS full_name, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' ELSE 'passed' END AS outcome, CAST(floor(value) AS BIGINT) AS duration_ms FROM (SELECT *, row_number() OVER (PARTITION BY date_trunc('day', ts), user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1)",
    "fl": "fl AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'AssertionError' WHEN 1 THEN 'ModuleNotFoundError' WHEN 2 THEN 'TimeoutError' WHEN 3 THEN 'RequestException' WHEN 4 THEN 'ConnectionError' WHEN 5 THEN 'CustomError' WHEN 6 THEN NULL ELSE 'FixtureError' END AS failure_type, CASE event_id % 8 WHEN 0 THEN 'Expected 5, got 3' WHEN 1 THEN 'No module named ''requests''' WHEN 2 THEN 'Test timed out' WHEN 3 THEN 'HTTP 404 Not Found' WHEN 4 THEN 'Connection refused' WHEN 5 THEN 'Something went wrong' WHEN 6 THEN NULL ELSE 'fixture db failed' END AS failure_message, CASE WHEN event_id % 8 = 0 THEN 'assert x == 5' END AS failure_stacktrace FROM events WHERE event_type = 'error')",
    "cu": "cu AS (SELECT doc_id AS chunk_id, text AS content, source AS chunk_type, lang AS language, embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id - 100000)",
    "cv": "cv AS (SELECT vec_id AS chunk_id, embedding, label FROM embeddings)",
    "sy": "sy AS (SELECT s.id, trim(s.name) AS name, s.symbol_type, s.analysis_run_id, s.file_id, f.path FROM (SELECT DISTINCT * FROM symbols) s JOIN (SELECT DISTINCT id, path FROM files) f ON f.id = s.file_id)",
}


def commits(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("commit_id"), F.col("o_orderpriority").alias("repository_id"),
        F.left(F.sha2(F.col("o_orderkey").cast("string"), 256), F.lit(40)).alias("commit_hash"), F.col("o_orderdate").alias("committed_at"),
    )


def changes(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.concat(F.lit("src/"), F.lower("p_brand"), F.lit("/"), F.lower("p_type"), F.lit(".py")).alias("path")
    )
    kind = F.when(F.col("l_returnflag") == "A", "added").when(F.col("l_returnflag") == "N", "modified").otherwise("deleted")
    return table(spark, folder, "lineitem").join(part, "l_partkey").select(
        F.col("l_orderkey").alias("commit_id"), "path", kind.alias("change_type"), F.col("l_quantity").cast("int").alias("additions"), F.col("l_linenumber").alias("deletions")
    )


def call_edges(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")
    rows = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), F.col("l_quantity").alias("q"))
    return rows.where("q >= 40 and dst is not null and src <> dst").select("src", "dst").distinct()


def test_cases(spark: SparkSession, folder: str) -> DataFrame:
    day = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz")
    last = table(spark, folder, "events").groupBy(day.alias("imported_at"), "user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("r"))
    outcome = F.when(F.col("r.event_type") == "error", "failed").when(F.col("r.event_type") == "signup", "skipped").otherwise("passed")
    return last.select(
        F.lit("all").alias("repository_id"), "imported_at", F.date_format("imported_at", "yyyy-MM-dd").alias("test_run_id"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("full_name"), outcome.alias("outcome"), F.floor("r.value").cast("long").alias("duration_ms"),
    )


def failures(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("event_id") % 8
    types = F.array(*[F.lit(x) for x in ("AssertionError", "ModuleNotFoundError", "TimeoutError", "RequestException", "ConnectionError", "CustomError", None, "FixtureError")])
    texts = F.array(*[F.lit(x) for x in ("Expected 5, got 3", "No module named 'requests'", "Test timed out", "HTTP 404 Not Found", "Connection refused", "Something went wrong", None, "fixture db failed")])
    return table(spark, folder, "events").where(F.col("event_type") == "error").select(
        "event_id", F.get(types, n.cast("int")).alias("failure_type"), F.get(texts, n.cast("int")).alias("failure_message"), F.when(n == 0, "assert x == 5").alias("failure_stacktrace")
    )


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select((F.col("vec_id") + 100000).alias("chunk_id"), "embedding", "label")
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("source").alias("chunk_type"), F.col("lang").alias("language"))
    return docs.join(vectors, "chunk_id", "left")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def located_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols with the path of their file."""
    files = table(spark, folder, "files").select(F.col("id").alias("file_id"), "path").distinct()
    s = table(spark, folder, "symbols").distinct()
    return s.join(files, "file_id").select("id", F.trim("name").alias("name"), "symbol_type", "analysis_run_id", "file_id", "path")


def imports(spark: SparkSession, folder: str) -> DataFrame:
    """(repository_id, path, source, imported_names) of the import lines of the stored texts."""
    rows = table(spark, folder, "file_info").select("repository_id", "path", F.explode(F.regexp_extract_all("content", F.lit(IMPORT), F.lit(0))).alias("x"))
    part = lambda p: F.nullif(F.regexp_extract("x", p, 1), F.lit(""))
    return rows.select(
        "repository_id", "path", F.coalesce(part(FROM_TEXT), part(FROM_PYTHON), part(PLAIN), F.lit("")).alias("source"),
        F.coalesce(part(NAMES_PYTHON), part(NAMES_SCRIPT), F.lit("")).alias("imported_names"),
    ).distinct()


def definitions(spark: SparkSession, folder: str) -> DataFrame:
    """(repository_id, path, name) of the lines of the stored texts that define a name."""
    rows = table(spark, folder, "file_info").select("repository_id", "path", F.explode(F.regexp_extract_all("content", F.lit(DEFINITION), F.lit(1))).alias("name"))
    return rows.distinct()
