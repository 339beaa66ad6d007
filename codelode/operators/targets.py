"""Which symbol, file or endpoint a free text speaks of.

``symbols`` has id, name, path; ``files`` has id, path; ``endpoints`` has id,
method, path.  Exact names are equi-joins; parts of names are compared only
with names that share a token, so no question meets every name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions import text as X

# Words of a question that can be names, paths and routes.
NAMES = r"\b([A-Za-z_][A-Za-z0-9_]{2,}(?:\.[a-z_][A-Za-z0-9_]*)?)\b"
PATHS = r"([\w/\\.-]+\.(?:py|js|ts|tsx|jsx|java|go|rb|php|cs))\b"
ROUTES = r"(?i)\b(GET|POST|PUT|PATCH|DELETE)\s+([/\w{}-]+)"


def _tokens(c):
    """Parts of a name at its case changes, dots and underscores, in lower case."""
    spaced = F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1_$2")
    return F.array_distinct(F.filter(F.split(F.lower(spaced), r"[^a-z0-9]+"), lambda t: F.length(t) > 2))


def candidates(questions: DataFrame, symbols: DataFrame, files: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(question_id, kind, target_id, score): best score of each target a question may mean."""
    text = F.col("question")
    names = questions.select("question_id", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(NAMES), F.lit(1)))).alias("word"))
    names = names.withColumn("word", F.substring_index("word", ".", -1))
    known = symbols.select(F.col("id").alias("target_id"), F.trim("name").alias("name")).distinct()
    exact = names.join(known, F.col("word") == F.col("name")).select("question_id", F.lit("symbol").alias("kind"), "target_id", F.lit(1.0).alias("score"))
    # distinct names only, so a name that many symbols have is compared once
    near = names.distinct().withColumn("part", F.explode(_tokens(F.col("word")))).join(
        known.select("name").distinct().withColumn("part", F.explode(_tokens(F.col("name")))), "part"
    ).select("question_id", "word", "name").distinct().where("word <> name")
    sim = X.name_similarity(F.col("word"), F.col("name"))
    partial = near.withColumn("sim", sim).where("sim >= 0.5").join(known, "name").select(
        "question_id", F.lit("symbol").alias("kind"), "target_id", F.round(F.col("sim") * 0.8, 6).alias("score")
    )
    paths = questions.select("question_id", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(PATHS), F.lit(1)))).alias("word"))
    places = files.select(F.col("id").alias("target_id"), "path", F.lower(X.filename(F.col("path"))).alias("base")).distinct()
    ps = X.path_similarity(F.col("word"), F.col("path"))
    by_path = (
        paths.withColumn("base", F.lower(X.filename(F.translate("word", "\\", "/")))).join(places, "base").withColumn("sim", ps).where("sim >= 0.5")
        .select("question_id", F.lit("file").alias("kind"), "target_id", F.when(F.col("sim") == 1, 1.0).otherwise(F.round(F.col("sim") * 0.85, 6)).alias("score"))
    )
    found = F.regexp_extract_all(text, F.lit(ROUTES), F.lit(0))
    routes = questions.select("question_id", F.explode(F.array_distinct(found)).alias("hit")).select(
        "question_id", F.upper(F.regexp_extract("hit", ROUTES, 1)).alias("method"), F.regexp_extract("hit", ROUTES, 2).alias("path")
    )
    by_route = routes.join(endpoints.select(F.col("id").alias("target_id"), F.upper("method").alias("method"), "path"), ["method", "path"]).select(
        "question_id", F.lit("endpoint").alias("kind"), "target_id", F.lit(1.0).alias("score")
    )
    every = exact.unionByName(partial).unionByName(by_path).unionByName(by_route)
    return every.groupBy("question_id", "kind", "target_id").agg(F.max("score").alias("score"))


def identify(questions: DataFrame, symbols: DataFrame, files: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(question_id, status, target_id, n_candidates): found, ambiguous or not_found."""
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "kind", "target_id")
    ranked = candidates(questions, symbols, files, endpoints).select(
        "*", F.row_number().over(w).alias("n"), F.lead("score").over(w).alias("next"), F.count(F.lit(1)).over(Window.partitionBy("question_id")).alias("n_candidates")
    ).where("n = 1")
    sure = (F.col("next").isNull() & (F.col("score") >= 0.9)) | (F.col("score") - F.col("next") >= 0.3)
    j = questions.select("question_id").join(ranked, "question_id", "left")
    return j.select(
        "question_id", F.when(F.col("n").isNull(), "not_found").when(sure, "found").otherwise("ambiguous").alias("status"),
        F.when(sure, F.col("target_id")).alias("target_id"), F.coalesce("n_candidates", F.lit(0).cast("long")).alias("n_candidates"),
    )


def global_search(query: str, files: DataFrame, symbols: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(kind, id, label): files by path, symbols by name, endpoints by path, handler or file; nothing below two characters."""
    q = query.lower()
    hit = lambda c: F.contains(F.lower(c), F.lit(q)) & F.lit(len(q) >= 2)
    return (
        files.where(hit("path")).select(F.lit("file").alias("kind"), "id", F.col("path").alias("label"))
        .unionByName(symbols.where(hit("name")).select(F.lit("symbol").alias("kind"), "id", F.col("name").alias("label")))
        .unionByName(endpoints.where(hit("path") | hit("handler_name") | hit("file_path")).select(F.lit("endpoint").alias("kind"), "id", F.col("path").alias("label")))
    )
