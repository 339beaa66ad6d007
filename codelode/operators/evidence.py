"""Evidence for answers: neighbours in the graph, counters, look-ups, context and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions import text as X
from codelode.operators import search
from codelode.operators.ordering import top_of


def graph_evidence(seeds: DataFrame, calls: DataFrame, most: int = 10) -> DataFrame:
    """(seed, relation, position, node, truncated): the first callers and callees of each seed; seeds without any give no rows."""
    seed = F.col(seeds.columns[0])
    s = seeds.select(seed.alias("seed")).distinct()
    rows = s.join(calls, calls["dst"] == s["seed"]).select("seed", F.lit("callers").alias("relation"), F.col("src").alias("node")).unionByName(
        s.join(calls, calls["src"] == s["seed"]).select("seed", F.lit("callees").alias("relation"), F.col("dst").alias("node"))
    ).distinct()
    n = rows.groupBy("seed", "relation").agg((F.count(F.lit(1)) > most).alias("truncated"))
    return top_of(rows, ["seed", "relation"], most, F.col("node")).join(n, ["seed", "relation"]).select("seed", "relation", "node", "truncated")


def counters(rows: DataFrame, by: list[str], level: str) -> DataFrame:
    """(by, n, text): how many rows there are of each level, as numbers and as one text such as ``high: 2, low: 1``."""
    counts = rows.groupBy(*by, level).agg(F.count(F.lit(1)).alias("n"))
    part = F.concat(F.col(level), F.lit(": "), F.col("n").cast("string"))
    return counts.groupBy(*by).agg(F.sum("n").alias("n"), F.array_join(F.sort_array(F.collect_list(part)), ", ").alias("text"))


def composite_lookup(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Chunks with ``symbol_id`` of the key ``path:name:type``; the smallest id where several have it, null where none has."""
    key = F.concat_ws(":", "path", "name", "symbol_type")
    ids = symbols.where("path is not null and name is not null and symbol_type is not null").groupBy(key.alias("symbol_key")).agg(F.min("id").alias("symbol_id"))
    return chunks.join(ids, "symbol_key", "left")


def cited_evidence(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Citations with what they cite: ``evidence`` has answer_id, number and its columns, the first row of a number holds."""
    first = top_of(evidence, ["answer_id", "number"], 1, F.col("evidence_id"))
    return search.citations(answers).join(first.withColumnRenamed("number", "evidence"), ["answer_id", "evidence"])


def first_symbols(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rows of (analysis_run_id, name) with the first symbol of that name in the run, by line and id."""
    row = F.struct("start_line", "id")
    first = symbols.groupBy("analysis_run_id", "name").agg(F.min(row)["id"].alias("symbol_id"))
    return names.join(first, ["analysis_run_id", "name"], "left")


def nodes(symbols: DataFrame, files: DataFrame, endpoints: DataFrame, modules: DataFrame) -> DataFrame:
    """(node_id, node_type, label): symbols, files, endpoints and external modules as nodes of one graph."""
    text = lambda c: F.col(c).cast("string")
    return (
        symbols.select(text("id").alias("node_id"), F.lit("symbol").alias("node_type"), F.col("name").alias("label"))
        .unionByName(files.select(text("id").alias("node_id"), F.lit("file").alias("node_type"), F.col("path").alias("label")))
        .unionByName(endpoints.select(text("id").alias("node_id"), F.lit("endpoint").alias("node_type"), F.concat_ws(" ", "method", "route").alias("label")))
        .unionByName(modules.select(F.lit("external").alias("node_id"), F.lit("external_module").alias("node_type"), F.col("source").alias("label")))
        .distinct()
    )


def file_preview(files: DataFrame, by: list[str], most: int = 100) -> DataFrame:
    """The first files of each group, those of a known language before the others, with the number of all."""
    n = files.groupBy(*by).agg(F.count(F.lit(1)).alias("n_files"))
    return top_of(files, by, most, F.col("language").isNull(), F.col("path"), F.col("id")).join(n, by).withColumn("is_cut", F.col("n_files") > most)


def context(chunks: DataFrame, query: str, vector: list[float], items: int = 20, chars: int = 15000, each: int = 2000) -> DataFrame:
    """(position, chunk_id, content, final_score, source): the evidence of a question within its budget, best first.

    The texts are joined to the found ids only, at most twice ``items`` of them.
    """
    found = search.hybrid(chunks, query, vector, items)
    texts = chunks.select("chunk_id", "content").join(F.broadcast(found.select("chunk_id")), "chunk_id", "left_semi")
    kept = search.within_budget(found.join(texts, "chunk_id"), items, chars, each)
    return kept.select("chunk_id", "content", "final_score", "source")


def evidence_prompt(evidence: DataFrame, by: list[str], title: Column, *order: Column, most: int = 10, each: int = 200) -> DataFrame:
    """(by, prompt): the first pieces of evidence of each group as numbered sections, each cut; ``evidence`` has content."""
    first = top_of(evidence.withColumn("title", title), by, most, *order)
    cut = X.truncated(F.col("content"), each, "...")
    numbered = first.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col("title"), cut.alias("content")))).alias("rows"))
    sections = F.transform("rows", lambda r, i: F.concat(F.lit("[Evidence "), (i + 1).cast("string"), F.lit("] "), r["title"], F.lit("\n"), r["content"]))
    return numbered.select(*by, F.array_join(sections, "\n\n").alias("prompt"))


def safe_message(message: Column) -> Column:
    """A message that may be shown: the paths of a machine replaced, the first line only, at most 200 characters."""
    line = F.substring_index(message, "\n", 1)
    return F.left(F.regexp_replace(line, r"(/[A-Za-z0-9_.-]+){2,}", "<path>"), F.lit(200))


def embedding_input(content: Column, limit: int = 2000) -> Column:
    """The text a vector is made of: its head of at most ``limit`` characters (the model's window), null if it is blank."""
    return F.when(F.trim(content) != "", F.left(content, F.lit(limit)))


def stage_seconds(runs: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_runs, seconds): finished runs and the seconds they took."""
    took = (F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    return runs.where("started_at is not null and completed_at is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("n_runs"), F.round(F.sum(took), 2).alias("seconds"))
