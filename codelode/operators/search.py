"""Semantic, keyword and hybrid search over text chunks, chunking and evidence budgets."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions import text as X
from codelode.operators.ordering import first_of, min_max, running_budget

MOST = 100


def semantic(chunks: DataFrame, query: list[float], top_k: int = 10, where: Column | None = None) -> DataFrame:
    """(chunk_id, semantic_score) of the chunks most similar to a vector; filters run below the scoring."""
    kept = chunks.where("embedding is not null") if where is None else chunks.where("embedding is not null").where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    score = X.vector_cosine(F.col("embedding").cast("array<double>"), q)
    return kept.select("chunk_id", F.round(score, 6).alias("semantic_score")).where("semantic_score is not null").orderBy(F.desc("semantic_score"), "chunk_id").limit(min(top_k, MOST))


def query_terms(query: str) -> tuple[list[list[str]], list[str], list[str]]:
    """Required words with their alternatives (``a or b``), required phrases and excluded words of a web-style query."""
    phrases = [p.lower() for p in re.findall(r'"([^"]+)"', query)]
    rest = re.sub(r'"[^"]+"', " ", query).lower()
    out = [w for w in re.findall(r"(?:^|\s)-([a-z0-9]+)", rest)]
    rest = re.sub(r"(?:^|\s)-[a-z0-9]+", " ", rest)
    need: list[list[str]] = []
    words = re.findall(r"[a-z0-9]+", rest)
    i = 0
    while i < len(words):
        if words[i] == "or" and need and i + 1 < len(words):
            need[-1].append(words[i + 1])
            i += 2
        else:
            need.append([words[i]])
            i += 1
    return need, phrases, out


def word_stem(word: str) -> str:
    """A word without the common endings of its forms."""
    for ending in ("ing", "ies", "ied", "es", "ed", "e", "y", "s"):
        if word.endswith(ending) and len(word) - len(ending) >= 3:
            return word[: -len(ending)]
    return word


def keyword(chunks: DataFrame, query: str, top_k: int = 10, where: Column | None = None, forms: bool = False) -> DataFrame:
    """(chunk_id, keyword_score): chunks with all words and phrases and none of the excluded words.

    The rank is the sum over words, alternatives and phrases of tf / (tf + 1),
    over 1 + ln(words of the chunk); words are runs of letters and digits in
    lower case.  With ``forms`` a word stands for its common forms as well.  A
    query without words and phrases finds nothing.
    """
    need, phrases, out = query_terms(query)
    kept = chunks if where is None else chunks.where(where)
    low = F.lower("content")
    part = (lambda w: word_stem(w)) if forms else (lambda w: w)
    shape = (lambda w: rf"{word_stem(w)}(?:ing|ies|ied|y|es|ed|e|s)?") if forms else (lambda w: w)
    any_part = lambda ws: reduce(lambda a, b: a | b, [low.contains(part(w)) for w in ws])
    # cheap, so texts without the words are never counted
    for p in phrases:
        kept = kept.where(low.contains(p))
    for words in need:
        kept = kept.where(any_part(words))
    times = lambda w: F.regexp_count(low, F.lit(rf"(?<![a-z0-9]){shape(w)}(?![a-z0-9])")).cast("double")
    said = lambda p: ((F.length(low) - F.length(F.replace(low, F.lit(p), F.lit("")))) / F.lit(float(len(p)))).cast("double")
    for w in out:
        kept = kept.where(~low.contains(part(w)) | (times(w) == 0))
    n_words = F.regexp_count(low, F.lit("[a-z0-9]+")).cast("double")
    groups = [F.array(*[times(w) for w in words]) for words in need] + [F.array(said(p)) for p in phrases]
    if not groups:
        groups = [F.array(F.lit(0.0))]
    counts = kept.select("chunk_id", F.array(*groups).alias("tf"), n_words.alias("n"))
    total = F.aggregate(F.flatten("tf"), F.lit(0.0), lambda acc, x: acc + x / (x + 1))
    score = F.round(total / (1 + F.ln(F.greatest("n", F.lit(1.0)))), 6)
    # one of the alternatives of each word
    full = F.forall("tf", lambda g: F.exists(g, lambda x: x > 0))
    found = counts.where(full).select("chunk_id", score.alias("keyword_score"))
    return found.where("keyword_score > 0").orderBy(F.desc("keyword_score"), "chunk_id").limit(min(top_k, MOST))


def weights(semantic_weight: float, keyword_weight: float) -> tuple[float, float]:
    if not (0 <= semantic_weight <= 1 and 0 <= keyword_weight <= 1) or semantic_weight + keyword_weight == 0:
        raise ValueError("weights lie between 0 and 1 and are not both 0")
    total = semantic_weight + keyword_weight
    return (semantic_weight / total, keyword_weight / total) if abs(total - 1) > 0.01 else (semantic_weight, keyword_weight)


def fuse(sem: DataFrame, key: DataFrame, semantic_weight: float = 0.5, keyword_weight: float = 0.5) -> DataFrame:
    """Full outer join of two result lists of at most MOST rows each; keyword scores scaled to [0, 1]."""
    ws, wk = weights(semantic_weight, keyword_weight)
    scaled = key.select("chunk_id", min_max(F.col("keyword_score")).alias("keyword_score"), F.lit(True).alias("k"))
    both = sem.withColumn("s", F.lit(True)).join(scaled, "chunk_id", "full_outer")
    s, k = F.coalesce("semantic_score", F.lit(0.0)), F.coalesce("keyword_score", F.lit(0.0))
    source = F.when(F.col("s") & F.col("k"), "hybrid").when(F.col("s"), "semantic").otherwise("keyword")
    return both.select("chunk_id", "semantic_score", "keyword_score", F.round(ws * s + wk * k, 6).alias("final_score"), source.alias("source"))


def hybrid(chunks: DataFrame, query: str, vector: list[float], top_k: int = 10, semantic_weight: float = 0.5, keyword_weight: float = 0.5) -> DataFrame:
    wide = min(2 * top_k, MOST)
    fused = fuse(semantic(chunks, vector, wide), keyword(chunks, query, wide), semantic_weight, keyword_weight)
    return fused.orderBy(F.desc("final_score"), F.desc("chunk_id")).limit(top_k)


def split_chunks(texts: DataFrame, limit: int = 2000) -> DataFrame:
    """(chunk_id, chunk_index, content, content_hash, token_count) of each text."""
    parts = texts.where("content is not null").select("chunk_id", F.posexplode(X.chunks(F.col("content"), limit)).alias("chunk_index", "content"))
    return parts.select("chunk_id", "chunk_index", "content", F.sha2("content", 256).alias("content_hash"), X.token_estimate(F.col("content")).alias("token_count"))


def symbol_chunks(symbols: DataFrame, files: DataFrame, limit: int = 2000) -> DataFrame:
    """Chunks of the lines of each symbol; ``files`` has file_id and content."""
    lined = symbols.join(files.select("file_id", F.col("content").alias("whole")), "file_id")
    texts = lined.select(F.col("id").alias("chunk_id"), X.line_range(F.col("whole"), F.col("start_line"), F.col("end_line")).alias("content"))
    return split_chunks(texts, limit)


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """The first chunk of each content, by id: a partial aggregate over content hashes."""
    return chunks.where("content is not null").groupBy(F.sha2("content", 256).alias("content_hash")).agg(F.min("chunk_id").alias("chunk_id"), F.count(F.lit(1)).alias("copies"))


def within_budget(evidence: DataFrame, items: int = 20, chars: int = 15000, each: int = 2000) -> DataFrame:
    """Best evidence whose cut texts fit the budget; ``evidence`` is a result list of at most MOST rows."""
    best = evidence.orderBy(F.desc("final_score"), F.desc("chunk_id")).limit(items)
    cut = best.withColumn("content", X.truncated(F.col("content"), each, "\n... [truncated]"))
    return running_budget(cut, F.length("content"), chars, [], F.desc("final_score"), F.desc("chunk_id"))


def containing(texts: DataFrame, items: DataFrame, most: int = 5_000) -> DataFrame:
    """Rows of ``texts`` (with ``text``) beside those of ``items`` (with ``part``) that they hold letter by letter.

    The items are a stated query set.  They are counted; up to ``most`` are
    broadcast, more go over the texts block by block, each block broadcast.
    """
    stated = items.where("part is not null").distinct()
    blocks = -(-stated.count() // most) or 1
    block = F.pmod(F.xxhash64("part"), F.lit(blocks))
    found = [texts.join(F.broadcast(stated.where(block == i)), F.contains("text", "part")) for i in range(blocks)]
    return reduce(DataFrame.unionByName, found)


def retrieval_counts(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("semantic_score") > 0).alias("semantic_candidates"), F.count_if(F.col("keyword_score") > 0).alias("keyword_candidates")
    )


def citations(answers: DataFrame) -> DataFrame:
    """(answer_id, position, evidence): cited numbers that exist, in the order first mentioned; answers have n_evidence."""
    cited = answers.select("answer_id", "n_evidence", F.posexplode(X.citation_numbers(F.col("answer"))).alias("position", "evidence"))
    kept = cited.where((F.col("evidence") >= 1) & (F.col("evidence") <= F.col("n_evidence")))
    return kept.select("answer_id", "position", "evidence")


def distinct_evidence(evidence: DataFrame) -> DataFrame:
    keys = ["repository_id", "evidence_type", "file_path", "start_line", "end_line", "symbol_name", "method_path"]
    return first_of(evidence, keys, F.desc("score"), F.col("evidence_id"))
