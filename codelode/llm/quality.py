"""Per-document text quality statistics and exact rank outlier scores.

Each document gets its statistics in one pass.  For every statistic and
language the distinct values with their counts are range partitioned and
sorted; running counts within a partition plus the offsets of the partitions
before it give exact ranks among the distinct texts of the language, so a text
that a third of all documents share counts once and no group is collected.
The ranks give empirical tail probabilities, blended with those of a fixed
reference population, so that a handful of documents, or a corpus of lists
only, is judged too.  Their negative logarithms, in the direction that speaks
against prose, add up with weights to an outlier score;
``not_prose`` takes the documents whose score is above zero.  Weights and cut
are those of WEIGHTS, moved towards the readers' labels where there are some,
at most LABELS of them: the ranks stand for what the corpus holds, the labels
for where in it prose ends.

Defined results
* Null, empty and blank texts have zero words and null shares, no score, and
  are no cases.
* A language is the first two letters of ``lang`` in lower case; anything else
  than two ASCII letters counts as ``und``, and so, for the ranks, do languages
  with fewer than LEAST_TEXTS distinct texts.  Languages without a word list
  have no common words, which then speak neither for nor against a document of
  a language with ranks of its own.
* Equal values share the rank of the last of them (left tail) or the first
  (right tail).
* Repeated rows of a document give one row in the results.  Rows without
  ``doc_id`` are ignored; extra columns are too.  An empty table gives empty
  results.  Labels that are null or contradict each other teach nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.staging import spread, stage

#: Common words of the four languages of the corpus.
COMMON = {
    "en": "the a an of to in on is are be for it that this with as and or not so when if by from at you we can has have had was were "
    "should must do does but even though before after since until because which what there here only than no nobody same other its "
    "our your they them their will would could i my me he she who how all any some more most one into out over under up down about then".split(),
    "de": "der die das den dem des ein eine einer einem einen und oder nicht ist sind es auf in zu von mit für sich wird werden wenn dass ohne "
    "bis im am beim als auch nur aber man da damit obwohl seit nach vor hier ich wir sie er so noch an aus bei durch diese dieser dieses kein "
    "keine was war hat haben davon dazu deshalb sonst trotzdem solange danach etwas nichts niemand jemand".split(),
    "fr": "le la les l de du des d un une et ou ne pas n est sont que qu qui à au aux en dans pour par sur ce cette ces se s il elle on nous "
    "vous je j avec sans si mais plus même tant jusqu quand parce comme y a ont été être ici depuis très aussi rien personne quelqu".split(),
    "es": "el la los las un una de del y o no es son que a al en por para con sin se lo le su si pero más cuando mientras porque hasta como ya "
    "va da he ha este esta ese esa eso esto nada nadie alguien solo aunque antes después aquí donde mi yo qué muy también vez".split(),
}
_ALL_COMMON = frozenset(w for words in COMMON.values() for w in words)
#: Marks of quotes, comments and headings at the start of a line; what follows them is read as the line.
_PREFIX = re.compile(r"^\s*(?:>+|\*+|//+|#+|/\*+|--|;+|%+|\"\"\"|'''|<!--)*\s*")
_CODE = re.compile(
    r"[;{}\[\]]$|^[\])}]|^(?:import|from|def|class|return|export|const|let|var|function|async|try|except|finally|while|elif|else|private|public|@\w)\b.*[:;({'\"\w]$"
    r"|^\w+(?:\.\w+)* ?[-+*]?= ?\S|^\w+(?:\.\w+)*\(.*\)?:?$"
)
_EDGE = ".,;:!?…\"'`()[]«»“”‘’¿¡*_"
_SYMBOL = re.compile(r"[^\w\s]|_")
_STOPS = (".", "!", "?", "…", ":", ";", '."', "。")

#: A paragraph reads as sentences with at least so many words, such a share of common ones, and at most such a share of code lines.
LEAST_WORDS, COMMON_IN_PROSE, CODE_IN_PROSE = 4, 0.2, 0.34
#: A text with more lines of code than this has no prose.
MOSTLY_CODE = 0.5
STATS = ("n_words", "mean_word_length", "symbol_share", "stop_line_share", "common_share", "prose_share", "code_line_share")
#: The tail that speaks against prose.
TAILS = {"mean_word_length": "both", "symbol_share": "right", "stop_line_share": "left", "common_share": "left", "prose_share": "left", "code_line_share": "right"}
#: Quantiles of the reference population, at (i + 0.5) / 20: documents of repositories in four languages.
REFERENCE = {
    "mean_word_length": [2.69, 4.10, 4.23, 4.29, 4.34, 4.38, 4.41, 4.44, 4.47, 4.52, 4.58, 4.66, 4.79, 5.11, 5.44, 5.83, 6.47, 7.45, 9.33, 21.33],
    "symbol_share": [0.0, 0.016, 0.019, 0.021, 0.023, 0.024, 0.025, 0.027, 0.029, 0.032, 0.035, 0.042, 0.051, 0.062, 0.116, 0.145, 0.168, 0.184, 0.25, 0.43],
    "stop_line_share": [0.0] * 5 + [0.056, 0.167, 0.235, 0.3, 0.395, 0.5, 0.667, 0.833] + [1.0] * 7,
    "common_share": [0.0, 0.0, 0.0, 0.0, 0.012, 0.078, 0.146, 0.417, 0.443, 0.455, 0.465, 0.472, 0.479, 0.486, 0.496, 0.51, 0.526, 0.542, 0.564, 0.595],
    "prose_share": [0.0] * 7 + [0.965, 0.993] + [1.0] * 11,
    "code_line_share": [0.0] * 18 + [0.438, 0.917],
}
#: Texts the reference population stands for: so many, and so many for each of the corpus.
REFERENCE_TEXTS, REFERENCE_SHARE = 1_000, 2.0
#: Weights of the tails, in that order, and what their sum has to exceed, fitted on some hundred labels; labels weigh one each against them.
WEIGHTS, CUT = (0.48, 1.22, 2.42, 8.58, 3.46, 1.15), 16.28
#: Bound of the sample of labels the weights are fitted on, those with the least hashes.
LABELS = 50_000
#: A language with fewer distinct texts has no ranks of its own.
LEAST_TEXTS = 50


def measure(text: str) -> tuple[float, ...]:
    """The STATS of a text that is not blank."""
    words = chars = common = prose = code = n_lines = stops = total = 0
    block_tokens: list[str] = []
    block_lines = block_code = 0

    def close() -> tuple[int, int, int]:
        size = sum(map(len, block_tokens))
        hits = 0
        for w in block_tokens:
            w = w.strip(_EDGE).lower()
            if w in _ALL_COMMON or "'" in w and w.split("'", 1)[0] in _ALL_COMMON or "’" in w and w.split("’", 1)[0] in _ALL_COMMON:
                hits += 1
        n = len(block_tokens)
        reads = n >= LEAST_WORDS and hits >= COMMON_IN_PROSE * n and block_code <= CODE_IN_PROSE * block_lines
        return size, hits, size if reads else 0

    for line in text.splitlines():
        rest = _PREFIX.sub("", line).strip()
        if rest.endswith("*/"):
            rest = rest[:-2].rstrip()
        if not rest:
            if block_lines:
                size, hits, good = close()
                total, common, prose, words = total + size, common + hits, prose + good, words + len(block_tokens)
                block_tokens, block_lines, block_code = [], 0, 0
            continue
        n_lines += 1
        block_lines += 1
        if rest.endswith(_STOPS):
            stops += 1
        if _CODE.search(line.strip()):
            code += 1
            block_code += 1
        block_tokens += rest.split()
    if block_lines:
        size, hits, good = close()
        total, common, prose, words = total + size, common + hits, prose + good, words + len(block_tokens)
    chars = len(text) - text.count(" ") - text.count("\n")
    if n_lines and code > MOSTLY_CODE * n_lines:
        prose = 0
    symbols = len(_SYMBOL.findall(text)) if chars else 0
    share = lambda a, b: round(a / b, 4) if b else 0.0
    return (
        float(words), share(total, words), share(symbols, chars), share(stops, n_lines),
        share(common, words), share(prose, total), share(code, n_lines),
    )


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(t) if t is not None and not t.isspace() and t else None for t in batch.column("text").to_pylist()]
        empty = (0.0,) + (None,) * (len(STATS) - 1)
        cols = list(zip(*(r or empty for r in rows))) or [()] * len(STATS)
        yield pa.record_batch(
            [*(batch.column(c) for c in ("doc_id", "lang", "text_id")), *(pa.array(c, pa.float64()) for c in cols)],
            names=["doc_id", "lang", "text_id", *STATS],
        )


def statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, text_id, the STATS) of each document; equal texts have one ``text_id``."""
    lang = F.lower(F.substring(F.trim("lang"), 1, 2))
    rows = documents.select("doc_id", F.when(lang.rlike("^[a-z]{2}$"), lang).otherwise("und").alias("lang"), F.xxhash64("text").alias("text_id"), "text").where("doc_id is not null")
    schema = "doc_id long, lang string, text_id long, " + ", ".join(f"{s} double" for s in STATS)
    return spread(rows, "doc_id").mapInArrow(_measure_batches, schema)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running counts of sorted (lang, stat, value, n), from zero in each partition and group."""
    last, total = None, 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        if not len(n):
            continue
        key = list(zip(batch.column("lang").to_pylist(), batch.column("stat").to_pylist()))
        out = np.empty(len(n), np.int64)
        start = 0
        while start < len(n):
            end = start
            while end < len(n) and key[end] == key[start]:
                end += 1
            base = total if key[start] == last else 0
            out[start:end] = base + np.cumsum(n[start:end])
            last, total = key[start], int(out[end - 1])
            start = end
        yield pa.record_batch([*batch.columns, pa.array(out)], names=[*batch.schema.names, "upto"])


def tails(melted: DataFrame) -> DataFrame:
    """(lang, stat, value, left, right, total): exact numbers of rows no greater and no less than the value, and of all."""
    counted = melted.groupBy("lang", "stat", "value").agg(F.count(F.lit(1)).alias("n"))
    schema = "lang string, stat string, value double, n long, part int, upto long"
    placed = stage(
        counted.repartitionByRange("lang", "stat", "value")
        .sortWithinPartitions("lang", "stat", "value")
        .withColumn("part", F.spark_partition_id())
        .mapInArrow(_running, schema)
    ).df
    # one row for each partition and group
    sums = placed.groupBy("lang", "stat", "part").agg(F.sum("n").alias("sum"))
    group = Window.partitionBy("lang", "stat")
    offsets = sums.select(
        "lang", "stat", "part",
        (F.sum("sum").over(group.orderBy("part")) - F.col("sum")).alias("offset"),
        F.sum("sum").over(group).alias("total"),
    )
    upto = F.col("offset") + F.col("upto")
    return placed.join(offsets, ["lang", "stat", "part"]).select(
        "lang", "stat", "value", upto.alias("left"), (F.col("total") - upto + F.col("n")).alias("right"), "total"
    )


def _terms(stats: DataFrame) -> DataFrame:
    """The statistics with a column ``t_`` of each tail: minus the logarithm of its probability."""
    texts = stage(stats.where("prose_share is not null").select("lang", "text_id", *TAILS).distinct()).df
    # two letters: at most 676 languages
    own = [r[0] for r in texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_TEXTS).collect()]
    group = F.when(F.col("lang").isin(own), F.col("lang")).otherwise("und") if own else F.lit("und")
    parts = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in TAILS])
    melted = texts.select(group.alias("lang"), F.explode(parts).alias("x")).select("lang", "x.*")
    # one row a distinct value, in four digits
    table = stage(tails(melted)).df
    out = stats.withColumn("ranked", group)
    n = F.col("total")
    m = REFERENCE_TEXTS + REFERENCE_SHARE * n
    for s, tail in TAILS.items():
        points = F.array(*[F.lit(x) for x in REFERENCE[s]])
        beside = lambda f: F.size(F.filter(points, f)) / F.lit(len(REFERENCE[s]))  # noqa: B023, E731
        left = (F.col("left") + m * beside(lambda x: x <= F.col("value"))) / (n + m)
        right = (F.col("right") + m * beside(lambda x: x >= F.col("value"))) / (n + m)
        p = {"left": left, "right": right, "both": F.least(F.lit(1.0), 2 * F.least(left, right))}[tail]
        side = table.where(F.col("stat") == s).select(F.col("lang").alias("ranked"), F.col("value").alias(s), (-F.log(p)).alias(f"t_{s}"))
        out = out.join(side, ["ranked", s], "left")
    return out.drop("ranked")


def fitted(terms: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights and minus the cut: logistic regression that starts from, and is held by, those of this module."""
    start = np.array([*WEIGHTS, -CUT])
    w, z = start.copy(), np.c_[terms, np.ones(len(terms))]
    loss = lambda w: np.logaddexp(0, np.where(labels > 0.5, -1, 1) * (z @ w)).sum() + ((w - start) ** 2).sum() / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(len(w)), z.T @ (p - labels) + w - start)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-8:
            step = step / 2
        w = w - step
        if np.abs(step).max() <= 1e-8:
            break
    return w


def weights(stats: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights and minus the cut from a bounded sample of (doc_id, kind)."""
    said = (
        labels.where("doc_id is not null and kind is not null")
        .groupBy("doc_id").agg(F.avg((F.col("kind") != "prose").cast("double")).alias("case"))
        .where("case in (0.0, 1.0)").orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELS)
    )
    names = [f"t_{s}" for s in TAILS]
    rows = stats.where("prose_share is not null").join(F.broadcast(said), "doc_id").groupBy("doc_id").agg(F.max("case"), *[F.max(n) for n in names]).orderBy("doc_id").collect()
    table = np.array([r[1:] for r in rows], float).reshape(-1, len(names) + 1)
    return fitted(table[:, 1:], table[:, 0])


def scored(documents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, lang, the STATS, score) of each document; a score above zero speaks against prose."""
    terms = _terms(stage(statistics(documents)).df)
    w = [*WEIGHTS, -CUT] if labels is None else weights(terms, labels).tolist()
    score = F.lit(w[-1])
    for s, x in zip(TAILS, w):
        score = score + F.lit(x) * F.col(f"t_{s}")
    return terms.select("doc_id", "lang", *STATS, F.round(score, 6).alias("score")).distinct()


def not_prose(documents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id) of the documents that are not mainly running prose."""
    return scored(documents, labels).where("score > 0").select("doc_id").distinct()
