"""Evaluation texts that occur in a corpus.

The test items form a BM25 inverted index, broadcast to the workers (their
number does not grow with the corpus; a size check guards it, and beyond it
the index is split into parts that are searched one after another).  Every
document is read in overlapping passages; each passage is a query, answered
by block-max WAND: documents of the index are visited in order, whole blocks
whose summed maxima stay below the threshold are passed over.  A threshold of
each item, the least weight that any of its runs of RUN words has, makes the
retrieval lossless: a passage that contains such a run reaches it.  A passage
without RUN consecutive words of the index is a block of weight zero.  What is
retrieved is verified word by word.

Defined results
* A word is a run of letters and digits after compatibility decomposition,
  without combining marks and format characters, in folded case; ``_``
  separates words.
* A document and an item match if they share RUN consecutive words.  Items of
  fewer words, null and empty texts match nothing.
* Items with equal texts match alike; repeated rows count once.  Extra columns
  are ignored; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.staging import spread

RUN = 12
#: Words of a passage, and how far the next one begins: every run of RUN words lies in one.
PASSAGE, STEP = 48, 48 - RUN + 1
K1, B = 1.2, 0.75
#: Items in a block of a posting list.
BLOCK = 16
#: Most words of the items in one broadcast part of the index, about 100 MB of postings.
PART_WORDS = 2_000_000

_WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")


class _Dropped(dict):
    """Translation that deletes combining marks and format characters."""

    def __missing__(self, code: int) -> int | None:
        kept = None if unicodedata.category(chr(code)) in ("Mn", "Mc", "Me", "Cf") else code
        self[code] = kept
        return kept


_DROPPED = _Dropped()


def words(text: str) -> list[str]:
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    plain = unicodedata.normalize("NFKD", text).translate(_DROPPED).casefold()
    return _WORD.findall(unicodedata.normalize("NFKD", plain).translate(_DROPPED))


@dataclass
class Postings:
    """Items of a term in order with their weights, and the largest weight of each block."""

    items: list[int] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    block_last: list[int] = field(default_factory=list)
    block_max: list[float] = field(default_factory=list)

    def close(self) -> None:
        for at in range(0, len(self.items), BLOCK):
            self.block_last.append(self.items[min(at + BLOCK, len(self.items)) - 1])
            self.block_max.append(max(self.weights[at : at + BLOCK]))


class Index:
    """BM25 postings of the items, scaled so that every item's own threshold is one."""

    def __init__(self, texts: list[tuple[int, str]]):
        split = [(i, words(t)) for i, t in texts]
        split = [(i, w) for i, w in split if len(w) >= RUN]
        self.ids = [i for i, _ in split]
        self.vocabulary: dict[str, int] = {}
        coded = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for _, ws in split]
        n, mean = len(coded), sum(map(len, coded)) / max(1, len(coded))
        in_items = np.zeros(len(self.vocabulary))
        for c in coded:
            in_items[np.unique(c)] += 1
        idf = np.log(1 + (n - in_items + 0.5) / (in_items + 0.5))
        self.postings: dict[int, Postings] = {}
        self.runs: list[set[bytes]] = []
        for item, c in enumerate(coded):
            terms, tf = np.unique(c, return_counts=True)
            weight = dict(zip(terms.tolist(), (idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(c) / mean))).tolist()))
            least = min(sum(weight[t] for t in set(c[j : j + RUN].tolist())) for j in range(len(c) - RUN + 1))
            for t, w in weight.items():
                p = self.postings.setdefault(t, Postings())
                p.items.append(item)
                p.weights.append(w / least)
            self.runs.append({c[j : j + RUN].astype(np.int32).tobytes() for j in range(len(c) - RUN + 1)})
        for p in self.postings.values():
            p.close()

    def search(self, terms: list[int], threshold: float = 1 - 1e-9) -> list[int]:
        """All items whose score for the distinct terms reaches the threshold, by block-max WAND."""
        cursors = [[self.postings[t], 0, 0] for t in terms]  # postings, place, block
        top = [max(c[0].block_max) for c in cursors]
        order = list(range(len(cursors)))
        at = [c[0].items[0] for c in cursors]
        end = math.inf
        found = []

        def seek(k: int, item: int) -> None:
            p, i, b = cursors[k]
            while b < len(p.block_last) and p.block_last[b] < item:
                b += 1
            if b == len(p.block_last):
                at[k] = end
                return
            i = max(i, b * BLOCK)
            items = p.items
            while items[i] < item:
                i += 1
            cursors[k][1], cursors[k][2] = i, b
            at[k] = items[i]

        while True:
            order.sort(key=at.__getitem__)
            total, pivot = 0.0, -1
            for n, k in enumerate(order):
                if at[k] == end:
                    break
                total += top[k]
                if total >= threshold:
                    pivot = n
                    break
            if pivot < 0:
                return found
            item = at[order[pivot]]
            while pivot + 1 < len(order) and at[order[pivot + 1]] == item:
                pivot += 1
            # the blocks that hold the item: their maxima bound every item up to the nearest end of one
            bound, until = 0.0, math.inf
            for k in order[: pivot + 1]:
                p, _, b = cursors[k]
                while b < len(p.block_last) and p.block_last[b] < item:
                    b += 1
                if b < len(p.block_last):
                    bound += p.block_max[b]
                    until = min(until, p.block_last[b])
            if bound < threshold:
                after = until + 1
                if pivot + 1 < len(order):
                    after = min(after, at[order[pivot + 1]])
                for k in order[: pivot + 1]:
                    if at[k] < after:
                        seek(k, after)
                continue
            if at[order[0]] == item:
                score = sum(cursors[k][0].weights[cursors[k][1]] for k in order[: pivot + 1])
                if score >= threshold:
                    found.append(item)
                for k in order[: pivot + 1]:
                    seek(k, item + 1)
            else:
                for k in order[:pivot]:
                    if at[k] < item:
                        seek(k, item)

    def leaked(self, text: str) -> set[int]:
        """Places of the items that share a run of words with the text."""
        get = self.vocabulary.get
        ws = words(text)
        if len(ws) < RUN:
            return set()
        codes = np.fromiter((get(w, -1) for w in ws), np.int32, len(ws))
        # stretches of words of the index; shorter ones are passages of weight zero
        gaps = np.flatnonzero(codes < 0)
        edges = np.concatenate(([-1], gaps, [len(codes)]))
        found: set[int] = set()
        for k in np.flatnonzero(np.diff(edges) > RUN):
            start, stop = int(edges[k]) + 1, int(edges[k + 1])
            for i in range(start, max(start + 1, stop - RUN + 1), STEP):
                passage = codes[i : min(i + PASSAGE, stop)]
                if len(passage) < RUN:
                    continue
                hits = [h for h in self.search(list(dict.fromkeys(passage.tolist()))) if h not in found]
                if hits:
                    runs = [passage[j : j + RUN].tobytes() for j in range(len(passage) - RUN + 1)]
                    found.update(h for h in hits if not self.runs[h].isdisjoint(runs))
        return found


def _parts(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in parts of bounded size, read one after another."""
    part, size = [], 0
    for row in items.select("item_id", "text").where("item_id is not null and text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        n = len(row[1].split()) + 1
        if part and size + n > PART_WORDS:
            yield part
            part, size = [], 0
        part.append((row[0], row[1]))
        size += n
    if part:
        yield part


_built: tuple[str, Index] | None = None


def _index(key: str, shared) -> Index:
    """The index of the items under this key, made once for each worker process and not for each task."""
    global _built
    if _built is None or _built[0] != key:
        _built = (key, Index(shared.value))
    return _built[1]


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (doc_id, item_id) that share RUN consecutive words."""
    spark = documents.sparkSession
    texts = spread(documents.select("doc_id", "text").where("doc_id is not null and text is not null"), "doc_id")
    found = None
    for part in _parts(items):
        shared = spark.sparkContext.broadcast(part)

        def batches(rows: Iterator[pa.RecordBatch], shared=shared, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = _index(key, shared)
            for batch in rows:
                docs, hits = [], []
                for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    for h in index.leaked(t):
                        docs.append(d)
                        hits.append(index.ids[h])
                yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(hits, pa.int64())], names=["doc_id", "item_id"])

        one = texts.mapInArrow(batches, "doc_id long, item_id long")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return texts.select("doc_id", F.lit(0).cast("long").alias("item_id")).where(F.lit(False))
    return found.distinct()


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, n_documents): in how many documents each leaked item occurs."""
    return leaks(documents, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))
