"""Token ids of a public byte-level BPE vocabulary.

Texts are cut by the vocabulary's pattern; each distinct piece is merged once
per worker with a segment tree over the ranks of adjacent pairs: its root is
the leftmost pair of lowest rank, and a merge changes three leaves, each in
logarithmic time, so a piece of n bytes costs n log n however long it is.

Defined results
* One row of ids for each row of input; null and empty texts give an empty
  list.  Blank texts are texts.  Strings of special tokens are ordinary text.
* Repeated rows stay rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.staging import spread

#: Place of the rank file; the folder's description names it.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = 1 << 30
#: Pieces that a worker remembers; beyond, it starts anew.
REMEMBERED = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PairTree:
    """A segment tree of minima over the ranks of adjacent pairs."""

    def __init__(self, leaves: list[int]):
        self.size = size = 1 << max(0, len(leaves) - 1).bit_length()
        self.t = t = [NONE] * size + leaves + [NONE] * (size - len(leaves))
        for i in range(size - 1, 0, -1):
            a, b = t[2 * i], t[2 * i + 1]
            t[i] = a if a <= b else b

    def set(self, i: int, rank: int) -> None:
        t = self.t
        i += self.size
        t[i] = rank
        i >>= 1
        while i:
            a, b = t[2 * i], t[2 * i + 1]
            low = a if a <= b else b
            if t[i] == low:
                return
            t[i] = low
            i >>= 1

    def leftmost(self) -> int:
        """Place of the leftmost minimum, or -1 if no pair can be merged."""
        t, i = self.t, 1
        low = t[1]
        if low == NONE:
            return -1
        while i < self.size:
            i *= 2
            if t[i] != low:
                i += 1
        return i - self.size


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    start = list(range(n + 1))  # start[i]: first byte of the part that begins at leaf i
    after = list(range(1, n + 1)) + [n]  # the part after the one at i
    before = list(range(-1, n))
    rank = lambda i: ranks.get(piece[i : after[after[i]]], NONE) if after[i] < n else NONE
    tree = PairTree([rank(i) for i in range(n)])
    while (i := tree.leftmost()) >= 0:
        gone = after[i]
        after[i] = after[gone]
        before[after[gone]] = i
        tree.set(gone, NONE)
        tree.set(i, rank(i))
        if before[i] >= 0:
            tree.set(before[i], rank(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[start[i] : after[i]]])
        i = after[i]
    return out


def encoder(ranks: dict[bytes, int]) -> Callable[[str | None], list[int]]:
    import regex

    split = regex.compile(PATTERN).findall

    class Known(dict):
        def __missing__(self, piece: str) -> list[int]:
            if len(self) >= REMEMBERED:
                self.clear()
            ids = self[piece] = merge(piece.encode(), ranks)
            return ids

    known = Known()
    return lambda text: list(chain.from_iterable(map(known.__getitem__, split(text)))) if text else []


_made: tuple[str, Callable[[str | None], list[int]]] | None = None


def _encoder(key: str, shared) -> Callable[[str | None], list[int]]:
    """The encoder under this key; a worker process makes it once and keeps the pieces it has met from task to task."""
    global _made
    if _made is None or _made[0] != key:
        _made = (key, encoder(shared.value))
    return _made[1]


def token_ids(documents: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """(doc_id, ids) of each row; the rank table has one row for each token of the vocabulary and is broadcast."""
    shared = documents.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    key = uuid.uuid4().hex

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(key, shared)
        for batch in parts:
            ids = [encode(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return spread(documents.select("doc_id", "text"), "doc_id").mapInArrow(batches, "doc_id long, ids array<int>")
