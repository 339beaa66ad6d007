"""What changed between full snapshots of a table.

Keys get persistent ordinals, dense and in key order within a delivery, so that
the keys of one owner lie next to each other.  They are kept in an
``OrdinalStore``; the next delivery finds the known ones there and numbers the
new ones behind them.  A snapshot is then a set of ordinals, held as compressed
bitmaps of 32 768 ordinals each, plus one vector of row values aligned with the
set bits.  Of two consecutive snapshots, AND-NOT of the bitmaps gives additions
and removals, and the vectors at the common ordinals expose changes.  The
bitmaps of one range of ordinals come to one task in the order of the
snapshots, which holds two of them at a time.

Defined results (``snapshot_changes``)
* Snapshots are the runs with a finished status, a start and a repository,
  ordered by (started_at, id) within the repository; repeated rows of a run
  are one run.  A finished run without symbols is an empty snapshot.
* Paths have ``/`` as their only separator, single, and no leading ``./``;
  names have no white space around them.  Rows without path or name are no
  keys; symbols whose file or run is missing are ignored.
* The value of a key is the set of its (symbol_type, number of lines); nulls
  are values.  Repeated rows, under the same id or another, change nothing.
* Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelode.staging import Staged, stage

FINISHED = ("completed", "completed_with_warnings")
#: Ordinals of one bitmap: 2**15.
BITS = 15
SPAN = 1 << BITS


def clean_path(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[/\\]+", "/"), r"^(\./)+", "")


def clean_name(c: Column) -> Column:
    return F.regexp_replace(c, r"(^[\s ]+)|([\s ]+$)", "")


def new_ordinals(keys: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The distinct ``keys`` that are not ``known``, with bigint ordinals behind the largest known one, in key order.

    The keys are range partitioned and sorted; the partitions' offsets come
    from one count per partition.
    """
    cols = keys.columns
    new, base = keys.distinct(), 0
    if known is not None:
        new = new.join(known, cols, "left_anti")
        highest = known.agg(F.max("ordinal")).first()[0]
        base = 0 if highest is None else highest + 1
    placed = stage(
        new.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("at", F.monotonically_increasing_id())
    )
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = sorted((r[0], r[1]) for r in placed.df.groupBy(part).count().collect())  # a row for each partition
    offsets, total = [], base
    for p, n in counts:
        offsets.append((p, total))
        total += n
    table = keys.sparkSession.createDataFrame(offsets, "part long, first long")
    return (
        placed.df.withColumn("part", part)
        .join(F.broadcast(table), "part")
        .select(*cols, (F.col("first") + row).alias("ordinal"))
    )


def assign_ordinals(keys: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Distinct ``keys`` with a dense bigint ``ordinal``; those of ``known`` (an earlier result) keep theirs."""
    out = new_ordinals(keys, known)
    return out if known is None else known.select(*keys.columns, "ordinal").unionByName(out)


class OrdinalStore:
    """Keys and their ordinals in a shared folder, one part for each delivery that brought new ones.

    A part is written apart and moved into its place; the move fails if another
    delivery has taken the place, and the keys are then numbered again behind it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        return at, at(self.path).getFileSystem(conf), jvm.org.apache.hadoop.fs.FileContext.getFileContext(at(self.path).toUri(), conf), jvm

    def parts(self) -> list[str]:
        at, fs, _, _ = self._fs()
        if not fs.exists(at(self.path)):
            return []
        return sorted(f"{self.path}/{s.getPath().getName()}" for s in fs.listStatus(at(self.path)) if s.getPath().getName().startswith("part-"))

    def known(self, columns: list[str]) -> DataFrame | None:
        parts = self.parts()
        return self.spark.read.parquet(*parts).select(*columns, "ordinal") if parts else None

    def assign(self, keys: DataFrame) -> DataFrame:
        """(key, ordinal) of all keys of the store, which afterwards holds those of ``keys`` too."""
        for _ in range(10):
            n, known = len(self.parts()), self.known(keys.columns)
            fresh = stage(new_ordinals(keys, known), n=F.count(F.lit(1)))
            if not fresh.seen["n"] and known is not None:
                fresh.drop()
                return known
            at, fs, context, jvm = self._fs()
            fs.mkdirs(at(self.path))
            none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            try:
                context.rename(at(fresh.path), at(f"{self.path}/part-{n:06d}"), none)
            except Py4JJavaError:
                fresh.drop()
                continue
            return self.known(keys.columns)
        raise RuntimeError(f"{self.path} is being written by others all the time")


# --- bitmaps -----------------------------------------------------------------------------------


def pack(bits: np.ndarray) -> bytes:
    """The shortest of three forms of a sorted array of ordinals below SPAN: list, runs or bits."""
    if not len(bits):
        return b"L"
    breaks = np.flatnonzero(np.diff(bits) != 1)
    if len(breaks) * 4 + 4 < min(2 * len(bits), SPAN // 8):
        first = bits[np.r_[0, breaks + 1]]
        last = bits[np.r_[breaks, len(bits) - 1]]
        return b"R" + np.stack([first, last], 1).astype("<u2").tobytes()
    if 2 * len(bits) < SPAN // 8:
        return b"L" + bits.astype("<u2").tobytes()
    full = np.zeros(SPAN, bool)
    full[bits] = True
    return b"B" + np.packbits(full).tobytes()


def unpack(blob: bytes | None) -> np.ndarray:
    """The bitmap as 64-bit words."""
    full = np.zeros(SPAN, bool)
    if blob:
        kind, body = blob[:1], blob[1:]
        if kind == b"B":
            return np.frombuffer(body, np.uint64).copy()
        if kind == b"L":
            full[np.frombuffer(body, "<u2")] = True
        else:
            edge = np.zeros(SPAN + 1, np.int32)
            runs = np.frombuffer(body, "<u2").reshape(-1, 2).astype(np.int64)
            edge[runs[:, 0]] += 1
            edge[runs[:, 1] + 1] -= 1
            full = np.cumsum(edge[:-1]) > 0
    return np.packbits(full).view(np.uint64)


def members(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8)))


def differences(before: bytes | None, v0: bytes | None, after: bytes | None, v1: bytes | None) -> tuple[np.ndarray, ...]:
    """Added, removed and changed ordinals of two bitmaps with their aligned value vectors."""
    a, b = unpack(before), unpack(after)
    common = members(a & b)
    old, new = np.frombuffer(v0 or b"", "<i8"), np.frombuffer(v1 or b"", "<i8")
    if len(common):
        # the rank of an ordinal in its bitmap is its place in the vector
        old, new = old[np.searchsorted(members(a), common)], new[np.searchsorted(members(b), common)]
        changed = common[old != new]
    else:
        changed = common
    return members(b & ~a), members(a & ~b), changed


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Changes between the snapshots of each range of ordinals, which come in order; a range without rows is empty."""
    before: tuple | None = None
    empty = (b"L", b"")

    def close(row: tuple) -> Iterator[tuple]:
        # in the snapshot after the last one seen nothing of the range is left
        owner, box, seq, last, *held = row
        if not last:
            yield owner, seq + 1, box, differences(*held, *empty)

    for batch in batches:
        found: list[tuple] = []
        low, val = batch.column("low"), batch.column("val")
        for i, (owner, box, seq, last) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("owner", "box", "seq", "last")))):
            at = np.asarray(low[i].values.to_numpy(zero_copy_only=False))
            order = np.argsort(at)
            held = pack(at[order]), np.asarray(val[i].values.to_numpy(zero_copy_only=False))[order].astype("<i8").tobytes()
            if before is not None and before[:3] == (owner, box, seq - 1):
                found.append((owner, seq, box, differences(*before[4:], *held)))
            else:
                if before is not None:
                    found += close(before)
                if seq > 1:
                    found.append((owner, seq, box, differences(*empty, *held)))
            before = (owner, box, seq, last, *held)
        yield _changes(found)
    if before is not None:
        yield _changes(list(close(before)))


def _changes(found: list[tuple]) -> pa.RecordBatch:
    owner, seq, ordinal, kind = [], [], [], []
    for o, s, box, sets in found:
        for name, at in zip(("added", "removed", "changed"), sets):
            if len(at):
                owner.append(np.full(len(at), o, np.int64))
                seq.append(np.full(len(at), s, np.int32))
                ordinal.append(at.astype(np.int64) + (box << BITS))
                kind += [name] * len(at)
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return pa.record_batch(
        [pa.array(cat(owner, np.int64)), pa.array(cat(seq, np.int32)), pa.array(cat(ordinal, np.int64)), pa.array(kind, pa.string())],
        names=["owner", "seq", "ordinal", "change_kind"],
    )


def compare_snapshots(facts: DataFrame) -> DataFrame:
    """(owner, seq, ordinal, change_kind) from (owner, seq, last, ordinal, val).

    ``seq`` counts the snapshots of an owner from 1; ``last`` marks the rows of
    its last one.  A result row names the later snapshot of the pair.  One
    shuffle by range of ordinals serves the grouping and the order.
    """
    boxes = (
        facts.withColumn("box", F.shiftright("ordinal", BITS))
        .repartition("owner", "box")
        .groupBy("owner", "box", "seq")
        .agg(
            F.max("last").alias("last"),
            F.collect_list(F.col("ordinal").bitwiseAND(SPAN - 1).cast("int")).alias("low"),
            F.collect_list("val").alias("val"),
        )
        .sortWithinPartitions("owner", "box", "seq")
    )
    return boxes.mapInArrow(_walk, "owner long, seq int, ordinal long, change_kind string")


# --- symbols -----------------------------------------------------------------------------------


def numbered_runs(runs: DataFrame) -> Staged:
    """(analysis_run_id, owner, seq, last, repository_id) of the finished runs, numbered in each repository."""
    done = (
        runs.where(F.col("status").isin(*FINISHED))
        .where("id is not null and repository_id is not null and started_at is not null")
        .groupBy(F.col("id").alias("analysis_run_id"))
        .agg(F.min("repository_id").alias("repository_id"), F.min("started_at").alias("started_at"))
    )
    w = Window.partitionBy("repository_id").orderBy("started_at", "analysis_run_id")
    return stage(
        done.select(
            "analysis_run_id", "repository_id",
            F.xxhash64("repository_id").alias("owner"),
            F.row_number().over(w).alias("seq"),
            F.lead("analysis_run_id").over(w).isNull().alias("last"),
        )
    )


def snapshot_changes(symbols: DataFrame, files: DataFrame, runs: DataFrame, store: OrdinalStore | None = None) -> DataFrame:
    """(repository_id, analysis_run_id, path, name, change_kind) of each two consecutive finished runs.

    With a store the keys keep the ordinals that earlier deliveries gave them.
    """
    numbered = numbered_runs(runs).df
    paths = (
        files.select(F.col("id").alias("file_id"), clean_path(F.col("path")).alias("path"))
        .where("file_id is not null and path is not null")
        .groupBy("file_id")
        .agg(F.min("path").alias("path"))
    )
    rows = symbols.select(
        "file_id", "analysis_run_id", clean_name(F.col("name")).alias("name"),
        "symbol_type", (F.col("end_line") - F.col("start_line") + 1).alias("lines"),
    ).where("name is not null")
    keyed = (
        rows.join(numbered.select("analysis_run_id", "repository_id", "owner", "seq", "last"), "analysis_run_id")
        .drop("analysis_run_id")
        .join(paths, "file_id")
        .groupBy("repository_id", "path", "name", "owner", "seq", "last")
        .agg(F.array_sort(F.collect_set(F.struct("symbol_type", "lines"))).alias("state"))
        .withColumn("val", F.xxhash64(F.to_json("state")))
        .drop("state")
    )
    facts = stage(keyed)
    names = facts.df.select("repository_id", "path", "name")
    keys = assign_ordinals(names) if store is None else store.assign(names)
    found = compare_snapshots(facts.df.join(keys, ["repository_id", "path", "name"]))
    later = numbered.select("owner", "seq", "analysis_run_id", "repository_id")
    return (
        found.join(keys.drop("repository_id"), "ordinal")
        .join(later, ["owner", "seq"])
        .select("repository_id", "analysis_run_id", "path", "name", "change_kind")
    )
