"""Cutting lineage: intermediate tables in the shared folder of the cluster.

Iterative operators and those whose result must be fixed before it is used
twice write a table and read it again.  The folder is the one the session
names in ``spark.checkpoint.dir``; all executors reach it, so the loss of an
executor costs nothing.  Only where the setting is missing and the master is a
local one (tests) a temporary folder is taken.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_local_dir: str | None = None
_scopes: list[list["Staged"]] = []


@contextlib.contextmanager
def cleared() -> Iterator[None]:
    """Remove, at its end, the tables staged within; what reads them has to be consumed or written before."""
    _scopes.append([])
    try:
        yield
    finally:
        for table in _scopes.pop():
            table.drop()


def shared_dir(spark: SparkSession) -> str:
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="codelode-")
    return "file://" + _local_dir


class Staged:
    """A written table: ``df`` reads it, ``drop`` removes its files.

    Aggregates named in the call are computed as the table is written and stand
    in ``seen``, so a loop that counts what is left needs no job of its own.
    """

    def __init__(self, df: DataFrame, **aggregates: Column):
        spark = df.sparkSession
        noted = Observation()
        if aggregates:
            df = df.observe(noted, *[c.alias(k) for k, c in aggregates.items()])
        self.spark = spark
        self.path = f"{shared_dir(spark)}/staged/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)
        self.seen = noted.get if aggregates else {}
        if _scopes:
            _scopes[-1].append(self)

    @staticmethod
    def of(table: "Staged", *columns: str) -> "Staged":
        """The same files, read for some columns only."""
        out = object.__new__(Staged)
        out.spark, out.path, out.seen, out.df = table.spark, table.path, table.seen, table.df.select(*columns)
        return out

    @staticmethod
    def together(tables: list["Staged"]) -> DataFrame:
        """The rows of tables of one schema, as one scan."""
        return tables[0].spark.read.schema(tables[0].df.schema).parquet(*[t.path for t in tables])

    def count(self) -> int:
        return self.df.count()

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, **aggregates: Column) -> Staged:
    return Staged(df, **aggregates)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over all cores where a scan has too few splits for costly work on each row.

    A scan with at least twice as many splits as there are cores is left as it
    is, so on large tables nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(4 * cores, *keys)
