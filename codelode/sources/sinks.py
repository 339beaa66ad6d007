"""Sinks: snapshots partitioned by run with the status of the run, idempotent appends, keys resolved on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelode.operators import testresults
from codelode.staging import stage


def write_snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table under the folder, partitioned by run; a repeated run replaces its partitions only."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("analysis_run_id").parquet(f"{folder}/{name}")


def read_snapshot(spark: SparkSession, folder: str, name: str, run: str | None = None) -> DataFrame:
    """A table of the folder; a run reads its partition only."""
    found = spark.read.parquet(f"{folder}/{name}").schema
    # ids are texts, also where they look like numbers in the names of partitions
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == "analysis_run_id" else f.dataType) for f in found])
    df = spark.read.schema(schema).parquet(f"{folder}/{name}")
    return df if run is None else df.where(F.col("analysis_run_id") == run)


def append_new(incoming: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose keys are not in the Parquet table yet, each once; returns how many."""
    spark = incoming.sparkSession
    rows = incoming.dropDuplicates(keys)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        rows = rows.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    new = stage(rows, n=F.count(F.lit(1)))
    n = new.seen["n"]
    if n:
        new.df.write.mode("append").parquet(path)
    new.drop()
    return n


def append_new_groups(incoming: DataFrame, path: str, key: str, buckets: int = 256) -> int:
    """Append all rows of the keys that are not in the Parquet table yet; returns how many rows.

    The table is partitioned by a hash of the key, and the look-up reads the
    partitions of the incoming keys only, not the whole history.
    """
    spark = incoming.sparkSession
    rows = incoming.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        # at most as many values as there are buckets
        wanted = [r[0] for r in rows.select("bucket").distinct().collect()]
        there = spark.read.parquet(path).where(F.col("bucket").isin(wanted)).select("bucket", key).distinct()
        rows = rows.join(there, ["bucket", key], "left_anti")
    new = stage(rows, n=F.count(F.lit(1)))
    n = new.seen["n"]
    if n:
        new.df.write.mode("append").partitionBy("bucket").parquet(path)
    new.drop()
    return n


def with_file_ids(rows: DataFrame, files: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with the id of the file of their run and path: inner drops unknown paths, left keeps them."""
    ids = files.groupBy("analysis_run_id", "path").agg(F.min("id").alias("file_id"))
    return rows.join(ids, ["analysis_run_id", "path"], how)


def with_symbol_ids(rows: DataFrame, symbols: DataFrame, name: str, symbol_id: str) -> DataFrame:
    """Rows of (analysis_run_id, file_id, ``name``) with the id of the symbol of that name in the file, the first by line and id; null where there is none."""
    first = F.min(F.struct("start_line", "id"))["id"]
    ids = symbols.groupBy("analysis_run_id", "file_id", F.col("name").alias(name)).agg(first.alias(symbol_id))
    return rows.join(ids, ["analysis_run_id", "file_id", name], "left")


def write_run(spark: SparkSession, folder: str, run: str, files: DataFrame, symbols: DataFrame, imports: DataFrame, calls: DataFrame) -> str:
    """Write one run: files, then symbols, imports and calls with the ids of their files and symbols, then its status.

    ``files`` has id and path; the others have path instead of a file id.  A
    table that fails leaves the run ``failed`` and raises; readers take runs
    with the status ``completed`` only, so half a run is never seen, and a run
    written again replaces its own partitions.
    """
    of_run = lambda df: df.withColumn("analysis_run_id", F.lit(run))
    status, done = "failed", {}
    try:
        write_snapshot({"files": of_run(files)}, folder)
        done["files"] = read_snapshot(spark, folder, "files", run)
        ids = lambda df: with_file_ids(of_run(df), done["files"]).drop("path")
        write_snapshot({"symbols": ids(symbols), "imports": ids(imports)}, folder)
        known = read_snapshot(spark, folder, "symbols", run)
        write_snapshot({"calls": with_symbol_ids(ids(calls), known, "caller_name", "caller_id")}, folder)
        status = "completed"
    finally:
        row = spark.createDataFrame([(run, status)], "analysis_run_id string, status string")
        write_snapshot({"runs": row}, folder)
    return status


def completed_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(analysis_run_id) of the runs whose tables are all there."""
    return read_snapshot(spark, folder, "runs").where("status = 'completed'").select("analysis_run_id")


def upsert_repositories(incoming: DataFrame, path: str) -> DataFrame:
    """(full_name, id) of the incoming repositories: the id that is stored, else a new one, which is stored."""
    rows = incoming.select("full_name", F.sha2(F.concat(F.lit("repository:"), "full_name"), 256).alias("id")).where("full_name is not null")
    append_new(rows, path, ["full_name"])
    return incoming.select("full_name").distinct().join(incoming.sparkSession.read.parquet(path), "full_name")


def write_chunks(chunks: DataFrame, symbols: DataFrame, path: str) -> int:
    """Append the chunks with a path and a vector that are not stored yet, each content once a run.

    ``chunks`` has analysis_run_id, file_id, path, symbol_name, content,
    embedding and a metadata struct, which is stored as JSON.
    """
    kept = chunks.where("path is not null and embedding is not null and content is not null")
    named = with_symbol_ids(kept, symbols, "symbol_name", "symbol_id")
    rows = named.withColumn("content_hash", F.sha2("content", 256)).withColumn("metadata", F.to_json("metadata"))
    return append_new(rows, path, ["analysis_run_id", "content_hash"])


def write_test_runs(cases: DataFrame, source_format: str, folder: str) -> DataFrame:
    """Store the runs of ``cases`` whose content is new to the repository, with counters and classified failures; returns the new runs.

    ``cases`` has repository_id, test_run_id, full_name, outcome, duration_ms and
    the failure's type, message and stack trace.
    """
    spark = cases.sparkSession
    owner = cases.groupBy("test_run_id").agg(F.min("repository_id").alias("repository_id"))
    runs = testresults.fingerprints(cases, source_format).join(owner, "test_run_id").join(testresults.counters(cases), "test_run_id").withColumn("status", F.lit("completed"))
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/test_runs")
    if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        fresh = testresults.new_runs(runs, spark.read.parquet(f"{folder}/test_runs"))
    else:
        fresh = testresults.new_runs(runs, runs.limit(0))
    new = stage(runs.join(fresh.select("test_run_id"), "test_run_id", "left_semi"))
    kept = cases.join(new.df.select("test_run_id"), "test_run_id", "left_semi")
    # the cases first: a run that is there has all of them
    testresults.classified(kept).write.mode("append").partitionBy("repository_id").parquet(f"{folder}/test_cases")
    new.df.write.mode("append").parquet(f"{folder}/test_runs")
    return new.df
