"""Repository trees and archives as rows of files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions import constants as K
from codelode.functions import predicates as P
from codelode.functions import text as X

URL = r"^https://github\.com/([A-Za-z0-9_-]+)/([A-Za-z0-9_.-]+)/?$"


def parse_url(url: Column) -> Column:
    """Struct of owner and name; null fields if the URL is of another form."""
    u = F.trim(url)
    part = lambda g: F.when(u.rlike(URL), F.regexp_extract(u, URL, g))
    return F.struct(part(1).alias("owner"), part(2).alias("name"))


def metadata(files: DataFrame) -> DataFrame:
    """(repository_id, path, filename, extension, language, size_bytes, lines, is_sensitive, content_hash) of (repository_id, path, content)."""
    path, text = F.translate("path", "\\", "/"), F.col("content")
    return files.select(
        "repository_id", path.alias("path"), X.filename(path).alias("filename"), X.extension(path).alias("extension"), X.language(path).alias("language"),
        F.octet_length(text).cast("long").alias("size_bytes"), X.line_count(text).alias("lines"), P.is_sensitive(path).alias("is_sensitive"), F.sha2(text, 256).alias("content_hash"),
    )


def _folders(spark: SparkSession, root: str) -> list[str]:
    """The folders of a tree that a scan enters; only names are listed, and nothing below an ignored folder."""
    jvm = spark.sparkContext._jvm
    start = jvm.org.apache.hadoop.fs.Path(root)
    fs = start.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out, open_ = [], [start]
    while open_:
        here = open_.pop()
        out.append(here.toString())
        open_ += [s.getPath() for s in fs.listStatus(here) if s.isDirectory() and s.getPath().getName() not in K.IGNORED_DIRECTORIES]
    return sorted(out)


def scan(spark: SparkSession, root: str, repository_id: str, max_files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """(repository_id, path, content) of a tree: ignored folders are not entered, binary files not read into text.

    More files, or more bytes in them, than allowed are an error; both are known
    before a file is read.
    """
    folders = _folders(spark, root)
    raw = spark.read.format("binaryFile").load(folders)
    base = root.rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + base.removeprefix("file://").replace(".", r"\.") + "/", "")
    kept = raw.withColumn("path", path).where(~P.is_ignored(F.col("path")) & ~P.is_binary(F.col("path")))
    if max_files is not None or max_bytes is not None:
        # names and lengths only: no content is asked for
        n, size = kept.agg(F.count(F.lit(1)), F.sum("length")).first()
        if max_files is not None and n > max_files:
            raise ValueError(f"more than {max_files} files")
        if max_bytes is not None and (size or 0) > max_bytes:
            raise ValueError(f"more than {max_bytes} bytes")
    return kept.select(F.lit(repository_id).alias("repository_id"), "path", F.try_validate_utf8(F.col("content").cast("string")).alias("content"))


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rid, data in zip(batch.column("repository_id").to_pylist(), batch.column("content").to_pylist()):
            ids, paths, texts, errors = [], [], [], []
            try:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    if z.testzip() is not None:
                        raise zipfile.BadZipFile("damaged member")
                    names = [n for n in z.namelist() if not n.endswith("/")]
                    unsafe = [n for n in names if n.startswith(("/", "\\")) or ".." in n.replace("\\", "/").split("/")]
                    if unsafe:
                        raise zipfile.BadZipFile("unsafe path " + unsafe[0])
                    tops = {n.split("/")[0] for n in names}
                    cut = len(tops) == 1 and all("/" in n for n in names)
                    for n in names:
                        ids.append(rid)
                        paths.append(n.split("/", 1)[1] if cut else n)
                        try:
                            texts.append(z.read(n).decode())
                        except UnicodeDecodeError:
                            texts.append(None)
                        errors.append(None)
            except zipfile.BadZipFile as e:
                ids, paths, texts, errors = [rid], [None], [None], [str(e)]
            yield pa.record_batch(
                [pa.array(ids, pa.string()), pa.array(paths, pa.string()), pa.array(texts, pa.string()), pa.array(errors, pa.string())],
                names=["repository_id", "path", "content", "error"],
            )


def archives(zips: DataFrame) -> DataFrame:
    """(repository_id, path, content, error) of zip files in (repository_id, content); one error row for a bad one."""
    return zips.mapInArrow(_unpack, "repository_id string, path string, content string, error string")


def readable(files: DataFrame, most_bytes: int = 1_000_000) -> DataFrame:
    """Files whose text may be shown: safe path, not sensitive, not too large."""
    return files.where(P.safe_relative_path(F.col("path")) & ~P.is_sensitive(F.col("path")) & (F.octet_length("content") <= most_bytes))
