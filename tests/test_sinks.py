"""Sinks with keys resolved on the way, continuous import and watched jobs."""

import json
import time
from datetime import datetime as D

import pytest

from codelode import staging
from codelode.sources import service, sinks
from codelode.streaming import ingest


def frames(spark):
    files = spark.createDataFrame([("f1", "a.py"), ("f2", "b.py")], "id string, path string")
    symbols = spark.createDataFrame([("s1", "a.py", "f", 1), ("s2", "a.py", "f", 9), ("s3", "b.py", "g", 1), ("s4", "gone.py", "h", 1)], "id string, path string, name string, start_line int")
    imports = spark.createDataFrame([("a.py", "os")], "path string, source string")
    calls = spark.createDataFrame([("a.py", "f", "g", 2), ("b.py", "none", "f", 3)], "path string, caller_name string, callee_name string, line int")
    return files, symbols, imports, calls


def test_run_with_keys(spark, rows, tmp_path):
    folder = f"file://{tmp_path}/runs"
    assert sinks.write_run(spark, folder, "7", *frames(spark)) == "completed"
    assert sinks.write_run(spark, folder, "7", *frames(spark)) == "completed"
    assert rows(sinks.read_snapshot(spark, folder, "symbols", "7"), "id", "file_id") == [("s1", "f1"), ("s2", "f1"), ("s3", "f2")]
    assert rows(sinks.read_snapshot(spark, folder, "calls", "7"), "caller_name", "caller_id") == [("f", "s1"), ("none", None)]
    files, symbols, imports, calls = frames(spark)
    with pytest.raises(Exception, match="caller_name"):
        sinks.write_run(spark, folder, "8", files, symbols, imports, calls.drop("caller_name"))
    assert rows(sinks.completed_runs(spark, folder)) == [("7",)]
    assert rows(sinks.read_snapshot(spark, folder, "runs"), "analysis_run_id", "status") == [("7", "completed"), ("8", "failed")]


def test_repositories_keep_their_ids(spark, rows, tmp_path):
    path = f"file://{tmp_path}/repositories"
    df = lambda *names: spark.createDataFrame([(n,) for n in names], "full_name string")
    first = dict(rows(sinks.upsert_repositories(df("a/b", "a/b"), path)))
    second = dict(rows(sinks.upsert_repositories(df("a/b", "c/d"), path)))
    assert second["a/b"] == first["a/b"] and second["c/d"] != first["a/b"] and len(first) == 1 and spark.read.parquet(path).count() == 2


def test_chunks(spark, rows, tmp_path):
    path = f"file://{tmp_path}/chunks"
    c = spark.createDataFrame(
        [("r", "f1", "a.py", "f", "text", [1.0], ("k",)), ("r", "f1", "a.py", "f", "text", [1.0], ("k",)), ("r", "f1", None, "f", "other", [1.0], ("k",)), ("r", "f1", "a.py", "zz", "more", [1.0], None), ("r", "f1", "a.py", "f", "bare", None, None)],
        "analysis_run_id string, file_id string, path string, symbol_name string, content string, embedding array<double>, metadata struct<kind:string>",
    )
    s = spark.createDataFrame([("r", "f1", "f", 3, "s3"), ("r", "f1", "f", 1, "s1")], "analysis_run_id string, file_id string, name string, start_line int, id string")
    assert sinks.write_chunks(c, s, path) == 2 and sinks.write_chunks(c, s, path) == 0
    assert rows(spark.read.parquet(path), "content", "symbol_id", "metadata") == [("more", None, None), ("text", "s1", '{"kind":"k"}')]


def test_test_runs_are_stored_once(spark, rows, tmp_path):
    folder = f"file://{tmp_path}/tests"
    schema = "repository_id string, test_run_id string, full_name string, outcome string, duration_ms long, failure_type string, failure_message string, failure_stacktrace string"
    case = lambda run, name, outcome, kind=None: ("r", run, name, outcome, 5, kind, None, None)
    one = spark.createDataFrame([case("1", "a", "passed"), case("1", "b", "failed", "TimeoutError")], schema)
    assert rows(sinks.write_test_runs(one, "junit", folder), "test_run_id", "failed_tests") == [("1", 1)]
    again = spark.createDataFrame([case("2", "b", "failed", "TimeoutError"), case("2", "a", "passed"), case("3", "a", "passed")], schema)
    assert rows(sinks.write_test_runs(again, "junit", folder), "test_run_id") == [("3",)]
    assert rows(spark.read.parquet(f"{folder}/test_cases"), "test_run_id", "full_name", "failure_class") == [("1", "a", "unknown"), ("1", "b", "timeout"), ("3", "a", "unknown")]


def test_reports_with_equal_names(spark, rows, tmp_path):
    """Cases of one name in one report all stay; a report that comes again is left out."""
    reports = tmp_path / "reports"
    reports.mkdir()
    body = '<testsuite name="s"><testcase name="t[1]" classname="c"/><testcase name="t" classname="c"/><testcase name="t" classname="c"/></testsuite>'
    (reports / "a.xml").write_text(body)
    target, checkpoint = f"file://{tmp_path}/cases", f"file://{tmp_path}/checkpoint"
    for copy in (None, "b.xml"):
        if copy:
            (reports / copy).write_text(body)
        ingest.import_reports(ingest.report_stream(spark, str(reports)), target, checkpoint).awaitTermination()
    assert rows(spark.read.parquet(target), "test_name") == [("t",), ("t",), ("t[1]",)]


def test_silent_jobs(spark, rows, tmp_path):
    """A job that ends is reported with its status, one that says nothing for an hour as silent, a busy one not yet."""
    source = tmp_path / "events"
    source.mkdir()
    put = lambda name, *events: (source / name).write_text("\n".join(json.dumps({"job_id": j, "ts": t, "status": s}) for j, t, s in events))
    put("1.json", ("ended", "2024-01-01T00:00:00", "running"), ("ended", "2024-01-01T00:05:00", "completed"), ("quiet", "2024-01-01T00:10:00", "running"), ("busy", "2024-01-01T00:10:00", "running"))
    stream = spark.readStream.schema("job_id string, ts timestamp, status string").option("maxFilesPerTrigger", 1).json(str(source))
    out, checkpoint = f"{tmp_path}/out", f"{tmp_path}/checkpoint"

    def run():
        q = ingest.silent_jobs(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    assert rows(spark.read.parquet(out), "job_id", "status", "n_events") == [("ended", "completed", 2)]
    time.sleep(0.01)
    put("2.json", ("busy", "2024-01-01T02:30:00", "running"))
    run()
    put("3.json", ("busy", "2024-01-01T02:31:00", "running"))
    run()
    assert rows(spark.read.parquet(out), "job_id", "status", "n_events") == [("ended", "completed", 2), ("quiet", "silent", 1)]


def test_windows(spark, rows):
    at = lambda h, m=0: D(2024, 1, 1, h, m)
    e = spark.createDataFrame([(at(1), "u", "x"), (at(1, 20), "u", "x"), (at(2), "u", "y"), (at(1), "v", "x")], "ts timestamp_ntz, user_id string, outcome string")
    assert rows(ingest.sessions(e, "user_id"), "user_id", "n") == [("u", 1), ("u", 2), ("v", 1)]
    sliding = rows(ingest.outcome_sliding(e, width="2 hours", slide="1 hour"), "window_start", "outcome", "n")
    assert sliding == [(at(0), "x", 3), (at(1), "x", 3), (at(1), "y", 1), (at(2), "y", 1)]


def test_service_defaults(spark):
    r = service.repositories(spark.createDataFrame([('{"id": "1", "name": "n", "owner": {"login": "o"}, "private": true}',), ("no json",), (None,)], "body string")).collect()
    assert (r[0].id, r[0].owner, r[0].default_branch, r[0].stars, r[0].visibility) == ("1", "o", "main", 0, "public") and r[1].name is None and r[2].name is None
    p = service.pull_requests(spark.createDataFrame([('{"number": 3, "head": {"ref": "h"}, "merged": true}',)], "body string")).first()
    assert (p.number, p.head, p.merged, p.state, p.title) == (3, "h", True, "open", "")


def test_staged_tables_are_cleared(spark):
    import os

    with staging.cleared():
        t = staging.stage(spark.range(5))
        path = t.path.removeprefix("file://")
        assert os.path.isdir(path) and t.count() == 5
    assert not os.path.exists(path)
