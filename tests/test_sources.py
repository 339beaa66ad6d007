import io
import zipfile

import pytest

from codelode.sources import ci, gitlog, reports, repository, sinks, source_code
from codelode.streaming import ingest

JUNIT = """<?xml version="1.0"?>
<testsuites><testsuite name="s"><testcase name="a" classname="c.K" time="0.123"/>
<testcase name="b" time="x"><failure message="m" type="T">trace</failure></testcase>
<testcase name="c"><error message="e" type="E"/></testcase><testcase name="d"><skipped/></testcase></testsuite></testsuites>"""
ONE = '<testsuite name="z"><testcase name="only" time="1"/></testsuite>'
JSON = '{"test_cases": [{"suite_name": "s", "test_name": "t", "outcome": "PASSED", "duration_ms": 5}, {}]}'


def test_reports(spark, rows):
    r = spark.createDataFrame([("1", JUNIT), ("2", ONE), ("3", JSON), ("4", "junk"), ("5", None), ("6", "")], "report_id string, content string")
    got = rows(reports.report_cases(r), "report_id", "full_name", "outcome", "duration_ms", "failure_type")
    assert got == sorted([
        ("1", "c.K.a", "passed", 123, None), ("1", "s.b", "failed", None, "T"), ("1", "s.c", "error", None, "E"), ("1", "s.d", "skipped", None, None),
        ("2", "z.only", "passed", 1000, None), ("3", "s.t", "passed", 5, None), ("3", "unknown.unknown", "error", 0, None),
    ], key=repr)


def test_gitlog(spark, rows):
    f = gitlog.FIELD
    log = gitlog.COMMIT.join([f.join(["h1", "n", "e", "0", "p1 p2", "subject", "body"]), "broken", f.join(["h2", "n", "e", "60", "", "s2", ""])])
    got = rows(gitlog.commits(spark.createDataFrame([("r", log)], "repository_id string, content string")), "commit_hash", "commit_message", "parent_hashes")
    assert got == [("h1", "subject\n\nbody", "p1,p2"), ("h2", "s2", "")]
    stat = "5\t0\ta.py\n-\t-\tbin\n0\t3\tb.py\n1\t1\tdir/{x => y}/f.py\n2\t2\told.js => new.js"
    got = rows(gitlog.changes(spark.createDataFrame([("h", stat)], "commit_hash string, content string")), "path", "change_type", "old_path")
    assert got == sorted([("a.py", "added", None), ("bin", "modified", None), ("b.py", "deleted", None), ("dir/y/f.py", "renamed", "dir/x/f.py"), ("new.js", "renamed", "old.js")], key=repr)


def test_python_rows():
    rows = source_code.python_rows("import os\nfrom x.y import z\nclass A:\n    def m(self):\n        return z(os.path)\n@app.get('/u')\ndef u(): pass\n@bp.route('/r', methods=['POST'])\ndef r(): pass\n")
    assert ("symbol", "m", "method", "A", 4, 5) in rows and ("import", "x.y", "z", None, 2, None) in rows and ("call", "z", None, "m", 5, None) in rows
    assert {r[2] for r in rows if r[0] == "route"} == {"GET /u", "POST /r"}


def test_script_rows():
    text = "import a, {b} from './x';\nexport function f(x) { return g(x); }\nconst h = (y) => 1;\nclass K {\n  m(q) { if (q) { f(q); } }\n}\napp.get('/p', mid, handler);\nconst q = require('q');\n// function no() {}\n"
    rows = source_code.script_rows(text)
    assert {(r[1], r[2]) for r in rows if r[0] == "symbol"} == {("f", "function"), ("h", "arrow_function"), ("K", "class"), ("m", "method")}
    assert {(r[1], r[2]) for r in rows if r[0] == "import"} == {("./x", "a,b"), ("q", "q")}
    assert ("route", "handler", "GET /p", "express", 7, None) in rows and ("call", "g", None, "f", 2, None) in rows


def test_analyse_never_fails(spark, rows):
    f = spark.createDataFrame([("r", "a.py", "def f(:"), ("r", "b.py", "def g(): pass"), ("r", "c.js", "function k() {"), ("r", "d.txt", "x"), ("r", "e.py", None)], "repository_id string, path string, content string")
    got = rows(source_code.analyse(f), "path", "kind")
    assert got == [("a.py", "error"), ("b.py", "symbol"), ("c.js", "symbol")]


def test_archive_and_scan(spark, rows, tmp_path):
    def zipped(names):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for n in names:
                z.writestr(n, "x = 1\n")
        return bytearray(b.getvalue())

    z = spark.createDataFrame([("r", zipped(["top/a.py", "top/b/c.py"])), ("s", zipped(["../evil"])), ("t", bytearray(b"no zip"))], "repository_id string, content binary")
    got = {(r.repository_id, r.path, r.error is None) for r in repository.archives(z).collect()}
    assert got == {("r", "a.py", True), ("r", "b/c.py", True), ("s", None, False), ("t", None, False)}
    for n in ("src/a.py", "node_modules/x.js", "img.png"):
        p = tmp_path / n
        p.parent.mkdir(exist_ok=True, parents=True)
        p.write_text("x = 1\n")
    tree = repository.scan(spark, str(tmp_path), "r")
    assert rows(repository.metadata(tree), "path", "language", "lines") == [("src/a.py", "Python", 1)]
    assert [f.rsplit("/", 1)[-1] for f in repository._folders(spark, str(tmp_path))] == [tmp_path.name, "src"]
    assert rows(repository.scan(spark, str(tmp_path), "r", max_files=1, max_bytes=6), "path") == [("src/a.py",)]
    for bound in ({"max_files": 0}, {"max_bytes": 5}):
        with pytest.raises(ValueError):
            repository.scan(spark, str(tmp_path), "r", **bound)


def test_ci(spark, rows):
    text = "on:\n  push:\njobs:\n  unit:\n    steps:\n      - run: python -m pytest\n      # npm test\n"
    jobs = ci.ci_jobs(spark.createDataFrame([("r", ".github/workflows/ci.yml", text), ("r", "a.yml", text)], "repository_id string, path string, content string"))
    assert [(r.job, r.commands, r.triggers) for r in jobs.collect()] == [("unit", ["- run: python -m pytest"], ["push"])]
    changed = spark.createDataFrame([("r", "src/a.py", "Python")], "repository_id string, path string, language string")
    assert ci.relevant(jobs, changed).first().relevance == "high"


def test_sinks(spark, rows, tmp_path):
    df = spark.createDataFrame([("1", "a"), ("2", "b")], "analysis_run_id string, path string")
    sinks.write_snapshot({"files": df}, str(tmp_path))
    sinks.write_snapshot({"files": spark.createDataFrame([("2", "c")], "analysis_run_id string, path string")}, str(tmp_path))
    assert rows(sinks.read_snapshot(spark, str(tmp_path), "files"), "analysis_run_id", "path") == [("1", "a"), ("2", "c")]
    target = str(tmp_path / "t")
    assert sinks.append_new(df, target, ["path"]) == 2 and sinks.append_new(df, target, ["path"]) == 0


def test_stream_imports_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.xml").write_text(ONE)
    (src / "b.json").write_text(JSON)
    target = str(tmp_path / "out")
    for n in range(2):
        ingest.import_reports(ingest.report_stream(spark, str(src)), target, str(tmp_path / f"cp{n}")).awaitTermination(120)
    assert spark.read.parquet(target).count() == 3
