from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from codelode.operators import change, coverage, graph, history, ordering, runs, search, targets, testresults

EDGES = [("process", "create"), ("handle", "process"), ("create", "validate")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string")


def seed(spark, *s):
    return spark.createDataFrame([(x,) for x in s], "seed string")


def test_callers_and_depth(spark, edges, rows):
    assert rows(graph.reached_edges(seed(spark, "create"), edges, 1, "up"), "src", "dst") == [("process", "create")]
    assert {r.src for r in graph.reached_edges(seed(spark, "create"), edges, 2, "up").collect()} == {"process", "handle"}
    assert graph.reach(seed(spark, "validate"), edges, 100, "up").count() == 4
    assert rows(graph.reach(seed(spark, "nobody"), edges, 3), "node") == [("nobody",)]
    b = graph.blast_radius(seed(spark, "validate"), edges, 3)
    assert rows(b, "node", "bucket") == [("create", 1), ("handle", 2), ("process", 2)]


def test_cycle_ends(spark, rows):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    for depth in (1, 3, 10):
        assert graph.reached_edges(seed(spark, "a"), e, depth).count() == min(depth, 3)
    tree = graph.tree_paths(seed(spark, "a"), e, 10)
    assert rows(tree, "depth", "again") == [(0, False), (1, False), (2, False), (3, True)]


def test_impact_categories(spark, edges, rows):
    found = graph.impact(seed(spark, "create"), edges, 3)
    assert rows(found, "node", "category") == [("handle", "transitive_caller"), ("process", "direct_caller"), ("validate", "direct_callee")]
    s = graph.impact_summary(found).first()
    assert (s.total, s.direct, s.transitive, s.callers) == (3, 2, 1, 2)


def test_workflow_caps(spark, rows):
    e = spark.createDataFrame([("r", f"n{i:03}") for i in range(150)], "src string, dst string")
    nodes, cut, summary = graph.workflow(seed(spark, "r"), e, 2)
    assert (nodes.count(), cut.count(), summary.first().reason) == (100, 150, "max_nodes_reached")


def test_imports(spark, rows):
    files = spark.createDataFrame([("r", p) for p in ("src/service.py", "src/a/index.ts", "lib/x.js")], "analysis_run_id string, path string")
    imports = spark.createDataFrame([("r", "src/c.py", "./service"), ("r", "src/c.py", "./a"), ("r", "src/b/c.ts", "../../lib/x"), ("r", "src/c.py", "os"), ("r", "c.py", "../x")], "analysis_run_id string, path string, source string")
    got = rows(graph.resolve_imports(imports, files), "source", "target", "kind")
    assert got == sorted([("./service", "src/service.py", "file"), ("./a", "src/a/index.ts", "file"), ("../../lib/x", "lib/x.js", "file"), ("os", "os", "external_module"), ("../x", "../x", "external_module")], key=repr)


def test_fusion(spark, rows):
    sem = spark.createDataFrame([("A", 0.9), ("B", 0.7)], "chunk_id string, semantic_score double")
    key = spark.createDataFrame([("A", 0.8), ("C", 0.6)], "chunk_id string, keyword_score double")
    got = {r.chunk_id: (r.source, r.semantic_score, r.keyword_score) for r in search.fuse(sem, key).collect()}
    assert got == {"A": ("hybrid", 0.9, 1.0), "B": ("semantic", 0.7, None), "C": ("keyword", None, 0.0)}
    one = lambda a, b, ws, wk: search.fuse(spark.createDataFrame([("A", a)], "chunk_id string, semantic_score double"), spark.createDataFrame([("A", b)], "chunk_id string, keyword_score double"), ws, wk).first().final_score
    assert one(0.8, 0.6, 0.5, 0.5) == 0.9 and one(0.8, 0.6, 0.8, 0.2) == 0.84 and one(0.8, 0.6, 0.2, 0.8) == 0.96
    with pytest.raises(ValueError):
        search.weights(0, 0)


def test_min_max(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (0.75,)], "v double")
    assert sorted(r[0] for r in df.select(ordering.min_max(F.col("v"))).collect()) == [0.0, 0.5, 1.0]
    assert {r[0] for r in spark.createDataFrame([(0.7,)] * 3, "v double").select(ordering.min_max(F.col("v"))).collect()} == {1.0}


def test_keyword(spark, rows):
    c = spark.createDataFrame([(1, "The parser layer reads the cache"), (2, "parser only"), (3, "the cache of the parser, the layer"), (4, None)], "chunk_id int, content string")
    assert [r.chunk_id for r in search.keyword(c, "parser cache").collect()] and {r[0] for r in rows(search.keyword(c, 'parser -only "the cache"'))} == {1, 3}


def test_budget(spark):
    e = spark.createDataFrame([(i, 1.0 - i / 10, "x" * 900) for i in range(6)], "chunk_id int, final_score double, content string")
    assert search.within_budget(e, chars=2000).count() == 2


def test_trends(spark, rows):
    t = lambda n, outs, ds: [("r", D(2024, 1, i + 1), str(i), n, o, d) for i, (o, d) in enumerate(zip(outs, ds))]
    p, f = "passed", "failed"
    data = t("a", [p, f, p, f, p, f], [1] * 6) + t("b", [p] * 4, [100, 110, 120, 130]) + [("r", D(2024, 1, 6), "5", "b", p, 250), ("r", D(2024, 1, 6), "5", "c", f, 1), ("r", D(2024, 1, 6), "5", "d", "error", 1)]
    cases = spark.createDataFrame(data, "repository_id string, imported_at timestamp_ntz, test_run_id string, full_name string, outcome string, duration_ms long")
    assert rows(testresults.trends(cases, "2024-01-06 00:00:00"), "full_name", "trend_type") == [
        ("a", "potentially_flaky"), ("a", "regression"), ("a", "repeated_failure"), ("b", "duration_increase"), ("c", "new_test_failure"),
    ]


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([("1", "x", "passed"), ("1", "y", "failed"), ("2", "y", "failed"), ("2", "x", "passed")], "test_run_id string, full_name string, outcome string")
    prints = {r.content_fingerprint for r in testresults.fingerprints(a, "junit").collect()}
    assert len(prints) == 1 and len(prints.pop()) == 64


def test_stale_runs(spark, rows):
    r = spark.createDataFrame([("a", "r", "running", D(2024, 1, 1), None, None), ("b", "r", "queued", D(2024, 1, 1), None, None), ("c", "r", "running", D(2024, 1, 2), None, None), ("d", "r", "completed", D(2023, 1, 1), None, None)],
                              "id string, repository_id string, status string, started_at timestamp_ntz, completed_at timestamp_ntz, error_message string")
    fixed = runs.recovered(r, "2024-01-02 01:00:00")
    assert rows(fixed, "id", "status") == [("a", "failed"), ("b", "failed"), ("c", "running"), ("d", "completed")]
    assert runs.stale_runs(fixed, "2024-01-02 01:00:00").count() == 0
    assert runs.latest_run(r).first().id == "d"


def test_changes(spark, rows):
    c = spark.createDataFrame([("src/user.py", "src/old.py", "renamed", 5, 1, "Python"), ("src/auth/token.py", None, "modified", 600, 0, "Python")], "path string, old_path string, change_type string, additions int, deletions int, language string")
    s = spark.createDataFrame([("src/user.py", "f", "function"), ("src/old.py", "_g", "function")], "path string, name string, symbol_type string")
    assert rows(change.changed_symbols(c, s)) == [("src/old.py", "_g", "function", "deleted", False), ("src/user.py", "f", "function", "added", True)]
    zero = F.lit(0).cast("long")
    risk = change.risk(c.withColumn("k", F.lit(1)), zero, zero, zero, "k").first()
    assert risk.signals == "security_code_change,large_change_size,missing_test_changes" and risk.score == 45 and risk.level == "medium"


def test_siblings(spark, rows):
    t = spark.createDataFrame([("tests/test_user.py",), ("src/user.test.ts",)], "path string")
    s = spark.createDataFrame([("src/user.py",), ("src/user.ts",), ("src/payment.py",)], "path string")
    assert {x[1] for x in rows(coverage.by_sibling(t, s))} == {"src/user.py", "src/user.ts"}
    rec = coverage.recommendations(spark.createDataFrame([("tests/a/x.py",), ("tests/a/b/y.py",)], "path string")).first()
    assert (rec.directory, rec.n_files) == ("tests/a/", 2)


def test_targets(spark, rows):
    q = spark.createDataFrame([("1", "What does OrderService do"), ("2", "zzz"), ("3", "see services/order_service.py")], "question_id string, question string")
    s = spark.createDataFrame([("s1", "OrderService", "services/order_service.py")], "id string, name string, path string")
    f = spark.createDataFrame([("f1", "services/order_service.py")], "id string, path string")
    e = spark.createDataFrame([], "id string, method string, path string")
    got = {r.question_id: (r.status, r.target_id) for r in targets.identify(q, s, f, e).collect()}
    assert got["1"] == ("found", "s1") and got["2"] == ("not_found", None) and got["3"][0] in ("found", "ambiguous")


def test_history(spark, rows):
    c = spark.createDataFrame([("c1", "r", "h1", D(2024, 1, 1)), ("c2", "r", "h2", D(2024, 1, 2))], "commit_id string, repository_id string, commit_hash string, committed_at timestamp_ntz")
    ch = spark.createDataFrame([("c1", "a", "added", 5, 0), ("c1", "b", "added", 1, 0), ("c2", "a", "modified", 2, 1), ("c2", "b", "deleted", 0, 1), ("c2", "c", "added", 1, 0)], "commit_id string, path string, change_type string, additions int, deletions int")
    assert rows(history.co_changes(c, ch, "a"), "path", "shared_commits") == [("b", 2), ("c", 1)]
    last = history.last_changes(c, ch, "2023-12-31", "2024-01-03")
    assert rows(last, "path", "change_type") == [("a", "modified"), ("b", "deleted"), ("c", "added")]
    assert history.new_commits(c, c.where("commit_id = 'c1'")).count() == 1 and history.new_commits(c, c).count() == 0
