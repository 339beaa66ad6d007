"""Impact, correlation and evidence on small tables with known answers."""

import pytest
from pyspark.sql import functions as F

from codelode.operators import correlation as C
from codelode.operators import coverage, evidence, graph, impact, search

SYMBOL = "id long, name string, path string, symbol_type string, clash string"


def world(spark):
    s = spark.createDataFrame([(1, "a", "x.py", "function", ""), (2, "b", "x.py", "function", ""), (3, "_c", "y.py", "function", ""), (4, "d", "z.py", "function", "")], SYMBOL)
    calls = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 1), (1, 1)], "src long, dst long")
    ends = spark.createDataFrame([(1, "GET", "/a", "x.py"), (4, "PUT", "/d", "z.py")], "symbol_id long, method string, route string, file_path string")
    return s, calls, ends


def test_neighbours_and_files(spark, rows):
    s, calls, _ = world(spark)
    f = impact.file_imports(calls, s)
    assert rows(f) == [("x.py", "y.py"), ("y.py", "z.py"), ("z.py", "x.py")]
    seed = spark.createDataFrame([(2,)], "seed long")
    assert rows(impact.dependencies(seed, calls, f, s)) == [(2, "calls", "3"), (2, "imports", "y.py")]
    assert rows(impact.dependents(seed, calls, f, s)) == [(2, "callers", "1"), (2, "imported_by", "z.py")]
    assert rows(impact.file_impact("x.py", calls, f, s, 1)) == [("dependency_file", "y.py", 1), ("dependent_file", "z.py", 1), ("direct_caller", "4", 1)]
    assert rows(impact.file_impact("none.py", calls, f, s, 1)) == []


def test_endpoints_and_workflows(spark, rows):
    s, calls, ends = world(spark)
    found = graph.impact(ends.select(F.col("symbol_id").alias("seed")), calls, 1)
    assert ("GET", "/a", 4, "direct_caller", 1) in rows(impact.endpoint_impact(ends, calls, 1))
    got = rows(impact.affected(found, s, ends))
    assert (1, "endpoint", "PUT /d") in got and (1, "file", "x.py") in got and (4, "file", "y.py") in got
    nodes, edges = impact.endpoint_workflow(ends, calls, 1)
    assert ("GET /a", "GET /a", "1", "handles", 1) in rows(edges) and ("GET /a", "1", "2", "calls", 2) in rows(edges)
    assert ("GET /a", "2", 2) in rows(nodes)
    changed = spark.createDataFrame([("c", "x.py"), ("c", "x.py"), ("d", "y.py"), ("e", "z.py")], "commit string, path string")
    # the workflow of /a holds both symbols of x.py; that of /d reaches from z.py to x.py
    assert rows(impact.affected_workflows(ends, calls, s, changed, "commit", 1)) == [("c", "GET", "/a", 2), ("e", "PUT", "/d", 1)]
    assert rows(impact.bounded(spark.createDataFrame([(1,)], "seed long"), calls, 3, 2, 99)) == [(1, 2, 5, "max_nodes_reached")]


def flows_of(ends, calls, s, changed, depth=1):
    """As affected_workflows is defined: row by row."""
    below = {e: {n for n in [e, *(d for c, d in calls if c == e)] if n} for e in {x[0] for x in ends}}
    path = dict(s)
    files = {}
    for c, p in changed:
        files.setdefault(c, set()).add(p)
    out = {}
    for c, of in files.items():
        for e, method, route, p in ends:
            if p is not None and p in of:
                n = sum(path.get(x) in of for x in below[e]) if c is not None else 0
                out[c, method, route] = out.get((c, method, route), 0) + n
    return sorted(((*k, n) for k, n in out.items()), key=repr)


@pytest.mark.parametrize(("together", "loaded"), [(1000, 500_000), (4, 20)])
def test_affected_workflows_however_they_are_cut(spark, rows, monkeypatch, together, loaded):
    """Wide sets, several broadcasts, routes of several files, sets without name, endpoints without symbol or elsewhere than it."""
    monkeypatch.setattr(impact, "MOST_TOGETHER", together)
    monkeypatch.setattr(impact, "MOST_LOADED", loaded)
    s = [(i, f"f{i % 7}.py") for i in range(1, 40)]
    calls = sorted({(i, i * k % 41) for i in range(1, 40) for k in (3, 8, 10, 15, 17, 24) if i != i * k % 41})
    ends = [(i, "GET", f"/{i}", f"f{i % 7}.py") for i in range(1, 12)] + [(12, "GET", "/1", "f5.py"), (15, "GET", "/1", "f1.py"), (None, "PUT", "/n", "f2.py"), (4, "PUT", None, "f6.py"), (5, "PUT", "/none", None)]
    changed = [(f"c{c}", f"f{p}.py") for c in range(6) for p in range(9) if (p * p + c) % 5 < c] * 2 + [(None, "f1.py"), (None, "f2.py"), ("c1", None)]
    frames = spark.createDataFrame(ends, "symbol_id long, method string, route string, file_path string"), spark.createDataFrame(calls, "src long, dst long")
    symbols = spark.createDataFrame([(i, "n", p, "function") for i, p in s], "id long, name string, path string, symbol_type string")
    expected = flows_of(ends, calls, s, changed)
    assert len(expected) > 30 and max(r[-1] for r in expected) > 3
    assert rows(impact.affected_workflows(*frames, symbols, spark.createDataFrame(changed, "commit string, path string"), "commit", 1)) == expected


def test_affected_workflows_do_not_shuffle_their_rows(spark):
    """Many sets times many endpoints: what is written for it stays in proportion to the tables."""
    ends = spark.range(400).select(F.col("id").alias("symbol_id"), F.lit("GET").alias("method"), F.col("id").cast("string").alias("route"), F.lit("a.py").alias("file_path"))
    symbols = spark.range(400).select("id", F.lit("n").alias("name"), F.lit("a.py").alias("path"), F.lit("function").alias("symbol_type"))
    changed = spark.range(2000).select(F.col("id").alias("commit"), F.lit("a.py").alias("path"))
    found = impact.affected_workflows(ends, spark.createDataFrame([(1, 2)], "src long, dst long"), symbols, changed, "commit", 1)
    assert found.groupBy("n_changed").count().orderBy("n_changed").collect() == [(1, 399 * 2000), (2, 2000)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("Generate")]
    assert "Exchange" not in top and "Aggregate" not in top and "BroadcastHashJoin" in top


def test_change_sets(spark, rows):
    s, calls, ends = world(spark)
    changed = spark.createDataFrame([("c", "x.py", 3, 1, "Python"), ("d", "docs/readme.md", 1, None, None)], "commit string, path string, additions int, deletions int, language string")
    got = {r.commit: r for r in impact.change_impact(changed, s, ends, "commit").collect()}
    assert (got["c"].n_endpoints, got["c"].n_public, got["c"].n_workflows, got["c"].level) == (1, 2, 1, "medium")
    assert (got["d"].score, got["d"].signals) == (0, "")
    plan = rows(impact.implementation_plan(impact.change_impact(changed, s, ends, "commit"), "commit"))
    assert ("c", "high", 0, "review_changed_files") in plan and ("d", "low", 0, "review_changed_files") in plan
    assert rows(impact.change_set_dependencies(changed, calls, s, "commit")) == [("c", "callees", 3, False), ("c", "callers", 2, False), ("c", "files", 3, False)]
    empty = impact.change_impact(changed.limit(0), s, ends, "commit")
    assert rows(empty) == []


def test_tree_opens_each_node_once(spark):
    """Layers of full connections: one row an edge, not one a path."""
    edges = spark.createDataFrame([(10 * d + i, 10 * (d + 1) + j) for d in range(5) for i in range(4) for j in range(4)] + [(99, i) for i in range(4)], "src long, dst long")
    t = graph.tree_paths(spark.createDataFrame([(99,)], "seed long"), edges, 6).collect()
    assert len(t) == 1 + 4 + 5 * 16 and sum(not r.again for r in t) == 1 + 6 * 4
    assert all(list(r.path)[-1] == r.node and len(r.path) == r.depth + 1 for r in t)
    loop = graph.tree_paths(spark.createDataFrame([(1,)], "seed long"), spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long"), 9).collect()
    assert sorted((r.node, r.depth, r.again) for r in loop) == [(1, 0, False), (1, 2, True), (2, 1, False)]


FAILED = "repository_id string, test_id string, full_name string, suite_name string, metadata string"
PATHS = "repository_id string, path string"
IMPORTS = "repository_id string, path string, source string, imported_names string"
NAMES = "repository_id string, path string, name string"


def test_failure_correlation(spark, rows):
    failed = spark.createDataFrame([
        ("r", "1", "one", "tests.test_user", None), ("r", "2", "two", "tests/test_auth.py", None), ("r", "3", "three", "", '{"file": "tests/test_x.py"}'), ("r", "4", "four", None, None), ("q", "5", "five", "tests.test_user", None),
        ("r", "6", "six", "tests/gone.py", None),
    ], FAILED)
    files = spark.createDataFrame([("r", p) for p in ("tests/test_user.py", "tests/test_auth.py", "tests/test_x.py", "src/services/user.py", "src/auth.py", "src/x.ts")] + [("q", "tests/test_user.py")], PATHS)
    imports = spark.createDataFrame([("r", "tests/test_user.py", "services.user", "create, drop"), ("r", "tests/test_x.py", "../src/x", ""), ("q", "tests/test_user.py", "services.user", "")], IMPORTS)
    changed = files.where("path like 'src%'")
    symbols = spark.createDataFrame([("r", "src/services/user.py", "create"), ("r", "src/services/user.py", "other"), ("r", "src/x.ts", "any")], NAMES)
    got = rows(C.failure_correlations(failed, files, imports, changed, symbols))
    assert got == [
        ("1", "one", "direct_import", "high", "src/services/user.py", "src/services/user.py::create"), ("2", "two", "module_sibling", "medium", "src/auth.py", ""),
        ("3", "three", "direct_import", "high", "src/x.ts", "src/x.ts::any"),
    ]
    assert rows(C.failure_correlations(failed.limit(0), files, imports, changed, symbols)) == []
    over = rows(C.failure_overview(failed.select("test_id", "full_name"), C.failure_correlations(failed, files, imports, changed, symbols), spark.createDataFrame([("one", "fixed"), ("one", "regression")], "full_name string, trend_type string")), "test_id", "correlation_type", "trends")
    assert over[0] == ("1", "direct_import", "fixed,regression") and over[3] == ("4", None, None)
    tests = files.where("path like 'tests%'")
    assert ("r", "tests/test_user.py", "direct_import", "high", 1) in rows(C.affected_tests(tests, imports, changed, symbols))
    assert ("r", "tests/test_auth.py", "src/auth.py", "sibling_module", "medium") in rows(C.sources_of_tests(tests, changed, imports))


def test_modules_by_parts(spark, rows):
    t = spark.createDataFrame([("t.py", "t", "app.services.user", ""), ("u.py", "u", "user", ""), ("v.py", "v", "use", ""), ("w.py", "w", "", ""), ("x.ts", "x", "../services/user", "")], "path string, name string, source string, imported_names string")
    s = spark.createDataFrame([("services/user.py",), ("user.py",), ("other/user.py",)], "path string")
    assert rows(coverage.by_module(t, s)) == [
        ("t.py", "services/user.py"), ("t.py", "user.py"), ("u.py", "other/user.py"), ("u.py", "services/user.py"), ("u.py", "user.py"), ("x.ts", "services/user.py"), ("x.ts", "user.py"),
    ]
    named = spark.createDataFrame([("a.py", "test_createUser_ok", "", ""), ("b.py", "test_recreate", "", "")], "path string, name string, source string, imported_names string")
    got = rows(coverage.tests_of_symbols(named, spark.createDataFrame([("create_user",), ("HTTPCreate",), ("ok",), ("",)], "name string")))
    assert got == [("a.py", "test_createUser_ok", "create_user", "low")]


def test_keyword_queries(spark):
    c = spark.createDataFrame([(1, "the exact phrase here"), (2, "exact the phrase"), (3, "parsing a cache"), (4, "parsed"), (5, None), (6, "a layer of cache, error")], "chunk_id long, content string")
    ids = lambda q, **k: {r.chunk_id for r in search.keyword(c, q, **k).collect()}
    assert ids('"exact phrase"') == {1} and ids('"exact phrase" here') == {1} and ids("exact phrase") == {1, 2}
    assert ids("parsing or layer") == {3, 6} and ids("cache -error") == {3} and ids("parse", forms=True) == {3, 4} and ids("") == set() and ids("or") == set()


def test_evidence(spark, rows):
    calls = spark.createDataFrame([(i, 0) for i in range(1, 13)] + [(0, 20)], "src long, dst long")
    got = rows(evidence.graph_evidence(spark.createDataFrame([(0,), (50,)], "seed long"), calls))
    assert len(got) == 11 and (0, "callers", 10, True) in got and (0, "callees", 20, False) in got
    levels = spark.createDataFrame([("r", "high"), ("r", "high"), ("r", "low")], "repository_id string, confidence string")
    assert rows(evidence.counters(levels, ["repository_id"], "confidence")) == [("r", 3, "high: 2, low: 1")]
    texts = spark.createDataFrame([("could not open /srv/a/b.txt\nat line 3",), (None,), ("x" * 300,)], "m string")
    assert [r[0] for r in texts.select(evidence.safe_message(F.col("m"))).collect()] == ["could not open <path>", None, "x" * 200]
    p = evidence.evidence_prompt(spark.createDataFrame([("a", "t1", "x" * 300, 2), ("a", "t2", "y", 1)], "g string, t string, content string, o int"), ["g"], F.col("t"), F.col("o")).first()
    assert p.prompt == "[Evidence 1] t2\ny\n\n[Evidence 2] t1\n" + "x" * 200 + "..."


def test_words_of_patterns_are_necessary(spark):
    """Patterns tried only where one of their words stands give what all patterns give on every text."""
    from codelode.functions import constants as K
    from codelode.functions import predicates as P

    texts = ["What does parse do", "GET /users", "the /api/ path", "who wrote this", "if I change it", "what would break", "Where is the author", "how is the repository\nstructured", "the project is well organized", "used by all", "nothing", "", "USED BY", "users", "unused bytes"]
    df = spark.createDataFrame([(t,) for t in texts], "q string").withColumn("w", P.words_of(F.col("q")))
    every = [p for ps in K.INTENT_PATTERNS.values() for p in ps]
    cols = [c.alias(f"a{i}") for i, c in enumerate(P.matches_any(F.col("q"), F.col("w"), every))] + [F.col("q").rlike("(?i)" + p).alias(f"b{i}") for i, p in enumerate(every)]
    for r in df.select("q", *cols).collect():
        for i, p in enumerate(every):
            assert bool(r[f"a{i}"]) == r[f"b{i}"], (r.q, p)
