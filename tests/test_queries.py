"""Every query of the core against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from codelode import staging
from codelode.plans import catalog, catalog_impact, catalog_sources, core_problems, oracle_core

FOLDER = "/root/testdata/sf0.001"
QUERIES = core_problems.QUERIES | catalog.QUERIES | catalog_sources.QUERIES
SQL = oracle_core.SQL | catalog.SQL | catalog_sources.SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    with staging.cleared():
        df = QUERIES[name](spark, FOLDER)
        cols = sorted(df.columns)
        got = plain(df.select(*cols).collect())
    if name in SQL:
        r = db.execute(SQL[name])
        at = [[d[0] for d in r.description].index(c) for c in cols]
        assert got == plain(tuple(x[i] for i in at) for x in r.fetchall())


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["repository_id", "analysis_run_id", "path", "name", "change_kind"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_whole_texts_are_read(spark, tmp_path):
    far = "x" * 100
    spark.createDataFrame([(1, far + " what does this call and who calls it"), (3, far + " one two"), (5, "x" * 60 + " one")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("a", far + " one two")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    intents = {r.doc_id: r.intent for r in QUERIES["intent_classification"](spark, str(tmp_path)).collect()}
    assert intents[1] != "unknown" and intents[3] == "unknown"
    assert [tuple(r) for r in QUERIES["substring_theta_join"](spark, str(tmp_path)).select("item_id", "doc_id").collect()] == [("a", 3)]


def test_real_calls_meet_all_symbols(spark, tmp_path):
    spark.createDataFrame([("r", "a.py", "def f():\n    g()\n"), ("r", "b.py", "class g:\n    def h(self):\n        f()\n")], "repository_id string, path string, content string").write.parquet(f"{tmp_path}/file_info.parquet")
    edges = QUERIES["source_call_edges"](spark, str(tmp_path)).collect()
    assert sorted(r.line for r in edges) == [2, 3] and {r.src for r in edges} != {r.dst for r in edges}


def test_all_modules_register(spark):
    assert {"failure_correlation", "change_impact", "symbol_dependents_union", "implementation_plan"} <= set(QUERIES) and catalog_impact.SQL is catalog.SQL
