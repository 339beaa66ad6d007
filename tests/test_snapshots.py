from datetime import datetime as D

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from codelode.operators import snapshots as S

RUN = "id string, repository_id string, status string, started_at timestamp_ntz, path string"
FILE = "id string, path string, analysis_run_id string, repository_id string, name string"
SYMBOL = "id string, file_id string, analysis_run_id string, name string, symbol_type string, start_line int, end_line int, parent_symbol_id string, path string"


@given(st.sets(st.integers(0, S.SPAN - 1), max_size=3000), st.booleans())
@settings(max_examples=60, deadline=None)
def test_bitmap_round_trip(bits, dense):
    a = np.array(sorted(bits | (set(range(100, 9000)) if dense else set())), np.int64)
    assert S.members(S.unpack(S.pack(a))).tolist() == a.tolist()


def test_bitmap_forms():
    assert S.pack(np.arange(20000))[:1] == b"R"
    assert S.pack(np.arange(0, 100, 7))[:1] == b"L"
    assert S.pack(np.arange(0, 32768, 3))[:1] == b"B"


@given(st.dictionaries(st.integers(0, 500), st.integers(0, 3)), st.dictionaries(st.integers(0, 500), st.integers(0, 3)))
@settings(max_examples=60, deadline=None)
def test_differences(a, b):
    enc = lambda d: (S.pack(np.array(sorted(d), np.int64)), np.array([d[k] for k in sorted(d)], "<i8").tobytes())
    added, removed, changed = (x.tolist() for x in S.differences(*enc(a), *enc(b)))
    assert added == sorted(b.keys() - a.keys()) and removed == sorted(a.keys() - b.keys())
    assert changed == sorted(k for k in a.keys() & b.keys() if a[k] != b[k])


def test_ordinals_persist(spark):
    keys = spark.createDataFrame([("r", f"k{i}") for i in range(50)] * 2, "a string, b string")
    first = S.assign_ordinals(keys)
    old = {r.b: r.ordinal for r in first.collect()}
    assert sorted(old.values()) == list(range(50))
    second = S.assign_ordinals(keys.union(spark.createDataFrame([("r", "a0")], "a string, b string")), first)
    new = {r.b: r.ordinal for r in second.collect()}
    assert {k: new[k] for k in old} == old and new["a0"] == 50


def run(i, day, status="completed", repo="r"):
    return (i, repo, status, D(2024, 1, day), "clash")


def test_changes(spark, rows):
    runs = spark.createDataFrame([run("1", 1), run("1", 1), run("x", 2, "failed"), run("2", 3, "completed_with_warnings"), run("3", 4), run("4", 5), ("q", None, "completed", D(2024, 1, 1), "")], RUN)
    files = spark.createDataFrame([("f1", "./a//b.py", "1", "r", "n"), ("f2", "a\\b.py", "2", "r", "n"), ("f2", "a\\b.py", "2", "r", "n"), ("f4", "a/b.py", "4", "r", "n"), ("fn", None, "2", "r", "n")], FILE)
    sym = lambda i, f, r, n, t="function", a=1, b=5, p=None: (i, f, r, n, t, a, b, p, "clash")
    symbols = spark.createDataFrame([
        sym("a", "f1", "1", "same "), sym("b", "f1", "1", "gone"), sym("c", "f1", "1", "grown"), sym("d", "f1", "1", "typed"),
        sym("e", "f2", "2", "same", a=11, b=15, p="z"), sym("e", "f2", "2", "same", a=11, b=15, p="z"), sym("e2", "f2", "2", "\tsame", a=11, b=15),
        sym("f", "f2", "2", "grown", b=6), sym("g", "f2", "2", "typed", "method"), sym("h", "f2", "2", "new"), sym("i", "f2", "x", "unseen"),
        sym("j", "fn", "2", "nopath"), sym("k", "f2", "2", None), sym("l", "missing", "2", "nofile"), sym("m", "f4", "4", "same"),
    ], SYMBOL)
    found = rows(S.snapshot_changes(symbols, files, runs), "analysis_run_id", "path", "name", "change_kind")
    p = "a/b.py"
    assert found == sorted([
        ("2", p, "gone", "removed"), ("2", p, "grown", "changed"), ("2", p, "typed", "changed"), ("2", p, "new", "added"),
        ("3", p, "same", "removed"), ("3", p, "grown", "removed"), ("3", p, "typed", "removed"), ("3", p, "new", "removed"), ("4", p, "same", "added"),
    ], key=repr)


def test_empty(spark, rows):
    e = [spark.createDataFrame([], s) for s in (SYMBOL, FILE, RUN)]
    assert rows(S.snapshot_changes(*e)) == []


def test_one_known_key(spark):
    """A largest known ordinal of 0 is one, too."""
    first = S.assign_ordinals(spark.createDataFrame([("a",)], "k string"))
    got = {r.k: r.ordinal for r in S.assign_ordinals(spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), first).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_store_keeps_ordinals(spark, rows, tmp_path):
    """Deliveries that bring nothing, one key, and many keys; no key is numbered twice or anew."""
    store = S.OrdinalStore(spark, f"file://{tmp_path}/keys")
    keys = lambda *k: spark.createDataFrame([(x, x * 2) for x in k], "a string, b string")
    get = lambda df: {r.a: r.ordinal for r in df.collect()}
    assert get(store.assign(keys("m"))) == {"m": 0}
    assert get(store.assign(keys("m"))) == {"m": 0} and len(store.parts()) == 1
    second = get(S.OrdinalStore(spark, store.path).assign(keys("m", "a", "z", "z")))
    assert second == {"m": 0, "a": 1, "z": 2}
    third = get(store.assign(keys(*(f"k{i}" for i in range(40)))))
    assert {k: third[k] for k in second} == second and sorted(third.values()) == list(range(43))
    assert get(S.OrdinalStore(spark, f"file://{tmp_path}/none").assign(keys())) == {}


def test_store_gives_the_same_changes(spark, rows, tmp_path):
    import random

    r = random.Random(2)
    runs, files, symbols, states = [], [], [], {}
    for repo in "pq":
        for n in range(1, 8):
            run_id = f"{repo}{n}"
            runs.append((run_id, repo, "completed", D(2024, 1, n), ""))
            files.append((f"f{run_id}", "a/b.py", run_id, repo, ""))
            states[repo, n] = {f"s{k}": r.randrange(1, 4) for k in range(r.randrange(0, 30)) if r.random() < 0.5} if n != 4 else {}
            symbols += [(f"{run_id}{k}", f"f{run_id}", run_id, k, "function", 1, v, None, "") for k, v in states[repo, n].items()]
    want = set()
    for repo in "pq":
        for n in range(2, 8):
            a, b = states[repo, n - 1], states[repo, n]
            want |= {(repo, f"{repo}{n}", "a/b.py", k, "added" if k not in a else "removed" if k not in b else "changed") for k in a.keys() | b.keys() if a.get(k) != b.get(k)}
    tables = [spark.createDataFrame(x, s) for x, s in ((symbols, SYMBOL), (files, FILE), (runs, RUN))]
    store = S.OrdinalStore(spark, f"file://{tmp_path}/keys")
    some = [tables[0].where("name < 's2'"), *tables[1:]]
    S.snapshot_changes(*some, store).collect()
    for s in (None, store, store):
        assert set(rows(S.snapshot_changes(*tables, s), "repository_id", "analysis_run_id", "path", "name", "change_kind")) == want
    assert len(store.parts()) == 2
