import random

from codelode.operators import hierarchy as H

SCHEMA = "id string, parent_symbol_id string, name string, path string, ptr string, low string, depth string"


def frame(spark, links, names=None):
    return spark.createDataFrame([(i, p, (names or {}).get(i, f"n{i}"), "clash", "clash", "clash", "clash") for i, p in links], SCHEMA)


def brute(links):
    parent = dict(links)
    out = {}
    for i in parent:
        seen, at = [i], parent[i]
        while at is not None and at in parent and at not in seen:
            seen.append(at)
            at = parent[at]
        loop = at is not None and at in parent
        out[i] = (min(seen[seen.index(at):]) if loop else None, None if loop else seen[::-1])
    return out


def check(spark, links):
    df = frame(spark, links)
    want = brute(links)
    got = {r.id: r.cycle_id for r in H.unending_chains(df, "id", "parent_symbol_id").collect()}
    assert got == {i: c for i, (c, _) in want.items() if c}
    tree = {r.id: r for r in H.hierarchy(df, "id", "parent_symbol_id", "name").collect()}
    assert set(tree) == set(want)
    below = {}
    for i, (c, chain) in want.items():
        for a in (chain or [])[:-1]:
            below[a] = below.get(a, 0) + 1
    for i, (c, chain) in want.items():
        r = tree[i]
        if c:
            assert (r.cycle_id, r.path, r.depth) == (c, None, None)
        else:
            assert (r.path, r.depth, r.root_id, r.n_descendants) == ("/".join("n" + x for x in chain), len(chain) - 1, chain[0], below.get(i, 0))
    pairs = {(r.ancestor_id, r.descendant_id, r.distance) for r in H.descendants(df, "id", "parent_symbol_id").collect()}
    assert pairs == {(a, i, len(ch) - 1 - k) for i, (_, ch) in want.items() if ch for k, a in enumerate(ch[:-1])}


def test_random_forest_with_cycles(spark):
    r = random.Random(5)
    links = [(f"{i:03}", f"{r.randrange(-20, 150):03}" if r.random() < 0.9 else None) for i in range(150)]
    check(spark, links)


def test_cycles_of_every_length_and_long_chain(spark):
    links = [("s", "s")]
    for n in (2, 3, 4, 8):
        links += [(f"c{n}-{k}", f"c{n}-{(k + 1) % n}") for k in range(n)]
    links += [("t0", "c8-3")] + [(f"t{k}", f"t{k - 1}") for k in range(1, 11)]
    links += [("d0", "missing")] + [(f"d{k}", f"d{k - 1}") for k in range(1, 40)]
    check(spark, links)


def test_repeats_nulls_and_empty(spark, rows):
    df = frame(spark, [("a", None), ("a", "b"), ("b", None), ("b", None), (None, "a")], {"b": None})
    got = {r.id: (r.path, r.depth) for r in H.hierarchy(df, "id", "parent_symbol_id", "name").collect()}
    assert got == {"a": ("/na", 1), "b": ("", 0)}
    empty = spark.createDataFrame([], SCHEMA)
    assert rows(H.unending_chains(empty, "id", "parent_symbol_id")) == []
    assert rows(H.hierarchy(empty, "id", "parent_symbol_id", "name")) == []
    assert rows(H.descendants(empty, "id", "parent_symbol_id")) == []


def test_hot_parent(spark):
    check(spark, [("root", None)] + [(f"k{i}", "root") for i in range(300)])
