"""What a change reaches: neighbours, files, endpoints and workflows beyond the symbols themselves.

``symbols`` has id, name, path, symbol_type; ``calls`` has src and dst, ids of
symbols; ``imports`` has src and dst, paths of files; ``endpoints`` has
symbol_id, method, route, file_path.  Everything is a join of these tables with
the levels of a traversal, for all seeds at once.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions import predicates as P
from codelode.operators import change, graph
from codelode.operators.ordering import top_of
from codelode.staging import Staged, spread, stage

NODES, EDGES = 500, 1000
# Most rows of a change set that go into one list, and most files of workflows in one broadcast.
MOST_TOGETHER, MOST_LOADED = 1000, 500_000


def _rows(df: DataFrame, relation: str, seed: str, target: str) -> DataFrame:
    return df.select(F.col(seed).alias("seed"), F.lit(relation).alias("relation"), F.col(target).cast("string").alias("target"))


def file_imports(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst): files whose symbols call into another file."""
    where = symbols.select("id", "path")
    a, b = where.toDF("src", "from_path"), where.toDF("dst", "to_path")
    joined = calls.join(a, "src").join(b, "dst").where("from_path <> to_path")
    return joined.select(F.col("from_path").alias("src"), F.col("to_path").alias("dst")).distinct()


def dependencies(seeds: DataFrame, calls: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(seed, relation, target): what each symbol calls, and what its file imports."""
    s = seeds.select(F.col(seeds.columns[0]).alias("seed"))
    called = calls.join(s, calls["src"] == s["seed"])
    own = s.join(symbols.select(F.col("id").alias("seed"), F.col("path").alias("src")), "seed")
    return _rows(called, "calls", "seed", "dst").unionByName(_rows(own.join(imports, "src"), "imports", "seed", "dst")).distinct()


def dependents(seeds: DataFrame, calls: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(seed, relation, target): what calls each symbol, and the files that import its file."""
    s = seeds.select(F.col(seeds.columns[0]).alias("seed"))
    callers = calls.join(s, calls["dst"] == s["seed"])
    own = s.join(symbols.select(F.col("id").alias("seed"), F.col("path").alias("dst")), "seed")
    return _rows(callers, "callers", "seed", "src").unionByName(_rows(own.join(imports, "dst"), "imported_by", "seed", "src")).distinct()


def file_impact(path: str, calls: DataFrame, imports: DataFrame, symbols: DataFrame, depth: int = 3) -> DataFrame:
    """(category, entity, depth): files that import a file, files it imports, callers of its symbols; the first category holds."""
    seed = symbols.where(F.col("path") == path).select("path").distinct().limit(1)
    found = graph.reach_both(seed, imports, depth).where(F.col("depth") > 0)
    files = found.select(
        F.when(F.col("way") == "up", "dependent_file").otherwise("dependency_file").alias("category"), F.col("node").alias("entity"), "depth", F.when(F.col("way") == "up", 0).otherwise(1).alias("rank")
    )
    own = symbols.where(F.col("path") == path).select(F.col("id").alias("dst"))
    callers = calls.join(own, "dst").select(F.col("src").alias("id")).distinct().join(own.withColumnRenamed("dst", "id"), "id", "left_anti")
    called = callers.select(F.lit("direct_caller").alias("category"), F.col("id").cast("string").alias("entity"), F.lit(1).alias("depth"), F.lit(2).alias("rank"))
    best = files.unionByName(called).groupBy("entity").agg(F.min(F.struct("rank", "category", "depth")).alias("r"))
    return best.select("r.category", "entity", "r.depth")


def endpoint_impact(endpoints: DataFrame, calls: DataFrame, depth: int = 3) -> DataFrame:
    """(method, route, node, category, depth): impact of the handler of each endpoint, with the endpoint it belongs to."""
    found = graph.impact(endpoints.select(F.col("symbol_id").alias("seed")).distinct(), calls, depth, NODES)
    return endpoints.select("method", "route", F.col("symbol_id").alias("seed")).join(found, "seed").select("method", "route", "node", "category", "depth")


def affected(found: DataFrame, symbols: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(seed, kind, value): files and endpoints of the impacted symbols and of the seed; ``found`` has seed and node."""
    nodes = found.select("seed", F.col("node").alias("id")).unionByName(found.select("seed", F.col("seed").alias("id"))).distinct()
    files = nodes.join(symbols.select("id", "path"), "id").select("seed", F.lit("file").alias("kind"), F.col("path").alias("value"))
    ends = nodes.join(endpoints.withColumnRenamed("symbol_id", "id"), "id").select("seed", F.lit("endpoint").alias("kind"), F.concat_ws(" ", "method", "route").alias("value"))
    return files.unionByName(ends).distinct()


def bounded(seeds: DataFrame, calls: DataFrame, depth: int = 3, most_nodes: int = NODES, most_edges: int = EDGES) -> DataFrame:
    """(seed, nodes, edges, reason): size of the impact of each seed and which bound cuts it first."""
    e = graph.fix(calls)
    both = graph.reach_both(seeds, e, depth)
    n = both.where(F.col("depth") > 0).groupBy("seed").agg(F.count_distinct("node").alias("n"))
    inner = both.where(F.col("depth") < depth)
    down = inner.where("way = 'down'").select("seed", F.col("node").alias("src")).join(e.df, "src").select("seed", "src", "dst")
    up = inner.where("way = 'up'").select("seed", F.col("node").alias("dst")).join(e.df, "dst").select("seed", "src", "dst")
    m = down.unionByName(up).distinct().groupBy("seed").agg(F.count(F.lit(1)).alias("m"))
    zero = F.lit(0).cast("long")
    sized = both.select("seed").distinct().join(n, "seed", "left").join(m, "seed", "left").select("seed", F.coalesce("n", zero).alias("n"), F.coalesce("m", zero).alias("m"))
    reason = F.when(F.col("n") > most_nodes, "max_nodes_reached").when(F.col("m") > most_edges, "max_edges_reached")
    return sized.select("seed", F.least("n", F.lit(most_nodes)).alias("nodes"), F.least("m", F.lit(most_edges)).alias("edges"), reason.alias("reason"))


def change_set_dependencies(changed: DataFrame, calls: DataFrame, symbols: DataFrame, by: str, most: int = NODES) -> DataFrame:
    """(by, kind, n, truncated): distinct callers, callees and their files of the public symbols each change set touches; a kind without any gives no row."""
    public = symbols.where(P.is_public_symbol(F.col("name"), F.col("symbol_type"))).select("id", "path")
    own = changed.select(by, "path").distinct().join(public, "path").select(by, "id")
    near = own.join(calls.withColumnRenamed("dst", "id"), "id").select(by, F.lit("callers").alias("kind"), F.col("src").alias("node")).unionByName(
        own.join(calls.withColumnRenamed("src", "id"), "id").select(by, F.lit("callees").alias("kind"), F.col("dst").alias("node"))
    ).distinct()
    files = near.select(by, F.col("node").alias("id")).distinct().join(symbols.select("id", "path"), "id").groupBy(by).agg(F.count_distinct("path").alias("n")).select(by, F.lit("files").alias("kind"), "n")
    counts = near.groupBy(by, "kind").agg(F.count(F.lit(1)).alias("n")).unionByName(files)
    return counts.select(by, "kind", F.least("n", F.lit(most)).alias("n"), (F.col("n") >= most).alias("truncated"))


def endpoint_workflow(endpoints: DataFrame, calls: DataFrame, depth: int = 5, most_nodes: int = 100, most_edges: int = 200) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the workflow of each endpoint: it handles to its symbol, which calls on; cut in the order of depth and id."""
    key = F.concat_ws(" ", "method", "route")
    e = graph.fix(calls)
    seeds = endpoints.select(F.col("symbol_id").alias("seed")).distinct()
    nodes, edges, _ = graph.workflow(seeds, e, depth, most_nodes - 1, most_edges - 1)
    named = endpoints.select(key.alias("endpoint"), F.col("symbol_id").alias("seed")).distinct()
    text = lambda c: F.col(c).cast("string")
    inner = nodes.join(named, "seed").select("endpoint", text("node").alias("node"), (F.col("depth") + 1).alias("depth"))
    start = named.select("endpoint", F.col("endpoint").alias("node"), F.lit(0).alias("depth"))
    handles = named.select("endpoint", F.col("endpoint").alias("src"), text("seed").alias("dst"), F.lit("handles").alias("kind"), F.lit(1).alias("depth"))
    called = edges.join(named, "seed").select("endpoint", text("src").alias("src"), text("dst").alias("dst"), F.lit("calls").alias("kind"), (F.col("depth") + 1).alias("depth"))
    return start.unionByName(inner), handles.unionByName(called)


def _bit(number: Column) -> Column:
    """One of 64 bits for each number; lists whose bits do not meet share no number."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(number).bitwiseAND(F.lit(63)).cast("int"))


class Flows(NamedTuple):
    """Workflows by the files they lie in.

    ``df`` has a row for each route and file (id) that declares it: ``own``
    counts its symbols in that file, ``far0``, ``far1`` ... list the other files
    whose counts have that binary digit, ``bits`` are those of all these files,
    and ``shared`` marks routes of several files.  ``known`` numbers the paths.
    """

    df: DataFrame
    known: DataFrame
    digits: int
    blocks: int
    shared: bool


def _flows(endpoints: DataFrame, nodes: DataFrame, symbols: DataFrame) -> Flows:
    where = symbols.select(F.col("id").alias("node"), F.col("path").alias("other"))
    # the files of each workflow first: a change set meets files, not symbols
    counted = nodes.join(where, "node").groupBy("seed", "other").agg(F.count(F.lit(1)).alias("n"))
    ends = endpoints.select("method", "route", F.col("symbol_id").alias("seed"), F.col("file_path").alias("path")).where("path is not null")
    links = stage(ends.join(counted, "seed", "left").groupBy("method", "route", "path", "other").agg(F.sum("n").alias("n")), most=F.max("n"))
    paths = links.df.select("path").unionByName(links.df.select(F.col("other").alias("path"))).where("path is not null").distinct()
    known = stage(paths.withColumn("id", F.monotonically_increasing_id())).df
    numbered = links.df.join(known, "path").join(known.select(F.col("path").alias("other"), F.col("id").alias("at")), "other", "left")
    digits, far, zero = (links.seen["most"] or 0).bit_length(), F.col("at") != F.col("id"), F.lit(0).cast("long")
    rows = numbered.groupBy("method", "route", "id").agg(
        F.coalesce(F.sum(F.when(F.col("at") == F.col("id"), F.col("n"))), zero).alias("own"),
        F.coalesce(F.bit_or(F.when(far, _bit(F.col("at")))), zero).alias("bits"), F.count(F.lit(1)).alias("files"),
        *[F.collect_list(F.when(far & (F.col("n").bitwiseAND(F.lit(1 << k)) != 0), F.col("at"))).alias(f"far{k}") for k in range(digits)],
    )
    several = F.count(F.lit(1)).over(Window.partitionBy("method", "route")) > 1
    t = stage(rows.withColumn("shared", several), files=F.sum("files"), shared=F.count_if("shared"))
    return Flows(t.df.drop("files"), known, digits, max(1, -(-(t.seen["files"] or 0) // MOST_LOADED)), t.seen["shared"] > 0)


def _files_of_sets(changed: DataFrame, known: DataFrame, by: str) -> Staged:
    """(by, wide, files, set_bits): the numbered files of each change set; one of more than MOST_TOGETHER rows is wide, its list is not whole."""
    each = Window.partitionBy(by)
    rows = changed.select(by, "path").join(known, "path").select(by, "id").repartition(by)
    lists = rows.select(by, "id", F.row_number().over(each.orderBy(by)).alias("k")).select(
        by, "k", (F.max("k").over(each) > MOST_TOGETHER).alias("wide"),
        F.collect_set(F.when(F.col("k") <= MOST_TOGETHER, F.col("id"))).over(each).alias("files"), F.bit_or(_bit(F.col("id"))).over(each).alias("set_bits"),
    )
    return stage(lists.where("k = 1").drop("k"), wide=F.count_if("wide"))


def _met(sets: DataFrame, flows: Flows, shared: bool, by: str) -> DataFrame:
    """Each set with the routes of its files; lists are compared only where their bits meet."""
    rows = sets.select(by, "files", "set_bits", F.explode("files").alias("id"))
    own, far = F.col("own"), [F.size(F.array_intersect("files", f"far{k}")).cast("long") * (1 << k) for k in range(flows.digits)]
    # a set without a name meets nothing
    met = F.when(F.col(by).isNull(), 0).when(F.col("set_bits").bitwiseAND(F.col("bits")) == 0, own).otherwise(reduce(Column.__add__, far, own))
    some, block = flows.df.where(F.col("shared") == shared), F.pmod(F.xxhash64("method", "route"), F.lit(flows.blocks))
    hit = [rows.join(F.broadcast(some.where(block == k)), "id").select(by, "method", "route", met.alias("n_changed")) for k in range(flows.blocks)]
    return reduce(DataFrame.unionByName, hit)


def _met_by_joins(changed: DataFrame, wide: DataFrame, flows: Flows, by: str) -> DataFrame:
    """As ``_met`` for wide sets, in rows still to be summed."""
    names = wide.select(F.col(by).alias("name"))
    rows = changed.select(by, "path").join(flows.known, "path").select(by, "id").distinct()
    files = stage(rows.join(names, rows[by].eqNullSafe(names["name"]), "left_semi")).df
    hit = files.join(flows.df, "id")
    parts = [hit.select(by, "method", "route", F.when(F.col(by).isNull(), 0).otherwise(F.col("own")).alias("n_changed"))]
    for k in range(flows.digits):
        far = hit.select(by, "method", "route", F.explode(f"far{k}").alias("id")).join(files, [by, "id"], "left_semi")
        parts.append(far.select(by, "method", "route", F.lit(1 << k).cast("long").alias("n_changed")))
    return reduce(DataFrame.unionByName, parts)


def affected_workflows(endpoints: DataFrame, calls: DataFrame, symbols: DataFrame, changed: DataFrame, by: str, depth: int = 3) -> DataFrame:
    """(by, method, route, n_changed): workflows of endpoints in changed files, with the symbols in them that changed.

    There is a row for each change set and endpoint in its files, far more than
    rows read, so these are not shuffled: each set brings the list of its files
    to the endpoints, which are broadcast block by block.  Only wide sets and
    routes of several files are joined and summed.
    """
    nodes = graph.reach(endpoints.select(F.col("symbol_id").alias("seed")).distinct(), calls, depth)
    flows = _flows(endpoints, nodes, symbols)
    sets = _files_of_sets(changed, flows.known, by)
    narrow = spread(sets.df, by).where("not wide")
    found = _met(narrow, flows, False, by)
    summed = [_met(narrow, flows, True, by)] if flows.shared else []
    if sets.seen["wide"]:
        summed.append(_met_by_joins(changed, sets.df.where("wide"), flows, by))
    if summed:
        found = found.unionByName(reduce(DataFrame.unionByName, summed).groupBy(by, "method", "route").agg(F.sum("n_changed").alias("n_changed")))
    return found


def change_facts(changed: DataFrame, symbols: DataFrame, endpoints: DataFrame, by: str) -> DataFrame:
    """``changed`` with the counts of its set: endpoints and workflows of changed files, public symbols in them."""
    paths = changed.select(by, "path").distinct()
    public = symbols.where(P.is_public_symbol(F.col("name"), F.col("symbol_type"))).groupBy("path").agg(F.count(F.lit(1)).alias("p"))
    ends = endpoints.groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("e"), F.count("symbol_id").alias("w"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(name)
    counts = paths.join(public, "path", "left").join(ends, "path", "left").groupBy(by).agg(total("e", "n_endpoints"), total("p", "n_public"), total("w", "n_workflows"))
    return changed.join(counts, by)


def change_impact(changed: DataFrame, symbols: DataFrame, endpoints: DataFrame, by: str) -> DataFrame:
    """One row a change set: files, symbols, endpoints, workflows, tests, score, level and signals."""
    facts = change_facts(changed, symbols, endpoints, by)
    scored = change.risk(facts, F.col("n_endpoints"), F.col("n_public"), F.col("n_workflows"), by)
    sizes = facts.groupBy(by).agg(
        F.count_distinct("path").alias("n_files"), F.count_distinct(F.when(P.is_changed_test(F.col("path")), F.col("path"))).alias("n_tests"),
        F.max("n_endpoints").alias("n_endpoints"), F.max("n_public").alias("n_public"), F.max("n_workflows").alias("n_workflows"),
    )
    return sizes.join(scored, by)


# Steps of a plan, in order, with what a change must have for each.
PLAN = (
    ("review_changed_files", "n_files > 0"), ("check_public_symbols", "n_public > 0"), ("check_endpoints", "n_endpoints > 0"),
    ("follow_workflows", "n_workflows > 0"), ("update_tests", "n_tests = 0"), ("run_tests", "n_files > 0"),
)


def implementation_plan(facts: DataFrame, by: str) -> DataFrame:
    """(by, risk, position, step): the steps that hold for each change set, in order; ``facts`` as from ``change_impact``."""
    steps = F.array_compact(F.array(*[F.when(F.expr(c), name) for name, c in PLAN]))
    impacts = F.col("n_public") + F.col("n_endpoints")
    risk = F.when((F.col("n_endpoints") > 0) | (impacts > 20), "high").when(impacts == 0, "low").otherwise("medium")
    return facts.select(by, risk.alias("risk"), F.posexplode(steps).alias("position", "step"))


def by_category(found: DataFrame, label: Column, most: int = 20) -> DataFrame:
    """(seed, category, n, listed): impacts of each category, the first in order written out, the rest counted."""
    rows = found.select("seed", "category", label.alias("label"))
    first = top_of(rows, ["seed", "category"], most, F.col("label")).groupBy("seed", "category").agg(F.array_join(F.sort_array(F.collect_list("label")), ", ").alias("head"))
    n = rows.groupBy("seed", "category").agg(F.count(F.lit(1)).alias("n"))
    more = F.when(F.col("n") > most, F.concat(F.lit(" ... "), (F.col("n") - most).cast("string"), F.lit(" more"))).otherwise("")
    return n.join(first, ["seed", "category"]).select("seed", "category", "n", F.concat("head", more).alias("listed"))
