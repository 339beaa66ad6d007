"""Call and import graphs: edges by join, bounded traversal by one join for each level.

A traversal keeps a frontier and the nodes seen; each level is one join of the
frontier with the edges, an anti-join with what was seen, and is written to the
shared folder, so the plan stays short however deep the search goes.  Levels
end with an empty frontier or the depth, which is cut to MOST_DEPTH.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions import constants as K
from codelode.functions import text as X
from codelode.operators.ordering import top_of
from codelode.staging import Staged, stage

MOST_DEPTH = 10


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst, line): the caller is the symbol of that name in the call's file, the callee any of its name in the run."""
    caller = symbols.select(F.col("id").alias("src"), F.col("name").alias("caller_name"), "file_id", "analysis_run_id")
    callee = symbols.select(F.col("id").alias("dst"), F.col("name").alias("callee_name"), "analysis_run_id")
    return (
        calls.join(caller, ["caller_name", "file_id", "analysis_run_id"])
        .join(callee, ["callee_name", "analysis_run_id"])
        .select("src", "dst", F.col("line_number").alias("line"))
        .distinct()
    )


class Fixed(NamedTuple):
    """Distinct edges written once, for all levels and directions that read them."""

    df: DataFrame


def fix(edges: DataFrame | Fixed) -> Fixed:
    return edges if isinstance(edges, Fixed) else Fixed(stage(edges.select("src", "dst").distinct()).df)


def fixed(edges: DataFrame | Fixed) -> DataFrame:
    return fix(edges).df


def _levels(start: DataFrame, steps: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """Rows (keys, node, depth) reached from those of ``start`` by (keys of steps, node, next), each with its least depth.

    One job a level: it joins the frontier, leaves out what was seen, and counts
    what it writes; all levels are read again as one scan.
    """
    with_way = [c for c in keys if c in steps.columns]
    found = [stage(start.select(*keys, "node", F.lit(0).alias("depth")).distinct())]
    for level in range(1, depth + 1):
        nxt = (
            found[-1].df.join(steps, [*with_way, "node"])
            .select(*keys, F.col("next").alias("node"))
            .distinct()
            .join(Staged.together(found).select(*keys, "node"), [*keys, "node"], "left_anti")
            .withColumn("depth", F.lit(level))
        )
        t = stage(nxt, n=F.count(F.lit(1)))
        if not t.seen["n"]:
            break
        found.append(t)
    return Staged.together(found)


def reach(seeds: DataFrame, edges: DataFrame | Fixed, depth: int, direction: str = "down") -> DataFrame:
    """(seed, node, depth): nodes reached from each seed, with the least depth; the seed itself at 0.

    ``seeds`` has one column; ``edges`` has src and dst.
    """
    depth = min(max(depth, 1), MOST_DEPTH)
    a, b = ("src", "dst") if direction == "down" else ("dst", "src")
    steps = fixed(edges).select(F.col(a).alias("node"), F.col(b).alias("next"))
    seed = F.col(seeds.columns[0])
    return _levels(seeds.select(seed.alias("seed"), seed.alias("node")), steps, ["seed"], depth)


def reach_both(seeds: DataFrame, edges: DataFrame | Fixed, depth: int) -> DataFrame:
    """(way, seed, node, depth): as ``reach``, up and down in the same levels."""
    depth = min(max(depth, 1), MOST_DEPTH)
    e = fixed(edges)
    steps = e.select(F.lit("down").alias("way"), F.col("src").alias("node"), F.col("dst").alias("next")).unionByName(
        e.select(F.lit("up").alias("way"), F.col("dst").alias("node"), F.col("src").alias("next"))
    )
    seed = F.col(seeds.columns[0])
    start = seeds.select(F.explode(F.array(F.lit("down"), F.lit("up"))).alias("way"), seed.alias("seed"), seed.alias("node"))
    return _levels(start, steps, ["way", "seed"], depth)


def reached_edges(seeds: DataFrame, edges: DataFrame | Fixed, depth: int, direction: str = "down") -> DataFrame:
    """(seed, src, dst, depth): distinct edges within the depth, with the least depth at which each is taken."""
    depth = min(max(depth, 1), MOST_DEPTH)
    edges = fix(edges)
    nodes = reach(seeds, edges, depth - 1 if depth > 1 else 1, direction).where(F.col("depth") < depth)
    near = "src" if direction == "down" else "dst"
    return (
        edges.df
        .join(nodes.withColumnRenamed("node", near), near)
        .groupBy("seed", "src", "dst")
        .agg((F.min("depth") + 1).alias("depth"))
    )


def blast_radius(seeds: DataFrame, edges: DataFrame | Fixed, depth: int = 5) -> DataFrame:
    """(seed, node, depth, bucket): everything that calls the seed, directly (1) or not (2)."""
    found = reach(seeds, edges, depth, "up").where(F.col("depth") > 0)
    return found.withColumn("bucket", F.least("depth", F.lit(2)))


def impact(seeds: DataFrame, edges: DataFrame | Fixed, depth: int = 3, most_nodes: int = 500) -> DataFrame:
    """(seed, node, category, depth): callers before callees, each node in the first category that claims it."""
    r = reach_both(seeds, edges, depth).where(F.col("depth") > 0)
    direct, up = F.col("depth") == 1, F.col("way") == "up"
    rank = F.when(up, 0).otherwise(2) + F.when(direct, 0).otherwise(1)
    category = F.concat(F.when(direct, "direct_").otherwise("transitive_"), F.when(up, "caller").otherwise("callee"))
    first = r.groupBy("seed", "node").agg(F.min(F.struct(rank.alias("rank"), category.alias("category"), "depth")).alias("r"))
    rows = first.select("seed", "node", "r.rank", "r.category", "r.depth")
    return top_of(rows, ["seed"], most_nodes, F.col("rank"), F.col("depth"), F.col("node")).drop("rank")


def impact_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("seed").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("transitive"),
        F.count_if(F.col("category").contains("caller")).alias("callers"), F.count_if(F.col("category").contains("callee")).alias("callees"),
        (F.count_if(F.col("category").contains("caller")) > 0).alias("has_callers"),
    )


def workflow(seeds: DataFrame, edges: DataFrame | Fixed, depth: int = 5, most_nodes: int = 100, most_edges: int = 200) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and a summary of the graph below each seed, cut in the order of depth and id."""
    edges = fix(edges)
    found = reach(seeds, edges, depth)
    nodes = top_of(found, ["seed"], most_nodes, F.col("depth"), F.col("node"))
    taken = reached_edges(seeds, edges, depth)
    cut = top_of(taken, ["seed"], most_edges, F.col("depth"), F.col("src"), F.col("dst"))
    sizes = found.groupBy("seed").agg(F.count(F.lit(1)).alias("all_nodes"), F.max("depth").alias("depth"))
    n_edges = taken.groupBy("seed").agg(F.count(F.lit(1)).alias("all_edges"))
    total = F.coalesce("all_edges", F.lit(0).cast("long"))
    summary = sizes.join(n_edges, "seed", "left").select(
        "seed", "depth", F.least("all_nodes", F.lit(most_nodes)).alias("nodes"), F.least(total, F.lit(most_edges)).alias("edges"),
        F.when(F.col("all_nodes") > most_nodes, "max_nodes_reached").when(total > most_edges, "max_edges_reached").alias("reason"),
    )
    return nodes, cut, summary


def tree_paths(seeds: DataFrame, edges: DataFrame | Fixed, depth: int = 3) -> DataFrame:
    """(seed, node, depth, path, again): calls unfolded from the seed, each node opened once for a seed.

    A node is opened where it stands least deep, below the smallest caller
    there; wherever else it stands it is shown once more and not opened.  So the
    tree has a row for each edge that is taken, however many ways there are.
    """
    steps = fixed(edges).select(F.col("src").alias("node"), F.col("dst").alias("next"))
    seed = seeds.columns[0]
    start = seeds.select(F.col(seed).alias("seed"), F.col(seed).alias("node"), F.lit(0).alias("depth"), F.array(seed).alias("path"), F.lit(False).alias("again"))
    levels = [stage(start.distinct())]
    for level in range(1, min(depth, MOST_DEPTH) + 1):
        opened = Staged.together(levels).where("not again").select("seed", F.col("node").alias("next"), F.lit(True).alias("seen"))
        first = F.row_number().over(Window.partitionBy("seed", "next").orderBy("node")) == 1
        nxt = levels[-1].df.where("not again").join(steps, "node").join(opened, ["seed", "next"], "left").withColumn("first", first)
        t = stage(
            nxt.select("seed", F.col("next").alias("node"), F.lit(level).alias("depth"), F.concat("path", F.array("next")).alias("path"), (F.col("seen").isNotNull() | ~F.col("first")).alias("again")),
            n=F.count(F.lit(1)),
        )
        if not t.seen["n"]:
            break
        levels.append(t)
    return Staged.together(levels)


# --- imports -----------------------------------------------------------------------------------


def _joined(folder: Column, rest: Column) -> Column:
    return F.when(folder == "", rest).otherwise(F.concat(folder, F.lit("/"), rest))


def import_target(importer: Column, source: Column) -> Column:
    """Path that a relative import names, without suffix; null if it is not relative or climbs too far."""
    folder = X.directory(importer)
    ups = F.size(F.split(source, r"\.\./")) - 1
    rest = F.regexp_replace(source, r"^(\./|(\.\./)+)", "")
    parts = F.filter(F.split(folder, "/"), lambda s: s != "")
    kept = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - ups, F.lit(0))), "/")
    return F.when(F.startswith(source, F.lit("./")), _joined(folder, rest)).when(
        F.startswith(source, F.lit("../")) & (ups <= F.size(parts)), _joined(kept, rest)
    )


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(analysis_run_id, importer, source, target, kind): files that relative imports name, else one external module.

    ``imports`` has analysis_run_id, path, source; ``files`` has analysis_run_id, path.
    """
    rows = imports.select("analysis_run_id", F.col("path").alias("importer"), "source").distinct()
    base = import_target(F.col("importer"), F.col("source"))
    tries = F.transform(F.array(*[F.lit(s) for s in K.IMPORT_SUFFIXES]), lambda s: F.concat(base, s))
    hits = rows.select("*", F.explode(tries).alias("target")).join(
        files.select("analysis_run_id", F.col("path").alias("target")).distinct(), ["analysis_run_id", "target"], "left_semi"
    ).withColumn("kind", F.lit("file"))
    outside = rows.join(hits, ["analysis_run_id", "importer", "source"], "left_anti").select("*", F.col("source").alias("target"), F.lit("external_module").alias("kind"))
    return hits.select(*outside.columns).unionByName(outside)


# --- lookups -----------------------------------------------------------------------------------


def contains_links(symbols: DataFrame) -> DataFrame:
    """(source_id, target_id): class contains method, by the parent link."""
    classes = symbols.where(F.col("symbol_type") == "class").select(F.col("id").alias("source_id"))
    methods = symbols.where(F.col("symbol_type") == "method").select(F.col("id").alias("target_id"), F.col("parent_symbol_id").alias("source_id"))
    return methods.join(classes.distinct(), "source_id").select("source_id", "target_id").distinct()


def qualified_names(symbols: DataFrame) -> DataFrame:
    """Each symbol with its parent's name before its own."""
    parent = symbols.select(F.col("id").alias("parent_symbol_id"), F.trim("name").alias("parent_name")).groupBy("parent_symbol_id").agg(F.min("parent_name").alias("parent_name"))
    return symbols.join(parent, "parent_symbol_id", "left").withColumn("qualified_name", F.concat_ws(".", "parent_name", F.trim("name")))


def resolve_handlers(endpoints: DataFrame, symbols: DataFrame) -> DataFrame:
    """Endpoints with the handler's symbol: a function before a method before an arrow function of that name and file."""
    order = F.when(F.col("symbol_type") == "function", 0).when(F.col("symbol_type") == "method", 1).when(F.col("symbol_type") == "arrow_function", 2)
    best = (
        symbols.select("file_id", F.col("name").alias("handler_name"), order.alias("rank"), F.col("id").alias("symbol_id"))
        .where("rank is not null")
        .groupBy("file_id", "handler_name")
        .agg(F.min(F.struct("rank", "symbol_id"))["symbol_id"].alias("symbol_id"))
    )
    return endpoints.join(best, ["file_id", "handler_name"], "left")
