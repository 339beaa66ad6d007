"""Parent-child links to full hierarchies by pointer doubling.

Every node holds a pointer to an ancestor and what lies on the way to it.  One
round joins the pointers with themselves and so doubles the distance jumped;
a node whose pointer leaves the table is resolved.  After round r exactly the
nodes with 2**r or more ancestors are left.  Depths have no gaps (the parent
of a node of depth d has depth d-1), so the first round that resolves no node
leaves only nodes whose chain never ends: no bound on the depth is needed.

Defined results
* Rows without id are ignored.  Rows repeated under one id are one node; if
  they differ, the smallest non-null parent and the smallest name hold.
* A null parent, or one that is not in the table, ends the chain: the node is a
  root of depth 0.  A node that is its own parent is a cycle of one.
* Nodes on a cycle, or below one, have no path, depth and root, but a
  ``cycle_id``, the smallest id on that cycle.
* A null name counts as an empty segment.  Empty tables give empty results;
  extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.staging import Staged, stage


OPEN = "ptr is not null"


def _nodes(df: DataFrame, id_col: str, parent_col: str, *carry: Column) -> DataFrame:
    kept = df.select(F.col(id_col).alias("id"), F.col(parent_col).alias("ptr"), *carry).where("id is not null")
    extra = [c for c in kept.columns if c not in ("id", "ptr")]
    return kept.groupBy("id").agg(F.min("ptr").alias("ptr"), *[F.min(c).alias(c) for c in extra])


def _round(u: DataFrame) -> DataFrame:
    """Jump twice as far; nodes whose pointer leaves ``u`` drop out."""
    a, b = u.alias("a"), u.alias("b")
    return a.join(b, F.col("a.ptr") == F.col("b.id")).select(
        "a.id", "b.ptr", F.least("a.low", "b.low").alias("low"), (F.col("b.low") < F.col("a.low")).alias("moved")
    )


def unending_chains(df: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(id, cycle_id) of the nodes on a cycle of parent links or below one."""
    links = _nodes(df.where(F.col(parent_col).isNotNull()), id_col, parent_col)
    u = stage(links.withColumn("low", F.col("id")).withColumn("moved", F.lit(True)), n=F.count(F.lit(1)))
    n = u.seen["n"]
    while n:
        nxt = stage(_round(u.df), n=F.count(F.lit(1)))
        u.drop()
        u, left = nxt, nxt.seen["n"]
        if left == n:
            break
        n = left
    return _cycles(u, n)


def _cycles(u: Staged, n: int) -> DataFrame:
    """Name the cycle of each node of ``u``, all of whose chains are endless.

    The targets of the doubled pointers shrink to the nodes on cycles; when
    doubling leaves their number as it was, the jump permutes them, so they are
    the nodes on cycles.  When no running minimum moves either, the minimum at
    a node on a cycle is that of the cycle.
    """
    targets = -1
    while n:
        nxt = stage(_round(u.df))
        u.drop()
        u = nxt
        now, moved = u.df.agg(F.count_distinct("ptr"), F.count_if("moved")).first()
        if now == targets and not moved:
            break
        targets = now
    a, b = u.df.alias("a"), u.df.alias("b")
    return a.join(b, F.col("a.ptr") == F.col("b.id")).select("a.id", F.col("b.low").alias("cycle_id"))


def _known_parents(nodes: DataFrame) -> DataFrame:
    """The nodes, those whose parent is not among them without pointer."""
    there = nodes.select(F.col("id").alias("key"), F.lit(True).alias("there"))
    # the many nodes without a parent look for themselves, so they do not meet in one task
    keyed = nodes.withColumn("key", F.coalesce("ptr", "id"))
    return keyed.join(there, "key", "left").withColumn("ptr", F.when(F.col("there"), F.col("ptr"))).drop("key", "there")


def _chains(df: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(id, ids) of the resolved nodes: the ids from the root down.

    Each round joins the open nodes with all and writes those only; what it
    resolves becomes another part of the result.
    """
    start = _nodes(df, id_col, parent_col)
    # parents that are not in the table end the chain before the rounds begin, so these are inner joins,
    # in which the few open nodes of late rounds are broadcast if they are small
    nodes = _known_parents(start)
    n_open = F.count_if(F.expr(OPEN))
    s = stage(nodes.select("id", "ptr", F.array("id").alias("ids")), n=n_open)
    parts, open_, left = [s], s.df.where(OPEN), s.seen["n"]
    while left:
        # a node stands open in the parts before the one that resolves it
        done = Staged.together(parts).where(f"not ({OPEN})")
        a, b = open_.alias("a"), done.unionByName(open_).alias("b")
        jumped = stage(a.join(b, F.col("a.ptr") == F.col("b.id")).select("a.id", "b.ptr", F.concat("b.ids", "a.ids").alias("ids")), n=n_open)
        parts.append(jumped)
        open_, now = jumped.df.where(OPEN), jumped.seen["n"]
        if now == left:
            break
        left = now
    return Staged.together(parts).where(f"not ({OPEN})")


def hierarchy(df: DataFrame, id_col: str, parent_col: str, name_col: str, separator: str = "/") -> DataFrame:
    """(id, path, depth, root_id, n_descendants, cycle_id) of every node.

    A node carries the path and the distance to its pointer, and how many nodes
    lie less than a jump below it.  In each round every open node adds that
    number to its pointer, which so learns of those up to two jumps below.  A
    node that is pointed at in one round was so in the round before (by the
    pointer of who points at it now), so what a round joins with shrinks along
    with the open nodes.
    """
    start = _nodes(df, id_col, parent_col, F.coalesce(F.col(name_col), F.lit("")).alias("name"))
    nodes = _known_parents(start)
    is_open, one = F.expr(OPEN), F.lit(1).cast("long")
    s = stage(
        nodes.select(
            "id", "ptr", F.col("ptr").alias("parent"), F.col("name").alias("path"), F.when(is_open, 1).otherwise(0).alias("depth"),
            F.when(~is_open, F.col("id")).alias("root_id"), one.alias("n"),
        ),
        left=F.count_if(is_open),
    )
    done, shown = f"not ({OPEN})", ["id", "ptr", "path", "depth", "root_id"]
    parts, passed, open_, left = [s], [], s.df.where(OPEN), s.seen["left"]
    ends, before = s.df.where(done).select(*shown), None
    while left:
        # what lies below each pointer, one row a pointer
        below = stage(open_.groupBy(F.col("ptr").alias("id")).agg(F.sum("n").alias("more")))
        passed.append(below)
        # resolved nodes that some open one points at
        held = stage(ends.join(below.df.select("id"), "id", "left_semi"))
        if before is not None:
            before.drop()
        before = held
        a, b = open_.join(below.df, "id", "left").alias("a"), held.df.unionByName(open_.select(*shown)).alias("b")
        joined = a.join(b, F.col("a.ptr") == F.col("b.id"))
        jumped = stage(
            joined.select(
                "a.id", "b.ptr", "a.parent", F.concat_ws(separator, "b.path", "a.path").alias("path"), (F.col("a.depth") + F.col("b.depth")).alias("depth"), "b.root_id",
                (F.col("a.n") + F.coalesce("a.more", F.lit(0))).alias("n"),
            ),
            left=F.count_if(is_open),
        )
        parts.append(jumped)
        open_, now = jumped.df.where(OPEN), jumped.seen["left"]
        ends = held.df.unionByName(jumped.df.where(done).select(*shown))
        if now == left:
            break
        left = now
    resolved = Staged.together(parts).where(f"not ({OPEN})").select("id", "path", "depth", "root_id")
    if passed:
        counts = Staged.together(passed).groupBy("id").agg(F.sum("more").alias("n_descendants"))
        resolved = resolved.join(counts, "id", "left").withColumn("n_descendants", F.coalesce("n_descendants", F.lit(0).cast("long")))
    else:
        resolved = resolved.withColumn("n_descendants", F.lit(0).cast("long"))
    resolved = resolved.withColumn("cycle_id", F.lit(None).cast("string"))
    if not left:
        return resolved
    links = open_.select("id", F.col("parent").alias("ptr"), F.col("id").alias("low"), F.lit(True).alias("moved"))
    return resolved.unionByName(_cycles(stage(links), left), allowMissingColumns=True)


def descendants(df: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(ancestor_id, descendant_id, distance) of every node and all nodes above it, cycles left out."""
    trees = _chains(df, id_col, parent_col)
    up = trees.select("id", F.size("ids").alias("n"), F.posexplode("ids").alias("pos", "ancestor_id"))
    return up.where("pos < n - 1").select(
        "ancestor_id", F.col("id").alias("descendant_id"), (F.col("n") - 1 - F.col("pos")).alias("distance")
    )
