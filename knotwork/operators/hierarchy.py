"""Parent-child rows to full hierarchies, by fragment contraction.

A node has one parent.  The nodes are dealt to partitions; inside each one,
every chain of parents is followed to where it leaves the partition (the
fragment's *exit*).  Only nodes that others enter a fragment by remain: with
their exits they form a smaller forest, the *quotient*, which is solved by the
same step recursively and without fragments once it fits in one partition.
Expanding puts the answer of each exit behind the local path of every node.

Dealing by hash alone would leave most parents in another partition, so a
node with a "tails" mark moves to its parent's partition when the parent has a
"heads" mark (marks are hashes that change by level): about a quarter of the
entered nodes vanish at each level, whatever the shape.  A parent with more
than ``HOT_CHILDREN`` children draws none of them, so no partition grows with
the largest family; nodes that nobody enters vanish at once.

Cycles: a local chain that returns to itself is a cycle inside a fragment; a
cycle through fragments shows as a cycle of the quotient and is expanded to
the nodes between its entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.session import Scratch

#: nodes that one task holds while it follows chains
FRAGMENT_ROWS = 20_000
#: children beyond which a parent draws none of them to its partition
HOT_CHILDREN = 1_000

_STEP = T.StructType(
    [
        T.StructField("tree", T.StringType()),
        T.StructField("node", T.StringType()),
        T.StructField("exit", T.StringType()),  # where the chain leaves; on a local cycle the node it enters it by
        T.StructField("steps", T.IntegerType()),
        T.StructField("least", T.StringType()),  # smallest id from the node up to, not including, the exit
        T.StructField("via", T.ArrayType(T.StringType())),  # nodes after this one, up to and with the exit
        T.StructField("state", T.IntegerType()),  # 0 leaves the fragment, -1 on a local cycle, -2 ends in one
        T.StructField("entered", T.BooleanType()),
    ]
)


def _follow(rows: pd.DataFrame, paths: bool = True) -> pd.DataFrame:
    """Local chains of one partition: columns tree, node, parent, entered, least, via (empty without ``paths``)."""
    key = list(zip(rows["tree"], rows["node"]))
    parent = dict(zip(key, rows["parent"]))
    weight = dict(zip(key, rows["hops"]))
    low = dict(zip(key, rows["least"]))
    between = dict(zip(key, rows["via"]))
    done: dict[tuple, tuple] = {}
    for start in key:
        trail: list[tuple] = []
        at: dict[tuple, int] = {}
        x = start
        while x in parent and x not in done and x not in at:
            at[x] = len(trail)
            trail.append(x)
            x = (x[0], parent[x])
        if x in at:  # a cycle inside the fragment
            ring = trail[at[x] :]
            least = min(low[v] for v in ring)
            names = [n for v in ring for n in (v[1], *list(between[v])[:-1])] if paths else []
            for v in ring:
                turn = names.index(v[1]) if paths else 0
                done[v] = (v[1], len(names), least, [*names[turn + 1 :], *names[:turn], v[1]] if paths else [], -1)
            trail = trail[: at[x]]
        for v in reversed(trail):
            p = (v[0], parent[v])
            if p not in done:
                done[v] = (p[1], weight[v], low[v], list(between[v]), 0)
            elif done[p][4]:  # its chain ends in a local cycle: the path goes once round it
                least, path = done[p][2], done[p][3]
                # a link of the quotient may run along the cycle before it reaches its exit
                done[v] = (done[p][0], 0, least, list(dict.fromkeys([*between[v], *path])), -2)
            else:
                e, steps, least, path, _ = done[p]
                done[v] = (e, weight[v] + steps, min(low[v], least), [*between[v], *path], 0)
    seen = [done[k] for k in key]
    return pd.DataFrame(
        {
            "tree": rows["tree"], "node": rows["node"], "exit": [d[0] for d in seen], "steps": [d[1] for d in seen], "least": [d[2] for d in seen],
            "via": [d[3] for d in seen], "state": [d[4] for d in seen], "entered": rows["entered"],
        }
    )


def _follow_all(parts: Iterator[pd.DataFrame], paths: bool) -> Iterator[pd.DataFrame]:
    held = [p for p in parts if len(p)]
    if held:
        yield _follow(pd.concat(held, ignore_index=True), paths)


def _mark(level: int, tree: str, node: str):
    return F.pmod(F.xxhash64(F.lit(level), F.col(tree), F.col(node)), F.lit(2))


def _solve(scratch: Scratch, links: DataFrame, level: int, fragment_rows: int, hot: int, paths: bool = True) -> DataFrame:
    """links: tree, node, parent, hops, least, via -> tree, node, root, depth, path (see ``hierarchy``)."""
    n = links.count()
    parts = max(1, -(-n // fragment_rows))
    children = links.groupBy("tree", F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    entered = links.join(children.select("tree", "node", F.lit(True).alias("__e")), ["tree", "node"], "left").withColumn("entered", F.coalesce("__e", F.lit(False))).drop("__e")
    if parts == 1:
        placed = entered.coalesce(1)
    else:
        calm = children.filter(F.col("kids") <= hot).select("tree", F.col("node").alias("parent"), F.lit(True).alias("__calm"))
        drawn = F.coalesce("__calm", F.lit(False)) & (_mark(level, "tree", "node") == 0) & (_mark(level, "tree", "parent") == 1)
        placed = (
            entered.join(calm, ["tree", "parent"], "left")
            .withColumn("__home", F.when(drawn, F.col("parent")).otherwise(F.col("node")))
            .repartition(parts, "tree", "__home")
        )
    cut = scratch.put(placed.select("tree", "node", "parent", "hops", "least", "via", "entered").mapInPandas(partial(_follow_all, paths=paths), _STEP))

    def final(df: DataFrame) -> DataFrame:
        # a chain that left its last fragment ended at a root; local cycles know their answer
        return df.select(
            "tree", "node",
            F.when(F.col("state") == 0, F.col("exit")).otherwise(F.col("least")).alias("root"),
            F.when(F.col("state") == 0, F.col("steps")).otherwise(F.col("state")).alias("depth"),
            F.col("via").alias("path"),
        )

    if parts == 1:
        return final(cut)
    quotient = cut.filter("entered AND state = 0").select("tree", "node", F.col("exit").alias("parent"), F.col("steps").alias("hops"), "least", "via")
    above = scratch.put(_solve(scratch, scratch.put(quotient), level + 1, fragment_rows, hot, paths))
    # entered nodes that know their answer already; a chain of the quotient may end at one
    local = final(cut.filter("entered AND state <> 0")).select("tree", "node", F.col("root").alias("l_root"), F.col("depth").alias("l_depth"), F.col("path").alias("l_path"))
    reached = above.join(local.withColumnRenamed("node", "root"), ["tree", "root"], "left").select(
        "tree", "node",
        F.when(F.col("depth") >= 0, F.coalesce("l_root", "root")).otherwise(F.col("root")).alias("root"),
        F.when(F.col("l_root").isNotNull() & (F.col("depth") >= 0), F.lit(-2)).otherwise(F.col("depth")).alias("depth"),
        F.when(F.col("l_root").isNotNull() & (F.col("depth") >= 0), F.array_distinct(F.concat("path", "l_path"))).otherwise(F.col("path")).alias("path"),
    )
    answers = reached.unionByName(local.select("tree", "node", F.col("l_root").alias("root"), F.col("l_depth").alias("depth"), F.col("l_path").alias("path")))
    # cycles through fragments: the nodes between the entries on the cycle lie on it too
    ring = above.filter("depth = -1").select("tree", F.explode("path").alias("node"), F.col("root").alias("ring_root")).groupBy("tree", "node").agg(F.min("ring_root").alias("ring_root"))
    joined = (
        cut.filter("state = 0")
        .join(answers.select("tree", F.col("node").alias("exit"), F.col("root").alias("a_root"), F.col("depth").alias("a_depth"), F.col("path").alias("a_path")), ["tree", "exit"], "left")
        .join(ring, ["tree", "node"], "left")
    )
    # path of a node whose exit is on a cycle: up to the exit and once round, each node once
    path = F.when(F.col("a_depth").isNull(), F.col("via")).when(F.col("a_depth") < 0, F.array_distinct(F.concat("via", "a_path"))).otherwise(F.concat("via", "a_path"))
    on_ring = F.col("ring_root").isNotNull()
    return joined.select(
        "tree", "node",
        F.when(on_ring, F.col("ring_root")).when(F.col("a_root").isNotNull(), F.col("a_root")).otherwise(F.col("exit")).alias("root"),
        F.when(on_ring, F.lit(-1)).when(F.col("a_depth").isNull(), F.col("steps")).when(F.col("a_depth") >= 0, F.col("steps") + F.col("a_depth")).otherwise(F.lit(-2)).alias("depth"),
        F.when(on_ring, F.concat(F.array_except(path, F.array("node")), F.array("node"))).otherwise(path).alias("path"),
    ).unionByName(final(cut.filter("state <> 0")))


def hierarchy(links: DataFrame, node: str = "node", parent: str = "parent", tree: str | None = None, fragment_rows: int = FRAGMENT_ROWS, hot: int = HOT_CHILDREN, paths: bool = True) -> DataFrame:
    """Root, depth and path of every node that has a parent.

    Result: ``tree, node, parent, root, depth, path``.  ``path`` lists the
    nodes after this one, up to the root.  On a cycle (also a node that is its
    own parent) ``depth`` is -1, for a node whose path ends in one -2; then
    ``root`` is the smallest id of the cycle, and ``path`` goes once round it,
    each node once (for a node on the cycle it ends with the node itself).

    Rows whose node or parent is null state no link.  Repeated rows count
    once; if rows give a node several parents, the smallest (by bytes) holds.
    ``tree`` names a column that keeps several hierarchies apart (null counts
    as one of its own).  Other columns are left out, whatever their names.
    An empty table gives an empty result.

    Without ``paths`` only ``tree, node, root, depth`` come out and no path is
    carried: the cost no longer grows with the depth.  Only the nodes whose
    path ends in a cycle are solved again with their paths.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "hierarchy")
    rows = links.select(
        (F.coalesce(F.col(tree).cast("string"), F.lit("")) if tree else F.lit("")).alias("tree"), F.col(node).cast("string").alias("node"), F.col(parent).cast("string").alias("parent")
    ).filter("node IS NOT NULL AND parent IS NOT NULL")
    one = scratch.put(rows.groupBy("tree", "node").agg(F.min("parent").alias("parent")))
    via = F.array("parent") if paths else F.array().cast("array<string>")
    solved = _solve(scratch, one.select("*", F.lit(1).alias("hops"), F.col("node").alias("least"), via.alias("via")), 0, fragment_rows, hot, paths)
    if not paths:
        solved, n = scratch.put_counted(solved.select("tree", "node", "root", "depth"), round_=F.count_if(F.col("depth") < 0))
        if not n["round_"]:
            return solved
        ringed = one.join(solved.filter("depth < 0").select("tree", "node"), ["tree", "node"], "left_semi")
        again = hierarchy(ringed, "node", "parent", "tree", fragment_rows, hot).select("tree", "node", "root", "depth")
        return solved.filter("depth >= 0").unionByName(again)
    return solved.select("tree", "node", F.col("path")[0].alias("parent"), "root", "depth", "path")


def descendants(solved: DataFrame) -> DataFrame:
    """One row per node and ancestor: ``tree, ancestor, node, distance``.

    From the result of ``hierarchy``.  A node on a cycle is a descendant of
    every other node of it, and of itself at the cycle's length.
    """
    return solved.select("tree", "node", F.posexplode("path").alias("i", "ancestor")).select("tree", "ancestor", "node", (F.col("i") + 1).alias("distance"))
