"""Connected components by hooking, shortcutting and contraction.

State: a table of links between *vertices* and, for every node, its current
vertex.  Each round

1. *hooks* every vertex to its smallest neighbour where that is smaller,
2. *shortcuts* the parent table (parent := parent of parent) until flat,
3. *contracts*: links are rewritten to the vertices reached, loops and repeats
   vanish.

Every vertex that is not a local minimum disappears, so the rounds are
logarithmic in practice whatever the diameter (a chain of length L costs
log L shortcuts, not L rounds).  Each step is one join on unique keys or one
aggregation with map-side combining; no group is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.session import Scratch


def _flatten(scratch: Scratch, parent: DataFrame) -> DataFrame:
    """Shortcut a parent table (v, p) until every p is a root.

    Two steps up a write: where nobody has a third ancestor all are flat.
    """
    while True:
        up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        further = parent.select(F.col("v").alias("pp"), F.col("p").alias("ppp"))
        twice = parent.join(up, "p", "left").join(further, "pp", "left")
        jumped, n = scratch.put_counted(twice.select("v", F.coalesce("ppp", "pp", "p").alias("p"), F.col("ppp").isNotNull().alias("moved")), moved=F.count_if("moved"))
        scratch.drop(parent)
        parent = jumped.select("v", "p")
        parent._knotwork_path = jumped._knotwork_path
        if not n["moved"]:
            return parent


def hook_and_shortcut(scratch: Scratch, links: DataFrame) -> DataFrame:
    """links (a, b) -> (v, p): the smallest node of each component, for every node that is not it.

    Nodes without links do not appear.  Null ends state no link.
    """
    some = {"n": F.count(F.lit(1))}
    links, left = scratch.put_counted(links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), **some)
    levels: list[DataFrame] = []
    while left["n"]:
        # b > a throughout: the smallest neighbour of b, if smaller than b, is a minimum over a
        parent = _flatten(scratch, scratch.put(links.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p"))))
        root = lambda end: parent.select(F.col("v").alias(end), F.col("p").alias(f"p{end}"))  # noqa: B023, E731
        moved = links.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y"))
        fewer, left = scratch.put_counted(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), **some)
        scratch.drop(links)
        links = fewer
        levels.append(parent)
    if not levels:  # no links: an empty table of the right schema
        return links.select(F.col("a").alias("v"), F.col("b").alias("p"))
    scratch.drop(links)
    # a vertex of level k may hook on at a later level
    out = levels.pop()
    while levels:
        below = levels.pop()
        above = out.select(F.col("v").alias("p"), F.col("p").alias("top"))
        out = below.join(above, "p", "left").select("v", F.coalesce("top", "p").alias("p")).unionByName(out)
    return scratch.put(out)


def components(links: DataFrame, a: str = "a", b: str = "b", nodes: DataFrame | None = None) -> DataFrame:
    """Component of every node: ``id, component``, the component being its smallest id.

    ``nodes`` (one column) adds nodes without links, each its own component.
    Null ids are left out; repeated rows, loops and empty tables are allowed.
    """
    scratch = Scratch(links.sparkSession, "components")
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b"))
    parent = hook_and_shortcut(scratch, pairs)
    every = pairs.select(F.explode(F.array("a", "b")).alias("v"))
    if nodes is not None:
        every = every.unionByName(nodes.select(F.col(nodes.columns[0]).alias("v")))
    return every.filter("v IS NOT NULL").distinct().join(parent, "v", "left").select(F.col("v").alias("id"), F.coalesce("p", "v").alias("component"))
