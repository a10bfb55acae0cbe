"""Consolidating pairwise matches into groups (problem 6).

The component of the vertex of highest degree is *peeled* first: a frontier
spreads from it by joins with the links that are left, and the links it has
passed are removed by an anti-join, so the giant component, if there is one,
is never moved again.  What remains is labelled by minimum propagation: each
node takes the smallest label among its neighbours' and labels are propagated
through the labels themselves, so a chain costs the logarithm of its length.

The breadth-first part stops after ``max_rounds`` or when a frontier no longer
grows the part it has reached by a ``1/slow`` share: that component is a long
chain, and the reached part then enters the propagation as one single vertex.
The result is the same in every case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.ids import normal_id
from knotwork.operators.components import hook_and_shortcut
from knotwork.session import Scratch


def peel(scratch: Scratch, links: DataFrame, max_rounds: int = 12, slow: int = 50) -> tuple[DataFrame | None, DataFrame]:
    """(reached nodes ``v`` with their ``hub``, links left with the reached part as one vertex)."""
    degree = links.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").count()
    hub = degree.orderBy(F.desc("count"), "v").limit(1).collect()
    if not hub:
        return None, links
    hub = hub[0]["v"]
    spark = links.sparkSession
    reached = scratch.put(spark.createDataFrame([(hub,)], "v string"))
    frontier, total = reached, 1
    for _ in range(max_rounds):
        ends = links.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(links.select(F.col("b").alias("v"), F.col("a").alias("w")))
        # the frontier is the small side; where it is not, the join is a shuffle and AQE splits hot keys
        found = scratch.put(ends.join(frontier, "v", "left_semi").select(F.col("w").alias("v")).distinct().join(reached, "v", "left_anti"))
        n = found.count()
        if not n:
            break
        # links with both ends reached are done
        left = scratch.put(links.join(frontier.select(F.col("v").alias("a")), "a", "left_anti").join(frontier.select(F.col("v").alias("b")), "b", "left_anti"))
        links = left
        reached = scratch.put(reached.unionByName(found))
        frontier, total = found, total + n
        if n * slow < total:
            break
    marked = reached.select("v", F.lit(True).alias("in"))
    touched = links.join(marked.select(F.col("v").alias("a"), F.col("in").alias("ia")), "a", "left").join(marked.select(F.col("v").alias("b"), F.col("in").alias("ib")), "b", "left")
    one = F.lit(hub)
    rest = touched.select(F.when(F.col("ia"), one).otherwise(F.col("a")).alias("a"), F.when(F.col("ib"), one).otherwise(F.col("b")).alias("b")).filter("a <> b")
    return reached.select("v", one.alias("hub")), scratch.put(rest)


def groups(pairs: DataFrame, a: str, b: str, max_rounds: int = 12) -> DataFrame:
    """``id, group_id``: every id of either column with the smallest id of its group.

    Ids are compared as text by bytes.  A row with one null id contributes the
    other id without a match; rows with both null, repeated rows, loops, other
    columns and empty tables are allowed.
    """
    scratch = Scratch(pairs.sparkSession, "grouping")
    links = scratch.put(pairs.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).distinct())
    ids = links.select(F.explode(F.array("a", "b")).alias("id")).filter("id IS NOT NULL").distinct()
    true = scratch.put(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    reached, rest = peel(scratch, true, max_rounds)
    label = hook_and_shortcut(scratch, rest)
    if reached is None:
        return ids.join(label.withColumnRenamed("v", "id"), "id", "left").select("id", F.coalesce("p", "id").alias("group_id"))
    # the hub stands for all reached nodes: its group's smallest id is the smaller of its label and theirs
    top = reached.agg(F.min("v").alias("low"), F.first("hub").alias("hub"))
    hub_label = top.join(label.withColumnRenamed("v", "hub"), "hub", "left").select("hub", F.coalesce("p", "hub").alias("was"), F.least(F.coalesce("p", "hub"), "low").alias("now"))
    owner = ids.join(reached.withColumnRenamed("v", "id"), "id", "left").join(label.withColumnRenamed("v", "id"), "id", "left")
    named = owner.select("id", F.coalesce("p", "id").alias("was"), "hub")
    [fix] = hub_label.collect()  # one row, whatever the data
    in_hub = F.col("hub").isNotNull() | (F.col("was") == F.lit(fix["was"]))
    return named.select("id", F.when(in_hub, F.lit(fix["now"])).otherwise(F.col("was")).alias("group_id"))


def compound_groups(canonical: DataFrame) -> DataFrame:
    """Groups of metabolite_canonical in normal form: ``id, group_id``."""
    return groups(canonical.select(normal_id(F.col("original_id")).alias("a"), normal_id(F.col("canonical_id")).alias("b")), "a", "b")


def write_groups(scratch: Scratch, canonical: DataFrame) -> DataFrame:
    """compound_groups without the ids that already are their group's name, as a table."""
    return scratch.put(compound_groups(canonical).filter("id <> group_id"))
