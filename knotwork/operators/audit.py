"""Audits of a split graph: leakage, reachability, composition.

Existence is asked with semi-joins on distinct pairs.  Neighbourhoods grow by
one join per hop from the frontier only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators.splits import of


def duplicates(test: DataFrame, train: DataFrame) -> DataFrame:
    """Test edges whose (head, relation, tail) is in train."""
    return test.join(train.select("head_id", "relation", "tail_id").distinct(), ["head_id", "relation", "tail_id"], "left_semi")


def pair_overlap(test: DataFrame, train: DataFrame) -> DataFrame:
    """Test triples whose pair stands in train under other relations, with those relations joined."""
    other = train.select("head_id", "tail_id", F.col("relation").alias("__r")).distinct()
    hit = test.select("head_id", "relation", "tail_id").distinct().join(other, ["head_id", "tail_id"]).filter("relation <> __r")
    return hit.groupBy("head_id", "relation", "tail_id").agg(F.array_join(F.array_sort(F.collect_set("__r")), "|").alias("other_relations"))


def symmetric(edges: DataFrame, a: str = "head_id", b: str = "tail_id") -> DataFrame:
    """Distinct pairs ``a, b`` in both directions, without loops, from one scan."""
    both = F.array(F.struct(F.col(a).alias("a"), F.col(b).alias("b")), F.struct(F.col(b).alias("a"), F.col(a).alias("b")))
    return edges.select(F.explode(both).alias("p")).select("p.*").filter("a <> b").distinct()


def hops(adjacency: DataFrame, sources: DataFrame, most: int = 2) -> DataFrame:
    """``source, node, hop``: nodes at exact distance 1..most from each source (column ``source``)."""
    frontier = sources.select("source", F.col("source").alias("node"))
    seen, out = frontier, None
    for k in range(1, most + 1):
        found = frontier.join(adjacency, F.col("node") == F.col("a")).select("source", F.col("b").alias("node")).distinct().join(seen, ["source", "node"], "left_anti")
        ring = found.withColumn("hop", F.lit(k))
        out = ring if out is None else out.unionByName(ring)
        frontier, seen = found, seen.unionByName(found)
    return out


def closure_leak(test: DataFrame, train: DataFrame, adjacency: DataFrame, end: str, most: int = 2) -> DataFrame:
    """Test triples, not in train themselves, with the closest ``hop`` at which a neighbour of their ``end`` has the same edge in train."""
    fresh = test.select("head_id", "relation", "tail_id").distinct().join(train.select("head_id", "relation", "tail_id").distinct(), ["head_id", "relation", "tail_id"], "left_anti")
    near = hops(adjacency, fresh.select(F.col(f"{end}_id").alias("source")).distinct(), most)
    other = "tail_id" if end == "head" else "head_id"
    seen = train.select(F.col(f"{end}_id").alias("node"), "relation", other).distinct()
    return fresh.join(near, F.col(f"{end}_id") == F.col("source")).join(seen, ["node", "relation", other]).groupBy("head_id", "relation", "tail_id").agg(F.min("hop").alias("hop"))


def two_hop(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct (x, z) with left (x, y) and right (y, z)."""
    return left.select("x", "y").distinct().join(right.select("y", "z").distinct(), "y").select("x", "z").distinct()


def reachable(targets: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Targets (x, z) joined by some y.

    Each target is walked from its end with fewer rows, the left ones of x or
    the right ones of z, and the other end is asked whether it has that y: a
    hub at one end costs nothing, and no full two-hop product is built.
    """
    ends = left.select(F.lit("x").alias("side"), F.col("x").alias("end"), "y").unionByName(right.select(F.lit("z").alias("side"), F.col("z").alias("end"), "y")).distinct()
    size = ends.groupBy("side", "end").agg(F.count("*").alias("n"))
    of_end = lambda c: size.filter(F.col("side") == c).select(F.col("end").alias(c), F.col("n").alias(f"n{c}"))
    sized = targets.select("x", "z").distinct().join(of_end("x"), "x").join(of_end("z"), "z")
    from_x = F.col("nx") <= F.col("nz")
    at = lambda near: [F.when(near, "x").otherwise("z"), F.when(near, F.col("x")).otherwise(F.col("z"))]
    (near_side, near), (far_side, far) = at(from_x), at(~from_x)
    walked = sized.select("x", "z", near_side.alias("side"), near.alias("end"), far_side.alias("far_side"), far.alias("far")).join(ends, ["side", "end"])
    asked = walked.select("x", "z", F.col("far_side").alias("side"), F.col("far").alias("end"), "y")
    return asked.join(ends, ["side", "end", "y"], "left_semi").select("x", "z").distinct()


def compose(left: DataFrame, right: DataFrame) -> DataFrame:
    """``x, z, n_via, via, labels`` over all y: left (x, y), right (y, z, label).

    ``via`` lists at most the distinct mediators of one pair.  Both sides are
    made distinct first; hub mediators are split by AQE's skew join.
    """
    joined = left.select("x", "y").distinct().join(right.select("y", "z", "label").distinct(), "y")
    return joined.groupBy("x", "z").agg(F.countDistinct("y").alias("n_via"), F.array_join(F.array_sort(F.collect_set("y")), ",").alias("via"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))


def roll_up(ids: DataFrame, up: DataFrame) -> DataFrame:
    """Ids (column ``id``) replaced by their parent (``id, parent``) where known; distinct.  Several parents: the smallest."""
    one = up.groupBy("id").agg(F.min("parent").alias("__p"))
    return ids.join(one, "id", "left").select(F.coalesce("__p", "id").alias("id")).distinct()


def leakage_free(train: DataFrame, test: DataFrame, hardneg: DataFrame, adjacency: DataFrame, relations: list[str]) -> tuple[DataFrame, DataFrame]:
    """(train without target edges that share a pair with a hard negative, test without edges leaked over one hop)."""
    pairs = hardneg.select("head_id", "tail_id").distinct()
    guarded = of(train, *relations).join(pairs, ["head_id", "tail_id"], "left_anti").unionByName(train.filter(~F.col("relation").isin(relations)))
    leaked = closure_leak(test, guarded, adjacency, "head", 1).select("head_id", "relation", "tail_id")
    return guarded, test.join(leaked, ["head_id", "relation", "tail_id"], "left_anti")
