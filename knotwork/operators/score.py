"""Link scores from graph structure, filtered ranks, embedding scores.

``adjacency`` is the distinct symmetric pair table (a, b) of ``audit.symmetric``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.operators import walks
from knotwork.operators.ranking import fraction_of, running_sums
from knotwork.operators.splits import fraction
from knotwork.operators.walks import Coded
from knotwork.session import Scratch


def with_degree(adjacency: DataFrame) -> DataFrame:
    """``node, deg`` of every node."""
    return adjacency.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("deg"))


def shared(pairs: DataFrame, adjacency: DataFrame) -> DataFrame:
    """``h, t, mid``: common neighbours of each pair, walked from the end with fewer neighbours.

    A hub at one end costs nothing unless both ends are hubs.
    """
    deg = with_degree(adjacency)
    sized = (
        pairs.select("h", "t").distinct()
        .join(deg.select(F.col("node").alias("h"), F.col("deg").alias("dh")), "h")
        .join(deg.select(F.col("node").alias("t"), F.col("deg").alias("dt")), "t")
    )
    near = F.when(F.col("dh") <= F.col("dt"), F.col("h")).otherwise(F.col("t"))
    far = F.when(F.col("dh") <= F.col("dt"), F.col("t")).otherwise(F.col("h"))
    walked = sized.select("h", "t", near.alias("near"), far.alias("far")).join(adjacency.select(F.col("a").alias("near"), F.col("b").alias("mid")), "near")
    return walked.join(adjacency.select(F.col("a").alias("far"), F.col("b").alias("mid")), ["far", "mid"], "left_semi").select("h", "t", "mid")


def common_neighbours(pairs: DataFrame, adjacency: DataFrame) -> DataFrame:
    """``h, t, cn`` for every distinct pair; 0 where nothing is shared or an end is not in the graph."""
    cn = shared(pairs, adjacency).groupBy("h", "t").agg(F.count("*").alias("cn"))
    return pairs.select("h", "t").distinct().join(cn, ["h", "t"], "left").na.fill(0, ["cn"])


def resource_allocation(pairs: DataFrame, adjacency: DataFrame) -> DataFrame:
    """``h, t, ra``: the sum of 1 / degree over common neighbours."""
    ra = shared(pairs, adjacency).join(with_degree(adjacency).withColumnRenamed("node", "mid"), "mid").groupBy("h", "t").agg(F.sum(1.0 / F.col("deg")).alias("ra"))
    return pairs.select("h", "t").distinct().join(ra, ["h", "t"], "left").na.fill(0.0, ["ra"])


def l3(pairs: DataFrame, adjacency: DataFrame, graph: Coded | None = None) -> DataFrame:
    """``h, t, l3``: walks h-x-y-t (backtracking too), each worth 1 / sqrt(deg x * deg y); 0 where an end is not in the graph.

    The first two steps are summed per head in one vector (``walks``).  ``graph``: the adjacency with numbered nodes, if it is at hand.
    """
    scored = walks.l3(pairs, graph or walks.coded(adjacency))
    return pairs.select("h", "t").distinct().join(scored, ["h", "t"], "left").na.fill(0.0, ["l3"])


def popularity(pairs: DataFrame, degrees: DataFrame) -> DataFrame:
    """``h, t, score``: edges at the tail (``degrees``: node_id, degree_multi)."""
    return pairs.select("h", "t").distinct().join(degrees.select(F.col("node_id").alias("t"), F.col("degree_multi").alias("score")), "t", "left").select("h", "t", F.coalesce("score", F.lit(0)).alias("score"))


def random_scores(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """``h, t, score``: a number in [0, 1) from the hash of the pair."""
    return pairs.select("h", "t").distinct().withColumn("score", fraction(seed, "h", "t"))


#: scorers of pairs over an adjacency, by name
SCORERS = {"CN": common_neighbours, "RA": resource_allocation, "L3": l3}


def outside(pairs: DataFrame, adjacency: DataFrame) -> DataFrame:
    """``n, n_oov``: distinct pairs, and those with an end that the graph does not have (their structural scores are 0)."""
    nodes = adjacency.select("a").distinct()
    inside = lambda c: nodes.select(F.col("a").alias(c), F.lit(True).alias(f"in_{c}"))
    known = pairs.select("h", "t").distinct().join(inside("h"), "h", "left").join(inside("t"), "t", "left")
    return known.agg(F.count("*").alias("n"), F.count_if(F.col("in_h").isNull() | F.col("in_t").isNull()).alias("n_oov"))


def row_scores(queries: DataFrame, adjacency: DataFrame, kind: str = "RA", pool: DataFrame | None = None) -> DataFrame:
    """``q, c, s``: all candidates that a query node reaches over two steps (three for L3), with a CN, RA or L3 score above 0.

    With ``pool`` (column ``c``) only its nodes are reached; degrees are those of the whole graph.
    """
    deg = with_degree(adjacency)
    worth = {"CN": F.lit(1.0), "RA": 1.0 / F.col("deg"), "L3": 1.0 / F.sqrt("deg")}[kind]
    weight = deg.select(F.col("node").alias("b"), worth.alias("w"))
    one = queries.select("q").distinct().join(adjacency, F.col("q") == F.col("a")).select("q", "b").join(weight, "b").select("q", F.col("b").alias("mid"), "w")
    last = adjacency.select(F.col("a").alias("mid"), F.col("b").alias("c"))
    if pool is not None:
        last = last.join(pool.select("c").distinct(), "c", "left_semi")
    if kind == "L3":
        two = one.join(adjacency.select(F.col("a").alias("mid"), F.col("b").alias("y")), "mid").groupBy("q", F.col("y").alias("mid")).agg(F.sum("w").alias("w"))
        one = two.join(weight.select(F.col("b").alias("mid"), F.col("w").alias("w2")), "mid").select("q", "mid", (F.col("w") * F.col("w2")).alias("w"))
    return one.join(last, "mid").groupBy("q", "c").agg(F.round(F.sum("w"), 9).alias("s"))


def filtered_ranks(test: DataFrame, known: DataFrame, pool: DataFrame, scores: DataFrame) -> DataFrame:
    """``q, target, rank``: of each test pair (q, target) the realistic rank among the pool, other known targets of q left out.

    rank = 1 + greater + ties / 2.  Candidates without a score have score 0, so
    only scored ones are joined and the rest are counted: no product of queries
    and candidates is built.  ``known``: distinct (q, c); ``pool``: distinct c;
    ``scores``: (q, c, s) with s > 0.
    """
    t, size_of, k, in_pool = _asked(test, known, pool)
    scored = scores.join(in_pool, "c", "left_semi").join(t.select("q").distinct(), "q", "left_semi")
    free = scored.join(k, ["q", "c"], "left_anti")
    target = size_of.join(scored.select("q", F.col("c").alias("target"), F.col("s").alias("ts")), ["q", "target"], "left").na.fill(0.0, ["ts"])
    # free candidates of a query never include its known ones, but may include a target that is not known
    per_score = free.groupBy("q", "s").agg(F.count("*").alias("m"))
    hit = target.join(per_score, "q", "left").groupBy("q", "target", "ts", "size", "self_free").agg(
        F.coalesce(F.sum(F.when(F.col("s") > F.col("ts"), F.col("m"))), F.lit(0)).alias("more"), F.coalesce(F.sum(F.when(F.col("s") == F.col("ts"), F.col("m"))), F.lit(0)).alias("same"), F.coalesce(F.sum("m"), F.lit(0)).alias("some")
    )
    same = F.when(F.col("ts") > 0, F.col("same") - F.col("self_free")).otherwise(F.col("size") - F.col("some"))
    return hit.select("q", "target", (1.0 + F.col("more") + same / 2.0).alias("rank"))


def walk_ranks(asked: Asked, graph: Coded, kinds: list[str]) -> DataFrame:
    """``kind, q, target, rank``: ``filtered_ranks`` under CN, RA and L3 without a table of scores; each query's are counted where they are made (``walks``)."""
    counts = walks.rank_counts(asked.size_of.select("q", "target"), asked.known, asked.pool, graph, kinds)
    every = asked.size_of.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds])))
    hit = every.join(counts, ["kind", "q", "target"], "left").na.fill(0, ["ts", "more", "same", "some"])
    same = F.when(F.col("ts") > 0, F.col("same") - F.col("self_free")).otherwise(F.col("size") - F.col("some"))
    return hit.select("kind", "q", "target", (1.0 + F.col("more") + same / 2.0).alias("rank"))


@dataclass
class Asked:
    """What is asked of every scorer: ``size_of`` (q, target, self_free, size), ``known`` (q, c) in question, ``pool`` (c)."""

    size_of: DataFrame
    known: DataFrame
    pool: DataFrame


def ask(test: DataFrame, known: DataFrame, pool: DataFrame) -> Asked:
    """The question, written once for all scorers."""
    scratch = Scratch(test.sparkSession, "asked")
    _, size_of, k, in_pool = _asked(test, known, pool)
    return Asked(scratch.put(size_of), scratch.put(k), scratch.put(in_pool))


def _asked(test: DataFrame, known: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(test pairs, the same with ``size`` (candidates beside the target) and ``self_free``, known pairs in question, pool)."""
    t = test.select("q", "target").distinct()
    in_pool = pool.select("c").distinct()
    k = known.select("q", "c").distinct().join(in_pool, "c", "left_semi").join(t.select("q").distinct(), "q", "left_semi")
    n_known = k.groupBy("q").agg(F.count("*").alias("nk"))
    marked = t.join(k.select("q", F.col("c").alias("target"), F.lit(1).alias("tk")), ["q", "target"], "left").join(in_pool.select(F.col("c").alias("target"), F.lit(1).alias("tp")), "target", "left")
    marked = marked.join(n_known, "q", "left").na.fill(0, ["nk", "tk", "tp"])
    # the target itself is no candidate against itself
    self_free = F.when((F.col("tp") == 1) & (F.col("tk") == 0), 1).otherwise(0)
    n_pool = in_pool.agg(F.count("*")).scalar()  # part of the same plan
    return t, marked.select("q", "target", self_free.alias("self_free"), (n_pool - F.col("nk") - self_free).alias("size")), k, in_pool


def node_ranks(asked: Asked, scores: DataFrame) -> DataFrame:
    """``q, target, rank`` where a candidate's score does not depend on the query (``c, s``; 0 where it has none).

    The pool is counted per score once; of each query its known targets are
    taken off per score, so a hub's targets never meet its known ones.
    """
    size_of, k, in_pool = asked.size_of, asked.known, asked.pool
    valued = in_pool.join(scores.select("c", "s"), "c", "left").na.fill(0, ["s"])
    level = valued.groupBy("s").agg(F.count("*").alias("m"))
    levels = running_sums(level, "s", ["m"])
    target = size_of.join(valued.select(F.col("c").alias("target"), F.col("s").alias("ts")), "target", "left").join(scores.select(F.col("c").alias("target"), F.col("s").alias("ts2")), "target", "left")
    target = target.withColumn("ts", F.coalesce("ts", "ts2", F.lit(0))).drop("ts2")
    mine = k.join(valued, "c").groupBy("q", "s").agg(F.count("*").alias("n"))
    off = target.select("q", "target", "ts").join(mine, "q").groupBy("q", "target").agg(F.sum(F.when(F.col("s") > F.col("ts"), F.col("n")).otherwise(0)).alias("km"), F.sum(F.when(F.col("s") == F.col("ts"), F.col("n")).otherwise(0)).alias("ks"))
    own = in_pool.select(F.col("c").alias("target"), F.lit(1).alias("own"))
    itself = k.select("q", F.col("c").alias("target"), F.lit(1).alias("tk"))
    at = target.join(levels.select(F.col("s").alias("ts"), "m", "cum_m"), "ts", "left").join(off, ["q", "target"], "left").join(own, "target", "left").join(itself, ["q", "target"], "left").na.fill(0, ["m", "cum_m", "km", "ks", "own", "tk"])
    # the target itself is no candidate against itself
    same = F.col("m") - F.col("own") - (F.col("ks") - F.col("tk"))
    return at.select("q", "target", (1.0 + (F.col("cum_m") - F.col("m") - F.col("km")) + same / 2.0).alias("rank"))


def random_ranks(asked: Asked, side: str, seed: int = 42) -> DataFrame:
    """``q, target, rank`` of a scorer that knows nothing: one of the places among the candidates, by the hash of side and pair."""
    x = fraction_of(seed, F.lit(side), F.col("q"), F.col("target"))
    return asked.size_of.select("q", "target", (1.0 + F.floor(x * (F.col("size") + 1))).alias("rank"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def transe(h: Column, r: Column, t: Column) -> Column:
    """Minus the length of h + r - t."""
    diff = F.zip_with(F.zip_with(h, r, lambda x, y: x.cast("double") + y.cast("double")), t, lambda x, y: x - y.cast("double"))
    return -F.sqrt(F.aggregate(diff, F.lit(0.0), lambda s, x: s + x * x))


def distmult(h: Column, r: Column, t: Column) -> Column:
    """Sum of h * r * t."""
    return dot(F.zip_with(h, r, lambda x, y: x.cast("double") * y.cast("double")), t)


def _halves(v: Column) -> tuple[Column, Column]:
    n = F.floor(F.size(v) / 2).cast("int")
    return F.slice(v, F.lit(1), n), F.slice(v, n + 1, n)


def complex_(h: Column, r: Column, t: Column) -> Column:
    """Real part of the trilinear product; a vector holds the real, then the imaginary parts."""
    (hr, hi), (rr, ri), (tr, ti) = _halves(h), _halves(r), _halves(t)
    return distmult(hr, rr, tr) + distmult(hi, rr, ti) + distmult(hr, ri, ti) - distmult(hi, ri, tr)


def rotate(h: Column, r: Column, t: Column) -> Column:
    """Minus the length of h turned by the angles r, less t; angles are the first half of r."""
    (hr, hi), (angle, _), (tr, ti) = _halves(h), _halves(r), _halves(t)
    cos, sin = F.transform(angle, lambda x: F.cos(x.cast("double"))), F.transform(angle, lambda x: F.sin(x.cast("double")))
    mul = lambda a, b: F.zip_with(a, b, lambda x, y: x.cast("double") * y)
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y.cast("double"))
    re = minus(F.zip_with(mul(hr, cos), mul(hi, sin), lambda x, y: x - y), tr)
    im = minus(F.zip_with(mul(hr, sin), mul(hi, cos), lambda x, y: x + y), ti)
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    return -F.sqrt(square(re) + square(im))
