"""Ranking and discrimination metrics as aggregations."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.operators.ranking import running_sums
from knotwork.operators.walks import columns, dealt
from knotwork.session import Scratch, location

HITS = [1, 3, 5, 10, 20]


def _r(c: Column) -> Column:
    return F.round(c, 6)


def rank_block(ranks: DataFrame) -> DataFrame:
    """``side, level, mrr, mean_rank, hits_1..20, n`` of (side, group_id, rank): micro and macro, per side and for both.

    Macro is the mean over groups of the group means; for ``both`` the groups
    of the two sides stand side by side.
    """
    both = ranks.withColumn("side", F.explode(F.array(F.col("side"), F.lit("both"))))
    stats = [F.avg(1.0 / F.col("rank")).alias("mrr"), F.avg("rank").alias("mean_rank"), *[F.avg((F.col("rank") <= k).cast("double")).alias(f"hits_{k}") for k in HITS], F.count("*").alias("n")]
    names = ["mrr", "mean_rank", *[f"hits_{k}" for k in HITS]]
    micro = both.groupBy("side").agg(*stats).select("side", F.lit("micro").alias("level"), *names, "n")
    groups = both.groupBy("side", "group_id").agg(*stats)
    macro = groups.groupBy("side").agg(*[F.avg(c).alias(c) for c in names], F.count("*").alias("n")).select("side", F.lit("macro").alias("level"), *names, "n")
    return micro.unionByName(macro).select("side", "level", *[_r(F.col(c)).alias(c) for c in names], "n")


def auc_block(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AUROC, average precision, its floor and ratio, false positives at the median positive; (score, positive).

    One row per value of ``by`` (none: one row).  Equal scores are one
    threshold.  NaN and null scores are left out.  Without positives or without
    negatives there is no row.
    """
    by = by or []
    one = by or ["__all"]
    clean = scores.filter(F.col("score").isNotNull() & ~F.isnan("score"))
    level = clean.groupBy(*by, "score").agg(F.sum(F.col("positive").cast("long")).alias("p"), F.sum(1 - F.col("positive").cast("long")).alias("q"))
    cum = running_sums(level, "score", ["p", "q"], by=by)
    cum = Scratch(scores.sparkSession, "levels").put(cum if by else cum.withColumn("__all", F.lit(0)))
    total = cum.groupBy(*one).agg(
        F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"),
        F.sum(F.col("q") * (F.col("cum_p") - F.col("p") + F.col("p") / 2.0)).alias("u"), F.sum(F.col("p") * F.col("cum_p") / (F.col("cum_p") + F.col("cum_q"))).alias("ap"),
    ).filter("n_pos > 0 AND n_neg > 0")
    # the median positive stands in the levels that cover the middle positions
    at = lambda k: (F.col("cum_p") - F.col("p") < k) & (k <= F.col("cum_p"))
    low, high = F.floor((F.col("n_pos") + 1) / 2), F.ceil((F.col("n_pos") + 1) / 2)
    middle = _with_total(cum, total.select(*one, "n_pos"), by).groupBy(*one).agg((F.sum(F.when(at(low), F.col("score"))) / 2 + F.sum(F.when(at(high), F.col("score"))) / 2).alias("med"))
    above = _with_total(cum, middle, by).groupBy(*one).agg(F.sum(F.when(F.col("score") >= F.col("med"), F.col("q")).otherwise(0)).alias("above"))
    joined = total.join(above, one)
    floor = F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))
    ap = F.col("ap") / F.col("n_pos")
    return joined.select(
        *by, _r(F.col("u") / (F.col("n_pos") * F.col("n_neg"))).alias("auroc"), _r(ap).alias("auprc"), _r(floor).alias("floor"), _r(ap / floor).alias("auprc_over_floor"), _r(F.col("above") / F.col("n_neg")).alias("fpr_at_med"), "n_pos", "n_neg"
    )


def _with_total(levels: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """Levels with the aggregates of their group; without groups the aggregate is one value, put in as such."""
    if by:
        return levels.join(totals, by)
    name = next(c for c in totals.columns if c != "__all")
    return levels.withColumn(name, totals.agg(F.max(name)).scalar())


def draw(seed: int, *keys: Column) -> Column:
    """A number of 32 bits from the hash of the keys."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])), 1, 8), 16, 10).cast("bigint")


def _interval(per: DataFrame, metric: str) -> DataFrame:
    ci = per.agg(F.expr(f"percentile({metric}, array(0.025, 0.975))").alias("ci"))  # one value per resample
    return ci.select(F.lit(metric).alias("metric"), _r(F.col("ci")[0]).alias("lo"), _r(F.col("ci")[1]).alias("hi"))


#: statistics of a resample that ``bootstrap`` knows, as SQL over the column ``rank``
STATS = {"mrr": "avg(1.0D / rank)", "mean_rank": "avg(rank)", **{f"hits_{k}": f"avg(double(rank <= {k}))" for k in HITS}}


def bootstrap(values: DataFrame, replicates: int = 1_000, stats: list[str] | None = None, seed: int = 42) -> DataFrame:
    """``metric, lo, hi``: 95 % intervals over resamples with replacement (``stats``: names of STATS).

    Values (``rk`` from 1, ``n``, ``rank``) are drawn by hash.  They are read once
    into one array of 8 bytes a value that every draw looks into, so no draw is
    moved; the places are dealt to all tasks.  No values give no interval (nulls).
    """
    stats = stats or ["mrr"]
    values = Scratch(values.sparkSession, "values").put(values.select("rk", "n", F.col("rank").cast("double").alias("rank")))
    ranks = values.agg(F.expr("transform(array_sort(collect_list(struct(rk, rank))), x -> x.rank)")).scalar()
    slots = dealt(values.select("rk", "n")).select("rk", "n", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("b"))
    drawn = slots.select("b", F.element_at(ranks, (draw(seed, F.col("b"), F.col("rk")) % F.col("n") + 1).cast("int")).alias("rank"))
    per = Scratch(values.sparkSession, "resamples").put(drawn.groupBy("b").agg(*[F.expr(STATS[s]).alias(s) for s in stats]))
    out = None
    for s in stats:
        out = _interval(per, s) if out is None else out.unionByName(_interval(per, s))
    return out


def bootstrap_auc(scores: DataFrame, replicates: int = 1_000, seed: int = 42) -> DataFrame:
    """``metric, lo, hi`` of AUROC and average precision, positives and negatives resampled each by themselves.

    ``scores``: rk (from 1 within its class), n (size of the class), positive, score.
    Each task reads the scores and makes its resamples one by one, so no draw is
    moved: 12 bytes a score.  NaN and null scores are drawn and left out, and a
    resample without positives or negatives is none, as in ``auc_block``.
    """
    spark = scores.sparkSession
    path = location(Scratch(spark, "scores").put(scores.select("rk", F.col("positive").cast("boolean").alias("positive"), F.coalesce(F.col("score").cast("double"), F.lit(float("nan"))).alias("score"))))

    def resample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        levels = None
        for batch in batches:
            levels = levels or _levels(path)
            rows = [(b, *_areas(levels, seed, b)) for b in batch["b"]]
            yield pd.DataFrame([r for r in rows if r[1] is not None], columns=["b", "auroc", "auprc"])

    per = dealt(spark.range(1, replicates + 1).toDF("b")).mapInPandas(resample, "b long, auroc double, auprc double")
    per = Scratch(spark, "resamples").put(per.select("b", _r(F.col("auroc")).alias("auroc"), _r(F.col("auprc")).alias("auprc")))
    return _interval(per, "auroc").unionByName(_interval(per, "auprc"))


def _levels(path: str) -> dict[int, np.ndarray]:
    """By class, 0 or 1, the score's level (0 is the largest; -1: none) of each rank."""
    rk, positive, score = columns(path, "rk", "positive", "score")
    known = np.unique(score[~np.isnan(score)])
    level = np.where(np.isnan(score), -1, len(known) - 1 - np.searchsorted(known, score)).astype(np.int32)
    out = {}
    for c in (0, 1):
        at = positive == bool(c)
        out[c] = level[at][np.argsort(rk[at])]
    return out


def _areas(levels: dict[int, np.ndarray], seed: int, b: int) -> tuple[float | None, float | None]:
    """AUROC and average precision of resample ``b``."""
    size = max((int(x.max(initial=-1)) for x in levels.values()), default=-1) + 1
    hits = []
    for c in (0, 1):
        n, start = len(levels[c]), f"{seed}|{b}|{c}|"
        drawn = np.fromiter((int.from_bytes(md5(f"{start}{k}".encode(), usedforsecurity=False).digest()[:4]) % n for k in range(1, n + 1)), np.int64, n)
        hit = levels[c][drawn]
        hits.append(np.bincount(hit[hit >= 0], minlength=size).astype(float))
    q, p = hits
    if not p.sum() or not q.sum():
        return None, None
    cp, cq, at = np.cumsum(p), np.cumsum(q), p > 0
    return float((q * (cp - p / 2)).sum() / (p.sum() * q.sum())), float((p[at] * cp[at] / (cp[at] + cq[at])).sum() / p.sum())


def gap(blocks: DataFrame) -> DataFrame:
    """``side, mrr_gap, mean_rank_gap``: micro less macro of ``rank_block``."""
    of = lambda c, k: F.max(F.when(F.col("level") == k, F.col(c)))
    return blocks.groupBy("side").agg(*[_r(of(c, "micro") - of(c, "macro")).alias(f"{c}_gap") for c in ("mrr", "mean_rank")])
