"""Global order without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knotwork.session import Scratch


def hash_order(seed: int, *keys: str) -> Column:
    """Reproducible random order: md5 of the seed and the key parts."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def fraction_of(seed: int, *keys: Column) -> Column:
    """Number in [0, 1) from the hash of the keys."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hash_rank(df: DataFrame, keys: list[str], seed: int = 42, within: list[str] | None = None) -> DataFrame:
    """Adds ``rk`` (from 1) in hash order and ``n``, over all rows or those with equal ``within``.

    Rows are ranked inside 4,096 buckets of the hash and shifted by the rows of
    the buckets before, so no task sorts more than its share.  ``keys`` should
    be unique; equal keys are ranked in no fixed order.
    """
    within = within or []
    h = df.withColumn("__h", hash_order(seed, *keys)).withColumn("__b", F.substring("__h", 1, 3))
    counts = h.groupBy(*within, "__b").agg(F.count("*").alias("__c"))
    before = Window.partitionBy(*within).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*within, "__b", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__s"), F.sum("__c").over(Window.partitionBy(*within)).alias("n"))
    inner = h.withColumn("__i", F.row_number().over(Window.partitionBy(*within, "__b").orderBy("__h")))
    return inner.join(shift, [*within, "__b"]).withColumn("rk", F.col("__i") + F.col("__s")).drop("__h", "__b", "__c", "__i", "__s")


def fold(train: float, valid: float) -> Column:
    """train, valid or test from ``rk`` of ``n``: the first shares, rounded half to even, then the rest."""
    a = F.bround(F.col("n") * train)
    return F.when(F.col("rk") <= a, "train").when(F.col("rk") <= a + F.bround(F.col("n") * valid), "valid").otherwise("test")


def running_sums(df: DataFrame, order: str, values: list[str], descending: bool = True, by: list[str] | None = None) -> DataFrame:
    """Adds ``cum_<v>`` for each value: the sum over rows up to and with this one, ``order`` being unique (within ``by``).

    Rows are dealt by ranges of ``by`` and ``order``; each range is summed alone
    and shifted by the sums of the ranges before, so a group of any size is cut.
    """
    by = by or []
    spark = df.sparkSession
    o = F.desc(order) if descending else F.asc(order)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = Scratch(spark, "running").put(df.repartitionByRange(parts, *by, o).withColumn("__p", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "__p").agg(*[F.sum(v).alias(f"__t_{v}") for v in values])
    before = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row per range and group
    shift = totals.select(*by, "__p", *[F.coalesce(F.sum(f"__t_{v}").over(before), F.lit(0)).alias(f"__s_{v}") for v in values])
    inside = Window.partitionBy(*by, "__p").orderBy(o).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.select("*", *[F.sum(v).over(inside).alias(f"__i_{v}") for v in values]).join(shift, [*by, "__p"])
    return out.select(*df.columns, *[(F.col(f"__i_{v}") + F.col(f"__s_{v}")).alias(f"cum_{v}") for v in values])
