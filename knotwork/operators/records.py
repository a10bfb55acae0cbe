"""Record-level steps of the source builders: texts, lists, filters with reasons, counters, lineages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knotwork.functions.missing import is_missing
from knotwork.operators.hierarchy import hierarchy


def key_values(values: dict[str, Column]) -> Column:
    """``key=value|key=value`` text in the given order; a null value is written as nothing behind its key."""
    return F.concat_ws("|", *[F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit(""))) for k, v in values.items()])


def first_key(values: Column, keys: list[str]) -> Column:
    """The value of the first of several alias keys that a map has; null if it has none."""
    return F.coalesce(*[F.element_at(values, F.lit(k)) for k in keys])


def folded(label: Column, parts: dict[str, str]) -> Column:
    """The name of the first part that a label contains, whatever its case; else the label."""
    out = label
    for part, name in reversed(parts.items()):
        out = F.when(F.contains(F.lower(label), F.lit(part.lower())), F.lit(name)).otherwise(out)
    return out


def split_ids(df: DataFrame, column: str, separators: str = "[;|,]") -> DataFrame:
    """One row per id of a delimited list, without ``*`` and missing entries; rows whose list has none are left out."""
    parts = F.filter(F.transform(F.split(F.col(column), separators), lambda x: F.trim(x)), lambda x: (x != "*") & ~is_missing(x))
    return df.withColumn(column, F.explode(F.array_distinct(parts)))


def reasons(df: DataFrame, tests: dict[str, Column], column: str = "reason") -> DataFrame:
    """Adds the first reason whose test holds, ``kept`` where none does (a null test does not hold)."""
    out = F.lit("kept")
    for name, test in reversed(tests.items()):
        out = F.when(test, F.lit(name)).otherwise(out)
    return df.withColumn(column, out)


def counted(df: DataFrame, counts: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Row counters in one pass: how many rows of each group fulfil each test."""
    return df.groupBy(*(by or [])).agg(*[F.count_if(c).alias(k) for k, c in counts.items()])


def first_n(df: DataFrame, key: list[str], value: str, n: int = 3) -> DataFrame:
    """``key..., first``: the n smallest distinct values of each key; never more than n of a key travel to one place."""
    w = Window.partitionBy(*key).orderBy(value)
    some = df.select(*key, value).distinct().withColumn("__i", F.row_number().over(w)).filter(F.col("__i") <= n)
    return some.groupBy(*key).agg(F.array_sort(F.collect_list(value)).alias("first"))


def lineage_edges(taxa: DataFrame, node: str, parent: str, rank: str, ranks: list[str]) -> DataFrame:
    """``head_id, relation, tail_id``: from every taxon to its ancestors of the given ranks, by ``belongs_to_<rank>``."""
    one = taxa.groupBy(node).agg(F.min(parent).alias("p"), F.min(rank).alias("r"))
    up = hierarchy(one, node, "p").select(F.col("node").alias("head_id"), F.explode("path").alias("tail_id"))
    ranked = one.select(F.col(node).alias("tail_id"), F.col("r")).filter(F.col("r").isin(ranks))
    return up.join(ranked, "tail_id").select("head_id", F.concat(F.lit("belongs_to_"), "r").alias("relation"), "tail_id")


def surrogates(test: DataFrame, train: DataFrame) -> DataFrame:
    """``relation, surrogate``: each relation of test itself where train has it, else train's most frequent one between the same types (ties: the smallest name); null if there is none."""
    shape = ["head_type", "tail_type"]
    have = train.groupBy("relation", *shape).agg(F.count("*").alias("n"))
    best = have.groupBy(*shape).agg(F.min_by("relation", F.struct(-F.col("n"), F.col("relation"))).alias("b"), F.max("n").alias("bn"))
    known = train.select("relation", F.col("relation").alias("own")).distinct()
    asked = test.groupBy("relation", *shape).agg(F.count("*").alias("m")).join(best, shape, "left").join(known, "relation", "left")
    picked = asked.groupBy("relation").agg(F.max("own").alias("own"), F.max_by("b", F.struct(F.coalesce("bn", F.lit(0)), "b")).alias("b"))
    return picked.select("relation", F.coalesce("own", "b").alias("surrogate"))
