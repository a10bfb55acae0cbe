"""Facts of the edge table over canonical nodes.

Compounds go by their group's id (problem 6), all other nodes by their normal
form.  One plan for every size: the edges are read and normalized once and both
ends are looked up by equi-joins; whether the group table is broadcast is left
to the planner, which goes by its measured bytes.  Ends that are no compounds
get a spread key, so a hot node that has no group never gathers in one task,
and a hot compound is split by AQE's skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions.ids import fact_columns, is_compound

#: keys that rows without a compound are spread over
SPREAD = 4_096


def _named(df: DataFrame, groups: DataFrame, end: str) -> DataFrame:
    g = groups.select(F.col("id").alias("__id"), F.col("group_id").alias("__g"))
    spread = F.concat(F.lit("\x00"), F.pmod(F.xxhash64("head_n", "relation_n", "tail_n"), F.lit(SPREAD)).cast("string"))
    keyed = df.withColumn("__id", F.when(is_compound(F.col(end)), F.col(end)).otherwise(spread))
    return keyed.join(g, "__id", "left").withColumn(end, F.coalesce("__g", F.col(end))).drop("__id", "__g")


def canonical_facts(edges: DataFrame, groups: DataFrame, keep: dict[str, Column], relations: list[str] | None = None) -> DataFrame:
    """Rows that state a fact: the ``keep`` columns and ``relation_n, head_n, tail_n``.

    ``co_occurs_with`` has no direction: its ends come in the order of their bytes.
    """
    facts = fact_columns(edges)
    if relations:
        facts = facts.filter(F.col("relation_n").isin(relations))
    out = _named(_named(facts.select(*[c.alias(k) for k, c in keep.items()], "relation_n", "head_n", "tail_n"), groups, "head_n"), groups, "tail_n")
    return _ordered(out)


def facts_looked_up_once(edges: DataFrame, groups: DataFrame, keep: dict[str, Column]) -> DataFrame:
    """The rows of ``canonical_facts`` for a wide ``keep``: a row moves once, to the group of its one compound end.

    Few facts have two compounds; they are filtered from a second scan and
    looked up at both ends.  The end that is the key is not moved twice.
    """
    facts = fact_columns(edges).select(*[c.alias(k) for k, c in keep.items()], "relation_n", "head_n", "tail_n")
    head, tail = is_compound(F.col("head_n")), is_compound(F.col("tail_n"))
    both = _named(_named(facts.filter(head & tail), groups, "head_n"), groups, "tail_n")
    g = groups.select(F.col("id").alias("__id"), F.col("group_id").alias("__g"))
    spread = F.concat(F.lit("\x00"), F.pmod(F.xxhash64("head_n", "relation_n", "tail_n"), F.lit(SPREAD)).cast("string"))
    keyed = facts.filter(~(head & tail)).withColumn("__id", F.when(head, F.col("head_n")).when(tail, F.col("tail_n")).otherwise(spread))
    rest = keyed.withColumns({c: F.when(F.col(c) != F.col("__id"), F.col(c)) for c in ("head_n", "tail_n")})
    one = rest.join(g, "__id", "left").withColumns({c: F.coalesce(c, "__g", "__id") for c in ("head_n", "tail_n")}).drop("__id", "__g")
    return _ordered(one.unionByName(both))


def _ordered(facts: DataFrame) -> DataFrame:
    loose = F.col("relation_n") == "co_occurs_with"
    return facts.withColumns({"head_n": F.when(loose, F.least("head_n", "tail_n")).otherwise(F.col("head_n")), "tail_n": F.when(loose, F.greatest("head_n", "tail_n")).otherwise(F.col("tail_n"))})
