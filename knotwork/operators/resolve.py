"""Entity resolution: clusters of ids, canonical members, prioritized lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions.scalars import namespace_of
from knotwork.operators.components import components

# Name spaces in the order in which a cluster's name is chosen.
CANONICAL_ORDER = ["HMDB", "CHEBI", "PUBCHEM", "KEGG", "VMH_MET", "MESH", "GMNAME"]


def star_pairs(ids: Column) -> Column:
    """Pairs (first non-empty id, each other one) of a row's ids, as an array of structs a, b."""
    kept = F.filter(ids, lambda x: x.isNotNull() & (x != ""))
    return F.transform(kept, lambda x: F.struct(kept[0].alias("a"), x.alias("b")))


def _rank(id_: Column, order: list[str]) -> Column:
    ns = namespace_of(id_)
    out = F.lit(99)
    for i, name in reversed(list(enumerate(order))):
        out = F.when(ns == name, F.lit(i)).otherwise(out)
    return out


def cluster_map(pairs: DataFrame, a: str, b: str, order: list[str] | None = None) -> DataFrame:
    """``original_id, canonical_id, cluster_id, cluster_size`` of all linked ids.

    The canonical member is the first by name space, then by its bytes.  Ids of
    rows with a null partner form clusters with what else they are linked to,
    or of their own; repeated rows and empty tables are allowed.
    """
    order = order or CANONICAL_ORDER
    c = components(pairs, a, b)
    named = c.groupBy("component").agg(F.min_by("id", F.struct(_rank(F.col("id"), order), F.col("id"))).alias("canonical_id"), F.count("*").cast("int").alias("cluster_size"))
    return c.join(named, "component").select(F.col("id").alias("original_id"), "canonical_id", F.col("canonical_id").alias("cluster_id"), "cluster_size")


def resolve_by_priority(candidates: DataFrame, order: list[str]) -> DataFrame:
    """``id, resolved_id, reason``: of each id's candidates (``id, other``) the smallest of the first name space that has one.

    One aggregation instead of one join per name space.
    """
    per = [F.min(F.when(F.col("other").startswith(f"{n}:"), F.col("other"))).alias(f"__{n}") for n in order]
    reason = F.lit("unresolved")
    for n in reversed(order):
        reason = F.when(F.col(f"__{n}").isNotNull(), F.lit(n)).otherwise(reason)
    return candidates.groupBy("id").agg(*per).select("id", F.coalesce(*[f"__{n}" for n in order], F.lit("")).alias("resolved_id"), reason.alias("reason"))
