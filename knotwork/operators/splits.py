"""Deterministic splits, their scrubs and proximity strata.

Random order is the md5 order of ``ranking``; no operator sorts a whole table
in one task or collects a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.operators.ranking import fold, hash_order, hash_rank

# Taxonomic ranks, the closest first.
RANKS = ["genus", "family", "order", "class", "phylum"]


def of(edges: DataFrame, *relations: str) -> DataFrame:
    return edges.filter(F.col("relation").isin(*relations))


def split_pairs(edges: DataFrame, train: float = 0.8, valid: float = 0.1, seed: int = 42) -> DataFrame:
    """Edges with ``fold``; all edges of a (head, tail) pair share it, whatever their relation."""
    pairs = hash_rank(edges.select("head_id", "tail_id").distinct(), ["head_id", "tail_id"], seed).select("head_id", "tail_id", fold(train, valid).alias("fold"))
    return edges.join(pairs, ["head_id", "tail_id"])


def split_rows(edges: DataFrame, key: list[str], train: float = 0.8, valid: float = 0.1, seed: int = 42) -> DataFrame:
    """Edges with ``fold``, each row by itself."""
    return hash_rank(edges, key, seed).withColumn("fold", fold(train, valid)).drop("rk", "n")


def hold_out(ids: DataFrame, column: str, test: float, valid: float, seed: int = 42) -> DataFrame:
    """``column, fold``: the first share of the distinct ids is test, the next valid, the rest train."""
    f = F.when(F.col("rk") <= F.bround(F.col("n") * test), "test").when(F.col("rk") <= F.bround(F.col("n") * test) + F.bround(F.col("n") * valid), "valid").otherwise("train")
    return hash_rank(ids.select(column).distinct(), [column], seed).select(column, f.alias("fold"))


def fraction(seed: int, *keys: str) -> Column:
    """Number in [0, 1) from the hash of the keys."""
    return F.conv(F.substring(hash_order(seed, *keys), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def keep_one(edges: DataFrame, head: str, key: list[str], share: float = 0.1, seed: int = 42) -> DataFrame:
    """Edges with ``fold``: of every head the first row in hash order stays, each other one is valid or test by its hash."""
    hashed = edges.withColumn("__h", hash_order(seed, *key))
    first = hashed.groupBy(head).agg(F.min("__h").alias("__m"))
    x = fraction(seed, *key)
    f = F.when(F.col("__h") == F.col("__m"), "train").when(x < share, "valid").when(x < 2 * share, "test").otherwise("train")
    return hashed.join(first, head).withColumn("fold", f).drop("__h", "__m")


def unordered(edges: DataFrame) -> DataFrame:
    """Adds ``__a, __b``: the ends in the order of their bytes."""
    return edges.withColumns({"__a": F.least("head_id", "tail_id"), "__b": F.greatest("head_id", "tail_id")})


def between(edges: DataFrame, pairs: DataFrame, how: str = "left_semi") -> DataFrame:
    """Edges, of any relation and direction, between held pairs (``left_anti``: all others)."""
    held = unordered(pairs).select("__a", "__b").distinct()
    return unordered(edges).join(held, ["__a", "__b"], how).drop("__a", "__b")


def without_pairs(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges whose (head, tail) is in no row of ``pairs``."""
    return edges.join(pairs.select("head_id", "tail_id").distinct(), ["head_id", "tail_id"], "left_anti")


def without_triples(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges that are not among the removed (head, relation, tail); repeated rows stay repeated."""
    return edges.join(removed.select("head_id", "relation", "tail_id").distinct(), ["head_id", "relation", "tail_id"], "left_anti")


def sample(rows: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """The first n rows in hash order (all if there are fewer)."""
    return hash_rank(rows, key, seed).filter(F.col("rk") <= n).drop("rk", "n")


def lineage(edges: DataFrame) -> DataFrame:
    """``microbe, rank_no, taxon`` from the ``belongs_to_*`` edges."""
    no = F.lit(None).cast("int")
    for i, r in enumerate(RANKS):
        no = F.when(F.col("relation") == f"belongs_to_{r}", F.lit(i)).otherwise(no)
    return edges.select(F.col("head_id").alias("microbe"), no.alias("rank_no"), F.col("tail_id").alias("taxon")).filter("rank_no IS NOT NULL").distinct()


def _rank_name(no: Column) -> Column:
    out = F.lit("none")
    for i, r in enumerate(RANKS):
        out = F.when(no == i, r).otherwise(out)
    return out


def nearest_shared_rank(query: DataFrame, reference: DataFrame, lines: DataFrame, exclude_query: bool = True) -> DataFrame:
    """``microbe, nearest_shared_rank``: the closest rank at which a query microbe shares a taxon with any reference microbe, else ``none``.

    With ``exclude_query`` the query microbes are no references.
    """
    ref = reference.select("microbe").distinct()
    if exclude_query:
        ref = ref.join(query.select("microbe").distinct(), "microbe", "left_anti")
    taxa = lines.join(ref, "microbe", "left_semi").select("rank_no", "taxon").distinct()
    ask = query.select("microbe").distinct()
    best = lines.join(ask, "microbe", "left_semi").join(taxa, ["rank_no", "taxon"], "left_semi").groupBy("microbe").agg(F.min("rank_no").alias("r"))
    return ask.join(best, "microbe", "left").select("microbe", _rank_name(F.col("r")).alias("nearest_shared_rank"))


def shares_parent(query: DataFrame, reference: DataFrame, is_a: DataFrame, exclude_query: bool = True) -> DataFrame:
    """``disease, shares_parent`` (parent or none): whether a query disease has a parent in common with a reference disease."""
    up = is_a.select(F.col("head_id").alias("disease"), F.col("tail_id").alias("parent")).distinct()
    ref = reference.select("disease").distinct()
    if exclude_query:
        ref = ref.join(query.select("disease").distinct(), "disease", "left_anti")
    parents = up.join(ref, "disease", "left_semi").select("parent").distinct()
    ask = query.select("disease").distinct()
    hit = up.join(ask, "disease", "left_semi").join(parents, "parent", "left_semi").select("disease", F.lit("parent").alias("p")).distinct()
    return ask.join(hit, "disease", "left").select("disease", F.coalesce("p", F.lit("none")).alias("shares_parent"))


def capacity_layers(query: DataFrame, capable: DataFrame, lines: DataFrame) -> DataFrame:
    """``microbe, capacity_layer, nearest_shared_rank``: own capacity, only a relative's, or none."""
    rank = nearest_shared_rank(query, capable, lines)
    own = capable.select("microbe", F.lit(True).alias("own")).distinct()
    layer = F.when(F.col("own"), "has_own_capacity").when(F.col("nearest_shared_rank") != "none", "tax_only").otherwise("no_capacity")
    return rank.join(own, "microbe", "left").select("microbe", layer.alias("capacity_layer"), "nearest_shared_rank")


def halves(pairs: DataFrame, key: list[str], seed: int = 42) -> DataFrame:
    """The distinct pairs with ``fold``: the first half in hash order is valid, the other test."""
    ranked = hash_rank(pairs.select(*key).distinct(), key, seed)
    return ranked.select(*key, F.when(F.col("rk") <= F.bround(F.col("n") * 0.5), "valid").otherwise("test").alias("fold"))


def valid_or_slice(valid: DataFrame | None, train: DataFrame, key: list[str], share: float = 0.02, most: int = 5_000, seed: int = 42) -> DataFrame:
    """The given validation rows, or, without any, a slice of train in hash order (at least one row, at most ``most``)."""
    if valid is not None and not valid.isEmpty():
        return valid.select(*key)
    return hash_rank(train.select(*key), key, seed).filter(F.col("rk") <= F.least(F.lit(most), F.greatest(F.lit(1), F.floor(F.col("n") * share)))).select(*key)
