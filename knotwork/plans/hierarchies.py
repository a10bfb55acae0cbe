"""Queries of the ontology and strain hierarchies (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions.ids import fact_columns
from knotwork.operators.hierarchy import descendants, hierarchy
from knotwork.plans.sqlnorm import facts_sql
from knotwork.sources import table

# The relations that lead to a parent.
PARENT_RELATIONS = ["is_a", "is_strain_of"]


def _links(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "final_kg_edges").select("head_id", "head_type", "relation", "tail_id", "tail_type")
    return fact_columns(edges).filter(F.col("relation_n").isin(PARENT_RELATIONS)).select("relation_n", "head_n", "tail_n")


def _solved(spark: SparkSession, d: str, **how) -> DataFrame:
    return hierarchy(_links(spark, d), "head_n", "tail_n", "relation_n", **how)


def _rooted(solved: DataFrame) -> DataFrame:
    return solved.select(F.col("tree").alias("relation"), F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of every node with a parent; circles reported by depth -1 and -2."""
    return _rooted(_solved(spark, d, paths=False))


def hierarchy_contracted(spark: SparkSession, d: str) -> DataFrame:
    """As p1_found with small fragments, so that every level of the contraction is at work on small tables too."""
    return _rooted(_solved(spark, d, fragment_rows=60, paths=False))


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    """The full path of every node, from itself to its root."""
    return _solved(spark, d).select(F.col("tree").alias("relation"), F.col("node").alias("node_id"), F.array_join(F.concat(F.array("node"), "path"), ">").alias("path"))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of every node with their distance, on and below circles too; a path goes once round a circle."""
    return descendants(_solved(spark, d)).select(F.col("tree").alias("relation"), F.col("ancestor").alias("ancestor_id"), F.col("node").alias("node_id"), "distance")


_LINKS = "links AS (SELECT relation_n AS relation, head_n AS node, min(tail_n) AS parent FROM (" + facts_sql("relation_n IN ('is_a', 'is_strain_of')") + ") GROUP BY 1, 2)"
_WALK = (
    f"WITH RECURSIVE {_LINKS}, walk AS (SELECT relation, node, parent AS cur, 1 AS steps, [node] AS seen FROM links"
    " UNION ALL SELECT w.relation, w.node, l.parent, w.steps + 1, list_append(w.seen, w.cur) FROM walk w JOIN links l ON l.relation = w.relation AND l.node = w.cur"
    " WHERE NOT list_contains(w.seen, w.cur))"
)
_TOP = (
    ", ended AS (SELECT w.* FROM walk w LEFT JOIN links l ON l.relation = w.relation AND l.node = w.cur WHERE l.node IS NULL OR list_contains(w.seen, w.cur))"
    ", res AS (SELECT relation, node AS node_id, seen, cur, list_contains(seen, cur) AS ring,"
    " CASE WHEN list_contains(seen, cur) THEN list_min(list_slice(seen, list_position(seen, cur), len(seen))) ELSE cur END AS root_id,"
    " CASE WHEN cur = node THEN -1 WHEN list_contains(seen, cur) THEN -2 ELSE steps END AS depth FROM ended)"
)

QUERIES = {"p1_found": p1_found, "p1_paths": p1_paths, "p1_descendants": p1_descendants, "hierarchy_contracted": hierarchy_contracted}
SQL = {
    "p1_found": f"{_WALK}{_TOP} SELECT relation, node_id, root_id, CAST(depth AS INTEGER) AS depth FROM res",
    "p1_paths": f"{_WALK}{_TOP} SELECT relation, node_id, array_to_string(CASE WHEN cur = node_id THEN list_append(seen, node_id) WHEN ring THEN seen ELSE list_append(seen, cur) END, '>') AS path FROM res",
    "p1_descendants": f"{_WALK}{_TOP} SELECT w.relation, w.cur AS ancestor_id, w.node AS node_id, CAST(w.steps AS INTEGER) AS distance FROM walk w WHERE w.cur = w.node OR NOT list_contains(w.seen, w.cur)",
}
SQL["hierarchy_contracted"] = SQL["p1_found"]
