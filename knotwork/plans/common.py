"""Tables shared by the queries, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from knotwork.operators.build import KEY as _KEY
from knotwork.operators.build import merge_edges, standardize
from knotwork.plans.sqlnorm import facts_sql, missing_sql
from knotwork.session import shared_table
from knotwork.sources import table, version

_RAW = ["edge_id", "split_name", "head_id", "head_type", "relation", "tail_id", "tail_type", "confidence", "species_source", "source", "evidence"]


def kg_raw(spark: SparkSession, d: str) -> DataFrame:
    """final_kg_edges in standard form: one row per record that states a fact."""
    return standardize(table(spark, d, "final_kg_edges").select(*_RAW))


def merged(spark: SparkSession, d: str) -> DataFrame:
    """The merged edges, computed."""
    return merge_edges(kg_raw(spark, d))


def kg(spark: SparkSession, d: str) -> DataFrame:
    """The merged edges as a table by relation, written once per state of the source files: a filter on ``relation`` reads only its folders."""
    columns = [*_KEY, "confidence", "species_source", "source", "evidence"]
    return shared_table(spark, f"kg:{version(spark, d, 'final_kg_edges')}", lambda scratch: scratch.put(merged(spark, d), by="relation")).select(*columns)


def _blank(c: str) -> str:
    return f"CASE WHEN {missing_sql(c)} THEN '' ELSE trim({c}) END"


LIST = "list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(coalesce(source, ''), '[|;,]'), lambda x: trim(x)), lambda x: lower(x) NOT IN ('', 'nan', 'none', 'na', 'n/a', '-'))))"
RAW = (
    f"raw AS (SELECT edge_id, split_name, head_n AS head_id, {_blank('head_type')} AS head_type, relation_n AS relation, tail_n AS tail_id, {_blank('tail_type')} AS tail_type,"
    f" {_blank('confidence')} AS confidence, {_blank('species_source')} AS species_source, array_to_string({LIST}, '|') AS source, {_blank('evidence')} AS evidence FROM ({facts_sql()}))"
)


def agg_list(c: str) -> str:
    return f"coalesce(string_agg(DISTINCT {c}, '|' ORDER BY {c}) FILTER ({c} <> ''), '')"


def sources_of(c: str = "source") -> str:
    """Aggregate: sorted distinct entries of all lists of a group, joined."""
    return f"array_to_string(list_sort(list_distinct(list_filter(flatten(list(string_split({c}, '|'))), lambda x: x <> ''))), '|')"


KEY = "head_id, head_type, relation, tail_id, tail_type"
KG = f"{RAW}, kg AS (SELECT {KEY}, {agg_list('confidence')} AS confidence, {agg_list('species_source')} AS species_source, {sources_of()} AS source, {agg_list('evidence')} AS evidence FROM raw GROUP BY {KEY})"


def with_raw(sql: str) -> str:
    return f"WITH RECURSIVE {RAW}{', ' if not sql.startswith('SELECT') else ' '}{sql}"


def with_kg(sql: str) -> str:
    return f"WITH RECURSIVE {KG}{', ' if not sql.startswith('SELECT') else ' '}{sql}"
