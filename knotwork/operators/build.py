"""Graph build: standardize, rewrite endpoints, merge, purge, classify, derive nodes.

Edge tables hold strings; missing is ``""``.  All operators accept empty tables
and extra columns; rows with null keys are handled like ``""`` after
``standardize``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions.ids import fact_columns
from knotwork.functions.missing import is_missing

KEY = ["head_id", "head_type", "relation", "tail_id", "tail_type"]
# Evidence classes, the strongest first.
EVIDENCE = ["experimental", "curated_database", "cohort_statistical", "computational", "ontology", "unknown"]
# Source -> evidence class.
SOURCE_CLASS = {
    "AGORA2": "computational", "GMMAD": "computational", "HMDB": "curated_database", "CTD": "curated_database", "gutMGene": "experimental", "BugSigDB": "experimental",
    "Disbiome": "experimental", "Peryton": "experimental", "HMDAD": "experimental", "mBodyMap": "experimental", "gutMDisorder_v2": "experimental", "Piccinno_2025": "experimental",
    "Thomas_2019": "experimental", "NJC19": "experimental", "GMrepo_v3": "cohort_statistical", "Lit44": "cohort_statistical", "cross_source_conflict": "cohort_statistical",
    "NCBI_Taxonomy": "ontology", "MeSH": "ontology",
}


def blank(col: Column) -> Column:
    """Trimmed text, ``""`` where missing."""
    return F.when(is_missing(col), F.lit("")).otherwise(F.trim(col))


def name_list(col: Column, separators: str = "[|;,]") -> Column:
    """Distinct trimmed entries of a delimited list, in order of their bytes."""
    parts = F.transform(F.split(F.coalesce(col, F.lit("")), separators), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: ~F.lower(x).isin("", "nan", "none", "na", "n/a", "-"))))


def standardize(raw: DataFrame, constants: dict[str, str] | None = None, recode: dict[str, str] | None = None) -> DataFrame:
    """Raw edges in the common columns: ids and relations in normal form, lists cleaned, missing as ``""``.

    ``constants`` sets columns for a source that lacks them; ``recode`` renames
    relations.  Rows without head, relation or tail are left out.
    """
    facts = fact_columns(raw)
    relation = F.col("relation_n")
    for old, new in (recode or {}).items():
        relation = F.when(relation == old, F.lit(new)).otherwise(relation)
    plain = {c: blank(F.col(c)) for c in ("head_type", "tail_type", "confidence", "species_source", "evidence")}
    cols = {"head_id": F.col("head_n"), "tail_id": F.col("tail_n"), "relation": relation, "source": F.array_join(name_list(F.col("source")), "|")} | plain
    cols |= {c: F.lit(v) for c, v in (constants or {}).items()}
    kept = [c for c in ("edge_id", "split_name") if c in raw.columns]
    return facts.select(*kept, *[cols[c].alias(c) for c in [*KEY, "confidence", "species_source", "source", "evidence"]])


def remap_endpoints(edges: DataFrame, mapping: DataFrame, types: list[str]) -> DataFrame:
    """Endpoints of the given types by ``mapping`` (original_id, canonical_id); others and unmapped ids stay.

    A map with several rows for an id uses the smallest.  Rows of other types
    get a spread key, so they never gather in one task.
    """
    one = mapping.filter("original_id IS NOT NULL AND canonical_id IS NOT NULL").groupBy("original_id").agg(F.min("canonical_id").alias("__new"))
    out = edges
    for end in ("head", "tail"):
        spread = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(*KEY), F.lit(4096)).cast("string"))
        keyed = out.withColumn("__k", F.when(F.col(f"{end}_type").isin(types), F.col(f"{end}_id")).otherwise(spread))
        out = keyed.join(one.withColumnRenamed("original_id", "__k"), "__k", "left").withColumn(f"{end}_id", F.coalesce("__new", f"{end}_id")).drop("__k", "__new")
    return out


def joined(values: Column) -> Column:
    """Sorted distinct non-empty values joined by a bar."""
    return F.array_join(F.array_sort(F.filter(F.collect_set(values), lambda v: v != "")), "|")


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row per five-part key; every attribute the sorted distinct values of its rows, sources split first."""
    plain = edges.groupBy(*KEY).agg(
        joined(F.col("confidence")).alias("confidence"),
        joined(F.col("species_source")).alias("species_source"),
        F.array_join(F.array_sort(F.filter(F.array_distinct(F.flatten(F.collect_set(F.split("source", r"[|]")))), lambda v: v != "")), "|").alias("source"),
        joined(F.col("evidence")).alias("evidence"),
    )
    return plain


def add_evidence_type(edges: DataFrame) -> DataFrame:
    """``evidence_type``: the classes of the edge's sources, the strongest first."""
    pairs = [F.lit(x) for kv in SOURCE_CLASS.items() for x in kv]
    of = F.create_map(*pairs)
    names = F.filter(F.split("source", r"[|]"), lambda s: s != "")
    classes = F.transform(names, lambda s: F.coalesce(F.element_at(of, s), F.lit("unknown")))
    ordered = F.filter(F.array(*[F.lit(c) for c in EVIDENCE]), lambda c: F.array_contains(classes, c))
    return edges.withColumn("evidence_type", F.array_join(ordered, "|"))


def drop_nodes(edges: DataFrame, nodes: DataFrame, node_type: str) -> DataFrame:
    """Edges without an endpoint of the type among ``nodes`` (one column ``node_id``)."""
    out = edges
    for end in ("head", "tail"):
        bad = nodes.select(F.col("node_id").alias(f"{end}_id"), F.lit(node_type).alias(f"{end}_type"))
        out = out.join(bad, [f"{end}_id", f"{end}_type"], "left_anti")
    return out.select(*edges.columns)


def purge_prefix(edges: DataFrame, node_type: str, prefixes: list[str]) -> DataFrame:
    """Edges without an endpoint of the type whose id begins with a prefix.  A predicate, no join."""
    bad = lambda end: (F.col(f"{end}_type") == node_type) & F.col(f"{end}_id").rlike("^(?:" + "|".join(prefixes) + ")")
    return edges.filter(~bad("head") & ~bad("tail"))


def endpoints(edges: DataFrame, *extra: str) -> DataFrame:
    """One row per end of an edge: node_id, node_type and the extra columns, in one scan."""
    both = F.array(F.struct(F.col("head_id").alias("node_id"), F.col("head_type").alias("node_type")), F.struct(F.col("tail_id").alias("node_id"), F.col("tail_type").alias("node_type")))
    return edges.select(F.explode(both).alias("e"), *extra).select("e.*", *extra)


def single_source_nodes(edges: DataFrame, node_type: str, source: str) -> DataFrame:
    """Nodes of the type that no source but one names."""
    named = endpoints(edges, "source").filter(F.col("node_type") == node_type).select("node_id", F.explode(F.split("source", r"[|]")).alias("s")).filter("s <> ''")
    return named.groupBy("node_id").agg(F.min("s").alias("a"), F.max("s").alias("b")).filter((F.col("a") == source) & (F.col("b") == source)).select("node_id")


def unanchored_diseases(edges: DataFrame) -> DataFrame:
    """Diseases with neither an edge from a microbe nor a place in the ontology."""
    anchored = edges.filter("head_type = 'microbe' AND tail_type = 'disease'").select(F.col("tail_id").alias("node_id"))
    onto = edges.filter("relation = 'is_a'").select(F.explode(F.array("head_id", "tail_id")).alias("node_id"))
    every = endpoints(edges).filter("node_type = 'disease'").select("node_id").distinct()
    return every.join(anchored.unionByName(onto), "node_id", "left_anti")


def default_name(node_id: Column) -> Column:
    """Name of a node that has none: the value behind some prefixes, else the id."""
    value = F.regexp_replace(node_id, "^[^:]*:", "")
    return F.when(node_id.rlike("^(?:HGNC|UNMAPPED|VMH_MET):"), value).when(node_id.rlike("^VMH:"), F.replace(value, F.lit("_"), F.lit(" "))).otherwise(node_id)


def build_nodes(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Nodes (id, type) with name and sorted distinct sources.  ``names``: node_id, node_name, priority; the highest priority wins."""
    sources = F.array_join(F.array_sort(F.filter(F.array_distinct(F.flatten(F.collect_set(F.split("source", r"[|]")))), lambda v: v != "")), "|")
    nodes = endpoints(edges, "source").groupBy("node_id", "node_type").agg(sources.alias("source_databases"))
    best = names.filter("node_name <> ''").groupBy("node_id").agg(F.max(F.struct("priority", "node_name")).alias("m")).select("node_id", F.col("m.node_name").alias("__n"))
    return nodes.join(best, "node_id", "left").select("node_id", "node_type", F.coalesce("__n", default_name(F.col("node_id"))).alias("node_name"), "source_databases")


def degrees(edges: DataFrame) -> DataFrame:
    """``node_id, degree_multi, degree_distinct``: edges at a node (a loop counts twice), and different neighbours."""
    multi = endpoints(edges).groupBy("node_id").agg(F.count("*").alias("degree_multi"))
    pairs = edges.select(F.explode(F.array(F.struct(F.col("head_id").alias("a"), F.col("tail_id").alias("b")), F.struct(F.col("tail_id").alias("a"), F.col("head_id").alias("b")))).alias("p")).select("p.*").distinct()
    return multi.join(pairs.groupBy(F.col("a").alias("node_id")).agg(F.count("*").alias("degree_distinct")), "node_id")
