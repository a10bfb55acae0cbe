"""Queries of the graph build."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions.missing import is_missing
from knotwork.operators import build as B
from knotwork.operators.records import key_values
from knotwork.plans.common import kg, kg_raw, merged, sources_of, with_kg, with_raw
from knotwork.plans.sqlnorm import id_sql, missing_sql
from knotwork.functions.ids import normal_id
from knotwork.sources import table

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(with_raw("SELECT relation, head_type, tail_type, count(*) AS n FROM raw GROUP BY 1, 2, 3"))
def edges_scan(spark: SparkSession, d: str) -> DataFrame:
    return kg_raw(spark, d).groupBy("relation", "head_type", "tail_type").agg(F.count("*").alias("n"))


@query(with_raw("SELECT head_id, head_type, CASE WHEN relation = 'inconsistent_association' THEN 'associated_with_disease' ELSE relation END AS relation, tail_id, tail_type, confidence, species_source, source, 'species=' || species_source || '|confidence=' || confidence || '|note=' || evidence AS evidence FROM raw"))
def kg_standardize(spark: SparkSession, d: str) -> DataFrame:
    raw = B.standardize(table(spark, d, "final_kg_edges"), recode={"inconsistent_association": "associated_with_disease"})
    return raw.drop("edge_id", "split_name").withColumn("evidence", key_values({"species": F.col("species_source"), "confidence": F.col("confidence"), "note": F.col("evidence")}))


_MAP = f"m AS (SELECT o AS original_id, min(c) AS canonical_id FROM (SELECT {id_sql('original_id')} AS o, {id_sql('canonical_id')} AS c FROM metabolite_canonical) WHERE o IS NOT NULL AND c IS NOT NULL GROUP BY 1)"
_REMAPPED = (
    f"{_MAP}, rm AS (SELECT kg.* EXCLUDE (head_id, tail_id), CASE WHEN head_type IN ('metabolite', 'substrate') THEN coalesce(a.canonical_id, head_id) ELSE head_id END AS head_id,"
    " CASE WHEN tail_type IN ('metabolite', 'substrate') THEN coalesce(b.canonical_id, tail_id) ELSE tail_id END AS tail_id FROM kg LEFT JOIN m a ON a.original_id = head_id LEFT JOIN m b ON b.original_id = tail_id)"
)


@query(with_kg(f"{_REMAPPED} SELECT head_id, head_type, relation, tail_id, tail_type, source FROM rm"))
def remap_endpoints(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "metabolite_canonical")
    mapping = c.select(normal_id(F.col("original_id")).alias("original_id"), normal_id(F.col("canonical_id")).alias("canonical_id"))
    return B.remap_endpoints(kg(spark, d), mapping, ["metabolite", "substrate"]).select(*B.KEY, "source")


@query(with_kg("SELECT * FROM kg"))
def kg_merge(spark: SparkSession, d: str) -> DataFrame:
    return merged(spark, d)


def _kept_sql(ctes: str, bad: str) -> str:
    return with_kg(f"{ctes}k AS (SELECT *, ({bad}) AS bad FROM kg) SELECT head_id, head_type, relation, tail_id, tail_type, bad AS removed FROM k")


def _marked(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Every edge and whether the purge took it."""
    return edges.select(*B.KEY).join(kept.select(*B.KEY, F.lit(False).alias("k")), B.KEY, "left").select(*B.KEY, F.col("k").isNull().alias("removed"))


@query(_kept_sql("", "(head_type = 'microbe' AND regexp_matches(head_id, '^(VMH|UNMAPPED):')) OR (tail_type = 'microbe' AND regexp_matches(tail_id, '^(VMH|UNMAPPED):'))"))
def purge_prefix(spark: SparkSession, d: str) -> DataFrame:
    e = kg(spark, d)
    return _marked(e, B.purge_prefix(e, "microbe", ["VMH:", "UNMAPPED:"]))


_ENDS = "ends AS (SELECT head_id AS node_id, head_type AS node_type, source FROM kg UNION ALL SELECT tail_id, tail_type, source FROM kg)"


@query(_kept_sql(f"{_ENDS}, one AS (SELECT node_id FROM ends WHERE node_type = 'metabolite' GROUP BY 1 HAVING {sources_of()} = 'GMMAD'), ", "(head_type = 'metabolite' AND head_id IN (FROM one)) OR (tail_type = 'metabolite' AND tail_id IN (FROM one))"))
def purge_single_source(spark: SparkSession, d: str) -> DataFrame:
    e = kg(spark, d)
    return _marked(e, B.drop_nodes(e, B.single_source_nodes(e, "metabolite", "GMMAD"), "metabolite"))


_UNANCHORED = (
    f"{_ENDS}, keep AS (SELECT tail_id AS node_id FROM kg WHERE head_type = 'microbe' AND tail_type = 'disease' UNION SELECT head_id FROM kg WHERE relation = 'is_a' UNION SELECT tail_id FROM kg WHERE relation = 'is_a'),"
    " bad AS (SELECT DISTINCT node_id FROM ends WHERE node_type = 'disease' AND node_id NOT IN (FROM keep)), "
)


@query(_kept_sql(_UNANCHORED, "(head_type = 'disease' AND head_id IN (FROM bad)) OR (tail_type = 'disease' AND tail_id IN (FROM bad))"))
def purge_unanchored(spark: SparkSession, d: str) -> DataFrame:
    e = kg(spark, d)
    return _marked(e, B.drop_nodes(e, B.unanchored_diseases(e), "disease"))


_CLASS = "CASE x " + " ".join(f"WHEN '{s}' THEN '{c}'" for s, c in B.SOURCE_CLASS.items()) + " ELSE 'unknown' END"
_EVIDENCE = f"list_transform(list_filter(string_split(source, '|'), lambda x: x <> ''), lambda x: {_CLASS})"
_TYPED = f"array_to_string(list_filter([{', '.join(repr(c) for c in B.EVIDENCE)}], lambda c: list_contains({_EVIDENCE}, c)), '|')"


@query(with_kg(f"SELECT {_TYPED} AS evidence_type, count(*) AS n FROM kg GROUP BY 1"))
def evidence_type(spark: SparkSession, d: str) -> DataFrame:
    return B.add_evidence_type(kg(spark, d)).groupBy("evidence_type").agg(F.count("*").alias("n"))


_NAMES = (
    f"named AS (SELECT node_id, node_name, 1 AS pr FROM final_kg_nodes WHERE NOT {missing_sql('node_name')} UNION ALL SELECT ncbi_taxon_id, name_txt, 2 FROM taxon_names WHERE name_class = 'scientific name' AND NOT {missing_sql('name_txt')}),"
    " names AS (SELECT node_id, arg_max(node_name, (pr, node_name)) AS node_name FROM named GROUP BY 1)"
)
_DEFAULT = "CASE WHEN regexp_matches(e.node_id, '^(HGNC|UNMAPPED|VMH_MET):') THEN regexp_replace(e.node_id, '^[^:]*:', '') WHEN starts_with(e.node_id, 'VMH:') THEN replace(regexp_replace(e.node_id, '^[^:]*:', ''), '_', ' ') ELSE e.node_id END"
_NODES = f"{_ENDS}, {_NAMES}, nodes AS (SELECT e.node_id, e.node_type, coalesce(min(n.node_name), min({_DEFAULT})) AS node_name, {sources_of('e.source')} AS source_databases FROM ends e LEFT JOIN names n ON n.node_id = e.node_id GROUP BY 1, 2)"


def _nodes(spark: SparkSession, d: str, e: DataFrame) -> DataFrame:
    """Names of the node table; the scientific name of a taxon goes before them."""
    listed = table(spark, d, "final_kg_nodes").filter(~is_missing(F.col("node_name"))).select("node_id", "node_name", F.lit(1).alias("priority"))
    taxa = table(spark, d, "taxon_names").filter((F.col("name_class") == "scientific name") & ~is_missing(F.col("name_txt")))
    return B.build_nodes(e, listed.unionByName(taxa.select(F.col("ncbi_taxon_id").alias("node_id"), F.col("name_txt").alias("node_name"), F.lit(2).alias("priority"))))


@query(with_kg(f"{_NODES} SELECT * FROM nodes"))
def kg_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d, kg(spark, d))


@query(
    with_kg(
        f"{_NODES}, src AS (SELECT unnest(string_split(source, '|')) AS s FROM kg), deg AS (SELECT node_id, count(*) AS k FROM ends GROUP BY 1)"
        " SELECT 'relation' AS section, relation AS key, count(*) AS n FROM kg GROUP BY 2 UNION ALL SELECT 'source', s, count(*) FROM src WHERE s <> '' GROUP BY 2"
        " UNION ALL SELECT 'node_type', node_type, count(*) FROM nodes GROUP BY 2 UNION ALL SELECT 'total', 'edges', count(*) FROM kg UNION ALL SELECT 'total', 'nodes', count(*) FROM nodes"
        " UNION ALL SELECT 'total', 'low_degree', count(*) FROM deg WHERE k <= 1 UNION ALL SELECT 'total', 'shared_microbes', count(*) FROM nodes WHERE node_type = 'microbe' AND contains(source_databases, '|')"
    )
)
def kg_report(spark: SparkSession, d: str) -> DataFrame:
    e = kg(spark, d)
    n = _nodes(spark, d, e)
    part = lambda df, section, key: df.groupBy(F.lit(section).alias("section"), key.alias("key")).agg(F.count("*").alias("n"))
    total = lambda df, key: df.agg(F.count("*").alias("n")).select(F.lit("total").alias("section"), F.lit(key).alias("key"), "n")
    sources = e.select(F.explode(F.split("source", r"[|]")).alias("s")).filter("s <> ''")
    low = B.endpoints(e).groupBy("node_id").count().filter("count <= 1")
    shared = n.filter("node_type = 'microbe'").filter(F.col("source_databases").contains("|"))
    out = part(e, "relation", F.col("relation"))
    for more in (part(sources, "source", F.col("s")), part(n, "node_type", F.col("node_type")), total(e, "edges"), total(n, "nodes"), total(low, "low_degree"), total(shared, "shared_microbes")):
        out = out.unionByName(more)
    return out


@query(with_raw(f"SELECT head_id, tail_id, relation, {sources_of()} AS sources, substr(arg_min(evidence, edge_id), 1, 200) AS detail, count(*) AS n_records FROM raw WHERE relation IN ('upregulates_gene', 'downregulates_gene') GROUP BY 1, 2, 3"))
def action_edges(spark: SparkSession, d: str) -> DataFrame:
    raw = kg_raw(spark, d).filter(F.col("relation").isin("upregulates_gene", "downregulates_gene"))
    return raw.groupBy("head_id", "tail_id", "relation").agg(
        F.array_join(F.array_sort(F.filter(F.array_distinct(F.flatten(F.collect_set(F.split("source", r"[|]")))), lambda v: v != "")), "|").alias("sources"),
        F.substring(F.min_by("evidence", "edge_id"), 1, 200).alias("detail"),
        F.count("*").alias("n_records"),
    )


@query("WITH t AS (SELECT unnest(list_filter(list_transform(regexp_split_to_array(lower(coalesce(evidence_type, '')), '[|;,]'), lambda x: replace(trim(x), ' ', '_')), lambda x: x <> '')) AS token FROM final_kg_edges) SELECT token, count(*) AS n FROM t GROUP BY 1")
def action_explode(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.transform(F.split(F.lower(F.coalesce("evidence_type", F.lit(""))), "[|;,]"), lambda x: F.replace(F.trim(x), F.lit(" "), F.lit("_")))
    return table(spark, d, "final_kg_edges").select(F.explode(F.filter(tokens, lambda x: x != "")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(with_kg(f"{_ENDS} SELECT e.node_id, count(*) AS degree_multi, (SELECT count(DISTINCT b) FROM (SELECT head_id AS a, tail_id AS b FROM kg UNION ALL SELECT tail_id, head_id FROM kg) p WHERE p.a = e.node_id) AS degree_distinct FROM ends e GROUP BY 1"))
def degree(spark: SparkSession, d: str) -> DataFrame:
    return B.degrees(kg(spark, d))


@query(with_kg("SELECT relation || '>' || tail_type AS key, count(*) AS n FROM kg GROUP BY 1 ORDER BY n DESC, key LIMIT 10"))
def topk_counts(spark: SparkSession, d: str) -> DataFrame:
    return kg(spark, d).groupBy(F.concat_ws(">", "relation", "tail_type").alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(10)


@query(with_kg("keys AS (SELECT DISTINCT head_id, tail_id FROM kg WHERE relation = 'treats_disease') SELECT kg.head_id, kg.relation, kg.tail_id FROM kg JOIN keys USING (head_id, tail_id)"))
def key_join(spark: SparkSession, d: str) -> DataFrame:
    e = kg(spark, d)
    keys = e.filter("relation = 'treats_disease'").select("head_id", "tail_id").distinct()
    return e.join(keys, ["head_id", "tail_id"]).select("head_id", "relation", "tail_id")


@query(
    with_kg(
        "SELECT CASE WHEN head_type = 'microbe' AND tail_type = 'disease' AND relation IN ('enriched_in', 'depleted_in') THEN 'pos' WHEN relation = 'inconsistent_association' THEN 'neg'"
        " WHEN relation IN ('is_a', 'is_strain_of') OR relation LIKE 'belongs_to_%' THEN 'aux' ELSE 'bridge' END AS scope, relation, count(*) AS n FROM kg GROUP BY 1, 2"
    )
)
def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    pos = (F.col("head_type") == "microbe") & (F.col("tail_type") == "disease") & F.col("relation").isin("enriched_in", "depleted_in")
    aux = F.col("relation").isin("is_a", "is_strain_of") | F.col("relation").startswith("belongs_to_")
    scope = F.when(pos, "pos").when(F.col("relation") == "inconsistent_association", "neg").when(aux, "aux").otherwise("bridge")
    return kg(spark, d).groupBy(scope.alias("scope"), "relation").agg(F.count("*").alias("n"))


