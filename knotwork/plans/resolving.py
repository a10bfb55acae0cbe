"""Queries of entity resolution: scalar normalizers, cross references, clusters, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions import scalars as S
from knotwork.functions.ids import normal_id
from knotwork.operators.components import components as connected
from knotwork.operators.resolve import cluster_map, resolve_by_priority
from knotwork.plans.common import kg, kg_raw, with_kg, with_raw
from knotwork.plans.sqlnorm import id_sql
from knotwork.sources import table
from knotwork.sources.delimited import parse_lines

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_STRIP = "CASE WHEN lower(trim(x)) IN ('', 'nan', 'none', 'na') THEN '' ELSE trim(x) END"
_FORMS = {
    "pubchem": "CASE WHEN s = '' THEN '' ELSE coalesce('PUBCHEM:' || CAST(CAST(trunc(try_cast(trim(replace(replace(s, 'PUBCHEM:', ''), 'CID:', '')) AS DOUBLE)) AS BIGINT) AS VARCHAR), '') END",
    "chebi": "CASE WHEN s = '' THEN '' ELSE 'CHEBI:' || CASE WHEN regexp_replace(regexp_replace(upper(s), '^(CHEBI:)+', ''), '^0+', '') = '' THEN '0' ELSE regexp_replace(regexp_replace(upper(s), '^(CHEBI:)+', ''), '^0+', '') END END",
    "hmdb": "CASE WHEN s = '' OR NOT starts_with(upper(regexp_replace(s, '^(?i)HMDB:', '')), 'HMDB') THEN '' ELSE 'HMDB:' || upper(regexp_replace(s, '^(?i)HMDB:', '')) END",
    "kegg": "CASE WHEN s = '' THEN '' ELSE 'KEGG:' || regexp_replace(s, '^(?i)KEGG:', '') END",
    "mesh": "CASE WHEN s = '' THEN '' ELSE 'MESH:' || regexp_replace(s, '^(?i)MESH:', '') END",
    "padded": "CASE WHEN s = '' THEN '' ELSE 'HMDB:HMDB' || CASE WHEN length(regexp_replace(s, '^(?i)(HMDB:)?HMDB', '')) < 7 THEN lpad(regexp_replace(s, '^(?i)(HMDB:)?HMDB', ''), 7, '0') ELSE regexp_replace(s, '^(?i)(HMDB:)?HMDB', '') END END",
    "namespace": "CASE WHEN contains(s, ':') THEN string_split(s, ':')[1] ELSE 'OTHER' END",
}


@query(f"WITH v AS (SELECT DISTINCT x, {_STRIP} AS s FROM (SELECT coalesce(original_id, '') AS x FROM metabolite_canonical)) SELECT x AS raw, " + ", ".join(f"{e} AS {k}" for k, e in _FORMS.items()).replace("(?i)", "(?i)") + " FROM v")
def id_normalize(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "metabolite_canonical").select(F.coalesce("original_id", F.lit("")).alias("raw")).distinct()
    x = F.col("raw")
    return v.select(
        "raw", S.pubchem(x).alias("pubchem"), S.chebi(x).alias("chebi"), S.hmdb(x).alias("hmdb"), S.prefixed(x, "KEGG").alias("kegg"), S.prefixed(x, "MESH").alias("mesh"), S.hmdb_padded(x).alias("padded"), S.namespace_of(S.strip(x)).alias("namespace")
    )


@query(
    "WITH t AS (SELECT doc_id AS line_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), l AS (SELECT line_id, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM t)"
    " SELECT line_id, CAST(line_no AS INTEGER) AS line_no, string_split(line, ' ')[1] AS f1, string_split(line, ' ')[3] AS f3 FROM l WHERE NOT starts_with(line, '#') AND len(string_split(line, ' ')) >= 5"
)
def line_parse(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every document, numbered from 0."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("line_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    return parse_lines(lines, "line", " ", 5).select("line_id", "line_no", F.col("fields")[0].alias("f1"), F.col("fields")[2].alias("f3"))


@query(
    with_raw(
        "SELECT CASE WHEN regexp_extract(evidence, 'body_site=([^|]*)', 1) = '' THEN 'none' ELSE regexp_extract(evidence, 'body_site=([^|]*)', 1) END AS capture,"
        " CASE WHEN regexp_extract(evidence, 'body_site=([^|]*)', 1) = '' THEN 'unspecified' WHEN species_source IN ('human', 'human gut', 'Homo sapiens') THEN 'human' ELSE 'other' END AS bucket, count(*) AS n FROM raw GROUP BY 1, 2"
    )
)
def regex_bucket(spark: SparkSession, d: str) -> DataFrame:
    site = F.regexp_extract("evidence", "body_site=([^|]*)", 1)
    bucket = F.when(site == "", "unspecified").when(F.col("species_source").isin("human", "human gut", "Homo sapiens"), "human").otherwise("other")
    return kg_raw(spark, d).groupBy(F.when(site == "", "none").otherwise(site).alias("capture"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


_NAME = "lower(regexp_replace(trim(replace(regexp_replace(coalesce(original_id, ''), '^(UNMAPPED:|VMH:|unmapped: )', ''), '_', ' ')), '\\s+', ' ', 'g'))"


@query(
    f"WITH s AS (SELECT lower(trim(name_txt)) AS name, min(ncbi_taxon_id) AS id FROM taxon_names GROUP BY 1), q AS (SELECT {_NAME} AS name, count(*) AS n FROM microbe_name_fallback GROUP BY 1)"
    " SELECT q.name, coalesce(s.id, '') AS id, s.id IS NOT NULL AS matched, q.n FROM q LEFT JOIN s USING (name)"
)
def synonym_map(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "taxon_names").groupBy(F.lower(F.trim("name_txt")).alias("name")).agg(F.min("ncbi_taxon_id").alias("id"))
    typed = F.lower(F.regexp_replace(F.trim(F.replace(F.regexp_replace(F.coalesce("original_id", F.lit("")), "^(UNMAPPED:|VMH:|unmapped: )", ""), F.lit("_"), F.lit(" "))), r"\s+", " "))
    asked = table(spark, d, "microbe_name_fallback").groupBy(typed.alias("name")).agg(F.count("*").alias("n"))
    return asked.join(names, "name", "left").select("name", F.coalesce("id", F.lit("")).alias("id"), F.col("id").isNotNull().alias("matched"), "n")


_XREF = (
    f"WITH p AS (SELECT {id_sql('original_id')} AS a, {id_sql('canonical_id')} AS b FROM metabolite_canonical), k AS (SELECT a AS id, b AS other FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),"
    " c AS (SELECT id, " + ", ".join(f"min(other) FILTER (starts_with(other, '{n}:')) AS {n.lower()}" for n in ("HMDB", "CHEBI", "PUBCHEM", "KEGG", "MESH")) + " FROM k GROUP BY 1)"
    " SELECT id, coalesce(hmdb, chebi, pubchem, kegg, mesh, '') AS resolved_id, CASE WHEN hmdb IS NOT NULL THEN 'HMDB' WHEN chebi IS NOT NULL THEN 'CHEBI' WHEN pubchem IS NOT NULL THEN 'PUBCHEM' WHEN kegg IS NOT NULL THEN 'KEGG' WHEN mesh IS NOT NULL THEN 'MESH' ELSE 'unresolved' END AS reason FROM c"
)


@query(_XREF)
def xref_resolve(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "metabolite_canonical").select(normal_id(F.col("original_id")).alias("id"), normal_id(F.col("canonical_id")).alias("other"))
    return resolve_by_priority(c.filter("id IS NOT NULL AND other IS NOT NULL AND id <> other"), ["HMDB", "CHEBI", "PUBCHEM", "KEGG", "MESH"])


_RANK = "CASE string_split(id, ':')[1] WHEN 'HMDB' THEN 0 WHEN 'CHEBI' THEN 1 WHEN 'PUBCHEM' THEN 2 WHEN 'KEGG' THEN 3 WHEN 'VMH_MET' THEN 4 WHEN 'MESH' THEN 5 WHEN 'GMNAME' THEN 6 ELSE 99 END"
_CLUSTERS = (
    f"WITH RECURSIVE pairs AS (SELECT DISTINCT {id_sql('original_id')} AS a, {id_sql('canonical_id')} AS b FROM metabolite_canonical), ids AS (SELECT a AS id FROM pairs WHERE a IS NOT NULL UNION SELECT b FROM pairs WHERE b IS NOT NULL),"
    " ends AS (SELECT a, b FROM pairs WHERE a <> b UNION SELECT b, a FROM pairs WHERE a <> b), reach AS (SELECT id, id AS name FROM ids UNION SELECT e.b, r.name FROM reach r JOIN ends e ON e.a = r.id),"
    f" c AS (SELECT id, min(name) AS component FROM reach GROUP BY id), k AS (SELECT component, arg_min(id, ({_RANK}, id)) AS canonical_id, count(*) AS n FROM c GROUP BY 1)"
    " SELECT c.id AS original_id, k.canonical_id, k.canonical_id AS cluster_id, CAST(k.n AS INTEGER) AS cluster_size FROM c JOIN k USING (component)"
)


@query(_CLUSTERS)
def canonical_ids(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "metabolite_canonical").select(normal_id(F.col("original_id")).alias("a"), normal_id(F.col("canonical_id")).alias("b"))
    return cluster_map(c, "a", "b")


_SPARSE = "sparse AS (SELECT head_id AS a, tail_id AS b FROM kg WHERE relation IN ('is_a', 'is_strain_of', 'treats_disease')), both_ AS (SELECT a, b FROM sparse UNION SELECT b, a FROM sparse), reach AS (SELECT a AS v, a AS name FROM both_ UNION SELECT b.b, r.name FROM reach r JOIN both_ b ON b.a = r.v), c AS (SELECT v, min(name) AS component FROM reach GROUP BY 1)"


@query(with_kg(f"{_SPARSE} SELECT component, count(*) AS size FROM c GROUP BY 1"))
def components(spark: SparkSession, d: str) -> DataFrame:
    e = kg(spark, d).filter(F.col("relation").isin("is_a", "is_strain_of", "treats_disease"))
    return connected(e, "head_id", "tail_id").groupBy("component").agg(F.count("*").alias("size"))


@query(None)
def components_all(spark: SparkSession, d: str) -> DataFrame:
    """Components of the whole graph, every relation; recursive SQL is too slow for the giant one."""
    return connected(kg(spark, d), "head_id", "tail_id").groupBy("component").agg(F.count("*").alias("size"))


_DOTTED = (
    "c AS (SELECT CAST(r_regionkey AS VARCHAR) AS code FROM region UNION ALL SELECT n_regionkey || '.' || n_nationkey FROM nation"
    " UNION ALL SELECT n.n_regionkey || '.' || n.n_nationkey || '.' || c_custkey FROM customer JOIN nation n ON n.n_nationkey = c_nationkey)"
)


@query(f"WITH {_DOTTED}, k AS (SELECT code, regexp_replace(code, '\\.[^.]*$', '') AS up FROM c WHERE contains(code, '.')) SELECT k.code AS child, c.code AS parent FROM k JOIN c ON c.code = k.up")
def tree_parents(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    code = lambda *c: F.concat_ws(".", *[F.col(x).cast("string") for x in c])
    codes = (
        table(spark, d, "region").select(code("r_regionkey").alias("code"))
        .unionByName(nation.select(code("n_regionkey", "n_nationkey").alias("code")))
        .unionByName(table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(code("n_regionkey", "n_nationkey", "c_custkey").alias("code")))
    )
    child = codes.filter(F.col("code").contains(".")).select(F.col("code").alias("child"), F.regexp_replace("code", r"\.[^.]*$", "").alias("up"))
    return child.join(codes, F.col("up") == F.col("code")).select("child", F.col("code").alias("parent"))
