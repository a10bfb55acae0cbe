"""Queries of the record-level steps and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions import scalars as C
from knotwork.functions.ids import normal_id
from knotwork.functions.missing import is_missing
from knotwork.operators import build as B
from knotwork.operators import records as R
from knotwork.operators import stats as T
from knotwork.operators.resolve import cluster_map, star_pairs
from knotwork.operators.splits import of
from knotwork.plans.common import kg, kg_raw, with_kg, with_raw
from knotwork.plans.resolving import _CLUSTERS, _FORMS, _STRIP
from knotwork.plans.splitting import TRANS, transductive
from knotwork.plans.sqlnorm import id_sql, missing_sql
from knotwork.sources import table

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_LABELS = {"mesh": "MeSH", "ctd": "CTD", "hmdb": "HMDB", "gut": "gut"}


@query(with_raw("SELECT CASE " + " ".join(f"WHEN contains(lower(source), '{k}') THEN '{v}' " for k, v in _LABELS.items()) + "ELSE source END AS label, count(*) AS n FROM raw GROUP BY 1"))
def label_folding(spark: SparkSession, d: str) -> DataFrame:
    """Source lists folded to a label by the first part they contain."""
    return kg_raw(spark, d).groupBy(R.folded(F.col("source"), _LABELS).alias("label")).agg(F.count("*").alias("n"))


@query(f"WITH t AS (SELECT edge_id, unnest(list_distinct(list_filter(list_transform(regexp_split_to_array(source, '[;|,]'), lambda x: trim(x)), lambda x: x <> '*' AND NOT {missing_sql('x')}))) AS source FROM final_kg_edges) SELECT source, count(*) AS n FROM t GROUP BY 1")
def id_split(spark: SparkSession, d: str) -> DataFrame:
    """Records per entry of a delimited column."""
    return R.split_ids(table(spark, d, "final_kg_edges").select("edge_id", "source"), "source").groupBy("source").agg(F.count("*").alias("n"))


@query(
    with_raw(
        "SELECT CASE WHEN starts_with(relation, 'does_not') THEN 'negative' WHEN species_source <> '' AND species_source NOT IN ('human', 'human gut', 'Homo sapiens') THEN 'species' WHEN source = '' THEN 'no source' ELSE 'kept' END AS reason, count(*) AS n FROM raw GROUP BY 1"
    )
)
def filter_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why records are left out: negatives, other hosts, no source."""
    host = (F.col("species_source") != "") & ~F.col("species_source").isin("human", "human gut", "Homo sapiens")
    return R.reasons(kg_raw(spark, d), {"negative": F.col("relation").startswith("does_not"), "species": host, "no source": F.col("source") == ""}).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "SELECT CASE WHEN contains(lower(coalesce(evidence_type, '')), 'experimental') THEN 'causal' ELSE 'association' END AS kind, count(*) AS rows_read,"
    f" count(*) FILTER ({missing_sql('head_id')} OR {missing_sql('relation')} OR {missing_sql('tail_id')}) AS no_fact, count(*) FILTER (NOT ({missing_sql('head_id')} OR {missing_sql('relation')} OR {missing_sql('tail_id')})) AS emitted FROM final_kg_edges GROUP BY 1"
)
def emission_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows read, skipped and emitted, causal records and others apart."""
    gone = is_missing(F.col("head_id")) | is_missing(F.col("relation")) | is_missing(F.col("tail_id"))
    kind = F.when(F.contains(F.lower(F.coalesce("evidence_type", F.lit(""))), F.lit("experimental")), "causal").otherwise("association")
    return R.counted(table(spark, d, "final_kg_edges").withColumn("kind", kind), {"rows_read": F.lit(True), "no_fact": gone, "emitted": ~gone}, ["kind"])


_MAP = f"m AS (SELECT o AS original_id, min(c) AS canonical_id FROM (SELECT {id_sql('original_id')} AS o, {id_sql('canonical_id')} AS c FROM metabolite_canonical) WHERE o IS NOT NULL AND c IS NOT NULL GROUP BY 1)"


@query(with_kg(f"{_MAP}, e AS (SELECT unnest([head_id, tail_id]) AS id, unnest([head_type, tail_type]) AS kind FROM kg) SELECT count(*) FILTER (canonical_id IS NOT NULL AND canonical_id <> id) AS replaced, count(*) FILTER (canonical_id = id) AS same, count(*) FILTER (canonical_id IS NULL) AS unmapped FROM e LEFT JOIN m ON original_id = id WHERE kind IN ('metabolite', 'substrate')"))
def remap_counts(spark: SparkSession, d: str) -> DataFrame:
    """Compound ends that the map replaces, keeps and does not know."""
    c = table(spark, d, "metabolite_canonical")
    one = c.select(normal_id(F.col("original_id")).alias("node_id"), normal_id(F.col("canonical_id")).alias("new")).filter("node_id IS NOT NULL AND new IS NOT NULL").groupBy("node_id").agg(F.min("new").alias("new"))
    ends = B.endpoints(kg(spark, d)).filter(F.col("node_type").isin("metabolite", "substrate"))
    return R.counted(ends.join(one, "node_id", "left"), {"replaced": F.col("new") != F.col("node_id"), "same": F.col("new") == F.col("node_id"), "unmapped": F.col("new").isNull()})


@query(with_raw("SELECT coalesce(nullif(regexp_extract(evidence, '(?:^|\\|)tissue=([^|]*)', 1), ''), nullif(regexp_extract(evidence, '(?:^|\\|)body_site=([^|]*)', 1), ''), nullif(regexp_extract(evidence, '(?:^|\\|)site=([^|]*)', 1), ''), '-') AS site, count(*) AS n FROM raw GROUP BY 1"))
def alias_keys(spark: SparkSession, d: str) -> DataFrame:
    """A value that goes by several names in key=value text."""
    pairs = F.transform(F.filter(F.split("evidence", "[|]"), lambda x: F.contains(x, F.lit("="))), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(x, "^[^=]*=", "").alias("v")))
    of_key = lambda k: F.filter(pairs, lambda p: (p["k"] == k) & (p["v"] != ""))
    value = F.coalesce(*[F.get(of_key(k), F.lit(0))["v"] for k in ("tissue", "body_site", "site")], F.lit("-"))
    return kg_raw(spark, d).groupBy(value.alias("site")).agg(F.count("*").alias("n"))


_DISPATCH = (
    "CASE upper(split_part(s, ':', 1)) " + " ".join(f"WHEN '{n}' THEN {_FORMS[k]}" for n, k in (("PUBCHEM", "pubchem"), ("CID", "pubchem"), ("CHEBI", "chebi"), ("HMDB", "hmdb"), ("KEGG", "kegg"), ("MESH", "mesh"))) + " ELSE '' END"
)


@query(f"WITH v AS (SELECT DISTINCT x, {_STRIP} AS s FROM (SELECT coalesce(original_id, '') AS x FROM metabolite_canonical)) SELECT x AS raw, {_DISPATCH} AS normal FROM v")
def id_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Ids normalized by the form of their own prefix; ``""`` for prefixes without one."""
    v = table(spark, d, "metabolite_canonical").select(F.coalesce("original_id", F.lit("")).alias("raw")).distinct()
    return v.select("raw", C.by_prefix(F.col("raw")).alias("normal"))


@query(
    f"{_CLUSTERS.rsplit(' SELECT c.id AS original_id', 1)[0]}, r AS (SELECT c.id, k.canonical_id, string_split(c.id, ':')[1] AS ns FROM c JOIN k USING (component)), per AS (SELECT canonical_id, ns, count(*) AS n FROM r GROUP BY 1, 2)"
    " SELECT 'size' AS section, CAST(n AS VARCHAR) AS key, count(*) AS n FROM k GROUP BY 2 UNION ALL SELECT 'canonical', string_split(canonical_id, ':')[1], count(*) FROM k GROUP BY 2"
    " UNION ALL SELECT 'conflict', ns, count(*) FROM per WHERE n > 1 GROUP BY 2"
)
def canonical_report(spark: SparkSession, d: str) -> DataFrame:
    """Cluster sizes, name spaces of the canonical ids, and clusters with several ids of one name space."""
    m = _canonical(spark, d)
    part = lambda df, section, key: df.groupBy(F.lit(section).alias("section"), key.alias("key")).agg(F.count("*").alias("n"))
    one = m.select("canonical_id", "cluster_size").distinct()
    many = m.groupBy("canonical_id", C.namespace_of(F.col("original_id")).alias("ns")).agg(F.count("*").alias("c")).filter("c > 1")
    return part(one, "size", F.col("cluster_size").cast("string")).unionByName(part(one, "canonical", C.namespace_of(F.col("canonical_id")))).unionByName(part(many, "conflict", F.col("ns")))


def _canonical(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "metabolite_canonical").select(normal_id(F.col("original_id")).alias("a"), normal_id(F.col("canonical_id")).alias("b"))
    return cluster_map(c, "a", "b")


@query(f"{_CLUSTERS} ORDER BY cluster_id, original_id")
def canonical_sorted(spark: SparkSession, d: str) -> DataFrame:
    """The canonical map by cluster and id."""
    return _canonical(spark, d).orderBy("cluster_id", "original_id")


@query(f"WITH p AS (SELECT {id_sql('original_id')} AS a, {id_sql('canonical_id')} AS b FROM metabolite_canonical) SELECT coalesce(a, b) AS hub, unnest(list_filter([a, b], lambda x: x IS NOT NULL)) AS id, count(*) AS n FROM p WHERE coalesce(a, b) IS NOT NULL GROUP BY 1, 2")
def star_links(spark: SparkSession, d: str) -> DataFrame:
    """The ids of a row as a star on the first one."""
    p = table(spark, d, "metabolite_canonical").select(F.explode(star_pairs(F.array(normal_id(F.col("original_id")), normal_id(F.col("canonical_id"))))).alias("s"))
    return p.groupBy(F.col("s.a").alias("hub"), F.col("s.b").alias("id")).agg(F.count("*").alias("n"))


@query(with_kg("u AS (SELECT DISTINCT relation, head_id, tail_id FROM kg WHERE relation IN ('enriched_in', 'depleted_in')), o AS (SELECT relation, tail_id, head_id, row_number() OVER (PARTITION BY relation, tail_id ORDER BY head_id) AS i FROM u) SELECT relation, tail_id, string_agg(head_id, ',' ORDER BY head_id) AS first FROM o WHERE i <= 3 GROUP BY 1, 2"))
def first_three(spark: SparkSession, d: str) -> DataFrame:
    """The first three heads of every relation and tail."""
    e = of(kg(spark, d), "enriched_in", "depleted_in")
    return R.first_n(e, ["relation", "tail_id"], "head_id", 3).select("relation", "tail_id", F.array_join("first", ",").alias("first"))


@query(with_kg("c AS (SELECT head_id, tail_id FROM kg WHERE relation = 'enriched_in' INTERSECT SELECT head_id, tail_id FROM kg WHERE relation = 'depleted_in') SELECT * FROM c ORDER BY head_id, tail_id LIMIT 30"))
def conflict_examples(spark: SparkSession, d: str) -> DataFrame:
    """The first 30 contradicting pairs of a report."""
    return T.conflicts(kg(spark, d).withColumn("source", F.lit("any")), "enriched_in", "depleted_in").select("head_id", "tail_id").orderBy("head_id", "tail_id").limit(30)


@query("WITH t AS (SELECT unnest(regexp_split_to_array(lower(coalesce(evidence, '')), '[^a-z0-9_]+')) AS token FROM final_kg_edges) SELECT token, count(*) AS n FROM t WHERE token <> '' GROUP BY 1 ORDER BY n DESC, token LIMIT 30")
def token_top30(spark: SparkSession, d: str) -> DataFrame:
    """The 30 most frequent words of the evidence texts."""
    words = table(spark, d, "final_kg_edges").select(F.explode(F.split(F.lower(F.coalesce("evidence", F.lit(""))), "[^a-z0-9_]+")).alias("token")).filter("token <> ''")
    return words.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(30)


_RANKS = ["genus", "family", "order", "class", "phylum"]


@query(
    "WITH RECURSIVE one AS (SELECT ncbi_taxon_id AS node, min(parent_taxon_id) AS p, min(taxon_rank) AS r FROM taxon_names GROUP BY 1), up AS (SELECT node AS head_id, p AS tail_id FROM one WHERE p IS NOT NULL UNION SELECT head_id, p FROM up JOIN one ON one.node = up.tail_id WHERE p IS NOT NULL)"
    f" SELECT head_id, 'belongs_to_' || r AS relation, tail_id FROM up JOIN one ON one.node = tail_id WHERE r IN ({', '.join(repr(r) for r in _RANKS)})"
)
def taxonomy_edges(spark: SparkSession, d: str) -> DataFrame:
    """Every taxon to its ancestors of the five ranks."""
    return R.lineage_edges(table(spark, d, "taxon_names"), "ncbi_taxon_id", "parent_taxon_id", "taxon_rank", _RANKS)


_NAME = "lower(regexp_replace(trim(replace(regexp_replace(coalesce(original_id, ''), '^(UNMAPPED:|VMH:|unmapped: )', ''), '_', ' ')), '\\s+', ' ', 'g'))"


@query(f"SELECT DISTINCT {_NAME} AS name FROM microbe_name_fallback WHERE {_NAME} NOT IN (SELECT lower(trim(name_txt)) FROM taxon_names WHERE name_txt IS NOT NULL)")
def unresolved_names(spark: SparkSession, d: str) -> DataFrame:
    """Typed names that are no name of the list."""
    typed = F.lower(F.regexp_replace(F.trim(F.replace(F.regexp_replace(F.coalesce("original_id", F.lit("")), "^(UNMAPPED:|VMH:|unmapped: )", ""), F.lit("_"), F.lit(" "))), r"\s+", " "))
    names = table(spark, d, "taxon_names").select(F.lower(F.trim("name_txt")).alias("name"))
    return table(spark, d, "microbe_name_fallback").select(typed.alias("name")).distinct().join(names, "name", "left_anti")


@query(
    with_kg(
        f"{TRANS}, te AS (SELECT relation, head_type, tail_type, count(*) AS m FROM kg WHERE relation IN ('utilizes', 'treats_disease', 'enriched_in') GROUP BY 1, 2, 3), ta AS (SELECT relation, head_type, tail_type, count(*) AS n FROM kg WHERE relation NOT IN ('utilizes', 'treats_disease') GROUP BY 1, 2, 3),"
        " be AS (SELECT head_type, tail_type, arg_min(relation, (-n, relation)) AS b, max(n) AS bn FROM ta GROUP BY 1, 2), p AS (SELECT te.relation, max(CASE WHEN te.relation IN (SELECT relation FROM ta) THEN te.relation END) AS own, arg_max(b, (coalesce(bn, 0), b)) AS b FROM te LEFT JOIN be USING (head_type, tail_type) GROUP BY 1) SELECT relation, coalesce(own, b) AS surrogate FROM p"
    )
)
def surrogate_relation(spark: SparkSession, d: str) -> DataFrame:
    """The relation that stands in for one that training never saw."""
    e = kg(spark, d)
    return R.surrogates(of(e, "utilizes", "treats_disease", "enriched_in"), e.filter(~F.col("relation").isin("utilizes", "treats_disease")))
