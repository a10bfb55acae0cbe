"""Queries of the graph audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import audit as A
from knotwork.operators.splits import RANKS, of
from knotwork.plans.common import kg, kg_raw, with_kg, with_raw
from knotwork.plans.splitting import MEDIATORS, TRANS, mediators, transductive
from knotwork.session import Scratch

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all edges, train graph, test edges) of the transductive split."""
    e = kg(spark, d)
    t = transductive(e)
    return e, t.filter("fold = 'train'"), t.filter("fold = 'test'")


_PARTS = f"{TRANS}, train AS (SELECT * FROM tr WHERE fold = 'train'), test AS (SELECT * FROM tr WHERE fold = 'test')"


_ROWS = "rws AS (SELECT *, CASE WHEN md5('7|' || head_id || '|' || relation || '|' || tail_id) < '2' THEN 'test' ELSE 'train' END AS f FROM kg WHERE relation IN ('enriched_in', 'depleted_in', 'inconsistent_association', 'produces', 'can_utilize'))"


def _rows(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A split of single edges, where pairs may leak."""
    r = of(e, "enriched_in", "depleted_in", "inconsistent_association", "produces", "can_utilize")
    is_test = F.md5(F.concat_ws("|", F.lit("7"), "head_id", "relation", "tail_id")) < "2"
    return r.filter(~is_test), r.filter(is_test)


@query(with_raw("SELECT DISTINCT head_id, relation, tail_id FROM raw WHERE split_name = 'test' INTERSECT SELECT head_id, relation, tail_id FROM raw WHERE split_name = 'train'"))
def leak_duplicate(spark: SparkSession, d: str) -> DataFrame:
    """Facts of test records that train records state too, word for word in normal form."""
    raw = kg_raw(spark, d)
    return A.duplicates(raw.filter("split_name = 'test'"), raw.filter("split_name = 'train'")).select("head_id", "relation", "tail_id").distinct()


@query(
    with_kg(
        f"{_ROWS} SELECT a.head_id, a.relation, a.tail_id, string_agg(DISTINCT b.relation, '|' ORDER BY b.relation) AS other_relations FROM (SELECT DISTINCT head_id, relation, tail_id FROM rws WHERE f = 'test') a"
        " JOIN rws b ON b.f = 'train' AND b.head_id = a.head_id AND b.tail_id = a.tail_id AND b.relation <> a.relation GROUP BY 1, 2, 3"
    )
)
def leak_pair_overlap(spark: SparkSession, d: str) -> DataFrame:
    train, test = _rows(kg(spark, d))
    return A.pair_overlap(test, train)


_ADJ = "adj AS (SELECT head_id AS a, tail_id AS b FROM kg WHERE relation IN ('is_strain_of', 'belongs_to_genus') AND head_id <> tail_id UNION SELECT tail_id, head_id FROM kg WHERE relation IN ('is_strain_of', 'belongs_to_genus') AND head_id <> tail_id)"
_HOPS = (
    f"{_ADJ}, fresh AS (SELECT DISTINCT head_id, relation, tail_id FROM test EXCEPT SELECT head_id, relation, tail_id FROM train), s AS (SELECT DISTINCT head_id AS source FROM fresh),"
    " h1 AS (SELECT DISTINCT source, b AS node, 1 AS hop FROM s JOIN adj ON a = source), h2 AS (SELECT DISTINCT source, adj.b AS node, 2 AS hop FROM h1 JOIN adj ON adj.a = h1.node WHERE adj.b <> source AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.source = h1.source AND x.node = adj.b)),"
    " hp AS (FROM h1 UNION ALL FROM h2), leak AS (SELECT f.head_id, f.relation, f.tail_id, min(hop) AS hop FROM fresh f JOIN hp ON hp.source = f.head_id JOIN (SELECT DISTINCT head_id, relation, tail_id FROM train) t ON t.head_id = hp.node AND t.relation = f.relation AND t.tail_id = f.tail_id GROUP BY 1, 2, 3)"
)


def _taxonomy(e: DataFrame) -> DataFrame:
    return A.symmetric(of(e, "is_strain_of", "belongs_to_genus"))


@query(with_kg(f"{_PARTS}, {_HOPS} SELECT head_id, relation, tail_id, hop FROM leak"))
def leak_closure(spark: SparkSession, d: str) -> DataFrame:
    e, train, test = parts(spark, d)
    return A.closure_leak(test, train, _taxonomy(e), "head", 2)


_FREE = (
    f"{TRANS}, hn AS (SELECT DISTINCT head_id, tail_id FROM kg WHERE relation = 'does_not_utilize' UNION SELECT DISTINCT head_id, tail_id FROM tr WHERE relation = 'inconsistent_association'),"
    " test AS (SELECT * FROM tr WHERE fold = 'test'), train0 AS (SELECT * FROM tr WHERE fold = 'train'), train AS (SELECT * FROM train0 t WHERE NOT (relation IN ('enriched_in', 'depleted_in') AND EXISTS (SELECT 1 FROM hn WHERE hn.head_id = t.head_id AND hn.tail_id = t.tail_id))),"
    + _HOPS
)


@query(
    with_kg(
        f"{_FREE}, l1 AS (SELECT * FROM leak WHERE hop = 1) SELECT 'train' AS file, head_id, relation, tail_id FROM train UNION ALL"
        " SELECT 'test', head_id, relation, tail_id FROM test WHERE NOT EXISTS (SELECT 1 FROM l1 WHERE l1.head_id = test.head_id AND l1.relation = test.relation AND l1.tail_id = test.tail_id)"
    )
)
def leakage_free(spark: SparkSession, d: str) -> DataFrame:
    e, train, test = parts(spark, d)
    hard = of(e, "does_not_utilize").select("head_id", "tail_id").unionByName(of(transductive(e), "inconsistent_association").select("head_id", "tail_id"))
    tr, te = A.leakage_free(train, test, hard, _taxonomy(e), ["enriched_in", "depleted_in"])
    tag = lambda df, f: df.select(F.lit(f).alias("file"), "head_id", "relation", "tail_id")
    return tag(tr, "train").unionByName(tag(te, "test"))


# The microbe taxonomy.
TAXONOMY = ["is_strain_of", "is_clade_of", *[f"belongs_to_{r}" for r in RANKS]]


def closures(e: DataFrame) -> dict[str, DataFrame]:
    """The neighbours of each end: the whole taxonomy for heads, is_a between diseases for tails."""
    return {"head": A.symmetric(of(e, *TAXONOMY)), "tail": A.symmetric(of(e, "is_a").filter("head_type = 'disease' AND tail_type = 'disease'"))}


def _written(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(all edges, associations with fold, train, test), written once: both ends use them again."""
    scratch = Scratch(spark, "audit")
    e = scratch.put(kg(spark, d).select("head_id", "head_type", "relation", "tail_id", "tail_type"))
    t = scratch.put(transductive(e))
    return e, t, t.filter("fold = 'train'"), t.filter("fold = 'test'")


@query(None)
def leak_closure_full(spark: SparkSession, d: str) -> DataFrame:
    """Leaks of both ends, over every rank and over the disease ontology."""
    e, _, train, test = _written(spark, d)
    leaks = [A.closure_leak(test, train, adj, end, 2).select(F.lit(end).alias("side"), "hop") for end, adj in closures(e).items()]
    return leaks[0].unionByName(leaks[1]).groupBy("side", "hop").agg(F.count("*").alias("n"))


@query(None)
def leakage_free_full(spark: SparkSession, d: str) -> DataFrame:
    """Rows before and after the leaks of both ends over one hop are taken out."""
    e, t, train, test = _written(spark, d)
    hard = of(e, "does_not_utilize").select("head_id", "tail_id").unionByName(of(t, "inconsistent_association").select("head_id", "tail_id"))
    near = closures(e)
    tr, te = A.leakage_free(train, test, hard, near["head"], ["enriched_in", "depleted_in"])
    by_tail = A.closure_leak(test, tr, near["tail"], "tail", 1).select("head_id", "relation", "tail_id")
    te = te.join(by_tail, ["head_id", "relation", "tail_id"], "left_anti")
    tag = lambda df, f, c: df.select(F.lit(f).alias("file"), F.lit(c).alias("c"))
    every = tag(train, "train", "before").unionByName(tag(tr, "train", "after")).unionByName(tag(test, "test", "before")).unionByName(tag(te, "test", "after"))
    return every.groupBy("file").agg(F.count_if(F.col("c") == "before").alias("n_before"), F.count_if(F.col("c") == "after").alias("n_after"))


# paths from a microbe to a disease: over a metabolite it makes or uses, and over a gene that metabolite regulates
_PATHS = (
    "tg AS (SELECT DISTINCT head_id AS x, tail_id AS z FROM kg WHERE relation IN ('enriched_in', 'depleted_in')), mm AS (SELECT DISTINCT head_id AS x, tail_id AS y FROM kg WHERE relation = 'produces'),"
    " md AS (SELECT DISTINCT head_id AS y, tail_id AS z FROM kg WHERE relation IN ('treats_disease', 'associated_with_disease')), mg AS (SELECT DISTINCT head_id AS y, tail_id AS g FROM kg WHERE relation IN ('upregulates_gene', 'downregulates_gene')),"
    " gd AS (SELECT DISTINCT head_id AS g, tail_id AS z FROM kg WHERE relation = 'therapeutic_target_for'), mgx AS (SELECT DISTINCT x, g FROM mm JOIN mg USING (y)),"
    " hard AS (SELECT x, z, EXISTS (SELECT 1 FROM mm JOIN md USING (y) WHERE mm.x = tg.x AND md.z = tg.z) AS micro, EXISTS (SELECT 1 FROM mgx JOIN gd USING (g) WHERE mgx.x = tg.x AND gd.z = tg.z) AS gene FROM tg)"
)


def _paths(e: DataFrame):
    pair = lambda df, a, b: df.select(F.col("head_id").alias(a), F.col("tail_id").alias(b)).distinct()
    tg = pair(of(e, "enriched_in", "depleted_in"), "x", "z")
    mm = pair(of(e, "produces"), "x", "y")
    md = pair(of(e, "treats_disease", "associated_with_disease"), "y", "z")
    mg = pair(of(e, "upregulates_gene", "downregulates_gene"), "y", "g")
    gd = pair(of(e, "therapeutic_target_for"), "y", "z")
    mgx = mm.join(mg, "y").select("x", F.col("g").alias("y")).distinct()
    return tg, mm, md, mg, gd, mgx


def _flags(tg: DataFrame, mm: DataFrame, md: DataFrame, mgx: DataFrame, gd: DataFrame) -> DataFrame:
    micro = A.reachable(tg, mm, md).withColumn("micro", F.lit(True))
    gene = A.reachable(tg, mgx, gd).withColumn("gene", F.lit(True))
    return tg.join(micro, ["x", "z"], "left").join(gene, ["x", "z"], "left").na.fill(False, ["micro", "gene"])


@query(with_kg(f"{_PATHS} SELECT 'microbe-disease' AS target, count(*) AS n, count(*) FILTER (micro) AS micro, count(*) FILTER (gene) AS gene, count(*) FILTER (micro OR gene) AS either_, count(*) FILTER (NOT micro AND NOT gene) AS none_ FROM hard"))
def path_reach(spark: SparkSession, d: str) -> DataFrame:
    tg, mm, md, _, gd, mgx = _paths(kg(spark, d))
    f = _flags(tg, mm, md, mgx, gd)
    both, neither = F.col("micro") | F.col("gene"), ~F.col("micro") & ~F.col("gene")
    return f.agg(F.count("*").alias("n"), F.count_if("micro").alias("micro"), F.count_if("gene").alias("gene"), F.count_if(both).alias("either_"), F.count_if(neither).alias("none_")).select(F.lit("microbe-disease").alias("target"), "*")


@query(with_kg(f"{_PATHS} SELECT 'micro' AS path, 'microbe' AS end_, count(DISTINCT x) FILTER (micro) AS covered, count(DISTINCT x) AS total FROM hard UNION ALL SELECT 'micro', 'disease', count(DISTINCT z) FILTER (micro), count(DISTINCT z) FROM hard UNION ALL SELECT 'gene', 'microbe', count(DISTINCT x) FILTER (gene), count(DISTINCT x) FROM hard UNION ALL SELECT 'gene', 'disease', count(DISTINCT z) FILTER (gene), count(DISTINCT z) FROM hard"))
def path_marginal(spark: SparkSession, d: str) -> DataFrame:
    tg, mm, md, _, gd, mgx = _paths(kg(spark, d))
    rows = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(e).alias("end_"), F.col(c).alias("id"), F.col(p).alias("hit")) for p in ("micro", "gene") for e, c in (("microbe", "x"), ("disease", "z"))])
    long = _flags(tg, mm, md, mgx, gd).select(F.explode(rows).alias("r")).select("r.*")
    return long.groupBy("path", "end_").agg(F.countDistinct(F.when(F.col("hit"), F.col("id"))).alias("covered"), F.countDistinct("id").alias("total"))


@query(
    with_kg(
        f"{_PATHS}, soft AS (SELECT *, x IN (SELECT x FROM mm) AS m_end, z IN (SELECT z FROM md) AS d_end FROM hard)"
        " SELECT 'microbe-disease' AS target, count(*) FILTER (micro) AS hard, count(*) FILTER (m_end AND d_end) AS soft, count(*) FILTER (m_end) AS met_end, count(*) FILTER (d_end) AS dis_end FROM soft"
    )
)
def path_soft(spark: SparkSession, d: str) -> DataFrame:
    tg, mm, md, _, gd, mgx = _paths(kg(spark, d))
    f = _flags(tg, mm, md, mgx, gd)
    f = f.join(mm.select("x", F.lit(True).alias("m")).distinct(), "x", "left").join(md.select("z", F.lit(True).alias("dd")).distinct(), "z", "left").na.fill(False, ["m", "dd"])
    return f.agg(F.count_if("micro").alias("hard"), F.count_if(F.col("m") & F.col("dd")).alias("soft"), F.count_if("m").alias("met_end"), F.count_if("dd").alias("dis_end")).select(F.lit("microbe-disease").alias("target"), "*")


@query(
    with_kg(
        f"{_PATHS}, br AS (SELECT y FROM mm INTERSECT SELECT y FROM mg) SELECT (SELECT count(DISTINCT y) FROM mm) AS n_prod, (SELECT count(DISTINCT y) FROM mg) AS n_reg, (SELECT count(*) FROM br) AS n_bridge,"
        " (SELECT count(DISTINCT x) FROM mm WHERE y IN (FROM br)) AS n_left, (SELECT count(DISTINCT g) FROM mg WHERE y IN (FROM br)) AS n_right"
    )
)
def bridge_nodes(spark: SparkSession, d: str) -> DataFrame:
    _, mm, _, mg, _, _ = _paths(kg(spark, d))
    br = mm.select("y").intersect(mg.select("y"))
    tag = lambda df, c, name: df.select(F.lit(name).alias("k"), F.col(c).alias("id")).distinct()
    every = tag(mm, "y", "n_prod")
    for df, c, name in ((mg, "y", "n_reg"), (br, "y", "n_bridge"), (mm.join(br, "y", "left_semi"), "x", "n_left"), (mg.join(br, "y", "left_semi"), "g", "n_right")):
        every = every.unionByName(tag(df, c, name))
    return every.agg(*[F.count_if(F.col("k") == n).alias(n) for n in ("n_prod", "n_reg", "n_bridge", "n_left", "n_right")])


@query(
    with_kg(
        f"{_PATHS}, ax AS (SELECT DISTINCT tail_id AS y, head_id AS g FROM kg WHERE relation = 'associated_with_metabolite'), tiers AS (SELECT 'base' AS tier, y, g FROM mg UNION ALL SELECT DISTINCT 'associated', y, g FROM (SELECT y, g FROM mg UNION SELECT y, g FROM ax)),"
        " tm AS (SELECT DISTINCT tier, x, g FROM mm JOIN tiers USING (y)) SELECT tier, count(*) FILTER (EXISTS (SELECT 1 FROM tm WHERE tm.tier = k.tier AND tm.x = tg.x)) AS met_end,"
        " count(*) FILTER (EXISTS (SELECT 1 FROM tm JOIN gd USING (g) WHERE tm.tier = k.tier AND tm.x = tg.x AND gd.z = tg.z)) AS reachable FROM tg, (SELECT unnest(['base', 'associated']) AS tier) k GROUP BY 1"
    )
)
def supply_tiers(spark: SparkSession, d: str) -> DataFrame:
    e = kg(spark, d)
    tg, mm, _, mg, gd, _ = _paths(e)
    extra = of(e, "associated_with_metabolite").select(F.col("tail_id").alias("y"), F.col("head_id").alias("g")).distinct()
    out = None
    for tier, genes in (("base", mg), ("associated", mg.unionByName(extra).distinct())):
        via = mm.join(genes, "y").select("x", F.col("g").alias("y")).distinct()
        hit = A.reachable(tg, via, gd).withColumn("r", F.lit(1))
        row = tg.join(via.select("x", F.lit(1).alias("m")).distinct(), "x", "left").join(hit, ["x", "z"], "left").agg(F.count("m").alias("met_end"), F.count("r").alias("reachable")).select(F.lit(tier).alias("tier"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    with_kg(
        "up AS (SELECT head_id AS id, min(tail_id) AS parent FROM kg WHERE relation = 'belongs_to_genus' GROUP BY 1), l AS (SELECT DISTINCT head_id AS id FROM kg WHERE relation = 'produces'), r AS (SELECT DISTINCT head_id AS id FROM kg WHERE relation IN ('enriched_in', 'depleted_in')),"
        " lu AS (SELECT DISTINCT coalesce(parent, id) AS id FROM l LEFT JOIN up USING (id)), ru AS (SELECT DISTINCT coalesce(parent, id) AS id FROM r LEFT JOIN up USING (id))"
        " SELECT 'microbe' AS level, count(*) AS mediator_n FROM (FROM l INTERSECT FROM r) UNION ALL SELECT 'genus', count(*) FROM (FROM lu INTERSECT FROM ru)"
    )
)
def genus_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = kg(spark, d)
    up = of(e, "belongs_to_genus").select(F.col("head_id").alias("id"), F.col("tail_id").alias("parent"))
    ids = lambda *r: of(e, *r).select(F.col("head_id").alias("id")).distinct()
    left, right = ids("produces"), ids("enriched_in", "depleted_in")
    n = lambda df, level: df.agg(F.count("*").alias("mediator_n")).select(F.lit(level).alias("level"), "mediator_n")
    return n(left.intersect(right), "microbe").unionByName(n(A.roll_up(left, up).intersect(A.roll_up(right, up)), "genus"))


@query(
    with_kg(
        "cu AS (SELECT DISTINCT head_id FROM kg WHERE relation = 'can_utilize'), md AS (SELECT DISTINCT head_id FROM kg WHERE relation IN ('enriched_in', 'depleted_in'))"
        " SELECT 'mediators' AS set_name, count(*) AS n FROM (FROM cu INTERSECT FROM md) UNION ALL SELECT 'capacity_only', count(*) FROM (FROM cu EXCEPT FROM md) UNION ALL SELECT 'disease_only', count(*) FROM (FROM md EXCEPT FROM cu)"
    )
)
def mediator_pool(spark: SparkSession, d: str) -> DataFrame:
    e = kg(spark, d)
    cu, md = of(e, "can_utilize").select("head_id"), of(e, "enriched_in", "depleted_in").select("head_id")
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("set_name"), "n")
    return n(cu.intersect(md), "mediators").unionByName(n(cu.subtract(md), "capacity_only")).unionByName(n(md.subtract(cu), "disease_only"))


@query(with_kg("a AS (SELECT DISTINCT head_id, tail_id FROM kg WHERE relation = 'enriched_in'), b AS (SELECT DISTINCT head_id, tail_id FROM kg WHERE relation = 'depleted_in') SELECT (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS overlap, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS net_new"))
def pair_overlap_counts(spark: SparkSession, d: str) -> DataFrame:
    e = kg(spark, d)
    sides = of(e, "enriched_in", "depleted_in").groupBy("head_id", "tail_id").agg(F.max(F.col("relation") == "enriched_in").alias("up"), F.max(F.col("relation") == "depleted_in").alias("down"))
    return sides.agg(F.count_if(F.col("up") & F.col("down")).alias("overlap"), F.count_if(F.col("down") & ~F.col("up")).alias("net_new"))


_CAP = "relation = 'utilizes'"
_COMPOSE = (
    f"{MEDIATORS}, lf AS (SELECT DISTINCT tail_id AS x, head_id AS y FROM kg WHERE {_CAP}), rg AS (SELECT DISTINCT head_id AS y, tail_id AS z, relation AS label FROM kg WHERE relation IN ('enriched_in', 'depleted_in')),"
    " cp AS (SELECT x, z, y, label, coalesce(fold, 'train') AS fold FROM lf JOIN rg USING (y) LEFT JOIN med ON med.head_id = y),"
    " tp AS (SELECT x, z, count(DISTINCT y) AS n_via, string_agg(DISTINCT y, ',' ORDER BY y) AS via, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM cp WHERE fold <> 'train' GROUP BY 1, 2),"
    " gen AS (SELECT tp.*, NOT EXISTS (SELECT 1 FROM cp WHERE cp.fold = 'train' AND cp.x = tp.x AND cp.z = tp.z) AS genuine FROM tp)"
)


def _composed(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(substrate-disease pairs over held-out mediators, pairs that train mediators already give)."""
    med = mediators(e).select(F.col("head_id").alias("y"), "fold")
    left = of(e, "utilizes").select(F.col("tail_id").alias("x"), F.col("head_id").alias("y")).distinct()
    right = of(e, "enriched_in", "depleted_in").select(F.col("head_id").alias("y"), F.col("tail_id").alias("z"), F.col("relation").alias("label")).distinct()
    side = left.join(med, "y", "left").withColumn("fold", F.coalesce("fold", F.lit("train")))
    return A.compose(side.filter("fold <> 'train'"), right), A.two_hop(side.filter("fold = 'train'"), right)


@query(with_kg(f"{_COMPOSE} SELECT x AS substrate, z AS disease, n_via AS n_microbes, labels AS directions, 'mediating_microbes=' || via || '|n_microbes=' || n_via || '|directions=' || labels || '|genuine_discovery=' || CASE WHEN genuine THEN 'yes' ELSE 'no' END AS evidence FROM gen"))
def compose_sd(spark: SparkSession, d: str) -> DataFrame:
    test, train = _composed(kg(spark, d))
    known = train.withColumn("known", F.lit(True))
    text = F.concat(F.lit("mediating_microbes="), F.col("via"), F.lit("|n_microbes="), F.col("n_via").cast("string"), F.lit("|directions="), F.col("labels"), F.lit("|genuine_discovery="), F.when(F.col("known"), "no").otherwise("yes"))
    return test.join(known, ["x", "z"], "left").select(F.col("x").alias("substrate"), F.col("z").alias("disease"), F.col("n_via").alias("n_microbes"), F.col("labels").alias("directions"), text.alias("evidence"))


@query(with_kg(f"{_COMPOSE} SELECT z AS disease, count(*) AS n_total, count(*) FILTER (genuine) AS n_genuine FROM gen GROUP BY 1"))
def sd_genuine(spark: SparkSession, d: str) -> DataFrame:
    test, train = _composed(kg(spark, d))
    flagged = test.join(train.withColumn("known", F.lit(1)), ["x", "z"], "left")
    return flagged.groupBy(F.col("z").alias("disease")).agg(F.count("*").alias("n_total"), F.count_if(F.col("known").isNull()).alias("n_genuine"))


@query(
    with_kg(
        f"{_COMPOSE}, subs AS (SELECT count(DISTINCT x) AS n FROM lf), per AS (SELECT z, count(*) AS total, count(*) FILTER (genuine) AS pos FROM gen GROUP BY 1)"
        " SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(greatest((SELECT n FROM subs) - total, 0)) AS BIGINT) AS n_neg, count(*) AS n_disease FROM per"
    )
)
def pool_imbalance(spark: SparkSession, d: str) -> DataFrame:
    e = kg(spark, d)
    test, train = _composed(e)
    n = of(e, "utilizes").select("tail_id").distinct().count()  # one number
    per = test.join(train.withColumn("known", F.lit(1)), ["x", "z"], "left").groupBy("z").agg(F.count("*").alias("total"), F.count_if(F.col("known").isNull()).alias("pos"))
    return per.agg(F.sum("pos").alias("n_pos"), F.sum(F.greatest(F.lit(n) - F.col("total"), F.lit(0))).alias("n_neg"), F.count("*").alias("n_disease"))
