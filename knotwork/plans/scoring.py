"""Queries of link scoring and metrics."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import metrics as M
from knotwork.operators import score as S
from knotwork.operators.audit import symmetric
from knotwork.operators.build import degrees
from knotwork.operators.ranking import hash_rank
from knotwork.operators.splits import of, without_triples
from knotwork.operators.walks import Coded, number, numbered
from knotwork.plans.common import kg, with_kg
from knotwork.plans.splitting import ASSOCIATIONS, TRANS, transductive
from knotwork.session import shared_table
from knotwork.sources import table, version

QUERIES, SQL = {}, {}
# The graph of the SQL oracles.  The full graphs are too dense for SQL on whole tables; their queries have the suffix of the scope.
GRAPH = ["enriched_in", "depleted_in", "treats_disease", "is_a", "is_strain_of", "belongs_to_genus", "utilizes"]
AUX = ["is_strain_of", "is_clade_of", "belongs_to_genus", "belongs_to_family", "belongs_to_order", "belongs_to_class", "belongs_to_phylum", "is_a", "co_occurs_with"]
_IN = "('" + "', '".join(GRAPH) + "')"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _edges(spark: SparkSession, d: str, scope: str) -> DataFrame:
    """Distinct edges of the scope (see ``_graph``), read from the merged table by relation."""
    e = kg(spark, d).select("head_id", "head_type", "relation", "tail_id", "tail_type")
    return e if scope == "bridges" else of(e, *sorted({*ASSOCIATIONS, *(GRAPH if scope == "oracle" else AUX)}))


def _shared(spark: SparkSession, d: str, name: str, make) -> DataFrame:
    return shared_table(spark, f"{name}:{version(spark, d, 'final_kg_edges')}", lambda scratch: scratch.put(make()))


def _folds(spark: SparkSession, d: str) -> DataFrame:
    """The associations with their fold, written once: every query over the split reads it."""
    return _shared(spark, d, "folds", lambda: transductive(kg(spark, d)).select("head_id", "relation", "tail_id", "fold"))


def _graph(spark: SparkSession, d: str, scope: str = "oracle") -> tuple[DataFrame, DataFrame]:
    """(train edges, test pairs h, t of enriched_in and depleted_in), the train graph of a scope being written once.

    ``scope``: ``oracle`` has the relations of GRAPH, ``aux`` the associations,
    the taxonomy, is_a and co_occurs_with, ``bridges`` every relation.
    """
    t = _folds(spark, d)

    def make() -> DataFrame:
        e = _edges(spark, d, scope)
        return without_triples(of(e, *GRAPH) if scope == "oracle" else e, t.filter("fold <> 'train'"))

    train = _shared(spark, d, f"graph-{scope}", make)
    return train, of(t.filter("fold = 'test'"), "enriched_in", "depleted_in").select(F.col("head_id").alias("h"), F.col("tail_id").alias("t")).distinct()


def _adjacency(spark: SparkSession, d: str, scope: str = "oracle", relations: list[str] | None = None) -> DataFrame:
    train, _ = _graph(spark, d, scope)
    return _shared(spark, d, f"adjacency-{scope}-{'+'.join(relations or [])}", lambda: symmetric(of(train, *relations) if relations else train))


def _coded(spark: SparkSession, d: str, scope: str = "oracle", relations: list[str] | None = None) -> Coded:
    """The adjacency with numbered nodes, written once."""
    name, adj = f"{scope}-{'+'.join(relations or [])}", _adjacency(spark, d, scope, relations)
    nodes = _shared(spark, d, f"nodes-{name}", lambda: number(adj))
    return Coded(nodes, _shared(spark, d, f"numbered-{name}", lambda: numbered(adj, nodes)))


_G = (
    f"{TRANS}, rem AS (SELECT DISTINCT head_id, relation, tail_id FROM tr WHERE fold <> 'train'), g AS (SELECT * FROM kg WHERE relation IN {_IN} AND NOT EXISTS (SELECT 1 FROM rem WHERE rem.head_id = kg.head_id AND rem.relation = kg.relation AND rem.tail_id = kg.tail_id)),"
    " adj AS (SELECT head_id AS a, tail_id AS b FROM g WHERE head_id <> tail_id UNION SELECT tail_id, head_id FROM g WHERE head_id <> tail_id), deg AS (SELECT a AS node, count(*) AS d FROM adj GROUP BY 1),"
    " pairs AS (SELECT DISTINCT head_id AS h, tail_id AS t FROM tr WHERE fold = 'test' AND relation IN ('enriched_in', 'depleted_in'))"
)
_MID = "mid AS (SELECT h, t, x.b AS m FROM pairs JOIN adj x ON x.a = h JOIN adj y ON y.a = x.b AND y.b = t)"


@query(with_kg(f"{_G}, {_MID} SELECT h AS head, t AS tail, count(m) AS cn FROM pairs LEFT JOIN mid USING (h, t) GROUP BY 1, 2"))
def structural_cn(spark: SparkSession, d: str, scope: str = "oracle") -> DataFrame:
    _, pairs = _graph(spark, d, scope)
    return S.common_neighbours(pairs, _adjacency(spark, d, scope)).select(F.col("h").alias("head"), F.col("t").alias("tail"), "cn")


@query(with_kg(f"{_G}, {_MID} SELECT h AS head, t AS tail, round(coalesce(sum(1.0::DOUBLE / d), 0), 6) AS ra FROM pairs LEFT JOIN mid USING (h, t) LEFT JOIN deg ON node = m GROUP BY 1, 2"))
def structural_ra(spark: SparkSession, d: str, scope: str = "oracle") -> DataFrame:
    _, pairs = _graph(spark, d, scope)
    return S.resource_allocation(pairs, _adjacency(spark, d, scope)).select(F.col("h").alias("head"), F.col("t").alias("tail"), F.round("ra", 6).alias("ra"))


_L3 = "w2 AS (SELECT h, y.b AS y, sum(1.0::DOUBLE / sqrt(d)) AS w FROM (SELECT DISTINCT h FROM pairs) JOIN adj x ON x.a = h JOIN deg ON node = x.b JOIN adj y ON y.a = x.b GROUP BY 1, 2), l3 AS (SELECT h, t, sum(w / sqrt(d)) AS s FROM pairs JOIN adj z ON z.a = t JOIN deg ON node = z.b JOIN w2 USING (h) WHERE w2.y = z.b GROUP BY 1, 2)"


@query(with_kg(f"{_G}, {_L3} SELECT h AS head, t AS tail, round(coalesce(s, 0), 6) AS l3 FROM pairs LEFT JOIN l3 USING (h, t)"))
def structural_l3(spark: SparkSession, d: str, scope: str = "oracle") -> DataFrame:
    _, pairs = _graph(spark, d, scope)
    return S.l3(pairs, _adjacency(spark, d, scope), _coded(spark, d, scope)).select(F.col("h").alias("head"), F.col("t").alias("tail"), F.round("l3", 6).alias("l3"))


@query(with_kg(f"{_G}, dm AS (SELECT n, count(*) AS k FROM (SELECT head_id AS n FROM g UNION ALL SELECT tail_id FROM g) GROUP BY 1) SELECT h AS head, t AS tail, coalesce(k, 0) AS score FROM pairs LEFT JOIN dm ON n = t"))
def popularity(spark: SparkSession, d: str, scope: str = "oracle") -> DataFrame:
    train, pairs = _graph(spark, d, scope)
    return S.popularity(pairs, degrees(train)).select(F.col("h").alias("head"), F.col("t").alias("tail"), "score")


_RND = "CAST(('0x' || substr(md5('42|' || h || '|' || t), 1, 8)) AS BIGINT) / 4294967296.0"


@query(with_kg(f"{_G} SELECT h AS head, t AS tail, {_RND} AS score FROM pairs"))
def random_floor(spark: SparkSession, d: str) -> DataFrame:
    _, pairs = _graph(spark, d)
    return S.random_scores(pairs).select(F.col("h").alias("head"), F.col("t").alias("tail"), "score")


@query(
    with_kg(
        f"{_G}, s AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5('42|' || h || '|' || t)) AS rk FROM pairs) WHERE rk <= 300), pairs2 AS (SELECT h, t FROM s),"
        f" m2 AS (SELECT h, t, count(*) AS cn FROM pairs2 JOIN adj x ON x.a = h JOIN adj y ON y.a = x.b AND y.b = t GROUP BY 1, 2), {_L3}"
        " SELECT round(avg(CASE WHEN h IN (SELECT node FROM deg) THEN 1.0::DOUBLE ELSE 0 END), 6) AS head_cov, round(avg(CASE WHEN t IN (SELECT node FROM deg) THEN 1.0::DOUBLE ELSE 0 END), 6) AS tail_cov,"
        " round(avg(CASE WHEN coalesce(cn, 0) > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS cn_pos, round(avg(CASE WHEN coalesce(l3.s, 0) > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS l3_pos FROM pairs2 LEFT JOIN m2 USING (h, t) LEFT JOIN l3 USING (h, t)"
    )
)
def heuristic_viability(spark: SparkSession, d: str, scope: str = "oracle") -> DataFrame:
    """Share of a sample of 300 test pairs whose ends are in the graph and whose scores are above 0."""
    _, pairs = _graph(spark, d, scope)
    adj = _adjacency(spark, d, scope)
    some = hash_rank(pairs, ["h", "t"]).filter("rk <= 300").select("h", "t")
    deg = S.with_degree(adj)
    inside = lambda c: deg.select(F.col("node").alias(c), F.lit(1.0).alias(f"in_{c}"))
    j = some.join(inside("h"), "h", "left").join(inside("t"), "t", "left").join(S.common_neighbours(some, adj), ["h", "t"]).join(S.l3(some, adj, _coded(spark, d, scope)), ["h", "t"]).na.fill(0.0)
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return j.agg(share(F.col("in_h") > 0).alias("head_cov"), share(F.col("in_t") > 0).alias("tail_cov"), share(F.col("cn") > 0).alias("cn_pos"), share(F.col("l3") > 0).alias("l3_pos"))


_RANK = (
    "pool_t AS (SELECT DISTINCT tail_id AS c FROM tr WHERE relation IN ('enriched_in', 'depleted_in')), pool_h AS (SELECT DISTINCT head_id AS c FROM tr WHERE relation IN ('enriched_in', 'depleted_in')), known AS (SELECT DISTINCT head_id AS h, tail_id AS t FROM tr WHERE relation IN ('enriched_in', 'depleted_in')),"
    " sc AS (SELECT x.a AS q, y.b AS c, round(sum(1.0::DOUBLE / d), 9) AS s FROM adj x JOIN deg ON node = x.b JOIN adj y ON y.a = x.b WHERE x.a IN (SELECT h FROM pairs UNION SELECT t FROM pairs) GROUP BY 1, 2),"
    " sides AS (SELECT 'tail' AS side, h AS q, t AS target FROM pairs UNION ALL SELECT 'head', t, h FROM pairs),"
    " cand AS (SELECT side, q, target, c FROM sides, pool_t WHERE side = 'tail' AND (c = target OR NOT EXISTS (SELECT 1 FROM known WHERE h = q AND t = c)) UNION ALL SELECT side, q, target, c FROM sides, pool_h WHERE side = 'head' AND (c = target OR NOT EXISTS (SELECT 1 FROM known WHERE t = q AND h = c))),"
    " sco AS (SELECT cand.*, coalesce(s, 0) AS s FROM cand LEFT JOIN sc ON sc.q = cand.q AND sc.c = cand.c), tgt AS (SELECT side, q, target, s AS ts FROM sco WHERE c = target),"
    " fr AS (SELECT side, q, target, 1.0 + count(*) FILTER (s > ts) + (count(*) FILTER (s = ts AND c <> target)) / 2.0 AS rank FROM sco JOIN tgt USING (side, q, target) GROUP BY 1, 2, 3)"
)


def _ranks(spark: SparkSession, d: str, scope: str = "oracle", kinds: list[str] = ["RA"], relations: list[str] | None = None) -> DataFrame:  # noqa: B006
    """scorer, side, q, target, rank of the test pairs under light scorers: CN, RA, L3, popularity, random."""
    train, pairs = _graph(spark, d, scope)
    known = of(_folds(spark, d), "enriched_in", "depleted_in").select(F.col("head_id").alias("h"), F.col("tail_id").alias("t")).distinct()
    walked = [k for k in kinds if k in S.SCORERS]
    out = None
    for side, q, c in (("tail", "h", "t"), ("head", "t", "h")):
        k = known.select(F.col(q).alias("q"), F.col(c).alias("c"))
        asked = S.ask(pairs.select(F.col(q).alias("q"), F.col(c).alias("target")), k, k.select("c").distinct())
        parts = [S.walk_ranks(asked, _coded(spark, d, scope, relations), walked).withColumnRenamed("kind", "scorer")] if walked else []
        if "popularity" in kinds:
            parts.append(S.node_ranks(asked, degrees(train).select(F.col("node_id").alias("c"), F.col("degree_multi").alias("s"))).withColumn("scorer", F.lit("popularity")))
        if "random" in kinds:
            parts.append(S.random_ranks(asked, side).withColumn("scorer", F.lit("random")))
        for ranks in parts:
            ranks = ranks.select("scorer", F.lit(side).alias("side"), "q", "target", "rank")
            out = ranks if out is None else out.unionByName(ranks)
    return out


@query(with_kg(f"{_G}, {_RANK} SELECT side, q AS query, target, CAST(rank AS DOUBLE) AS rank FROM fr"))
def filtered_rank(spark: SparkSession, d: str, scope: str = "oracle") -> DataFrame:
    return _ranks(spark, d, scope).select("side", F.col("q").alias("query"), "target", "rank")


LIGHT = ["CN", "RA", "L3", "popularity", "random"]
_LIGHT = (
    f"{_G}, {_RANK.split(' fr AS (')[0].rstrip().rstrip(',')}, hq AS (SELECT DISTINCT q FROM sides), w2 AS (SELECT q, y.b AS y, sum(1.0::DOUBLE / sqrt(d)) AS w FROM hq JOIN adj x ON x.a = q JOIN deg ON node = x.b JOIN adj y ON y.a = x.b GROUP BY 1, 2),"
    " all_s AS (SELECT 'RA' AS scorer, q, c, s FROM sc UNION ALL SELECT 'CN', x.a, y.b, CAST(count(*) AS DOUBLE) FROM adj x JOIN adj y ON y.a = x.b WHERE x.a IN (FROM hq) GROUP BY 2, 3"
    " UNION ALL SELECT 'L3', q, z.b, round(sum(w / sqrt(d)), 9) FROM w2 JOIN adj z ON z.a = y JOIN deg ON node = y GROUP BY 2, 3),"
    " dm AS (SELECT n, CAST(count(*) AS DOUBLE) AS k FROM (SELECT head_id AS n FROM g UNION ALL SELECT tail_id FROM g) GROUP BY 1),"
    " valued AS (SELECT scorer, cand.side, cand.q, cand.target, cand.c, coalesce(s, 0) AS s FROM cand CROSS JOIN (SELECT unnest(['CN', 'RA', 'L3']) AS scorer) LEFT JOIN all_s USING (scorer, q, c)"
    " UNION ALL SELECT 'popularity', side, q, target, c, coalesce(k, 0) FROM cand LEFT JOIN dm ON n = c), aim AS (SELECT scorer, side, q, target, s AS ts FROM valued WHERE c = target),"
    " lr AS (SELECT scorer, side, q, target, CAST(1.0 + count(*) FILTER (s > ts) + (count(*) FILTER (s = ts AND c <> target)) / 2.0 AS DOUBLE) AS rank FROM valued JOIN aim USING (scorer, side, q, target) GROUP BY 1, 2, 3, 4"
    " UNION ALL SELECT 'random', side, q, target, 1.0 + floor(CAST(('0x' || substr(md5('42|' || side || '|' || q || '|' || target), 1, 8)) AS BIGINT) / 4294967296.0 * count(*)) FROM cand GROUP BY 2, 3, 4)"
)


def _light(spark: SparkSession, d: str, scope: str = "oracle") -> DataFrame:
    return _ranks(spark, d, scope, LIGHT)


@query(with_kg(f"{_LIGHT} SELECT scorer, side, q AS query, target, rank FROM lr"))
def light_ranks(spark: SparkSession, d: str, scope: str = "oracle") -> DataFrame:
    """Filtered ranks of the test pairs, both sides, under every light scorer."""
    return _light(spark, d, scope).select("side", F.col("q").alias("query"), "target", "rank", "scorer")


@query(with_kg(f"{_G}, nd AS (SELECT DISTINCT a FROM adj) SELECT count(*) AS n, count(*) FILTER (h NOT IN (FROM nd) OR t NOT IN (FROM nd)) AS n_oov FROM pairs"))
def oov_report(spark: SparkSession, d: str, scope: str = "oracle") -> DataFrame:
    """Test pairs, and those with an end that the train graph does not have."""
    return S.outside(_graph(spark, d, scope)[1], _adjacency(spark, d, scope))


def _block_sql(src: str) -> str:
    names = ["mrr", "mean_rank", *[f"hits_{k}" for k in M.HITS]]
    stats = "avg(1.0 / rank) AS mrr, avg(rank) AS mean_rank, " + ", ".join(f"avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0 END) AS hits_{k}" for k in M.HITS)
    r = ", ".join(f"round({n}, 6) AS {n}" for n in names)
    m = ", ".join(f"avg({n}) AS {n}" for n in names)
    return (
        f"b AS (SELECT unnest([side, 'both']) AS side, q, CAST(rank AS DOUBLE) AS rank FROM {src}), mi AS (SELECT side, 'micro' AS level, {stats}, count(*) AS n FROM b GROUP BY 1), gr AS (SELECT side, q, {stats} FROM b GROUP BY 1, 2),"
        f" ma AS (SELECT side, 'macro' AS level, {m}, count(*) AS n FROM gr GROUP BY 1) SELECT side, level, {r}, n FROM (FROM mi UNION ALL FROM ma)"
    )


@query(with_kg(f"{_G}, {_RANK}, {_block_sql('fr')}"))
def rank_metrics(spark: SparkSession, d: str, scope: str = "oracle") -> DataFrame:
    return M.rank_block(_ranks(spark, d, scope).select("side", F.col("q").alias("group_id"), "rank"))


_POSNEG = f"{_G}, neg AS (SELECT DISTINCT head_id AS h, tail_id AS t FROM kg WHERE relation = 'inconsistent_association' EXCEPT SELECT h, t FROM pairs), pn AS (SELECT h, t, TRUE AS positive FROM pairs UNION ALL SELECT h, t, FALSE FROM neg), sp AS (SELECT pn.*, round(coalesce((SELECT sum(1.0::DOUBLE / d) FROM adj x JOIN adj y ON y.a = x.b JOIN deg ON node = x.b WHERE x.a = pn.h AND y.b = pn.t), 0), 9) AS score FROM pn)"


def _scored(spark: SparkSession, d: str, scope: str = "oracle") -> DataFrame:
    _, pairs = _graph(spark, d, scope)
    # the full graphs hold the inconsistent associations of train: only the others are negatives there
    neg = of(_folds(spark, d) if scope == "oracle" else _folds(spark, d).filter("fold <> 'train'"), "inconsistent_association").select(F.col("head_id").alias("h"), F.col("tail_id").alias("t")).distinct().join(pairs, ["h", "t"], "left_anti")
    every = pairs.withColumn("positive", F.lit(True)).unionByName(neg.withColumn("positive", F.lit(False)))
    return every.join(S.resource_allocation(every, _adjacency(spark, d, scope)), ["h", "t"]).select("h", "t", "positive", F.round("ra", 9).alias("score"))


def _auc_sql(src: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    p = f"PARTITION BY {by} " if by else ""
    on = f"USING ({by})" if by else "ON TRUE"
    return (
        f"lv AS (SELECT {g}score, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS q FROM {src} GROUP BY {g}score), cu AS (SELECT *, sum(p) OVER ({p}ORDER BY score DESC) AS cp, sum(q) OVER ({p}ORDER BY score DESC) AS cq FROM lv),"
        f" ar AS (SELECT {g}sum(q * (cp - p + p / 2.0::DOUBLE)) AS u, sum(p * cp::DOUBLE / (cp + cq)) AS ap, sum(p) AS n_pos, sum(q) AS n_neg FROM cu {'GROUP BY ' + by if by else ''}), md AS (SELECT {g}median(score) AS med FROM {src} WHERE positive {'GROUP BY ' + by if by else ''}),"
        f" fp AS (SELECT {g}avg(CASE WHEN score >= med THEN 1.0::DOUBLE ELSE 0 END) AS fpr FROM {src} JOIN md {on} WHERE NOT positive {'GROUP BY ' + by if by else ''}),"
        f" au AS (SELECT {g}round(u / (n_pos * n_neg), 6) AS auroc, round(ap / n_pos, 6) AS auprc, round(n_pos / (n_pos + n_neg), 6) AS floor, round((ap / n_pos) / (n_pos / (n_pos + n_neg)), 6) AS auprc_over_floor, round(fpr, 6) AS fpr_at_med, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg FROM ar JOIN fp {on})"
    )


@query(with_kg(f"{_POSNEG}, {_auc_sql('sp')} SELECT * FROM au"))
def auc(spark: SparkSession, d: str, scope: str = "oracle") -> DataFrame:
    return M.auc_block(_scored(spark, d, scope))


_BOOT = "bv AS (SELECT row_number() OVER (ORDER BY md5('42|' || side || '|' || q || '|' || target)) AS rk, count(*) OVER () AS n, CAST(rank AS DOUBLE) AS rank FROM fr)"
_DRAW = "dr AS (SELECT b, CAST(('0x' || substr(md5('42|' || b || '|' || rk), 1, 8)) AS BIGINT) % n + 1 AS rk FROM bv, (SELECT unnest(range(1, 1001)) AS b))"


@query(
    with_kg(
        f"{_G}, {_RANK}, {_BOOT}, {_DRAW}, pb AS (SELECT b, avg(1.0 / rank) AS mrr, avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0 END) AS hits_10 FROM dr JOIN bv USING (rk) GROUP BY 1)"
        " SELECT 'mrr' AS metric, round(quantile_cont(mrr, 0.025), 6) AS lo, round(quantile_cont(mrr, 0.975), 6) AS hi FROM pb UNION ALL SELECT 'hits_10', round(quantile_cont(hits_10, 0.025), 6), round(quantile_cont(hits_10, 0.975), 6) FROM pb"
    )
)
def bootstrap(spark: SparkSession, d: str, scope: str = "oracle") -> DataFrame:
    return M.bootstrap(hash_rank(_ranks(spark, d, scope), ["side", "q", "target"]), stats=["mrr", "hits_10"])


_DRAWN = (
    "od AS (SELECT score, positive, row_number() OVER (PARTITION BY positive ORDER BY md5('42|' || h || '|' || t)) AS rk, count(*) OVER (PARTITION BY positive) AS n FROM sp),"
    " dz AS (SELECT b, od.positive, CAST(('0x' || substr(md5('42|' || b || '|' || CAST(od.positive AS INTEGER) || '|' || rk), 1, 8)) AS BIGINT) % n + 1 AS rk FROM od, (SELECT unnest(range(1, 1001)) AS b)), kp AS (SELECT b, positive, score FROM dz JOIN od USING (positive, rk))"
)


@query(
    with_kg(
        f"{_POSNEG}, {_DRAWN}, {_auc_sql('kp', 'b')} SELECT 'auroc' AS metric, round(quantile_cont(auroc, 0.025), 6) AS lo, round(quantile_cont(auroc, 0.975), 6) AS hi FROM au"
        " UNION ALL SELECT 'auprc', round(quantile_cont(auprc, 0.025), 6), round(quantile_cont(auprc, 0.975), 6) FROM au"
    )
)
def bootstrap_auc(spark: SparkSession, d: str, scope: str = "oracle") -> DataFrame:
    """Intervals of AUROC and AUPRC, positives and negatives resampled by themselves."""
    return M.bootstrap_auc(hash_rank(_scored(spark, d, scope), ["h", "t"], within=["positive"]))


_RATIOS = [0.5, 1.0, 2.0, 5.0, 10.0]
_SWEEP = (
    f"{_POSNEG}, od AS (SELECT *, row_number() OVER (PARTITION BY positive ORDER BY md5('42|' || h || '|' || t)) AS rk, count(*) FILTER (positive) OVER () AS np, count(*) FILTER (NOT positive) OVER () AS nn FROM sp),"
    f" rs AS (SELECT unnest({_RATIOS}::DOUBLE[]) AS ratio), kp AS (SELECT ratio, score, positive FROM od, rs WHERE CASE WHEN positive THEN rk <= least(np, CAST(floor(nn / ratio) AS BIGINT)) ELSE rk <= greatest(1, least(nn, CAST(floor(least(np, floor(nn / ratio)) * ratio) AS BIGINT))) END)"
)


@query(with_kg(f"{_SWEEP}, {_auc_sql('kp', 'ratio')} SELECT ratio, n_pos, n_neg, auprc, auroc FROM au WHERE n_pos >= 5"))
def ratio_sweep(spark: SparkSession, d: str, scope: str = "oracle") -> DataFrame:
    """Metrics at fixed negatives per positive, both sides cut in hash order; at least 5 positives."""
    ranked = hash_rank(_scored(spark, d, scope), ["h", "t"], within=["positive"])
    n = F.max(F.when(F.col("positive"), F.col("n")))
    sizes = ranked.groupBy().agg(F.coalesce(n, F.lit(0)).alias("np"), F.coalesce(F.max(F.when(~F.col("positive"), F.col("n"))), F.lit(0)).alias("nn")).first()  # two numbers
    np_, nn = sizes["np"], sizes["nn"]
    keep = [(r, min(np_, int(nn // r)), max(1, min(nn, int(min(np_, nn // r) * r)))) for r in _RATIOS]
    rows = F.array(*[F.struct(F.lit(r).alias("ratio"), F.lit(p).alias("kp"), F.lit(q).alias("kq")) for r, p, q in keep])
    kept = ranked.select("score", "positive", "rk", F.explode(rows).alias("k")).filter(F.when(F.col("positive"), F.col("rk") <= F.col("k.kp")).otherwise(F.col("rk") <= F.col("k.kq")))
    return M.auc_block(kept.select("k.ratio", "score", "positive"), ["ratio"]).filter("n_pos >= 5").select("ratio", "n_pos", "n_neg", "auprc", "auroc")


ONLY = ["enriched_in", "depleted_in"]
_ABL = (
    f"{_G}, {_RANK}, f1 AS (SELECT avg(1.0 / CAST(rank AS DOUBLE)) AS m FROM fr), adj0 AS (SELECT head_id AS a, tail_id AS b FROM g WHERE relation IN ('enriched_in', 'depleted_in') UNION SELECT tail_id, head_id FROM g WHERE relation IN ('enriched_in', 'depleted_in')),"
    " deg0 AS (SELECT a AS node, count(*) AS d FROM adj0 GROUP BY 1), sc0 AS (SELECT x.a AS q, y.b AS c, round(sum(1.0::DOUBLE / d), 9) AS s FROM adj0 x JOIN deg0 ON node = x.b JOIN adj0 y ON y.a = x.b GROUP BY 1, 2),"
    " sco0 AS (SELECT cand.*, coalesce(s, 0) AS s FROM cand LEFT JOIN sc0 ON sc0.q = cand.q AND sc0.c = cand.c), tgt0 AS (SELECT side, q, target, s AS ts FROM sco0 WHERE c = target),"
    " fr0 AS (SELECT side, q, target, 1.0 + count(*) FILTER (s > ts) + (count(*) FILTER (s = ts AND c <> target)) / 2.0 AS rank FROM sco0 JOIN tgt0 USING (side, q, target) GROUP BY 1, 2, 3), f0 AS (SELECT avg(1.0 / CAST(rank AS DOUBLE)) AS m FROM fr0)"
)


@query(with_kg(f"{_ABL} SELECT 'RA' AS scorer, round(f0.m, 6) AS mrr_only, round(f1.m, 6) AS mrr_bridge, round(f1.m - f0.m, 6) AS delta FROM f0, f1"))
def ablation_delta(spark: SparkSession, d: str) -> DataFrame:
    return _delta(_ranks(spark, d, relations=ONLY), _ranks(spark, d))


def _delta(only: DataFrame, bridge: DataFrame) -> DataFrame:
    tag = lambda df, name: df.select(F.lit("RA").alias("scorer"), F.lit(name).alias("k"), (1.0 / F.col("rank")).alias("m"))
    both = tag(only, "only").unionByName(tag(bridge, "bridge"))
    per = both.groupBy("scorer").agg(F.avg(F.when(F.col("k") == "only", F.col("m"))).alias("a"), F.avg(F.when(F.col("k") == "bridge", F.col("m"))).alias("b"))
    return per.select("scorer", F.round("a", 6).alias("mrr_only"), F.round("b", 6).alias("mrr_bridge"), F.round(F.col("b") - F.col("a"), 6).alias("delta"))


@query(None)
def ablation_delta_full(spark: SparkSession, d: str) -> DataFrame:
    """The graph of associations and AUX against the same with every bridge relation."""
    return _delta(_ranks(spark, d, "aux"), _ranks(spark, d, "bridges"))


for _f in (structural_cn, structural_ra, structural_l3, popularity, heuristic_viability, filtered_rank, light_ranks, rank_metrics, auc, bootstrap, bootstrap_auc, ratio_sweep):
    for _s in ("aux", "bridges"):
        QUERIES[f"{_f.__name__}_{_s}"] = partial(_f, scope=_s)


# The job matrix: what every setting is expected to report.
MATRIX = {"transductive": ["CN", "RA", "L3", "popularity"], "only": ["CN", "RA"]}
_CELLS = "cells AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{m}')" for k, ms in MATRIX.items() for m in ms) + ") v(setting, scorer))"


@query(
    with_kg(
        f"{_ABL}, {_LIGHT[_LIGHT.index(' hq AS ('):].strip()}, {_CELLS}, have AS (SELECT 'transductive' AS setting, scorer, round(avg(1.0 / rank), 6) AS mrr FROM lr GROUP BY 2 UNION ALL SELECT 'only', 'RA', round(m, 6) FROM f0)"
        " SELECT coalesce(c.setting, h.setting) AS setting, coalesce(c.scorer, h.scorer) AS scorer, mrr, CASE WHEN h.scorer IS NULL THEN 'missing' WHEN c.scorer IS NULL THEN 'extra' ELSE 'ok' END AS status FROM cells c FULL JOIN have h ON h.setting = c.setting AND h.scorer = c.scorer"
    )
)
def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """The cells of the job matrix against the results at hand: missing, extra or ok."""
    cells = spark.createDataFrame([(k, m) for k, ms in MATRIX.items() for m in ms], "setting string, scorer string").withColumn("wanted", F.lit(True))
    runs = _light(spark, d).withColumn("setting", F.lit("transductive")).unionByName(_ranks(spark, d, relations=ONLY).withColumn("setting", F.lit("only")))
    have = runs.groupBy("setting", "scorer").agg(F.round(F.avg(1.0 / F.col("rank")), 6).alias("mrr"))
    status = F.when(F.col("mrr").isNull(), "missing").when(F.col("wanted").isNull(), "extra").otherwise("ok")
    return cells.join(have, ["setting", "scorer"], "full").select("setting", "scorer", "mrr", status.alias("status"))


@query(with_kg(f"{_LIGHT}, {_block_sql('(SELECT * FROM lr WHERE scorer = \'RA\')').rsplit(' SELECT side, level', 1)[0]} SELECT i.side, round(i.mrr - a.mrr, 4) AS mrr_gap, round(i.mean_rank - a.mean_rank, 4) AS mean_rank_gap FROM mi i JOIN ma a USING (side)"))
def micro_macro_gap(spark: SparkSession, d: str) -> DataFrame:
    """Micro less macro mean per side under RA."""
    g = M.gap(M.rank_block(_ranks(spark, d).select("side", F.col("q").alias("group_id"), "rank")))
    return g.select("side", F.round("mrr_gap", 4).alias("mrr_gap"), F.round("mean_rank_gap", 4).alias("mean_rank_gap"))


@query(with_kg(f"{_LIGHT}, per AS (SELECT scorer, side, avg(1.0 / rank) AS mrr FROM lr GROUP BY 1, 2) SELECT side, round(median(mrr), 6) AS median_mrr, count(*) AS n_models FROM per GROUP BY 1"))
def median_over_models(spark: SparkSession, d: str) -> DataFrame:
    """Median of the models' mean reciprocal ranks per side."""
    per = _light(spark, d).groupBy("scorer", "side").agg(F.avg(1.0 / F.col("rank")).alias("mrr"))
    return per.groupBy("side").agg(F.round(F.median("mrr"), 6).alias("median_mrr"), F.count("*").alias("n_models"))


_V = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), tp AS (SELECT h.vec_id AS i, t.vec_id AS j, h.v AS h, r.v AS r, t.v AS t, len(h.v) // 2 AS n FROM e h JOIN e r ON r.vec_id = (h.vec_id + 1) % 100 JOIN e t ON t.vec_id = h.vec_id + 7)"
_dm = lambda a, b, c: f"list_sum(list_transform(range(1, n + 1), lambda k: {a} * {b} * {c}))"


@query(
    f"WITH {_V} SELECT i, j, round(-sqrt(list_sum(list_transform(range(1, len(h) + 1), lambda k: (h[k] + r[k] - t[k]) ** 2))), 6) AS transe, round(list_sum(list_transform(range(1, len(h) + 1), lambda k: h[k] * r[k] * t[k])), 6) AS distmult,"
    f" round({_dm('h[k]', 'r[k]', 't[k]')} + {_dm('h[n + k]', 'r[k]', 't[n + k]')} + {_dm('h[k]', 'r[n + k]', 't[n + k]')} - {_dm('h[n + k]', 'r[n + k]', 't[k]')}, 6) AS complex,"
    " round(-sqrt(list_sum(list_transform(range(1, n + 1), lambda k: (h[k] * cos(r[k]) - h[n + k] * sin(r[k]) - t[k]) ** 2 + (h[k] * sin(r[k]) + h[n + k] * cos(r[k]) - t[n + k]) ** 2))), 6) AS rotate FROM tp"
)
def embed_score(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    at = lambda name: v.select(F.col("vec_id").alias(f"{name}_id"), F.col("embedding").alias(name))
    triples = at("h").join(at("r"), F.col("r_id") == (F.col("h_id") + 1) % 100).join(at("t"), F.col("t_id") == F.col("h_id") + 7)
    h, r, t = F.col("h"), F.col("r"), F.col("t")
    kinds = {"transe": S.transe, "distmult": S.distmult, "complex": S.complex_, "rotate": S.rotate}
    return triples.select(F.col("h_id").alias("i"), F.col("t_id").alias("j"), *[F.round(f(h, r, t), 6).alias(k) for k, f in kinds.items()])
