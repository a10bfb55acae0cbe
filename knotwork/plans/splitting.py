"""Queries of split construction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import splits as S
from knotwork.operators.ranking import hash_rank
from knotwork.operators.build import KEY
from knotwork.plans.common import kg, with_kg

QUERIES, SQL = {}, {}
ASSOCIATIONS = ["enriched_in", "depleted_in", "inconsistent_association"]


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def fold_sql(train: float, valid: float) -> str:
    a, b = f"round_even(n * {train}, 0)", f"round_even(n * {valid}, 0)"
    return f"CASE WHEN rk <= {a} THEN 'train' WHEN rk <= {a} + {b} THEN 'valid' ELSE 'test' END"


def out_sql(test: float, valid: float) -> str:
    a, b = f"round_even(n * {test}, 0)", f"round_even(n * {valid}, 0)"
    return f"CASE WHEN rk <= {a} THEN 'test' WHEN rk <= {a} + {b} THEN 'valid' ELSE 'train' END"


def ranked(name: str, source: str, *keys: str) -> str:
    h = " || '|' || ".join(["'42'", *keys])
    return f"{name} AS (SELECT *, row_number() OVER (ORDER BY md5({h})) AS rk, count(*) OVER () AS n FROM ({source}))"


_ASSOC = "a AS (SELECT * FROM kg WHERE relation IN ('enriched_in', 'depleted_in', 'inconsistent_association'))"
TRANS = f"{_ASSOC}, {ranked('pr', 'SELECT DISTINCT head_id, tail_id FROM a', 'head_id', 'tail_id')}, tr AS (SELECT a.*, {fold_sql(0.8, 0.1)} AS fold FROM a JOIN pr USING (head_id, tail_id))"


def transductive(e: DataFrame) -> DataFrame:
    return S.split_pairs(S.of(e, *ASSOCIATIONS))


@query(with_kg(f"{TRANS} SELECT head_id, head_type, relation, tail_id, tail_type, fold FROM tr"))
def split_transductive(spark: SparkSession, d: str) -> DataFrame:
    return transductive(kg(spark, d)).select(*KEY, "fold")


@query(with_kg(f"{ranked('r', "SELECT * FROM kg WHERE relation = 'can_utilize'", 'head_id', 'head_type', 'relation', 'tail_id', 'tail_type')} SELECT head_id, head_type, relation, tail_id, tail_type, {fold_sql(0.8, 0.1)} AS fold FROM r"))
def split_rows(spark: SparkSession, d: str) -> DataFrame:
    return S.split_rows(S.of(kg(spark, d), "can_utilize"), KEY).select(*KEY, "fold")


COLD = f"{ranked('cm', "SELECT DISTINCT head_id FROM kg WHERE relation IN ('enriched_in', 'depleted_in')", 'head_id')}, cold AS (SELECT head_id, {out_sql(0.05, 0.05)} AS fold FROM cm)"


def cold_microbes(e: DataFrame) -> DataFrame:
    return S.hold_out(S.of(e, "enriched_in", "depleted_in"), "head_id", 0.05, 0.05)


@query(with_kg(f"{COLD} SELECT kg.head_id, relation, tail_id, fold FROM cold JOIN kg USING (head_id) WHERE relation IN ('enriched_in', 'depleted_in', 'inconsistent_association')"))
def cold_entity(spark: SparkSession, d: str) -> DataFrame:
    """The associations by the fold of their microbe; inconsistent ones are its hard negatives."""
    e = kg(spark, d)
    return S.of(e, *ASSOCIATIONS).join(cold_microbes(e), "head_id").select("head_id", "relation", "tail_id", "fold")


COLD_D = f"{ranked('cd', "SELECT DISTINCT tail_id FROM kg WHERE relation IN ('enriched_in', 'depleted_in') AND starts_with(tail_id, 'D') AND tail_id IN (SELECT head_id FROM kg WHERE relation = 'is_a')", 'tail_id')}, coldd AS (SELECT tail_id, {out_sql(0.05, 0.05)} AS fold FROM cd)"


def cold_diseases(e: DataFrame) -> DataFrame:
    parents = S.of(e, "is_a").select(F.col("head_id").alias("tail_id")).distinct()
    pool = S.of(e, "enriched_in", "depleted_in").filter(F.col("tail_id").startswith("D")).join(parents, "tail_id", "left_semi")
    return S.hold_out(pool, "tail_id", 0.05, 0.05)


@query(with_kg(f"{COLD_D} SELECT head_id, relation, kg.tail_id, fold FROM coldd JOIN kg USING (tail_id) WHERE relation IN ('enriched_in', 'depleted_in')"))
def cold_disease(spark: SparkSession, d: str) -> DataFrame:
    e = kg(spark, d)
    return S.of(e, "enriched_in", "depleted_in").join(cold_diseases(e), "tail_id").select("head_id", "relation", "tail_id", "fold")


MEDIATORS = f"{ranked('md', "SELECT head_id FROM kg WHERE relation = 'can_utilize' INTERSECT SELECT head_id FROM kg WHERE relation IN ('enriched_in', 'depleted_in')", 'head_id')}, med AS (SELECT head_id, {out_sql(0.2, 0.1)} AS fold FROM md)"


def mediators(e: DataFrame) -> DataFrame:
    pool = S.of(e, "can_utilize").select("head_id").intersect(S.of(e, "enriched_in", "depleted_in").select("head_id"))
    return S.hold_out(pool, "head_id", 0.2, 0.1)


@query(with_kg(f"{MEDIATORS} SELECT kg.head_id, tail_id, fold, fold <> 'train' AS removed FROM med JOIN kg USING (head_id) WHERE relation = 'can_utilize'"))
def rel_zero_shot(spark: SparkSession, d: str) -> DataFrame:
    e = kg(spark, d)
    return S.of(e, "can_utilize").join(mediators(e), "head_id").select("head_id", "tail_id", "fold", (F.col("fold") != "train").alias("removed"))


_SCRUBBED = "u AS (SELECT DISTINCT head_id, tail_id FROM kg WHERE relation = 'utilizes'), c AS (SELECT kg.*, (u.head_id IS NOT NULL) AS hit FROM kg LEFT JOIN u USING (head_id, tail_id) WHERE relation = 'can_utilize')"


@query(with_kg(f"{_SCRUBBED} SELECT CASE WHEN hit THEN 'scrubbed' ELSE 'train' END AS part, head_id, tail_id FROM c UNION ALL SELECT 'test', head_id, tail_id FROM kg WHERE relation = 'utilizes'"))
def zero_shot(spark: SparkSession, d: str) -> DataFrame:
    """Capacity edges to train on, those scrubbed because the real edge is known, and the real edges to test on."""
    e = kg(spark, d)
    capacity, real = S.of(e, "can_utilize"), S.of(e, "utilizes")
    hit = capacity.join(real.select("head_id", "tail_id").distinct(), ["head_id", "tail_id"], "left_semi")
    tag = lambda df, part: df.select(F.lit(part).alias("part"), "head_id", "tail_id")
    return tag(S.without_pairs(capacity, real), "train").unionByName(tag(hit, "scrubbed")).unionByName(tag(real, "test"))


@query(
    with_kg(
        f"{ranked('ru', "SELECT * FROM kg WHERE relation = 'utilizes'", 'head_id', 'head_type', 'relation', 'tail_id', 'tail_type')}"
        " SELECT CAST(k AS INTEGER) AS n_inject, CASE WHEN rk <= k THEN 'inject' ELSE 'test' END AS part, head_id, tail_id FROM ru, (SELECT unnest([50, 100, 500]) AS k) WHERE k <= n"
    )
)
def few_shot(spark: SparkSession, d: str) -> DataFrame:
    """Real edges to inject into training and to keep for the test, per level that the table can give."""
    real = hash_rank(S.of(kg(spark, d), "utilizes"), KEY)
    levels = real.withColumn("n_inject", F.explode(F.array(*[F.lit(k) for k in (50, 100, 500)]))).filter("n_inject <= n")
    return levels.select("n_inject", F.when(F.col("rk") <= F.col("n_inject"), "inject").otherwise("test").alias("part"), "head_id", "tail_id")


_H = "md5('42|' || head_id || '|' || tail_id)"


@query(
    with_kg(
        f"c AS (SELECT head_id, tail_id, {_H} AS h, min({_H}) OVER (PARTITION BY head_id) AS m, CAST(('0x' || substr({_H}, 1, 8)) AS BIGINT) / 4294967296.0 AS x FROM kg WHERE relation = 'can_utilize'),"
        " f AS (SELECT head_id, tail_id, CASE WHEN h = m THEN 'train' WHEN x < 0.1 THEN 'valid' WHEN x < 0.2 THEN 'test' ELSE 'train' END AS fold FROM c)"
        " SELECT head_id, tail_id, fold FROM f"
    )
)
def holdout_keep1(spark: SparkSession, d: str) -> DataFrame:
    return S.keep_one(S.of(kg(spark, d), "can_utilize"), "head_id", ["head_id", "tail_id"]).select("head_id", "tail_id", "fold")


@query(with_kg(f"{TRANS}, rem AS (SELECT DISTINCT head_id, relation, tail_id FROM tr WHERE fold <> 'train') SELECT head_id, head_type, relation, tail_id, tail_type FROM kg WHERE NOT EXISTS (SELECT 1 FROM rem WHERE rem.head_id = kg.head_id AND rem.relation = kg.relation AND rem.tail_id = kg.tail_id)"))
def gtrain(spark: SparkSession, d: str) -> DataFrame:
    e = kg(spark, d)
    return S.without_triples(e, transductive(e).filter("fold <> 'train'")).select(*KEY)


@query(
    with_kg(
        f"{TRANS}, held AS (SELECT DISTINCT least(head_id, tail_id) AS a, greatest(head_id, tail_id) AS b FROM tr WHERE fold <> 'train')"
        " SELECT head_id, head_type, relation, tail_id, tail_type FROM kg JOIN held ON a = least(head_id, tail_id) AND b = greatest(head_id, tail_id)"
    )
)
def scrub_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = kg(spark, d)
    return S.between(e, transductive(e).filter("fold <> 'train'")).select(*KEY)


POOL = "pool AS (SELECT DISTINCT head_id, tail_id FROM kg WHERE relation = 'associated_with_disease' AND head_type = 'metabolite' AND NOT EXISTS (SELECT 1 FROM kg k WHERE k.relation = 'treats_disease' AND k.head_id = kg.head_id AND k.tail_id = kg.tail_id))"


def pool(e: DataFrame) -> DataFrame:
    return S.without_pairs(S.of(e, "associated_with_disease").filter("head_type = 'metabolite'"), S.of(e, "treats_disease")).select("head_id", "tail_id").distinct()


@query(with_kg(f"{POOL} SELECT head_id, tail_id FROM pool"))
def hardneg_pool(spark: SparkSession, d: str) -> DataFrame:
    return pool(kg(spark, d))


@query(
    with_kg(
        f"{TRANS}, {POOL}, {ranked('rp', 'SELECT * FROM pool', 'head_id', 'tail_id')}, pos AS (SELECT count(*) AS n FROM (SELECT DISTINCT head_id, tail_id FROM tr WHERE fold = 'test' AND relation IN ('enriched_in', 'depleted_in')))"
        " SELECT CAST(k AS INTEGER) AS ratio, head_id, tail_id FROM rp, pos, (SELECT unnest([1, 5, 10]) AS k) WHERE rk <= k * pos.n"
    )
)
def neg_sample(spark: SparkSession, d: str) -> DataFrame:
    """Hard negatives at k for each positive of the test fold, at most the pool, for k of 1, 5 and 10."""
    e = kg(spark, d)
    n = S.of(transductive(e).filter("fold = 'test'"), "enriched_in", "depleted_in").select("head_id", "tail_id").distinct().agg(F.count("*")).scalar()
    ordered = hash_rank(pool(e), ["head_id", "tail_id"]).withColumn("ratio", F.explode(F.array(*[F.lit(k) for k in (1, 5, 10)])))
    return ordered.filter(F.col("rk") <= F.col("ratio") * n).select("ratio", "head_id", "tail_id")


_NO = "CASE relation " + " ".join(f"WHEN 'belongs_to_{r}' THEN {i}" for i, r in enumerate(S.RANKS)) + " END"
LINEAGE = f"ln AS (SELECT DISTINCT head_id AS microbe, {_NO} AS rank_no, tail_id AS taxon FROM kg WHERE relation LIKE 'belongs_to_%')"
_NAMES = "[" + ", ".join(f"'{r}'" for r in S.RANKS) + "]"


def proximity_sql(query_: str, ref: str) -> str:
    return (
        f"{LINEAGE}, q AS ({query_}), ref AS (SELECT microbe FROM ({ref}) WHERE microbe NOT IN (FROM q)), best AS (SELECT a.microbe, min(a.rank_no) AS r FROM ln a JOIN q USING (microbe)"
        " WHERE EXISTS (SELECT 1 FROM ln b WHERE b.rank_no = a.rank_no AND b.taxon = a.taxon AND b.microbe IN (FROM ref)) GROUP BY 1),"
        f" prox AS (SELECT q.microbe, coalesce({_NAMES}[best.r + 1], 'none') AS nearest_shared_rank FROM q LEFT JOIN best USING (microbe))"
    )


@query(with_kg(f"{COLD}, {proximity_sql("SELECT head_id AS microbe FROM cold WHERE fold = 'test'", "SELECT head_id AS microbe FROM cold WHERE fold = 'train'")} SELECT microbe, nearest_shared_rank FROM prox"))
def tax_proximity(spark: SparkSession, d: str) -> DataFrame:
    e = kg(spark, d)
    f = cold_microbes(e).withColumnRenamed("head_id", "microbe")
    return S.nearest_shared_rank(f.filter("fold = 'test'"), f.filter("fold = 'train'"), S.lineage(e))


@query(
    with_kg(
        f"{COLD_D}, up AS (SELECT DISTINCT head_id, tail_id AS parent FROM kg WHERE relation = 'is_a'), rp AS (SELECT DISTINCT parent FROM up WHERE head_id IN (SELECT tail_id FROM coldd WHERE fold = 'train'))"
        " SELECT tail_id AS disease, CASE WHEN EXISTS (SELECT 1 FROM up WHERE up.head_id = coldd.tail_id AND parent IN (FROM rp)) THEN 'parent' ELSE 'none' END AS shares_parent FROM coldd WHERE fold = 'test'"
    )
)
def parent_proximity(spark: SparkSession, d: str) -> DataFrame:
    e = kg(spark, d)
    f = cold_diseases(e).withColumnRenamed("tail_id", "disease")
    return S.shares_parent(f.filter("fold = 'test'"), f.filter("fold = 'train'"), S.of(e, "is_a"))


@query(
    with_kg(
        proximity_sql("SELECT DISTINCT head_id AS microbe FROM kg WHERE relation = 'utilizes'", "SELECT DISTINCT head_id AS microbe FROM kg WHERE relation = 'can_utilize'")
        + " SELECT microbe, CASE WHEN microbe IN (SELECT head_id FROM kg WHERE relation = 'can_utilize') THEN 'has_own_capacity' WHEN nearest_shared_rank <> 'none' THEN 'tax_only' ELSE 'no_capacity' END AS capacity_layer, nearest_shared_rank FROM prox"
    )
)
def capacity_layer(spark: SparkSession, d: str) -> DataFrame:
    e = kg(spark, d)
    heads = lambda r: S.of(e, r).select(F.col("head_id").alias("microbe"))
    return S.capacity_layers(heads("utilizes"), heads("can_utilize"), S.lineage(e))


@query(
    with_kg(
        f"{COLD}, {proximity_sql("SELECT head_id AS microbe FROM cold WHERE fold = 'test'", "SELECT head_id AS microbe FROM cold WHERE fold = 'train'")} SELECT nearest_shared_rank, count(*) AS n FROM prox GROUP BY 1"
    )
)
def layer_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many cold microbes there are of each nearest shared rank."""
    return tax_proximity(spark, d).groupBy("nearest_shared_rank").agg(F.count("*").alias("n"))


@query(
    with_kg(
        f"{ranked('gd', "SELECT DISTINCT head_id, tail_id FROM kg WHERE relation = 'therapeutic_target_for'", 'head_id', 'tail_id')} SELECT head_id, tail_id, CASE WHEN rk <= round_even(n * 0.5, 0) THEN 'valid' ELSE 'test' END AS fold FROM gd"
    )
)
def external_halves(spark: SparkSession, d: str) -> DataFrame:
    """An outside list of pairs in two halves; no list gives no rows."""
    return S.halves(S.of(kg(spark, d), "therapeutic_target_for"), ["head_id", "tail_id"])


@query(
    with_kg(
        f"{TRANS}, {ranked('vt', "SELECT DISTINCT head_id, relation, tail_id FROM tr WHERE fold = 'train'", 'head_id', 'relation', 'tail_id')} SELECT head_id, relation, tail_id FROM vt WHERE rk <= least(5000, greatest(1, CAST(floor(n * 0.02) AS BIGINT)))"
    )
)
def valid_slice(spark: SparkSession, d: str) -> DataFrame:
    """Validation rows where no file gives them: a slice of train in hash order, 2 % and at most 5,000."""
    train = transductive(kg(spark, d)).filter("fold = 'train'").select("head_id", "relation", "tail_id").distinct()
    return S.valid_or_slice(None, train, ["head_id", "relation", "tail_id"])
