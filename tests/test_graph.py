import random

from pyspark.sql import functions as F

from knotwork.operators import audit as A
from knotwork.operators import build as B
from knotwork.operators import metrics as M
from knotwork.operators import score as S
from knotwork.operators import splits as P
from knotwork.operators import stats as T
from knotwork.operators.components import components
from knotwork.operators.ranking import hash_rank, running_sums
from knotwork.operators.resolve import cluster_map, star_pairs

EDGE = "head_id string, head_type string, relation string, tail_id string, tail_type string, confidence string, species_source string, source string, evidence string"


def edges(spark, rows):
    return spark.createDataFrame([(h, ht, r, t, tt, "", "", s, e) for h, ht, r, t, tt, s, e in rows], EDGE)


def test_merge_and_evidence(spark):
    df = edges(spark, [("a", "microbe", "r", "b", "disease", "B", ""), ("a", "microbe", "r", "b", "disease", "A|B", "e1"), ("a", "microbe", "r", "c", "disease", "HMDB|AGORA2|Disbiome", "")])
    got = {r["tail_id"]: r for r in B.add_evidence_type(B.merge_edges(df)).collect()}
    assert (got["b"]["source"], got["b"]["evidence"], got["b"]["evidence_type"]) == ("A|B", "e1", "unknown")
    assert got["c"]["evidence_type"] == "experimental|curated_database|computational"
    assert B.merge_edges(df.limit(0)).count() == 0


def test_purges(spark):
    df = edges(spark, [("VMH:x", "microbe", "r", "d1", "disease", "A", ""), ("m", "microbe", "r", "d1", "disease", "A", ""), ("c", "metabolite", "r", "d2", "disease", "CTD", ""), ("VMH:x", "metabolite", "r", "d1", "disease", "CTD|A", "")])
    assert B.purge_prefix(df, "microbe", ["VMH:"]).count() == 3
    assert [r[0] for r in B.single_source_nodes(df, "metabolite", "CTD").collect()] == ["c"]
    assert [r[0] for r in B.unanchored_diseases(df).collect()] == ["d2"]
    assert B.drop_nodes(df, B.unanchored_diseases(df), "disease").count() == 3


def test_remap_keeps_other_types_and_unmapped(spark):
    df = edges(spark, [("x", "metabolite", "r", "x", "disease", "", ""), ("y", "substrate", "r", "x", "metabolite", "", "")])
    m = spark.createDataFrame([("x", "z"), ("x", "zz"), (None, "q"), ("y", None)], "original_id string, canonical_id string")
    assert sorted((r["head_id"], r["tail_id"]) for r in B.remap_endpoints(df, m, ["metabolite", "substrate"]).collect()) == [("y", "z"), ("z", "x")]


GRAPH = [("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), ("c", "y"), ("a", "y"), ("c", "z")]


def graph(spark):
    return edges(spark, [(h, "m", "r", t, "d", "", "") for h, t in GRAPH])


def test_degrees_and_scores(spark):
    e = graph(spark)
    deg = {r["node_id"]: (r["degree_multi"], r["degree_distinct"]) for r in B.degrees(e).collect()}
    assert deg == {"a": (3, 2), "b": (2, 2), "c": (2, 2), "x": (3, 2), "y": (3, 3), "z": (1, 1)}
    adj = A.symmetric(e)
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("a", "z"), ("b", "z"), ("a", "x"), ("q", "a")], "h string, t string")
    cn = {(r["h"], r["t"]): r["cn"] for r in S.common_neighbours(pairs, adj).collect()}
    assert (cn["a", "b"], cn["a", "c"], cn["b", "c"], cn["q", "a"]) == (2, 1, 1, 0)
    ra = {(r["h"], r["t"]): round(r["ra"], 6) for r in S.resource_allocation(pairs, adj).collect()}
    assert (ra["a", "b"], ra["a", "c"]) == (0.833333, 0.333333)
    l3 = {(r["h"], r["t"]): round(r["l3"], 6) for r in S.l3(pairs, adj).collect()}
    assert (l3["a", "z"], l3["b", "z"], l3["a", "x"]) == (0.408248, 0.408248, 1.816497)


def test_filtered_rank_against_the_definition(spark):
    rng = random.Random(6)
    nodes, cands = [f"q{i}" for i in range(6)], [f"c{i}" for i in range(12)]
    score = {(q, c): rng.choice([0, 0, 1, 2, 2]) for q in nodes for c in cands}
    known = {(q, c) for q in nodes for c in cands if rng.random() < 0.3}
    test = sorted(known)[::3] + [("q0", "c1"), ("q5", "c11")]
    want = {}
    for q, t in set(test):
        rest = [c for c in cands if c != t and (q, c) not in known]
        want[q, t] = 1 + sum(score[q, c] > score[q, t] for c in rest) + sum(score[q, c] == score[q, t] for c in rest) / 2
    mk = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = S.filtered_ranks(mk(test, "q string, target string"), mk(sorted(known), "q string, c string"), mk([(c,) for c in cands], "c string"), mk([(q, c, float(s)) for (q, c), s in score.items() if s], "q string, c string, s double"))
    assert {(r["q"], r["target"]): r["rank"] for r in got.collect()} == want


def test_auc_and_rank_block(spark):
    df = spark.createDataFrame([(3.0, True), (2.0, True), (2.0, True), (1.0, True), (2.0, False), (1.0, False), (0.0, False), (float("nan"), True), (None, False)], "score double, positive boolean")
    r = M.auc_block(df).first()
    assert (r["auroc"], r["auprc"], r["floor"], r["fpr_at_med"], r["n_pos"], r["n_neg"]) == (0.791667, 0.791667, 0.571429, 0.333333, 4, 3)
    assert M.auc_block(df.filter("positive")).count() == 0
    ranks = spark.createDataFrame([("tail", "u", 1.0), ("tail", "u", 2.0), ("tail", "v", 4.0)], "side string, group_id string, rank double")
    got = {(x["side"], x["level"]): x["mrr"] for x in M.rank_block(ranks).collect()}
    assert got[("tail", "micro")] == 0.583333 and got[("tail", "macro")] == 0.5


def test_ranks_and_running_sums(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(500)], "k int, v int")
    got = hash_rank(df, ["k"]).collect()
    import hashlib

    order = sorted(range(500), key=lambda k: hashlib.md5(f"42|{k}".encode()).hexdigest())
    assert {r["k"]: r["rk"] for r in got} == {k: i + 1 for i, k in enumerate(order)} and {r["n"] for r in got} == {500}
    total, want = 0, {}
    for k in range(499, -1, -1):
        total += k % 7
        want[k] = total
    assert {r["k"]: r["cum_v"] for r in running_sums(df, "k", ["v"]).collect()} == want
    assert hash_rank(df.limit(0), ["k"]).count() == 0 and running_sums(df.limit(0), "k", ["v"]).count() == 0


def test_splits(spark):
    e = edges(spark, [(f"m{i % 20}", "microbe", "r", f"d{i}", "disease", "", "") for i in range(200)])
    assert sorted(r[0] for r in P.split_pairs(e).groupBy("fold").count().select("count").collect()) == [20, 20, 160]
    kept = P.keep_one(e, "head_id", ["head_id", "tail_id"]).filter("fold = 'train'").select("head_id").distinct().count()
    assert kept == 20
    held = spark.createDataFrame([("m", "d")], "head_id string, tail_id string")
    g = edges(spark, [("m", "", "r1", "d", "", "", ""), ("d", "", "r2", "m", "", "", ""), ("m", "", "r3", "g", "", "", "")])
    assert P.between(g, held).count() == 2 and [r["relation"] for r in P.between(g, held, "left_anti").collect()] == ["r3"]


def test_closure_and_composition(spark):
    tax = edges(spark, [("m1", "", "t", "g", "", "", ""), ("m2", "", "t", "g", "", "", "")])
    train, test = edges(spark, [("m2", "", "r", "d", "", "", "")]), edges(spark, [("m1", "", "r", "d", "", "", "")])
    assert [r["hop"] for r in A.closure_leak(test, train, A.symmetric(tax), "head", 2).collect()] == [2]
    left = spark.createDataFrame([("s1", "t"), ("s1", "v"), ("s2", "v")], "x string, y string")
    right = spark.createDataFrame([("t", "d1", "up"), ("v", "d1", "down"), ("v", "d1", "down")], "y string, z string, label string")
    got = {(r["x"], r["z"]): (r["n_via"], r["via"], r["labels"]) for r in A.compose(left, right).collect()}
    assert got == {("s1", "d1"): (2, "t,v", "down,up"), ("s2", "d1"): (1, "v", "down")}


def test_clusters(spark):
    pairs = spark.createDataFrame([("PUBCHEM:5", "CHEBI:9"), ("CHEBI:10", "PUBCHEM:5"), ("KEGG:1", None)], "a string, b string")
    got = {r["original_id"]: (r["canonical_id"], r["cluster_size"]) for r in cluster_map(pairs, "a", "b").collect()}
    assert got == {"PUBCHEM:5": ("CHEBI:10", 3), "CHEBI:9": ("CHEBI:10", 3), "CHEBI:10": ("CHEBI:10", 3), "KEGG:1": ("KEGG:1", 1)}
    row = spark.createDataFrame([(["", "a", None, "b"],)], "ids array<string>")
    assert [(p["a"], p["b"]) for p in row.select(star_pairs(F.col("ids")).alias("p")).first()["p"]] == [("a", "a"), ("a", "b")]
    chain = spark.createDataFrame([(f"n{i:04d}", f"n{i + 1:04d}") for i in range(300)], "a string, b string")
    assert {r["component"] for r in components(chain).collect()} == {"n0000"}


def test_statistics(spark):
    p = spark.createDataFrame([(0.01,), (0.02,), (0.03,), (0.5,)], "p double")
    assert [round(r["fdr"], 4) for r in T.benjamini_hochberg(p, "p").orderBy("p").collect()] == [0.04, 0.04, 0.04, 0.5]
    z = spark.createDataFrame([(1.959964, 1e6), (0.0, 3.0), (12.706205, 1.0), (-2.228139, 10.0), (2.0, 7.5)], "z double, df double").select(F.round(T.student_p(F.col("z"), F.col("df")), 4)).collect()
    assert [r[0] for r in z] == [0.05, 1.0, 0.05, 0.05, 0.0829]
    import random

    ps = [round(random.Random(i).random() ** 2, 2) for i in range(200)]
    n, want = len(ps), {}
    for q in ps:
        want[q] = min(1.0, min(x * n / sum(y <= x for y in ps) for x in ps if x >= q))
    got = {r["p"]: r["fdr"] for r in T.benjamini_hochberg(spark.createDataFrame([(x,) for x in ps], "p double"), "p").collect()}
    assert all(abs(got[q] - want[q]) < 1e-9 for q in ps)
    assert T.benjamini_hochberg(spark.createDataFrame([(None,)], "p double"), "p").first()["fdr"] is None
    rows = [(i, u, v) for i, vs in enumerate(([1, 2, 3, 4], [2, 4, 6, 9], [4, 3, 2, 1])) for u, v in enumerate(vs)]
    got = {(r["a"], r["b"]): round(r["spearman_r"], 6) for r in T.spearman(spark.createDataFrame(rows, "i int, u int, v int"), "i", "u", "v").collect()}
    assert got == {(0, 1): 1.0, (0, 2): -1.0, (1, 2): -1.0}
