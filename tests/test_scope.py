"""The queries over whole graphs, against brute force on a fixture that is read like the real tables."""

import itertools
import math
import random

import pytest

from knotwork.plans import catalog
from knotwork.plans.common import kg
from knotwork.plans.scoring import AUX
from knotwork.plans.splitting import ASSOCIATIONS, transductive

RAW = "edge_id string, split_name string, head_id string, head_type string, relation string, tail_id string, tail_type string, confidence string, species_source string, source string, evidence string"
M, D, C = [f"NCBI:{i}" for i in range(1, 31)], [f"MESH:D{i:06d}" for i in range(1, 21)], [f"CHEBI:{i}" for i in range(1, 16)]


def write(spark, d, rows):
    full = [(str(i), "a", h, ht, r, t, tt, "", "", "S", "") for i, (h, ht, r, t, tt) in enumerate(rows)]
    spark.createDataFrame(full, RAW).write.mode("overwrite").parquet(f"{d}/final_kg_edges.parquet")
    return str(d)


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    g = random.Random(3)
    rows = [(g.choice(M), "microbe", g.choice(ASSOCIATIONS), g.choice(D), "disease") for _ in range(250)]
    rows += [(g.choice(M), "microbe", g.choice([r for r in AUX if r != "is_a"]), g.choice(M), "microbe") for _ in range(60)]
    rows += [(g.choice(D), "disease", "is_a", g.choice(D), "disease") for _ in range(25)]
    rows += [(g.choice(M), "microbe", g.choice(["produces", "can_utilize", "associated_with_metabolite"]), g.choice(C), "metabolite") for _ in range(80)]
    rows += [(g.choice(C), "metabolite", "associated_with_disease", g.choice(D), "disease") for _ in range(40)]
    return write(spark, tmp_path_factory.mktemp("graph"), rows)


@pytest.mark.parametrize("scope", ["aux", "bridges"])
def test_scores_on_whole_graphs(spark, graph, scope):
    e = kg(spark, graph)
    folds = transductive(e).select("head_id", "relation", "tail_id", "fold").collect()
    held = {(h, r, t) for h, r, t, f in folds if f != "train"}
    pairs = {(h, t) for h, r, t, f in folds if f == "test" and r != "inconsistent_association"}
    triples = {(r["head_id"], r["relation"], r["tail_id"]) for r in e.collect()} - held
    near = {}
    for h, r, t in triples:
        if h != t and (scope == "bridges" or r in ASSOCIATIONS or r in AUX):
            near.setdefault(h, set()).add(t)
            near.setdefault(t, set()).add(h)
    of = lambda n: near.get(n, set())
    run = lambda name: {(r["head"], r["tail"]): r[2] for r in catalog.queries()[f"{name}_{scope}"](spark, graph).collect()}
    assert len(pairs) > 10
    assert run("structural_cn") == {(h, t): len(of(h) & of(t)) for h, t in pairs}
    assert run("structural_ra") == pytest.approx({(h, t): sum(1 / len(of(m)) for m in of(h) & of(t)) for h, t in pairs}, abs=2e-6)
    assert run("structural_l3") == pytest.approx({(h, t): sum(1 / math.sqrt(len(of(x)) * len(of(y))) for x, y in itertools.product(of(h), of(t)) if y in of(x)) for h, t in pairs}, abs=2e-6)


def test_ablation_of_bridges(spark, graph):
    got = catalog.queries()["ablation_delta_full"](spark, graph).first()
    for column, scope in (("mrr_only", "aux"), ("mrr_bridge", "bridges")):
        ranks = [r["rank"] for r in catalog.queries()[f"filtered_rank_{scope}"](spark, graph).collect()]
        assert got[column] == pytest.approx(sum(1 / r for r in ranks) / len(ranks), abs=2e-6)
    assert got["mrr_only"] != got["mrr_bridge"]


def test_components_of_every_relation(spark, graph):
    label = {}
    edges = [(r["head_id"], r["tail_id"]) for r in kg(spark, graph).collect()]
    for h, t in edges:
        label.setdefault(h, h), label.setdefault(t, t)
    for _ in label:
        for h, t in edges:
            label[h] = label[t] = min(label[h], label[t])
    sizes = {}
    for c in label.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert {r["component"]: r["size"] for r in catalog.queries()["components_all"](spark, graph).collect()} == sizes


def test_leaks_of_both_ends(spark, graph):
    rows = kg(spark, graph).collect()
    folds = transductive(kg(spark, graph)).collect()
    train = {(r["head_id"], r["relation"], r["tail_id"]) for r in folds if r["fold"] == "train"}
    test = {(r["head_id"], r["relation"], r["tail_id"]) for r in folds if r["fold"] == "test"}
    want = {}
    for side, names in (("head", [r for r in AUX if r not in ("is_a", "co_occurs_with")]), ("tail", ["is_a"])):
        near = {}
        for r in rows:
            if r["relation"] in names and r["head_id"] != r["tail_id"]:
                near.setdefault(r["head_id"], set()).add(r["tail_id"])
                near.setdefault(r["tail_id"], set()).add(r["head_id"])
        for h, r, t in test - train:
            me = h if side == "head" else t
            one = near.get(me, set())
            two = {y for x in one for y in near[x]} - one - {me}
            for hop, ring in ((1, one), (2, two)):
                if any(((n, r, t) if side == "head" else (h, r, n)) in train for n in ring):
                    want[side, hop] = want.get((side, hop), 0) + 1
                    break
    got = {(r["side"], r["hop"]): r["n"] for r in catalog.queries()["leak_closure_full"](spark, graph).collect()}
    assert got == want and {s for s, _ in want} == {"head", "tail"}


def test_leakage_free_of_both_ends(spark, tmp_path):
    g = random.Random(1)
    rows = [(m, "microbe", "enriched_in", d, "disease") for m in M for d in D if g.random() < 0.3]
    near = [(D[i], "disease", "is_a", D[0], "disease") for i in range(1, len(D))]
    test = catalog.queries()["leakage_free_full"](spark, write(spark, tmp_path / "a", rows)).filter("file = 'test'").first()
    assert test["n_before"] == test["n_after"] > 0
    test = catalog.queries()["leakage_free_full"](spark, write(spark, tmp_path / "b", rows + near)).filter("file = 'test'").first()
    assert test["n_after"] < test["n_before"]


def test_descendants_below_and_on_circles(spark, tmp_path):
    up = {0: 1, 1: 2, 2: 1, 3: 0, 4: 5}
    d = write(spark, tmp_path, [(D[a], "disease", "is_a", D[b], "disease") for a, b in up.items()])
    n = [x.removeprefix("MESH:") for x in D]
    got = {(r["ancestor_id"], r["node_id"]) for r in catalog.queries()["p1_descendants"](spark, d).collect()}
    assert {(n[1], n[0]), (n[2], n[0]), (n[0], n[3]), (n[1], n[3]), (n[2], n[3]), (n[5], n[4])} <= got
    assert {(n[1], n[2]), (n[2], n[1])} <= got
    assert not any((n[a], n[b]) in got for a, b in [(0, 1), (3, 0), (4, 5), (1, 4)])


def test_every_line_is_parsed(spark, tmp_path):
    texts = [(1, "# note\na b c d e\nshort\nf g h i j"), (2, None), (3, "k l m n o")]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in catalog.queries()["line_parse"](spark, str(tmp_path)).collect())
    assert got == [(1, 1, "a", "c"), (1, 3, "f", "h"), (3, 0, "k", "m")]
