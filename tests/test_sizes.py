"""What grows with a hub, a cap or the number of draws must not: against brute force, and by the rows that are made."""

import random
from hashlib import md5

import numpy as np
import pandas as pd
import pytest

from knotwork.operators import audit as A
from knotwork.operators import metrics as M
from knotwork.operators import score as S
from knotwork.operators import stats as T
from knotwork.operators import walks as W


def test_reach_is_asked_from_the_smaller_end(spark):
    g = random.Random(5)
    mk = lambda rows, s: spark.createDataFrame(sorted(rows), s)
    left = {("hub", f"y{i}") for i in range(3_000)} | {(f"x{g.randrange(20)}", f"y{g.randrange(3_000)}") for _ in range(200)}
    right = {(f"y{g.randrange(3_000)}", f"z{g.randrange(900)}") for _ in range(1_500)}
    target = {("hub", f"z{i}") for i in range(900)} | {(f"x{g.randrange(25)}", f"z{g.randrange(900)}") for _ in range(200)}
    want = {(x, z) for x, z in target if any((y, z) in right for a, y in left if a == x)}
    got = A.reachable(mk(target, "x string, z string"), mk(left, "x string, y string"), mk(right, "y string, z string"))
    assert {tuple(r) for r in got.collect()} == want
    joins = _joined(got)
    assert joins and max(joins) < 20_000  # from the hub's side it were 2,700,000


def _joined(df):
    """Rows out of every join of the executed plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    out, todo = [], [plan.executedPlan() if hasattr(plan, "executedPlan") else plan]
    while todo:
        p = todo.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
            continue
        if p.nodeName().endswith(("QueryStage", "ReusedExchange")):
            todo.append(p.plan() if p.nodeName().endswith("QueryStage") else p.child())
        if "Join" in p.nodeName():
            out.append(p.metrics().apply("numOutputRows").value())
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return out


def test_walked_ranks_are_those_of_the_scores(spark):
    g = random.Random(8)
    mk = lambda rows, s: spark.createDataFrame(sorted(rows), s)
    edges = {("hub", f"t{i}") for i in range(40)} | {(f"h{g.randrange(25)}", f"t{g.randrange(40)}") for _ in range(90)} | {(f"h{g.randrange(25)}", f"x{g.randrange(5)}") for _ in range(40)}
    adj = A.symmetric(mk(edges, "head_id string, tail_id string"))
    known = {(h, t) for h, t in edges if t[0] == "t" and g.random() < 0.6} | {("lone", "t1"), ("h1", "far")}
    test = set(g.sample(sorted(known), 25)) | {("lone", "t1"), ("h1", "far"), ("h2", "t3"), ("h2", "unknown")}
    ask = mk(test, "q string, target string")
    k = mk(known, "q string, c string")
    pool = k.select("c").distinct()
    got = {(r["kind"], r["q"], r["target"]): r["rank"] for r in S.walk_ranks(S.ask(ask, k, pool), W.coded(adj), ["CN", "RA", "L3"]).collect()}
    for kind in ("CN", "RA", "L3"):
        want = {(kind, r["q"], r["target"]): r["rank"] for r in S.filtered_ranks(ask, k, pool, S.row_scores(ask, adj, kind, pool)).collect()}
        assert want == {x: r for x, r in got.items() if x[0] == kind}


def test_resamples_are_those_of_moved_draws(spark):
    g = random.Random(9)
    rows = [(g.random() < 0.3, g.choice([0.0, 0.5, 1.0, 2.0, float("nan")])) for _ in range(60)]
    of = {c: [s for p, s in rows if p == c] for c in (True, False)}
    table = [(i + 1, len(of[c]), c, s) for c in of for i, s in enumerate(of[c])]
    scores = spark.createDataFrame(table, "rk long, n long, positive boolean, score double")
    drawn = [(b, c, of[c][int(md5(f"42|{b}|{int(c)}|{k}".encode()).hexdigest()[:8], 16) % len(of[c])]) for b in range(1, 41) for c in of for k in range(1, len(of[c]) + 1)]
    per = M.auc_block(spark.createDataFrame(drawn, "b long, positive boolean, score double"), ["b"]).toPandas()
    got = {r["metric"]: (r["lo"], r["hi"]) for r in M.bootstrap_auc(scores, 40).collect()}
    for m in ("auroc", "auprc"):
        assert got[m] == pytest.approx(tuple(np.percentile(per[m], [2.5, 97.5])), abs=2e-6)
    values = spark.createDataFrame([(i + 1, 30, float(g.randrange(1, 50))) for i in range(30)], "rk long, n long, rank double")
    [ci] = M.bootstrap(values, 40).collect()
    ranks = [r["rank"] for r in values.orderBy("rk").collect()]
    means = [np.mean([1 / ranks[int(md5(f"42|{b}|{k}".encode()).hexdigest()[:8], 16) % 30] for k in range(1, 31)]) for b in range(1, 41)]
    assert (ci["lo"], ci["hi"]) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])), abs=2e-6)


def test_correlations_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 7)
    monkeypatch.setattr(T, "UNITS", 8)
    g = random.Random(4)
    rows = [(i, u, g.randrange(6)) for i in range(30) for u in range(40) if g.random() < 0.7] + [(99, u, 1) for u in range(40)]
    got = T.spearman(spark.createDataFrame(rows, "i int, u int, v int"), "i", "u", "v")
    wide = pd.DataFrame(rows, columns=["i", "u", "v"]).pivot(index="u", columns="i", values="v").rank()
    want = {}
    for a in range(30):
        for b in range(a + 1, 30):
            both = wide[[a, b]].dropna()
            want[a, b] = (len(both), both[a].corr(both[b]))
    assert {(r["a"], r["b"]): (r["n"], r["spearman_r"]) for r in got.collect()} == {k: (n, pytest.approx(r, abs=1e-9)) for k, (n, r) in want.items()}
    assert max(_joined(got)) <= 5 * len(rows)  # a row per pair and unit were 9,000 and more
