import random

import pytest

from knotwork.llm import overlap
from knotwork.llm.overlap import contained


def brute(rows, n, t):
    def fp(ws):
        return {tuple(ws)} if len(ws) < n else {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}

    good = [(i, s, fp(w)) for i, s, w in rows if i is not None and s and w]
    return {(a, b) for a, s, x in good if s != "train" for b, q, y in good if q == "train" and len(x & y) / len(x) >= t}


def pairs(links, members):
    m = [r.asDict() for r in members.select("record_id", "split", "class_x", "class_y").collect()]
    out = set()
    for k in links.collect():
        ev = [r["record_id"] for r in m if (r["class_x"], r["class_y"]) == (k["eval_x"], k["eval_y"]) and r["split"] != "train"]
        tr = [r["record_id"] for r in m if (r["class_x"], r["class_y"]) == (k["train_x"], k["train_y"]) and r["split"] == "train"]
        out |= {(a, b) for a in ev for b in tr}
    return out


@pytest.mark.parametrize("salt", [50_000, 3])
def test_contained_against_brute_force(spark, monkeypatch, salt):
    monkeypatch.setattr(overlap, "GRAM_ROWS", salt)
    rng = random.Random(3)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 40))] for _ in range(30)]
    rows = []
    for i in range(120):
        w = list(rng.choice(base))
        if rng.random() < 0.5 and w:
            w[rng.randrange(len(w))] = "changed"
        if rng.random() < 0.2:
            w = w + ["tail"] * rng.randrange(3)
        rows.append((i, rng.choice(["train", "train", "valid", "test"]), w))
    rows += [(900, None, ["a"]), (None, "train", ["a"]), (901, "valid", []), (902, "train", None), (903, "train", ["x"]), (904, "test", ["x"]), (904, "test", ["x"])]
    df = spark.createDataFrame(rows, "rid bigint, part string, words array<string>").selectExpr("*", "1 as grams", "2 as gram")
    assert pairs(*contained(df, "rid", "words", "part")) == brute(rows, 5, 0.8)
    links, members = contained(df.limit(0), "rid", "words", "part")
    assert links.count() == 0 and members.count() == 0
