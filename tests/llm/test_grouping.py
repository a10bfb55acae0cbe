import random

import pytest

from knotwork.llm.grouping import groups


def brute(pairs):
    label = {x: x for p in pairs for x in p if x is not None}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a is not None and b is not None and label[a] != label[b]:
                low = min(label[a], label[b])
                old = {label[a], label[b]}
                label = {k: low if v in old else v for k, v in label.items()}
                changed = True
    return label


def shapes():
    rng = random.Random(5)
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(150)]
    rng.shuffle(chain)
    star = [("hub", f"s{i}") for i in range(40)] + [("a-low", "s3")]
    tree = [(f"t{i}", f"t{i // 3}") for i in range(1, 60)]
    noise = [(f"n{rng.randrange(80)}", f"n{rng.randrange(80)}") for _ in range(40)]
    odd = [("x", None), (None, "y"), (None, None), ("z", "z"), ("z", "z")]
    return {"all": chain + star + tree + noise + odd, "chain": chain, "star": star, "odd": odd, "empty": []}


@pytest.mark.parametrize("name", ["all", "chain", "star", "odd", "empty"])
def test_groups_against_brute_force(spark, name):
    pairs = shapes()[name]
    df = spark.createDataFrame(pairs, "p string, q string").selectExpr("*", "1 as v", "2 as id", "3 as hub")
    got = {r["id"]: r["group_id"] for r in groups(df, "p", "q").collect()}
    assert got == brute(pairs)
