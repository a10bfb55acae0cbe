import random
from itertools import product

from knotwork.llm.assignment import _subset, assign, deal, linked_groups
from knotwork.session import Scratch


def test_subset_is_the_nearest_total():
    rng = random.Random(1)
    for _ in range(60):
        sizes = [(s, rng.randrange(1, 4)) for s in rng.sample(range(1, 15), 4)]
        target = rng.randrange(0, sum(s * m for s, m in sizes) + 1)
        totals = {sum(s * k for (s, _), k in zip(sizes, ks)) for ks in product(*[range(m + 1) for _, m in sizes])}
        got = sum(s * k for s, k in _subset(sizes, target, 10**6).items())
        assert abs(got - target) == min(abs(t - target) for t in totals)


def test_bulk_dealing_stays_near_the_target():
    sizes = [(1, 5000), (7, 300), (900, 5)]
    got = sum(s * k for s, k in _subset(sizes, 6000, 200).items())
    assert abs(got - 6000) <= 7


def test_groups_and_splits(spark):
    rows = [(5, "a", "x"), (3, "b", "x"), (9, "b", "y"), (4, "c", "z"), (8, None, "z"), (7, None, None), (None, "a", "b"), (6, "q", "q"), (6, "q", "q")]
    df = spark.createDataFrame(rows, "eid bigint, h string, t string").selectExpr("*", "1 as p", "2 as v")
    got = {r["record_id"]: r["group_id"] for r in linked_groups(Scratch(spark, "t"), df, "eid", "h", "t").collect()}
    assert got == {5: 3, 3: 3, 9: 3, 4: 4, 8: 4, 7: 7, 6: 6}
    rng = random.Random(2)
    links = [(i, f"h{rng.randrange(150)}", f"t{i % 170}") for i in range(200)]
    groups = linked_groups(Scratch(spark, "t"), spark.createDataFrame(links, "eid bigint, h string, t string"), "eid", "h", "t")
    plan = spark.createDataFrame([("train", 80), ("valid", 10), ("test", 10), (None, 5)], "split_name string, share_pct int")
    out = assign(groups, plan).collect()
    assert len(out) == 200
    by = {}
    for r in out:
        assert by.setdefault(r["group_id"], r["split_name"]) == r["split_name"]
    assert assign(groups.limit(0), plan).count() == 0


def test_deal_covers_every_group_once():
    sizes = [(1, 10), (2, 5), (30, 1)]
    seen = {}
    for s, _, first, last in deal(sizes, [("train", 80), ("valid", 10), ("test", 10)]):
        for i in range(first, last + 1):
            assert (s, i) not in seen
            seen[s, i] = 1
    assert len(seen) == 16


def test_a_giant_group_does_not_widen_the_bits():
    import time
    import tracemalloc

    tracemalloc.start()
    start = time.time()
    for sizes in ([(1, 100_000), (2, 50_000), (400_000_000, 1)], [(s, 2) for s in range(1, 3000)] + [(30_000_000, 1)], [(2 * s, 1) for s in range(1, 10_001)]):
        total = sum(s * m for s, m in sizes)
        out = deal(sizes, [("train", 80), ("valid", 10), ("test", 10)])
        got = {n: sum(s * (b - a + 1) for s, x, a, b in out if x == n) for n in ("train", "valid", "test")}
        assert sum(got.values()) == total
        if sizes[-1][0] != 400_000_000:
            assert all(abs(got[n] - total / 10) <= 2 for n in ("valid", "test"))
    assert tracemalloc.get_traced_memory()[1] < 100 * 2**20 and time.time() - start < 60
    tracemalloc.stop()


def test_widening_finds_the_exact_total():
    rng = random.Random(4)
    for _ in range(40):
        sizes = [(s, rng.randrange(1, 3)) for s in rng.sample(range(20, 90, 3), 5)]
        target = rng.randrange(0, sum(s * m for s, m in sizes) + 1)
        totals = {sum(s * k for (s, _), k in zip(sizes, ks)) for ks in product(*[range(m + 1) for _, m in sizes])}
        got = sum(s * k for s, k in _subset(sizes, target, 8).items())
        assert abs(got - target) == min(abs(t - target) for t in totals)
