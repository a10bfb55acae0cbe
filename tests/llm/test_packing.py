import random

from knotwork.llm.packing import SumOfSquares, best_fit, pack


def test_sum_of_squares_is_the_best_choice():
    rng = random.Random(2)
    packer, cap = SumOfSquares(20), 20
    counts = [0] * 21
    for _ in range(400):
        s = rng.randrange(1, 20)
        options = {0: counts[s] + 0}
        score = lambda c: sum(x * x for x in c[1:20])
        best = None
        for h in range(20):
            if (h == 0 or counts[h]) and h + s <= cap:
                c = list(counts)
                if h:
                    c[h] -= 1
                c[h + s] += 1
                best = min(x for x in (best, score(c)) if x is not None)
        before = list(packer.level)
        w, at = packer.place(s)
        if at:
            counts[at] -= 1
        counts[at + s] += 1
        assert score(counts) == best and (at == 0 or before[w] == at) and options


def check(rows, sizes, cap):
    seen, windows = {}, {}
    for r in rows:
        seen.setdefault(r["item"], []).append((r["piece"], r["first_token"], r["size"]))
        if r["size"]:
            windows.setdefault(r["window"], []).append((r["offset"], r["size"]))
        else:
            assert r["window"] is None
    assert set(seen) == set(sizes)
    for k, n in sizes.items():
        parts = sorted(seen[k])
        assert [p[0] for p in parts] == list(range(len(parts))) and sum(p[2] for p in parts) == n
        assert len(parts) == max(1, -(-n // cap))
    for parts in windows.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= cap
    return sum(sizes.values()) / (len(windows) * cap)


def test_pack_keeps_everything_and_fills(spark):
    rng = random.Random(3)
    sizes = {i: rng.choice([0, rng.randrange(1, 400), rng.randrange(1, 900), 1000, 3500]) if i % 9 == 0 else rng.randrange(1, 300) for i in range(3000)}
    df = spark.createDataFrame(list(sizes.items()), "k bigint, n int").selectExpr("*", "1 as window", "2 as size")
    for tasks in (100_000, 400):
        assert check(pack(df, "k", "n", 1000, tasks).collect(), sizes, 1000) > 0.99


def test_odd_sizes(spark):
    df = spark.createDataFrame([("a", None), ("b", -4), ("c", 10), ("c", 10), (None, 3)], "k string, n int")
    rows = pack(df, "k", "n", 10).collect()
    assert len(rows) == 5 and sum(r["size"] for r in rows) == 23
    assert pack(df.limit(0), "k", "n", 10).count() == 0


def test_best_fit():
    out = best_fit([6, 5, 4, 5], 10)
    assert out[0][0] == out[2][0] and out[1][0] == out[3][0]


def test_items_without_partners_end_and_are_not_lost(spark):
    for sizes in ({i: 60 for i in range(300)}, {i: 60 if i % 2 else 55 for i in range(300)}, {i: 75 if i % 2 else 25 for i in range(400)}):
        df = spark.createDataFrame(list(sizes.items()), "k bigint, n int")
        rows = pack(df, "k", "n", 100, 10).collect()
        check(rows, sizes, 100)
        if 25 in sizes.values():
            assert check(rows, sizes, 100) > 0.9


def test_many_levels_fill_as_well_as_one(spark):
    rng = random.Random(5)
    sizes = {i: min(2000, int(rng.lognormvariate(4.5, 1.0)) + 1) for i in range(20_000)}
    df = spark.createDataFrame(list(sizes.items()), "k bigint, n int")
    for tasks in (1_000, 100_000):
        rows = pack(df, "k", "n", 2048, tasks).collect()
        assert check(rows, sizes, 2048) > 0.99
        assert sum(not r["again"] for r in rows) > 0.9 * len(rows)
