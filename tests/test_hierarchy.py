import random

import pytest

from knotwork.operators.hierarchy import descendants, hierarchy


def brute(parent):
    out = {}
    for v in parent:
        path, x = [], v
        while x in parent and x not in path[:-1]:
            x = parent[x]
            if x in path:
                break
            path.append(x)
            if x == v:
                break
        seen, y = [v], v
        ring = None
        while y in parent:
            y = parent[y]
            if y in seen:
                ring = seen[seen.index(y) :]
                break
            seen.append(y)
        if ring is None:
            out[v] = (seen[-1], len(seen) - 1, seen[1:])
        elif v in ring:
            out[v] = (min(ring), -1, [*seen[1:], v])
        else:
            out[v] = (min(ring), -2, seen[1:])
    return out


def forest(rng, n):
    parent = {}
    for i in range(n):
        kind = rng.random()
        if kind < 0.8 and i:
            parent[f"n{i}"] = f"n{rng.randrange(max(0, i - 4), i)}"
        elif kind < 0.85:
            parent[f"n{i}"] = f"n{rng.randrange(n)}"
    return parent


@pytest.mark.parametrize("seed,n,rows,hot", [(1, 60, 10, 3), (2, 300, 40, 1000), (3, 200, 20, 1), (4, 120, 100000, 10)])
def test_against_brute_force(spark, seed, n, rows, hot):
    parent = forest(random.Random(seed), n)
    df = spark.createDataFrame(list(parent.items()), "node string, parent string")
    got = {r["node"]: (r["root"], r["depth"], list(r["path"])) for r in hierarchy(df, fragment_rows=rows, hot=hot).collect()}
    assert got == brute(parent)
    short = {r["node"]: (r["root"], r["depth"]) for r in hierarchy(df, fragment_rows=rows, hot=hot, paths=False).collect()}
    assert short == {k: v[:2] for k, v in got.items()}


def test_ring_of_fragments_and_self_parent(spark):
    parent = {f"r{i:02d}": f"r{(i + 1) % 30:02d}" for i in range(30)} | {"a": "r05", "b": "a", "s": "s", "t": "s"}
    df = spark.createDataFrame(list(parent.items()), "node string, parent string")
    got = {r["node"]: (r["root"], r["depth"]) for r in hierarchy(df, fragment_rows=4).collect()}
    assert got["r07"] == ("r00", -1) and got["b"] == ("r00", -2) and got["s"] == ("s", -1) and got["t"] == ("s", -2)


def test_nulls_repeats_trees_and_empty(spark):
    rows = [("x", "a", "b"), ("x", "a", "b"), ("y", "a", "c"), (None, "a", "d"), ("x", None, "b"), ("x", "q", None), ("y", "a", "d")]
    df = spark.createDataFrame(rows, "tree string, node string, parent string").selectExpr("*", "1 as root", "2 as depth", "3 as path")
    got = sorted((r["tree"], r["node"], r["root"], r["depth"]) for r in hierarchy(df, tree="tree").collect())
    assert got == [("", "a", "d", 1), ("x", "a", "b", 1), ("y", "a", "c", 1)]
    assert hierarchy(df.limit(0)).count() == 0 and hierarchy(df.limit(0), paths=False).count() == 0


def test_descendants(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b")], "node string, parent string")
    got = sorted(tuple(r) for r in descendants(hierarchy(df)).select("ancestor", "node", "distance").collect())
    assert got == [("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1), ("b", "d", 1)]
