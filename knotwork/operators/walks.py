"""Scores over walks through a graph, one query node at a time.

The rows of a graph's square or cube are dense where there are hubs, so they
are never written: the graph, its nodes numbered, lies in the shared folder as
a table of two integers per edge, a task reads it once, sums the walks of each
of its query nodes in one vector, and only what was asked for comes back.  A
worker holds 4 bytes per direction of an edge, the same again for the edges
that end in the pool (twice for L3), and vectors as long as the graph has nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators.ranking import hash_rank
from knotwork.session import Scratch, location

#: digits that scores are rounded to before they are compared
DIGITS = 9


@dataclass
class Coded:
    """A graph with numbered nodes: ``nodes`` (node, n, deg), n from 0; ``edges`` (a, b), both directions, as a written table."""

    nodes: DataFrame
    edges: DataFrame


def number(adjacency: DataFrame) -> DataFrame:
    """``node, n, deg`` of every node of an adjacency."""
    degree = adjacency.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("deg"))
    return hash_rank(degree, ["node"]).select("node", (F.col("rk") - 1).cast("int").alias("n"), "deg")


def numbered(adjacency: DataFrame, nodes: DataFrame) -> DataFrame:
    """The adjacency in numbers, in order."""
    of = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"))
    pairs = adjacency.join(of("a"), "a").join(of("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    return pairs.repartitionByRange("a").sortWithinPartitions("a", "b")


def coded(adjacency: DataFrame) -> Coded:
    """The graph, written for one operator run."""
    scratch = Scratch(adjacency.sparkSession, "walks")
    nodes = scratch.put(number(adjacency))
    return Coded(nodes, scratch.put(numbered(adjacency, nodes)))


def columns(path: str, *names: str) -> list[np.ndarray]:
    """Columns of a written table, read inside a task."""
    fs, at = FileSystem.from_uri(path)
    table = pq.read_table(at, filesystem=fs, columns=list(names))
    return [table.column(c).to_numpy() for c in names]


class Graph:
    """Neighbours of node k: ``to[start[k]:start[k + 1]]``."""

    def __init__(self, path: str):
        a, to = columns(path, "a", "b")
        if np.any(a[1:] < a[:-1]):  # files may come in another order
            order = np.argsort(a, kind="stable")
            a, to = a[order], to[order]
        self.degree = np.bincount(a).astype(np.int64)
        self.start, self.to = np.concatenate([[0], np.cumsum(self.degree)]), to.astype(np.int32, copy=False)
        self.size = len(self.degree)


class Ends:
    """The edges that end in the pool: ``place`` of each node there (-1: not in it), walked from the start or taken from the end."""

    def __init__(self, graph: Graph, pool: np.ndarray):
        self.pool = np.unique(pool)
        self.place = np.full(graph.size, -1, np.int32)
        self.place[self.pool] = np.arange(len(self.pool), dtype=np.int32)
        inside = self.place[graph.to] >= 0
        self.start = np.concatenate([[0], np.cumsum(inside)])[graph.start]
        self.to = self.place[graph.to[inside]]
        self.back: tuple[np.ndarray, np.ndarray] | None = None

    def backward(self, graph: Graph) -> tuple[np.ndarray, np.ndarray]:
        """(neighbours of the pool's nodes, where each node's begin)."""
        if self.back is None:
            self.back = _spread(graph.start, graph.to, self.pool)[0], np.concatenate([[0], np.cumsum(graph.degree[self.pool])])[:-1]
        return self.back


def _spread(start: np.ndarray, to: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours of all ``at``, how many each has)."""
    n = start[at + 1] - start[at]
    first = np.cumsum(n) - n
    return to[np.repeat(start[at] - first, n) + np.arange(n.sum())], n


def two_steps(graph: Graph, q: int, weight: np.ndarray) -> np.ndarray:
    """Of each node y the sum of ``weight[x]`` over the walks q-x-y."""
    mids = graph.to[graph.start[q] : graph.start[q + 1]]
    ends, n = _spread(graph.start, graph.to, mids)
    return np.bincount(ends, np.repeat(weight[mids], n), graph.size)


def to_pool(graph: Graph, ends: Ends, q: int, weight: np.ndarray, kind: str) -> np.ndarray:
    """Scores of q to each node of the pool."""
    if kind != "L3":
        mids = graph.to[graph.start[q] : graph.start[q + 1]]
        found, n = _spread(ends.start, ends.to, mids)
        return np.bincount(found, np.repeat(weight[mids], n), len(ends.pool))
    worth = two_steps(graph, q, weight) * weight
    ys = np.flatnonzero(worth)
    if (ends.start[ys + 1] - ends.start[ys]).sum() * 3 < len(ends.to):  # few walks: forward
        found, n = _spread(ends.start, ends.to, ys)
        return np.bincount(found, np.repeat(worth[ys], n), len(ends.pool))
    near, first = ends.backward(graph)
    return np.add.reduceat(worth[near], first)


def weights(graph: Graph, kind: str) -> np.ndarray:
    """What a node in the middle of a walk is worth."""
    return {"CN": np.ones(graph.size), "RA": 1.0 / graph.degree, "L3": 1.0 / np.sqrt(graph.degree)}[kind]


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Numbers of 10 ** -digits, halves up."""
    return np.floor(x * 10.0**digits + 0.5)


_READ: dict = {}


def _once(key: tuple, make):
    """One graph and one pool are kept per worker: its next task reads them again."""
    if key not in _READ:
        for k in [k for k in _READ if k[0] == key[0]]:
            del _READ[k]
        _READ[key] = make()
    return _READ[key]


def rank_counts(asked: DataFrame, known: DataFrame, pool: DataFrame, graph: Coded, kinds: list[str]) -> DataFrame:
    """``kind, q, target, ts, more, same, some``: the target's score (in units of 10 ** -9), and among the candidates that are
    neither known nor unreached how many have a higher one, the same one, and any.  Query nodes outside the graph have no row.

    ``asked``: q, target; ``known``: q, c; ``pool``: c; each distinct.
    """
    spark = asked.sparkSession
    scratch = Scratch(spark, "pool")
    code = lambda c, n: graph.nodes.select(F.col("node").alias(c), F.col("n").alias(n))
    inside = scratch.put(pool.join(code("c", "n"), "c").select("n"))
    wanted = asked.join(code("target", "tn"), "target", "left").groupBy("q").agg(F.collect_list(F.struct("target", F.coalesce("tn", F.lit(-1)).alias("tn"))).alias("w"))
    out_of = known.join(code("c", "n"), "c").groupBy("q").agg(F.collect_list("n").alias("known"))
    rows = wanted.join(code("q", "qn"), "q").join(out_of, "q", "left").select("q", "qn", "w.target", "w.tn", F.coalesce("known", F.array().cast("array<int>")).alias("known"))
    edges, ends = location(graph.edges), location(inside)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            g = _once(("graph", edges), lambda: Graph(edges))
            e = _once(("ends", ends, edges), lambda: Ends(g, columns(ends, "n")[0]))
            out, of_kind = [], {kind: weights(g, kind) for kind in kinds}
            for q, qn, targets, tns, out_of in zip(batch["q"], batch["qn"], batch["target"], batch["tn"], batch["known"]):
                at = e.place[np.asarray(out_of, np.int64)]
                at = at[at >= 0]
                for kind, w in of_kind.items():
                    s = rounded(to_pool(g, e, qn, w, kind), DIGITS) if len(e.pool) else np.zeros(0)
                    free = s.copy()
                    free[at] = -1
                    some = int(np.count_nonzero(free > 0))
                    for target, tn in zip(targets, tns):
                        k = e.place[tn] if tn >= 0 else -1
                        ts = float(s[k]) if k >= 0 else 0.0
                        out.append((kind, q, target, ts, int(np.count_nonzero(free > ts)), int(np.count_nonzero(free == ts)), some))
            yield pd.DataFrame(out, columns=["kind", "q", "target", "ts", "more", "same", "some"])

    return dealt(rows).mapInPandas(count, "kind string, q string, target string, ts double, more long, same long, some long")


def l3(pairs: DataFrame, graph: Coded) -> DataFrame:
    """``h, t, l3`` of the distinct pairs whose ends are both in the graph."""
    code = lambda c: graph.nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"))
    both = pairs.select("h", "t").distinct().join(code("h"), "h").join(code("t"), "t")
    rows = both.groupBy("h", "nh").agg(F.collect_list(F.struct("t", "nt")).alias("w")).select("h", "nh", "w.t", "w.nt")
    edges = location(graph.edges)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            g = _once(("graph", edges), lambda: Graph(edges))
            w, out = weights(g, "L3"), []
            for h, nh, ts, nts in zip(batch["h"], batch["nh"], batch["t"], batch["nt"]):
                worth = two_steps(g, nh, w) * w
                out += [(h, t, float(worth[g.to[g.start[n] : g.start[n + 1]]].sum())) for t, n in zip(ts, nts)]
            yield pd.DataFrame(out, columns=["h", "t", "l3"])

    return dealt(rows).mapInPandas(score, "h string, t string, l3 double")


def dealt(rows: DataFrame) -> DataFrame:
    """Query nodes in as many tasks as the session shuffles to: they are few bytes and much work."""
    return rows.repartition(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
