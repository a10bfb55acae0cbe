"""Filling fixed-capacity windows with items (problem 8).

Sum-of-squares online packing: let N(h) be the number of open windows filled to
level h.  An item goes to the level that makes the sum of N(h)^2 over all
partially filled levels smallest, ties to the fullest window.  The levels are
one array, so an item costs one pass over it.

Items are dealt to partitions by a hash of their id and packed there in a fixed
order, so a task that is run again gives the same windows.  The items of the
windows that stay partially filled are packed again, together, in fewer
partitions, as long as each level leaves at most ``SHRINK`` of the items of the
one before; so there are at most log2 of the number of tasks levels.  What no
further level would fill better (one task's worth, or items that have no
partners, such as all larger than half a window) is settled where it lies, in
parallel: the open windows of each task are filled anew by falling size if that
takes fewer windows.  At most one badly filled window a task is lost by that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.session import Scratch

#: items that one task packs
ITEMS_PER_TASK = 100_000
#: a window of at least this share of its capacity is not packed again
FULL_ENOUGH = 0.995
#: a level that leaves more than this share of its items is the last one
SHRINK = 0.5


class SumOfSquares:
    """Open windows of one task; ``place`` gives (window number, offset)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self._twice = np.ones(capacity + 1, dtype=np.int64)  # 2 N(h) + 1
        self._twice[capacity] = 0  # a full window counts nothing
        self._at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.level: list[int] = []

    def place(self, size: int) -> tuple[int, int]:
        cap, w = self.capacity, self._twice
        best, to = int(w[size]), 0  # a new window
        if size < cap:
            # moving a window from h to h + size changes the sum by 2N(h + size) + 1 - (2N(h) - 1)
            here = w[1 : cap - size + 1]
            cost = np.where(here > 1, w[1 + size : cap + 1] - here + 2, np.iinfo(np.int64).max)
            k = len(cost) - 1 - int(np.argmin(cost[::-1]))
            if cost[k] <= best:
                to = k + 1
        if to:
            window = self._at[to].pop()
            w[to] -= 2
        else:
            window = len(self.level)
            self.level.append(0)
        at = self.level[window]
        self.level[window] = at + size
        if at + size < cap:
            self._at[at + size].append(window)
            w[at + size] += 2
        return window, at


def best_fit(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(window, offset) of items by falling size, each in the fullest window that takes it."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = np.zeros(capacity + 1, dtype=np.int64)
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    n = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[i]
        fit = np.flatnonzero(rooms[s:])
        if len(fit):
            room = s + int(fit[0])
            window = by_room[room].pop()
            rooms[room] -= 1
        else:
            room, window = capacity, n
            n += 1
        out[i] = (window, capacity - room)
        if room > s:
            by_room[room - s].append(window)
            rooms[room - s] += 1
    return out


def _pack(part: pd.DataFrame, capacity: int, last: bool, tag: str) -> pd.DataFrame:
    sizes = part["size"].to_numpy()
    packer = SumOfSquares(capacity)
    placed = [packer.place(int(s)) for s in sizes]
    level = np.array(packer.level, dtype=np.int64)
    window = np.array([w for w, _ in placed], dtype=np.int64)
    offset = np.array([o for _, o in placed], dtype=np.int64)
    done = level[window] >= FULL_ENOUGH * capacity
    by = np.zeros(len(sizes), dtype=bool)  # placed anew
    if last:
        rest = np.flatnonzero(~done)
        again = best_fit(sizes[rest].tolist(), capacity)
        if rest.size and max(w for w, _ in again) + 1 < len(np.unique(window[rest])):
            window[rest] = [len(level) + w for w, _ in again]
            offset[rest] = [o for _, o in again]
            by[rest] = True
        done[:] = True
    out = part[["item", "piece", "first_token", "size"]].copy()
    out["window"] = [f"{tag}-{w}" for w in window]
    out["offset"] = offset
    out["done"] = done
    out["again"] = by
    return out


def pack(items: DataFrame, item_id: str, size: str, capacity: int, items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """``item, piece, first_token, size, window, offset, again``: one row per piece of every item.

    Only an item larger than the capacity is divided, into whole windows and a
    rest (``piece`` counts from 0, ``first_token`` is where the piece begins).
    An item of size 0 takes no room: its window is null.  Null or negative sizes
    count as 0.  Rows are items: repeated ids are packed each; ids of any type
    are allowed and kept.  ``again`` marks the leftovers that were placed by
    falling size, not by sum of squares.  An empty table gives an empty result.
    """
    scratch = Scratch(items.sparkSession, "packing")
    rows = items.select(F.col(item_id).alias("item"), F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("int"), F.lit(0)).alias("n"))
    pieces = rows.select("item", "n", F.posexplode(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(capacity))).alias("piece", "first_token")).select(
        "item", "piece", "first_token", F.least(F.col("n") - F.col("first_token"), F.lit(capacity)).alias("size")
    )
    cut = scratch.put(pieces)
    kind = items.schema[item_id].dataType.simpleString()
    schema = f"item {kind}, piece int, first_token int, size int, window string, offset bigint, done boolean, again boolean"
    order = [F.xxhash64(F.col("item").cast("string"), F.col("piece")), F.col("item").cast("string"), "piece", "size"]
    fixed = [F.lit(0).cast("bigint").alias("offset"), F.lit(False).alias("again")]
    # whole windows need no packing
    whole = cut.filter(F.col("size") == capacity).select("*", F.concat(F.lit("w-"), F.col("item").cast("string"), F.lit("-"), F.col("piece"), F.lit("-"), F.monotonically_increasing_id()).alias("window"), *fixed)
    empty = cut.filter("size = 0").select("*", F.lit(None).cast("string").alias("window"), *fixed)
    out = scratch.put(whole).unionByName(empty)
    rest, level = cut.filter((F.col("size") > 0) & (F.col("size") < capacity)), 0
    left, before = rest.count(), None
    while True:
        tasks = max(1, -(-left // items_per_task))
        last = tasks == 1 or (before is not None and left > SHRINK * before)

        def run(parts: Iterator[pd.DataFrame], last: bool = last, level: int = level) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            held = [p for p in parts if len(p)]
            if held:
                yield _pack(pd.concat(held, ignore_index=True), capacity, last, f"{level}-{TaskContext.get().partitionId()}")

        part = F.pmod(F.xxhash64(F.lit(level), F.col("item").cast("string"), F.col("piece"), F.monotonically_increasing_id()), F.lit(tasks)).cast("int")
        dealt = rest.coalesce(1) if tasks == 1 else rest.withColumn("part", part).repartitionById(tasks, F.col("part"))
        placed = scratch.put(dealt.sortWithinPartitions(*order).select("item", "piece", "first_token", "size").mapInPandas(run, schema))
        out = out.unionByName(placed.filter("done").drop("done"))
        if last:
            return out
        rest, level = placed.filter("NOT done").select("item", "piece", "first_token", "size"), level + 1
        left, before = rest.count(), left
        if not left:
            return out
