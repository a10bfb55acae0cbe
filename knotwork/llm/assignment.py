"""Splits that keep related records together (problem 4).

Records that share an entity form components: entities are vertices, records
are links, and parallel hooking and shortcutting over the parent table (see
``operators.components``) finds the smallest vertex of each.  Whole components
are then dealt to the splits.  Only how many components there are of each size
matters for the totals, and that table has O(sqrt(records)) rows, since the
sizes add up to the number of records.

For every split but the largest, the sizes to use are found by a subset sum
over the size multiplicities: reachable totals are the bits of one integer,
and a size with multiplicity m enters as the binary pieces 1, 2, 4, ... of m.
Beside the bits, one number per total tells which piece reached it first, and
from that the pieces are read back.  Groups larger than the target never enter:
only the smallest of them may stand alone as an overshoot.

The bits first cover ``exact_limit`` totals (4.2 bytes each), the bulk being
dealt from the largest sizes down.  A total that meets the target to within
what the common divisor of the sizes allows is proven to be the nearest.  Only
if it does not, the bits are widened four times and it is tried again, up to
the whole target, so the answer is exact at every size.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knotwork.operators.components import hook_and_shortcut
from knotwork.session import Scratch

#: totals that the bits cover at first
EXACT_LIMIT = 2_000_000


def linked_groups(scratch: Scratch, records: DataFrame, record_id: str, left: str, right: str) -> DataFrame:
    """``record_id, group_id``: the smallest record id among all records linked through entities.

    A null entity links nothing; a record with two null entities is a group of
    its own.  Repeated rows are allowed; rows with a null id are left out.
    """
    rows = records.select(F.col(record_id).alias("record_id"), F.col(left).alias("l"), F.col(right).alias("r")).filter("record_id IS NOT NULL")
    rows = scratch.put(rows)
    parent = hook_and_shortcut(scratch, rows.select(F.col("l").alias("a"), F.col("r").alias("b")))
    named = rows.withColumn("v", F.coalesce("l", "r")).join(parent, "v", "left").select("record_id", F.coalesce("p", "v").alias("vertex"))
    named = scratch.put(named)
    least = named.filter("vertex IS NOT NULL").groupBy("vertex").agg(F.min("record_id").alias("group_id"))
    alone = named.filter("vertex IS NULL").select("record_id", F.col("record_id").alias("group_id"))
    return named.join(least, "vertex").select("record_id", "group_id").unionByName(alone)


def _pieces(sizes: list[tuple[int, int]], width: int) -> list[tuple[int, int]]:
    """(size, how many) in binary multiplicities, the largest sizes first."""
    out = []
    for s, m in sorted(sizes, reverse=True):
        m, step = min(m, width // s), 1
        while m > 0:
            k = min(step, m)
            out.append((s, k))
            m -= k
            step *= 2
    return out


def _reach(pieces: list[tuple[int, int]], width: int, goal: int) -> tuple[int, np.ndarray]:
    """(reachable totals up to ``width`` as bits, the piece that reached each first); stops when ``goal`` is reached."""
    mask, bits = (1 << (width + 1)) - 1, 1
    first = np.full(width + 1, -1, dtype=np.int32)
    for i, (s, k) in enumerate(pieces):
        new = (bits << (s * k)) & mask & ~bits
        if new:
            low = (new & -new).bit_length() - 1
            shifted = new >> low
            at = np.flatnonzero(np.unpackbits(np.frombuffer(shifted.to_bytes(-(-shifted.bit_length() // 8), "little"), dtype=np.uint8), bitorder="little"))
            first[at + low] = i
            bits |= new
            if bits >> goal & 1:
                break
    return bits, first


def _exact(sizes: list[tuple[int, int]], target: int) -> dict[int, int]:
    """How many of each size make the total nearest to the target (the smaller on a tie)."""
    usable = [(s, m) for s, m in sizes if 0 < s <= target and m]
    big = min((s for s, m in sizes if s > target and m), default=None)
    pieces = _pieces(usable, target)
    everything = sum(s * m for s, m in usable)
    if everything <= target:  # nothing to choose
        if big is not None and big - target < target - everything:
            return {big: 1}
        return dict(usable)
    bits, first = _reach(pieces, target, target)
    total = bits.bit_length() - 1
    gap = target - total
    if gap and big is not None and big - target < gap:
        gap = big - target
    else:
        big = None
    if gap > 1:  # a total above the target may be nearer
        above = target + gap - 1
        wide = _pieces(usable, above)
        more, first_wide = _reach(wide, above, above + 1)
        over = more >> (target + 1)
        if over:
            total, pieces, first, big = target + (over & -over).bit_length(), wide, first_wide, None
    if big is not None:
        return {big: 1}
    taken: dict[int, int] = {}
    while total:
        s, k = pieces[first[total]]
        taken[s] = taken.get(s, 0) + k
        total -= s * k
    return taken


def _subset(sizes: list[tuple[int, int]], target: int, exact_limit: int) -> dict[int, int]:
    """As ``_exact``, with bits of ``exact_limit`` totals as long as that is proven to be enough."""
    unit = math.gcd(*[s for s, m in sizes if m]) or 1
    best = min(target % unit, unit - target % unit)  # no total can be nearer
    while True:
        taken: dict[int, int] = {}
        left, rest = dict(sizes), target
        for s in sorted(left, reverse=True):  # bulk, from the largest down, while the rest is too wide
            if rest <= exact_limit:
                break
            k = min(left[s], max(0, rest - exact_limit // 2) // s)
            if k:
                taken[s], left[s], rest = k, left[s] - k, rest - k * s
        if min(rest, sum(s * m for s, m in left.items() if s <= rest)) <= exact_limit:
            scaled = [(s // unit, m) for s, m in left.items()]
            low, up = rest // unit, -(-rest // unit)
            tries = [{s * unit: k for s, k in _exact(scaled, t).items()} for t in sorted({low, up})]
            found = min(tries, key=lambda t: (abs(sum(s * k for s, k in t.items()) - rest), sum(s * k for s, k in t.items())))
            for s, k in found.items():
                taken[s] = taken.get(s, 0) + k
            if exact_limit >= target or abs(sum(s * k for s, k in taken.items()) - target) <= best:
                return taken
        exact_limit *= 4


def deal(sizes: list[tuple[int, int]], shares: list[tuple[str, int]], exact_limit: int = EXACT_LIMIT) -> list[tuple[int, str, int, int]]:
    """(size, split, first, last): which of the groups of a size, counted from 1, go to which split.

    The split with the largest share takes what the others leave.
    """
    total = sum(s * m for s, m in sizes)
    whole = sum(p for _, p in shares) or 1
    order = sorted(shares, key=lambda x: (x[1], x[0]))
    left, used, out = dict(sizes), dict.fromkeys(dict(sizes), 0), []
    for name, pct in order[:-1]:
        for s, k in _subset([(s, m) for s, m in left.items() if m], round(total * pct / whole), exact_limit).items():
            out.append((s, name, used[s] + 1, used[s] + k))
            used[s] += k
            left[s] -= k
    return out + [(s, order[-1][0], used[s] + 1, used[s] + m) for s, m in left.items() if m]


def assign(groups: DataFrame, plan: DataFrame, exact_limit: int = EXACT_LIMIT) -> DataFrame:
    """``record_id, group_id, split_name``: every group in one split, totals as near the plan as group sizes allow.

    ``groups``: record_id, group_id; ``plan``: split_name, share_pct (bounded:
    a handful of rows; missing or negative shares count as 0).  Which groups of
    a size go where is decided by a hash of the group id.
    """
    spark = groups.sparkSession
    size = groups.groupBy("group_id").agg(F.count("*").alias("size"))
    shares = [(r["split_name"], max(0, r["share_pct"] or 0)) for r in plan.filter("split_name IS NOT NULL").groupBy("split_name").agg(F.max("share_pct").alias("share_pct")).collect()]
    table = [(r["size"], r["count"]) for r in size.groupBy("size").count().collect()]  # O(sqrt(records)) rows
    ranges = deal(table, shares, exact_limit) if table and shares else []
    cut = spark.createDataFrame(ranges, "size bigint, split_name string, first bigint, last bigint")
    # position of a group among those of its size: buckets by hash are counted first, so no size is sorted in one task
    bucket = F.pmod(F.xxhash64("group_id"), F.lit(1024))
    placed = size.withColumn("b", bucket)
    before = placed.groupBy("size", "b").count().withColumn("before", F.sum("count").over(Window.partitionBy("size").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)))
    within = placed.withColumn("i", F.row_number().over(Window.partitionBy("size", "b").orderBy("group_id")))
    at = within.join(before.select("size", "b", F.coalesce("before", F.lit(0)).alias("before")), ["size", "b"]).withColumn("pos", F.col("i") + F.col("before"))
    split = at.join(cut, "size").filter("pos BETWEEN first AND last").select("group_id", "split_name")
    return groups.join(split, "group_id").select("record_id", "group_id", "split_name")
