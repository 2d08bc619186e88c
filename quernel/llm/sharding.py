"""Shards of near equal bytes: minimax contiguous partition of ordered atomic group sizes.

Equal texts form a group that stays whole. Groups are ordered by a hash of the text. The smallest feasible capacity
is found by binary search, each candidate checked by greedy filling, and the groups are cut there.

The groups themselves don't reach the driver, but the sizes of ranges of their order: first `atoms` equal ranges of
the hash. With cuts between ranges only, the search gives a capacity that is feasible; with cuts anywhere within
ranges of several groups, one that no partition can go below. While the two differ, the ranges between them in which
a cut may lie, a bounded number, are divided again by the next bits of the hash. At the end the capacity is the exact
one over the groups.

Defined cases: a null text has size 1 and crc 0 and forms one group with other null texts; equal rows get
different slots; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.session import written

#: Rows of one shard that one window partition numbers, about.
SLOT_ROWS = 20_000


def greedy_cuts(prefix: np.ndarray, capacity: int, shards: int, open_: np.ndarray | None = None) -> list[int] | None:
    """Where each next shard begins if every shard takes all parts that fit; None if that needs more shards.

    prefix: total size up to and with each part. open_: which parts may be cut anywhere (the part cut is given)."""
    cuts, at, before, n = [], 0, 0, len(prefix)
    for _ in range(shards):
        at = int(np.searchsorted(prefix, before + capacity, side="right"))
        if at == n:
            return cuts
        full = int(prefix[at - 1]) if at else 0
        before = before + capacity if open_ is not None and open_[at] else full
        cuts.append(at)
    return None


def least_capacity(sizes: np.ndarray, shards: int, open_: np.ndarray | None = None) -> int:
    """The smallest capacity with which `shards` contiguous runs hold all parts; parts that are open may be cut anywhere."""
    prefix = np.cumsum(sizes)
    if not len(sizes) or not prefix[-1]:
        return 0
    whole = sizes if open_ is None else sizes[~open_]
    low, high = max(int(whole.max(initial=0)), -(-int(prefix[-1]) // shards)), int(prefix[-1])
    while low < high:
        mid = (low + high) // 2
        if greedy_cuts(prefix, mid, shards, open_) is None:
            low = mid + 1
        else:
            high = mid
    return low


def minimax_cuts(sizes: np.ndarray, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity, and where runs begin: as near to equal sizes as runs within that capacity can be."""
    capacity = least_capacity(sizes, shards)
    if not capacity:
        return 0, []
    n, prefix = len(sizes), np.concatenate([[0], np.cumsum(sizes)])
    last = [n]  # of each start, how late the later runs' capacity lets it be early: from the end backward
    for _ in range(shards - 1):
        last.append(int(np.searchsorted(prefix, prefix[last[-1]] - capacity, side="left")))
    cuts, at = [], 0
    for i in range(1, shards):
        goal = prefix[-1] * i / shards
        j = int(np.searchsorted(prefix, goal))
        if j and goal - prefix[j - 1] < prefix[j] - goal:
            j -= 1
        furthest = int(np.searchsorted(prefix, prefix[at] + capacity, side="right")) - 1
        at = min(max(j, last[shards - i], at), furthest)
        cuts.append(at)
    return capacity, [c for c in cuts if c < n]


def _undecided(sizes: np.ndarray, open_: np.ndarray, shards: int) -> np.ndarray:
    """Numbers of the open parts in which a cut may lie for some capacity that is still possible."""
    low, high = least_capacity(sizes, shards, open_), least_capacity(sizes, shards)
    if low == high:
        return np.zeros(0, np.int64)
    prefix = np.cumsum(sizes)
    # the i-th shard ends no earlier than closed filling at `low` takes it, and no later than i times `high`
    inside, before = np.zeros(len(sizes), bool), 0
    for i in range(1, shards):
        first = int(np.searchsorted(prefix, before + low, side="right"))
        last = int(np.searchsorted(prefix, i * high, side="right"))
        inside[first : last + 1] = True
        before = int(prefix[first - 1]) if first else 0
    return np.flatnonzero(inside & open_)


def shard_of(place: Column, starts: list[int]) -> Column:
    """How many shards' starts lie at or before the place."""
    out = F.lit(0)
    for c in starts:
        out = out + (place >= F.lit(c)).cast("int")
    return out


def _ranges(rows: DataFrame, bits: int, within: DataFrame | None = None, split: int = 0) -> list[tuple[int, int, int, int]]:
    """(first place, size, least and greatest place held) of equal ranges of the order, or of `split` bits more within some."""
    if within is not None:
        rows = rows.join(F.broadcast(within), F.shiftright("_place", 62 - bits) == F.col("_range"), "left_semi")
    part = F.shiftright("_place", 62 - bits - split)
    got = rows.groupBy(part.alias("p")).agg(F.sum("size"), F.min("_place"), F.max("_place")).collect()
    return [(r[0] << (62 - bits - split), *r[1:]) for r in got]


def shard_starts(rows: DataFrame, shards: int, atoms: int, split: int = 8) -> list[int]:
    """The places (0 to 2^62) at which shards after the first begin. rows: size and _place, equal for rows of a group."""
    bits = atoms.bit_length() - 1
    parts = [(*r, bits) for r in _ranges(rows, bits)]  # at most `atoms` rows
    while True:
        parts.sort()
        sizes, open_ = np.array([p[1] for p in parts], np.int64), np.array([p[2] < p[3] for p in parts], bool)
        again = _undecided(sizes, open_, shards) if parts else []
        if not len(again):
            _, cuts = minimax_cuts(sizes, shards)
            return [parts[c][0] for c in cuts]
        coarse = min(parts[i][4] for i in again)
        again = [i for i in again if parts[i][4] == coarse]
        within = rows.sparkSession.createDataFrame([(parts[i][0] >> (62 - coarse),) for i in again], "_range long")
        more = min(split, 62 - coarse)
        gone = set(again)
        parts = [p for i, p in enumerate(parts) if i not in gone] + [(*r, coarse + more) for r in _ranges(rows, coarse, within, more)]


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", *, shards: int = 16, atoms: int = 1 << 16) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) for each row."""
    if atoms & (atoms - 1):
        raise ValueError("atoms must be a power of two")
    t = F.col(text).cast("string")
    body = F.coalesce(t, F.lit(""))
    rows = written(docs.select(F.col(key).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(t), 2).alias("_place"), F.monotonically_increasing_id().alias("_row")), "shards")
    starts = shard_starts(rows, shards, atoms)
    return with_slots(rows.withColumn("shard", shard_of(F.col("_place"), starts)).drop("_place"), rows.count())


def with_slots(rows: DataFrame, n: int, order: tuple[str, ...] = ("doc_id", "size", "text_crc32"), row: str = "_row") -> DataFrame:
    """Number the rows of each shard from 0 without gaps: by hashed cells whose starts come from their counts.

    `row` numbers the rows of the written table, so that equal rows, however many, are spread over the cells as well."""
    cells = max(64, 1 << (n // SLOT_ROWS).bit_length())
    rows = rows.withColumn("_c", F.pmod(F.xxhash64(*order, row), F.lit(cells)))
    counts = rows.groupBy("shard", "_c").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    within = Window.partitionBy("shard", "_c").orderBy(*order, row)
    return rows.join(starts.hint("shuffle_hash"), ["shard", "_c"]).select(*order, "shard", (F.col("_s") + F.row_number().over(within) - 1).alias("slot"))
