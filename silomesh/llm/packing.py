"""Filling fixed-capacity containers with items: variable-capacity best-fit decreasing on the histogram of item sizes.

Items of one size are interchangeable, so the packing is decided on how many items there are of each size: at most as many
numbers as the largest capacity, however many items there are.  Sizes are placed from the largest down.  A size goes to the
open bins with the least room that still fits it; when none does, bins of the capacity with the least cost per placed
token are opened.  At the end each bin shrinks to the smallest permitted capacity that holds its contents.  Bins with equal
contents are one pattern with a multiplicity.

An item above the largest capacity is cut into full bins and a rest; no other item is cut.  Items of size 0 or null are
left out, repeated ids are items of their own as long as they are different rows, an empty table gives no bins.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silomesh.llm.ranks import hash_slice, n_slices, positions
from silomesh.runtime import Workspace


@dataclass
class Pattern:
    """``bins`` bins with the same contents: (size, items of that size in each bin)."""

    room: int
    bins: int
    contents: list[tuple[int, int]] = field(default_factory=list)


def _open_size(size: int, count: int, capacities: Sequence[int]) -> int:
    """The capacity with the least cost per token if filled with items of this size alone; ties to the larger."""

    def cost(c: int) -> float:
        return c / (min(c // size, count) * size)

    return min((c for c in capacities if c >= size), key=lambda c: (cost(c), -c))


def pack_sizes(histogram: dict[int, int], capacities: Sequence[int]) -> list[Pattern]:
    """Patterns of best-fit decreasing over several permitted capacities."""
    caps = sorted(capacities)
    by_room: dict[int, list[Pattern]] = {}
    rooms: list[int] = []

    def put(p: Pattern) -> None:
        if p.room not in by_room:
            by_room[p.room] = []
            bisect.insort(rooms, p.room)
        by_room[p.room].append(p)

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left > 0:
            at = bisect.bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                p = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[at]
            else:
                cap = _open_size(size, left, caps)
                room, p = cap, Pattern(cap, max(1, left // (cap // size)))
            each = room // size
            full = min(p.bins, left // each)
            if full:
                put(Pattern(room - each * size, full, [*p.contents, (size, each)]))
            left -= full * each
            rest = p.bins - full
            if rest and left:
                some = min(left, each)
                put(Pattern(room - some * size, 1, [*p.contents, (size, some)]))
                left -= some
                rest -= 1
            if rest and p.contents:
                put(Pattern(room, rest, p.contents))
    return [p for r in rooms for p in by_room[r]]


def shrink(total: int, capacities: Sequence[int]) -> int:
    """The smallest permitted capacity that holds ``total``."""
    return min(c for c in capacities if c >= total)


def _slots(patterns: Sequence[Pattern], capacities: Sequence[int]) -> dict[int, np.ndarray]:
    """For each size the rows (first position, items in a bin, first bin, capacity) of the patterns that hold it."""
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    at: dict[int, int] = {}
    first = 0
    for p in patterns:
        cap = shrink(sum(s * n for s, n in p.contents), capacities)
        for size, each in p.contents:
            slots.setdefault(size, []).append((at.get(size, 0), each, first, cap))
            at[size] = at.get(size, 0) + each * p.bins
        first += p.bins
    return {s: np.array(rows, dtype=np.int64) for s, rows in slots.items()}


def pieces(items: DataFrame, item: str, size: str, largest: int) -> DataFrame:
    """(item, piece, start, size): items above ``largest`` are cut into full pieces and a rest, all others are one piece."""
    n = F.col(size)
    cut = items.filter(n > 0).select(item, n.cast("bigint").alias("whole"), F.explode(F.sequence(F.lit(0), (F.ceil(n / largest) - 1).cast("int"))).alias("piece"))
    start = F.col("piece").cast("bigint") * largest
    return cut.select(item, "piece", start.alias("start"), F.least(F.col("whole") - start, F.lit(largest)).cast("int").alias("size"))


def pack(items: DataFrame, item: str, size: str, capacities: Sequence[int]) -> DataFrame:
    """(item, piece, start, size, bin, capacity): every piece in its bin."""
    caps = sorted(set(int(c) for c in capacities))
    if not caps or caps[0] <= 0:
        raise ValueError("capacities must be positive")
    work = Workspace(items.sparkSession, "packing")
    cut = work.write(pieces(items, item, size, caps[-1]))
    histogram = {r["size"]: r["n"] for r in cut.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most caps[-1] rows
    slots = _slots(pack_sizes(histogram, caps), caps)
    parts = n_slices(max(histogram.values(), default=0))
    ranked = positions(cut, ["size"], [F.xxhash64(item, "piece"), item, "piece"], hash_slice(F.xxhash64(item, "piece"), parts))
    shared = items.sparkSession.sparkContext.broadcast(slots)  # bounded by the patterns, whatever the number of items

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bins, caps_of = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
            sizes, pos = b["size"].to_numpy(), b["pos"].to_numpy()
            for s in np.unique(sizes):
                own, t = np.flatnonzero(sizes == s), shared.value[int(s)]
                row = np.searchsorted(t[:, 0], pos[own], side="right") - 1
                bins[own] = t[row, 2] + (pos[own] - t[row, 0]) // t[row, 1]
                caps_of[own] = t[row, 3]
            yield b.drop(columns="pos").assign(bin=bins, capacity=caps_of)

    kind = dict(cut.dtypes)[item]
    return ranked.select(item, "piece", "start", "size", "pos").mapInPandas(place, f"{item} {kind}, piece int, start bigint, size int, bin bigint, capacity bigint")


def bin_report(packed: DataFrame) -> DataFrame:
    """Bins, items, tokens and fill of each capacity."""
    bins = packed.groupBy("bin", "capacity").agg(F.count("*").alias("n"), F.sum("size").alias("tokens"))
    return bins.groupBy("capacity").agg(F.count("*").alias("n_bins"), F.sum("n").alias("n_pieces"), F.sum("tokens").alias("n_tokens"), (F.sum("tokens") / F.sum("capacity")).alias("fill"))
