"""Most similar vectors for every vector: a forest of random-projection trees with one priority queue for all trees.

A tree splits at each level along the difference of two sampled vectors, at the median of the sample in that node, as deep
as the number of vectors asks for and the sample has vectors to take medians from.  Every vector is stored in one leaf of
each tree.  A search descends all trees at once: the branches not taken wait in one queue, ordered by how close the vector
lies to the split, and the nearest ones are opened next, in whichever tree they are.  Where there are more vectors than the
sample can divide, a leaf goes on splitting at the medians of its own vectors, and searches that lie near a split go both
ways.  The candidates of all opened leaves are ranked by their exact cosine in double precision.

Only (leaf, vector id) rows pass through the queue; vectors join them once, as bytes, when a leaf is worked on.

The forest is fitted on at most ``sample`` vectors; all vectors are indexed and searched.  Equal vectors are one class: it
is searched once, counts with its number of members and is expanded at the end.  Null, short, long, all-zero, NaN and
infinite vectors don't count, repeated rows count once, an empty table has no neighbours, other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silomesh.runtime import Workspace

ASKING = 8192  # searches of a leaf that one task ranks, or as many as the leaf stores if that is more
NEAR = 0.25  # share of the searches of a split nearest to it that go both ways


@dataclass
class Forest:
    directions: np.ndarray  # trees x levels x dims
    thresholds: list[np.ndarray]  # by level: trees x 2^level

    @property
    def shape(self) -> tuple[int, int]:
        return self.directions.shape[0], self.directions.shape[1]


def fit_forest(sample: np.ndarray, n_vectors: int, trees: int, leaf: int, seed: int = 11) -> Forest:
    """Directions and medians from unit vectors.  A node with fewer than four samples splits at its level's median."""
    wanted, held = np.log2(max(n_vectors, 1) / leaf), np.log2(max(len(sample), 4) / 4)
    levels = int(max(0, min(np.ceil(wanted), np.floor(held))))
    rng, dims = np.random.default_rng(seed), sample.shape[1]
    a, b = rng.integers(0, len(sample), (trees, levels)), rng.integers(0, len(sample), (trees, levels))
    directions = sample[a] - sample[b] if levels else np.zeros((trees, 0, dims))
    norm = np.linalg.norm(directions, axis=2, keepdims=True)
    directions = np.where(norm > 1e-6, directions / np.maximum(norm, 1e-6), rng.normal(size=directions.shape) / np.sqrt(dims))
    thresholds = [np.zeros((trees, 1 << lv)) for lv in range(levels)]
    for t in range(trees):
        proj, node = sample @ directions[t].T, np.zeros(len(sample), dtype=np.int64)
        for lv in range(levels):
            med = pd.Series(proj[:, lv]).groupby(node).agg(["median", "size"])
            th = np.full(1 << lv, np.median(proj[:, lv]))
            med = med[med["size"] >= 4]
            th[med.index.to_numpy()] = med["median"].to_numpy()
            thresholds[lv][t] = th
            node = node * 2 + (proj[:, lv] > th[node])
    return Forest(directions, thresholds)


def search_leaves(forest: Forest, x: np.ndarray, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaves (tree * 2^levels + leaf) that each row of ``x`` opens: first its own in every tree, then the ``extra`` next
    of the shared queue.  Second result: a mask of the own leaves.  -1 = the queue was empty."""
    trees, levels = forest.shape
    n, width = len(x), 1 << levels
    proj = np.einsum("nd,tld->ntl", x, forest.directions, optimize=True) if levels else np.zeros((n, trees, 0))
    rows = np.arange(n)
    entries = (trees + extra) * levels
    cost = np.full((n, entries), np.inf)  # the queue: of each entry the cost and the branch that wasn't taken,
    branch = np.zeros((n, entries), dtype=np.int64)  # as tree << 40 | level << 32 | node
    used, leaves = 0, []

    def descend(tree: np.ndarray, level: np.ndarray, node: np.ndarray, base: np.ndarray) -> np.ndarray:
        nonlocal used
        for lv in range(levels):
            on = level <= lv
            side = proj[rows, tree, lv] - forest.thresholds[lv][tree, np.where(on, node, 0)]
            go = side > 0
            cost[:, used] = np.where(on, np.maximum(base, np.abs(side)), np.inf)
            branch[:, used] = (tree << 40) | ((lv + 1) << 32) | np.where(on, node * 2 + ~go, 0)
            used += 1
            node = np.where(on, node * 2 + go, node)
        return tree * width + node

    zero = np.zeros(n, dtype=np.int64)
    for t in range(trees):
        leaves.append(descend(zero + t, zero, zero, np.zeros(n)))
    for _ in range(extra if levels else 0):
        best = cost[:, :used].argmin(1)
        least, code = cost[rows, best], branch[rows, best]
        cost[rows, best] = np.inf
        opened = descend(code >> 40, (code >> 32) & 0xFF, code & 0xFFFFFFFF, np.where(np.isfinite(least), least, np.inf))
        leaves.append(np.where(np.isfinite(least), opened, -1))
    own = np.zeros((n, len(leaves)), dtype=bool)
    own[:, :trees] = True
    return np.stack(leaves, 1), own


def split_leaf(stored: np.ndarray, asking: np.ndarray, leaf: int, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (stored, asking) of the parts that a leaf splits into, each with at most ``leaf`` stored vectors.

    Vectors split at the median along the difference of two of them; the asking ones nearest to a split go both ways.
    """
    todo = [(np.arange(len(stored)), np.arange(len(asking)))]
    while todo:
        m, q = todo.pop()
        if len(m) <= leaf:
            if len(m) and len(q):
                yield m, q
            continue
        a, b = rng.choice(len(m), 2, replace=False)
        way = stored[m[a]] - stored[m[b]]
        if not way.any():
            way = rng.normal(size=stored.shape[1])
        along = stored[m] @ way
        order = np.argsort(along, kind="stable")
        half = len(m) // 2
        cut = (along[order[half - 1]] + along[order[half]]) / 2
        side = asking[q] @ way - cut
        near = np.abs(side) <= np.quantile(np.abs(side), NEAR) if len(q) else np.zeros(0, dtype=bool)
        todo.append((m[order[:half]], q[(side <= 0) | near]))
        todo.append((m[order[half:]], q[(side > 0) | near]))


def vector_classes(df: DataFrame, rec: str, vector: str, dims: int) -> DataFrame:
    """(rec, v) of usable vectors, once each."""
    v = F.col(vector).cast("array<double>")
    sound = F.coalesce(~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(v, lambda e: e != 0), F.lit(False))
    return df.filter(F.col(rec).isNotNull() & (F.size(vector) == dims)).filter(sound).select(F.col(rec).cast("bigint").alias("rec"), F.col(vector).alias("v")).distinct()


def _unit(packed: pd.Series) -> np.ndarray:
    """Unit vectors of vectors kept as the bytes of single-precision numbers."""
    x = np.frombuffer(b"".join(packed), dtype=np.float32).reshape(len(packed), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _as_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(v=[np.asarray(v, dtype=np.float32).tobytes() for v in b["v"]])


#: What a row of a leaf does there.
STORED, BOTH, ASKS = 0, 1, 2


def neighbours(df: DataFrame, rec: str, vector: str, dims: int = 64, k: int = 5, least: float = -2.0, tie: float = 1e-9, trees: int = 8, leaf: int = 256, extra: int = 8, sample: int = 20_000, asking: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Neighbours (q, s, cosine) of every class of equal vectors among the other classes, and the membership (rec, rep, n).

    A class s is a neighbour of q when one of its members is among the k most similar records of a member of q, with all
    that are within ``tie`` of the k-th, and the cosine is at least ``least``.  Copies of q itself fill ranks first.

    ``asking`` is a condition on ``rec``: only classes with a record that meets it are searched for, in all of the others.
    """
    work = Workspace(df.sparkSession, "forest")
    prints = [f(F.col("v")).alias(n) for f, n in ((lambda v: F.xxhash64(v), "p1"), (lambda v: F.hash(v), "p2"))]
    held = work.write(vector_classes(df, rec, vector, dims).select("rec", "v", *prints))
    asks = F.lit(True) if asking is None else F.coalesce(asking, F.lit(False))
    groups = work.write(held.groupBy("p1", "p2", "v").agg(F.min("rec").alias("rep"), F.count("*").alias("n"), F.bool_or(asks).alias("asks")))
    packed = work.write(groups.select("rep", "n", "asks", "v").mapInPandas(_as_bytes, "rep long, n long, asks boolean, v binary"))
    h, g = held.alias("h"), groups.alias("g")  # sorted by their prints, compared whole
    same = (F.col("h.p1") == F.col("g.p1")) & (F.col("h.p2") == F.col("g.p2")) & (F.col("h.v") == F.col("g.v"))
    members = work.write(h.join(g, same).select("rec", "rep", "n"))
    count = packed.count()
    if not count:
        return packed.select(F.col("rep").alias("q"), F.col("rep").alias("s"), F.lit(0.0).alias("cosine")), members
    drawn = packed.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("v").toPandas()  # the sample of the fit
    forest = fit_forest(_unit(drawn["v"]), count, trees, leaf)
    shared = df.sparkSession.sparkContext.broadcast(forest)  # at most trees x sample / 4 thresholds

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for asks, rows in b.groupby("asks"):
                for at in range(0, len(rows), 4096):
                    part = rows.iloc[at : at + 4096]
                    leaves, own = search_leaves(shared.value, _unit(part["v"]), extra if asks else 0)
                    row, col = np.nonzero(leaves >= 0)
                    yield pd.DataFrame({"block": leaves[row, col], "rep": part["rep"].to_numpy()[row], "own": own[row, col], "asks": asks})

    routed = work.write(packed.select("rep", "asks", "v").mapInPandas(route, "block long, rep long, own boolean, asks boolean"))
    sizes = routed.groupBy("block").agg(F.count_if("own").alias("stored"), F.count_if("asks").alias("asking")).filter("asking > 0")
    slices = sizes.select("block", F.ceil(F.col("asking") / F.greatest(F.lit(ASKING), F.col("stored"))).cast("int").alias("slices"))
    cut = routed.join(slices, "block").withColumn("mine", F.pmod(F.xxhash64("rep", "block"), F.col("slices")).cast("int"))
    every = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda i: F.struct(i.alias("slice"), F.when((i == F.col("mine")) & F.col("asks"), BOTH).otherwise(STORED).alias("role")))
    only = F.array(F.struct(F.col("mine").alias("slice"), F.lit(ASKS).alias("role")))
    placed = cut.select("block", "rep", F.inline(F.when(F.col("own"), every).otherwise(only))).join(packed.drop("asks"), "rep")

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        role, rep, n = pdf["role"].to_numpy(), pdf["rep"].to_numpy(), pdf["n"].to_numpy()
        x = _unit(pdf["v"])
        stored, asks = np.flatnonzero(role <= BOTH), np.flatnonzero(role >= BOTH)
        out = []
        for m, q in split_leaf(x[stored], x[asks], 2 * leaf, np.random.default_rng(int(pdf["block"].iloc[0]))):
            m, q = stored[m], asks[q]
            for at in range(0, len(q), 4096):
                part = q[at : at + 4096]
                sims = x[part] @ x[m].T
                sims[rep[part][:, None] == rep[m][None, :]] = -3.0
                low = np.full(len(part), least, dtype=float)
                if sims.shape[1] > k:
                    low = np.maximum(low, np.partition(sims, -k, axis=1)[:, -k] - tie)
                row, col = np.nonzero(sims >= np.maximum(low, -2.0)[:, None])
                out.append(pd.DataFrame({"q": rep[part[row]], "s": rep[m[col]], "n": n[m[col]], "cosine": sims[row, col]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"q": np.zeros(0, "int64"), "s": np.zeros(0, "int64"), "n": np.zeros(0, "int64"), "cosine": np.zeros(0)})

    met = placed.groupBy("block", "slice").applyInPandas(rank, "q long, s long, n long, cosine double")
    met = work.write(met.groupBy("q", "s", "n").agg(F.max("cosine").alias("cosine")))
    asked = met.join(packed.select(F.col("rep").alias("q"), (F.col("n") - 1).alias("copies")), "q")
    by_rank = Window.partitionBy("q").orderBy(F.desc("cosine"), "s").rowsBetween(Window.unboundedPreceding, 0)
    ranked = asked.withColumn("upto", F.col("copies") + F.sum("n").over(by_rank))
    bar = F.max(F.when(F.col("upto") >= k, F.col("cosine"))).over(Window.partitionBy("q"))
    full = F.col("copies") >= k
    kept = ranked.withColumn("bar", F.when(full, F.lit(1.0)).otherwise(F.coalesce(bar, F.lit(-2.0)))).filter((F.col("cosine") >= F.col("bar") - tie) & (F.col("cosine") >= least))
    return kept.select("q", "s", "cosine"), members
