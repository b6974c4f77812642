"""All similar pairs between set-valued records by pigeonhole partitioning.

For a Jaccard similarity of at least t, two sets r and s with |r| <= |s| <= |r| / t differ in at most
H(r) = floor(|r| (1 - t) / t) elements.  Lengths fall into classes; the class of the smaller set fixes a number m of
segments into which a hash splits the token universe.  If r spends a budget of H(r) + 1 units over its segments (one unit
for asking for an equal segment, two for asking for a segment at most one deletion away), then at least one question is
answered by every similar s, because a segment with u units would otherwise hold u differences.  r asks where answers are
rare: the expected number of answers of a segment follows from the frequencies of its tokens.  Candidates are then
verified exactly, over chunks of their sets when these are long.

Tokens are 64-bit hashes of names; ``hashed_names`` makes them with a seed under which no two names share a hash, so
comparing hashes is comparing names.  Equal sets are found by a print, compared whole and joined once, through their least
record.  Records and tokens that are null are left out, repeated tokens count once, a record without tokens has no pairs and
an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silomesh.operators.skew import heavy_hashes, split_heavy
from silomesh.runtime import Workspace

CHUNK = 1024  # tokens of a set that one row holds
MOST = 1_000_000  # frequent tokens that every task gets at most
SLACK = 1.25  # segments, against the least that the budget needs


def length_classes(t: float, longest: int) -> list[int]:
    """Least lengths of the classes: a set and the smaller ones similar to it are in the same class or the one below."""
    bounds = [1]
    while bounds[-1] <= longest:
        bounds.append(math.floor(bounds[-1] / t + 1e-9) + 1)
    return bounds


def _units(length: int, t: float) -> int:
    return math.floor(length * (1 - t) / t + 1e-9) + 1


@dataclass
class Schemes:
    """What fixes the segments of each length class: chunks of a set and segments of a chunk."""

    t: float
    bounds: list[int]
    rare: float
    tokens: np.ndarray  # sorted hashes of the frequent tokens
    shares: np.ndarray  # and the share of records that hold them

    def __post_init__(self) -> None:
        last = [b - 1 for b in self.bounds[1:]]
        self.chunks = np.array([max(1, math.ceil(n / CHUNK)) for n in last])
        self.segments = np.array([max(1, math.ceil(_units(n, self.t) / 2 * SLACK / c)) for n, c in zip(last, self.chunks)])

    def share(self, tok: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.full(len(tok), self.rare)
        at = np.minimum(np.searchsorted(self.tokens, tok), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tok, self.shares[at], self.rare)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _signature(kind: int, scheme: np.ndarray, seg: np.ndarray, x: np.ndarray) -> np.ndarray:
    place = (scheme.astype(np.uint64) << np.uint64(48)) ^ (seg.astype(np.uint64) << np.uint64(2)) ^ np.uint64(kind)
    return _mix(x ^ _mix(place + np.uint64(0x9E3779B97F4A7C15))).view(np.int64)


EQUAL, LESS_ONE = 1, 2


def _signatures(b: pd.DataFrame, schemes: Schemes, asking: bool) -> pd.DataFrame:
    """Questions or answers of some chunks of sets, all of them at once."""
    bounds = np.array(schemes.bounds)
    length, of, chunk = (b[c].to_numpy() for c in ("len", "of", "chunk"))
    k = np.searchsorted(bounds, length, side="right") - 1
    below = (k > 0) & (np.ceil(length * schemes.t - 1e-9) < bounds[k])
    sigs, recs, lens = [], [], []
    for shift in (0,) if asking else (0, 1):
        scheme = np.maximum(k - shift, 0)
        use = np.flatnonzero((schemes.chunks[scheme] == of) & (below | (shift == 0)))
        if not len(use):
            continue
        scheme, m = scheme[use], schemes.segments[scheme[use]]
        sets = [b["hs"].iloc[i] for i in use]
        row = np.repeat(np.arange(len(use)), [len(s) for s in sets])
        signed = np.concatenate(sets).astype(np.int64)
        tok = signed.view(np.uint64)
        first = np.concatenate([[0], np.cumsum(m)])
        g = first[row] + (_mix(tok) >> np.uint64(8)).astype(np.int64) % m[row]
        g_row = np.repeat(np.arange(len(use)), m)
        g_seg = chunk[use][g_row] * m[g_row] + np.arange(len(g_row)) - first[g_row]
        x = np.zeros(len(g_row), dtype=np.uint64)
        np.bitwise_xor.at(x, g, tok)
        sign = lambda kind, at, value: _signature(kind, scheme[g_row[at]], g_seg[at], value)
        every = np.arange(len(g_row))
        if asking:
            share = schemes.share(signed)
            lf = np.bincount(g, np.log2(share), len(g_row))
            inv = np.maximum(np.bincount(g, 1 / share, len(g_row)), 1)
            level = np.concatenate([lf, np.minimum(0, lf + np.log2(inv))])  # how likely an answer is, for the first and the second unit
            unit_row = np.concatenate([g_row, g_row])
            order = np.lexsort((level, unit_row))
            start = np.searchsorted(unit_row[order], np.arange(len(use)))
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order)) - start[unit_row[order]]
            need = np.ceil((np.floor(length[use] * (1 - schemes.t) / schemes.t + 1e-9) + 1) / of[use])
            taken = rank < need[unit_row]
            one, two = np.flatnonzero(taken[: len(g_row)] | taken[len(g_row) :]), np.flatnonzero(taken[len(g_row) :])
            less = np.flatnonzero(taken[len(g_row) :][g])
            parts = [(sign(EQUAL, one, x[one]), g_row[one]), (sign(LESS_ONE, two, x[two]), g_row[two]), (sign(EQUAL, g[less], x[g[less]] ^ tok[less]), row[less])]
        else:
            parts = [(sign(EQUAL, every, x), g_row), (sign(LESS_ONE, g, x[g] ^ tok), row)]
        for s, r in parts:
            sigs.append(s)
            recs.append(b["rec"].to_numpy()[use][r])
            lens.append(length[use][r])
    if not sigs:
        return pd.DataFrame({"sig": np.zeros(0, "int64"), "rec": np.zeros(0, "int64"), "len": np.zeros(0, "int64")})
    return pd.DataFrame({"sig": np.concatenate(sigs), "rec": np.concatenate(recs), "len": np.concatenate(lens)})


def _pack(rows: DataFrame, t: float) -> DataFrame:
    """(rec, len, of, chunk, hs): each set in chunks of about ``CHUNK`` tokens, cut as its classes cut it."""
    sets = rows.distinct()
    size = sets.groupBy("rec").agg(F.count("*").alias("len"))
    of = lambda l: F.ceil(l / CHUNK).cast("int")  # noqa: E731,E741
    bounds = length_classes(t, 1 << 40)
    last = lambda k_shift: F.element_at(F.array(*(F.lit(b - 1) for b in bounds)), F.greatest(F.col("k") - k_shift, F.lit(0)) + 2)
    size = size.withColumn("k", F.size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: b <= F.col("len"))) - 1)
    size = size.withColumn("ofs", F.array_distinct(F.array(of(last(0)), of(last(1))))).drop("k")
    cut = sets.join(size, "rec").select("rec", "len", "h", F.explode("ofs").alias("of"))
    return cut.withColumn("chunk", F.pmod("h", F.col("of")).cast("int")).groupBy("rec", "len", "of", "chunk").agg(F.collect_list("h").alias("hs"))


def hashed_names(names: DataFrame) -> DataFrame:
    """(rec, h) of (rec, name): tokens for ``similar_sets``, by the first seed that gives all names different hashes."""
    held = Workspace(names.sparkSession, "names").write(names.filter("rec is not null and name is not null").select("rec", "name"))
    for seed in range(8):
        h = F.xxhash64(F.lit(seed), "name")
        if held.select(h.alias("h"), "name").groupBy("h").agg((F.min("name") != F.max("name")).alias("shared")).filter("shared").isEmpty():
            return held.select("rec", h.alias("h"))
    raise RuntimeError("names share hashes under every seed")


def _equal_sets(packed: DataFrame, alike: DataFrame) -> DataFrame:
    """The rows (rec, rep, len) of ``alike`` whose sets are equal, chunk by chunk."""
    one = packed.select("rec", "of", "chunk", F.array_sort("hs").alias("own"))
    other = packed.select(F.col("rec").alias("rep"), "of", "chunk", F.array_sort("hs").alias("theirs"))
    met = alike.join(one, "rec").join(other, ["rep", "of", "chunk"])
    by = met.groupBy("rec", "rep", "len").agg(F.bool_and(F.col("own") == F.col("theirs")).alias("same"), F.sum(F.size("own")).alias("held"), F.count_distinct("of").alias("cuts"))
    return by.filter(F.col("same") & (F.col("held") == F.col("len") * F.col("cuts"))).select("rec", "rep")


def similar_sets(tokens: DataFrame, t: float = 0.7, rare_share: float = 0.002, heavy_share: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of representatives with |intersection| / |union| >= ``t``, and the membership (rec, rep) of all records.

    ``tokens`` has (rec bigint, h bigint).  Frequencies are kept only for tokens in at least ``rare_share`` of the records:
    as all sets together hold N x mean length tokens, these are at most mean length / ``rare_share``; where that is more than
    ``MOST``, a larger share keeps to it, so what is sent to every task is bounded.  Which questions a set asks depends on the
    frequencies, what is found doesn't.  Records with more than ``heavy_share`` of all rows are put together with pre-aggregation; all others
    are partitioned once, by record.
    """
    spark = tokens.sparkSession
    work = Workspace(spark, "similar-sets")
    raw = work.write(tokens.filter("rec is not null and h is not null").select("rec", "h"))
    light, hot = split_heavy(raw, F.xxhash64("rec"), heavy_hashes(raw, F.xxhash64("rec"), heavy_share))
    packed = _pack(light.repartition("rec"), t)
    packed = work.write(packed if hot is None else packed.unionByName(_pack(hot, t)))
    work.drop(raw)
    xor = lambda hs: F.aggregate(hs, F.lit(0).cast("bigint"), lambda a, h: a.bitwiseXOR(h))
    prints = packed.groupBy("rec", "len", "of").agg(F.bit_xor(xor(F.col("hs"))).alias("x"), F.bit_xor(xor(F.transform("hs", lambda h: F.xxhash64(h)))).alias("y"))
    sets = work.write(prints.groupBy("rec", "len").agg(F.first("x").alias("x"), F.first("y").alias("y")))
    n, longest, mean = sets.agg(F.count("*"), F.coalesce(F.max("len"), F.lit(1)), F.coalesce(F.avg("len"), F.lit(1.0))).first()
    rare_share = max(rare_share, mean / MOST)
    bounds = length_classes(t, longest)
    classes = sets.groupBy("len", "x", "y").agg(F.min("rec").alias("rep"), F.count("*").alias("n"))
    same_print = sets.join(classes.filter("n > 1"), ["len", "x", "y"]).filter("rec <> rep").select("rec", "rep", "len")
    alike = work.write(_equal_sets(packed, same_print))
    members = sets.select("rec").join(alike, "rec", "left").select("rec", F.coalesce("rep", "rec").alias("rep"))
    reps = packed.join(alike, "rec", "left_anti")
    often = packed.select(F.explode("hs").alias("h")).groupBy("h").agg(F.count("*").alias("df")).filter(F.col("df") >= max(2, rare_share * n)).orderBy("h").toPandas()
    schemes = spark.sparkContext.broadcast(Schemes(t, bounds, max(rare_share, 2 / max(n, 1)), often["h"].to_numpy("int64"), np.minimum(often["df"].to_numpy("float64") / max(n, 1), 1.0)))

    def signatures(asking: bool, rec: str, length: str) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for at in range(0, len(b), 2048):
                    yield _signatures(b.iloc[at : at + 2048], schemes.value, asking).rename(columns={"rec": rec, "len": length})

        return reps.mapInPandas(run, f"sig long, {rec} long, {length} long")

    fits = (F.col("ls") >= F.col("lr")) & (F.col("lr") >= F.col("ls") * t - 1e-9) & ((F.col("ls") > F.col("lr")) | (F.col("s") > F.col("r")))
    found = signatures(True, "r", "lr").join(signatures(False, "s", "ls"), "sig").filter(fits).select("r", "s", "lr", "ls").distinct()
    found = work.write(found)
    side = lambda c, name: packed.select(F.col("rec").alias(c), "of", "chunk", F.col("hs").alias(name))
    k_of = F.size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: b <= F.col("lr")))
    cut = found.withColumn("of", F.ceil((F.element_at(F.array(*(F.lit(b) for b in bounds)), k_of + 1) - 1) / CHUNK).cast("int"))
    met = cut.join(side("r", "hr"), ["r", "of"]).join(side("s", "hs"), ["s", "of", "chunk"])
    same = met.select("r", "s", "lr", "ls", F.size(F.array_intersect("hr", "hs")).alias("n")).groupBy("r", "s", "lr", "ls").agg(F.sum("n").alias("n"))
    pairs = same.filter(F.col("n") / (F.col("lr") + F.col("ls") - F.col("n")) >= t)
    return pairs.select(F.least("r", "s").alias("a"), F.greatest("r", "s").alias("b")), members


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """All record pairs (x, y), x < y, behind pairs of representatives and between copies of one set."""
    one, other = members.select(F.col("rep").alias("a"), F.col("rec").alias("x")), members.select(F.col("rep").alias("b"), F.col("rec").alias("y"))
    across = pairs.join(one, "a").join(other, "b").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    copies = one.join(other.withColumnRenamed("b", "a"), "a").filter("x < y").select("x", "y")
    return across.unionByName(copies)
