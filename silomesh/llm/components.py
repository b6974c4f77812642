"""Consolidating pairwise matches into groups by hash-to-min.

Every vertex holds a cluster set, at first its neighbours.  In a round each vertex sends its whole set to the least member
it knows and that least member to all others, until every set is a star around its least vertex.  Sets are rows
(v, u), never arrays, so the set of a group with a third of all vertices is spread over many tasks; the only join meets
one row for each vertex and can be split by adaptive execution.  The number of rounds grows with the logarithm of a
group's diameter.

Null ends, an end linked to itself and repeated links change nothing; an empty table gives no groups; columns other than
the two ends are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from silomesh.runtime import Workspace


def links(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Both directions (v, u) of every link between two different vertices."""
    ends = F.inline(F.array(F.struct(F.col(a).alias("v"), F.col(b).alias("u")), F.struct(F.col(b).alias("v"), F.col(a).alias("u"))))
    return pairs.filter(f"`{a}` <> `{b}`").select(ends).distinct()


def _least(sets: DataFrame) -> DataFrame:
    return sets.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("m"))


def hash_to_min(pairs: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """One row (node, root) for every vertex that has a link; ``root`` is the least vertex it reaches, itself included.

    Each round is written to the shared folder.  The loop ends when no row (v, u) is left in which neither end is the
    least vertex known to v: as rows come in both directions, all sets are stars then and another round changes nothing.
    """
    work = Workspace(pairs.sparkSession, "hash-to-min")
    sets = work.write(links(pairs, a, b))
    if sets.isEmpty():
        return sets.select(F.col("v").alias("node"), F.col("u").alias("root"))
    for _ in range(max_rounds):
        seen = Observation()
        met = sets.join(_least(sets), "v").observe(seen, F.count_if((F.col("u") != F.col("m")) & (F.col("v") != F.col("m"))).alias("open"))
        to = lambda x, y: F.struct(F.col(x).alias("v"), F.col(y).alias("u"))
        sent = met.select(F.inline(F.array(to("m", "u"), to("u", "m"), to("m", "v"), to("v", "m"))))
        new = work.write(sent.filter("v <> u").distinct())
        work.drop(sets)
        sets = new
        if not seen.get["open"]:
            return _least(sets).select(F.col("v").alias("node"), F.col("m").alias("root"))
    raise RuntimeError(f"groups were not stable after {max_rounds} rounds")


def match_groups(pairs: DataFrame, a: str, b: str, score: str, least_score: float) -> DataFrame:
    """Groups over the links with a score of at least ``least_score``; null and NaN scores don't link."""
    s = F.col(score)
    return hash_to_min(pairs.filter(~F.isnan(s) & (s >= least_score)).select(a, b), a, b)
