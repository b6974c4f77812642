"""Finding the keys that hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def heavy_hashes(df: DataFrame, key: Column, share: float = 0.02) -> list[int]:
    """``xxhash64`` values (``key`` is a hash) of the keys that hold at least ``share`` of the rows.

    Two passes, the second counting at most ``1 / share`` candidates of the first; no key is shuffled.  Ties and nulls hash
    like any other key and an empty table gives an empty list.
    """
    h = df.select(key.alias("_h"))
    found = h.stat.freqItems(["_h"], share).first()
    maybe = [x for x in (found[0] or []) if x is not None] if found else []
    if not maybe:
        return []
    counts = h.select(F.when(F.col("_h").isin(maybe), F.col("_h")).alias("_h")).groupBy("_h").count().collect()
    total = sum(r["count"] for r in counts)
    return [r["_h"] for r in counts if r["_h"] is not None and r["count"] >= share * total]


def split_heavy(df: DataFrame, key_hash: Column, heavy: list[int]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of light keys, and rows of heavy keys (None when there is no heavy key)."""
    if not heavy:
        return df, None
    return df.filter(~key_hash.isin(heavy)), df.filter(key_hash.isin(heavy))
