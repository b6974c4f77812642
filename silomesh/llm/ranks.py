"""Positions of rows within groups of any size."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS = 250_000  # rows that one slice of a group holds on average


def n_slices(rows: int, per_slice: int = ROWS) -> int:
    """How many slices a group of at most ``rows`` rows is cut into, so that slices don't grow with the data."""
    return max(1, math.ceil(rows / per_slice))


def hash_slice(key: Column, parts: int) -> Column:
    """One of ``parts`` slices by a hash of the key."""
    return F.pmod(F.xxhash64(key, F.lit(parts)), F.lit(parts)).cast("int")


def positions(df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], slice_of: Column, name: str = "pos") -> DataFrame:
    """``df`` with the 0-based position of each row in its group, slice after slice and in ``order`` within a slice.

    Rows are numbered inside a slice and shifted by the sizes of the slices before it, so a group with a third of all rows
    is numbered by as many tasks as it has slices.
    """
    groups = list(groups)
    cut = df.withColumn("_part", slice_of)
    sizes = cut.groupBy(*groups, "_part").agg(F.count("*").alias("_n"))
    shift = sizes.withColumn("_shift", F.sum("_n").over(Window.partitionBy(*groups).orderBy("_part")) - F.col("_n")).drop("_n")
    own = cut.withColumn("_own", F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(*order)) - 1)
    return own.join(shift, [*groups, "_part"]).withColumn(name, F.col("_shift") + F.col("_own")).drop("_part", "_shift", "_own")
