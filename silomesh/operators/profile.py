"""Profiles of columns and silos.

A table is profiled in long form, one row (column, value) for each cell, so all columns share one aggregation.  Nulls are
cells with a null value; an empty table gives no rows; repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cells(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., column_name, ordinal, value): every cell as a string."""
    parts = F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("ordinal"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)))
    return df.select(*keys, F.inline(parts))


def column_profile(long: DataFrame, keys: Sequence[str] = ("column_name",)) -> DataFrame:
    """n_rows, n_null, n_distinct, sparsity, entropy (bits) and numeric share of each column (A1, A2, A3, M2).

    Values are counted first, so a column's distinct values are never gathered in one place.  Sparsity and entropy of an
    empty column are 0; the numeric share is over all rows, nulls included.
    """
    counts = long.groupBy(*keys, "value").agg(F.count("*").alias("n"))
    n, v = F.col("n"), F.col("value")
    held = F.when(v.isNotNull(), n)
    total = F.sum(held)
    return counts.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(v.isNull(), n)), F.lit(0)).cast("bigint").alias("n_null"), F.count("value").alias("n_distinct"),
        F.coalesce(F.sum(F.when(v.isNull(), n)) / F.sum("n"), F.lit(0.0)).alias("sparsity"), F.greatest(F.coalesce(F.log2(total) - F.sum(held * F.log2(held)) / total, F.lit(0.0)), F.lit(0.0)).alias("entropy"),
        F.coalesce(F.sum(F.when(F.expr("try_cast(value AS DOUBLE)").isNotNull(), n)) / F.sum("n"), F.lit(0.0)).alias("numeric_share"), F.max("n").alias("top_count"),
    )


def varying_columns(profile: DataFrame) -> DataFrame:
    """The profile with ``keep`` (P2): more than one value, or one value beside nulls; if no column of the table would be
    kept, all are."""
    keep = (F.col("n_distinct") > 1) | ((F.col("n_distinct") == 1) & (F.col("n_null") > 0))
    return profile.withColumn("varies", keep).withColumn("keep", F.col("varies") | ~F.max("varies").over(Window.partitionBy()))


def pair_varying_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    """Common columns worth keeping for a pair of tables (P3): a side varies, the single values differ, or one side is null.

    Both inputs are (column_name, n_distinct, single) with ``single`` the least value.
    """
    both = left.alias("a").join(right.alias("b"), "column_name")
    a, b = F.col("a.n_distinct"), F.col("b.n_distinct")
    keep = (a > 1) | (b > 1) | ((a == 1) & (b == 1) & (F.col("a.single") != F.col("b.single"))) | ((a + b) == 1)
    return both.select("column_name", F.coalesce(keep, F.lit(False)).alias("keep"))


def top_values(long: DataFrame, keys: Sequence[str] = ("column_name",), limit: int = 10, top: int = 5) -> DataFrame:
    """The ``top`` values, with their share, of columns that have at most ``limit`` distinct ones."""
    counts = long.filter("value is not null").groupBy(*keys, "value").agg(F.count("*").alias("n"))
    size = counts.groupBy(*keys).agg(F.count("*").alias("n_distinct"), F.sum("n").alias("n_values")).filter(F.col("n_distinct") <= limit)
    ranked = counts.join(size, list(keys)).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "value")))
    return ranked.filter(F.col("rank") <= top).select(*keys, "rank", "value", "n", (F.col("n") / F.col("n_values")).alias("share"))


def label_candidates(profile: DataFrame, missing: float = 0.5, classes: tuple[int, int] = (2, 50), numeric: float = 0.5, distinct: int = 50) -> DataFrame:
    """Columns that can serve as a label (F8): few enough missing values, and 2-50 classes, or numeric with many values."""
    few = F.col("n_distinct").between(*classes)
    task = F.when((F.col("numeric_share") > numeric) & (F.col("n_distinct") > distinct), "regression").when(few, "classification")
    return profile.filter((F.col("sparsity") <= missing)).withColumn("task", task).filter("task is not null")


def best_label(candidates: DataFrame, variance: str = "variance") -> DataFrame:
    """The label of a table (A21): fewest classes, else the largest variance; the first column wins ties.  One row."""
    rank = F.struct(F.when(F.col("task") == "classification", 0).otherwise(1), F.when(F.col("task") == "classification", F.col("n_distinct").cast("double")).otherwise(-F.coalesce(F.col(variance), F.lit(0.0))), F.col("ordinal"))
    return candidates.orderBy(rank).limit(1)


def balanced_labels(counts: DataFrame, keys: Sequence[str], least_rows: int = 200, low: float = 0.2, high: float = 0.8, most: int = 10) -> DataFrame:
    """Columns with 2 to ``most`` classes and enough rows (F9); two classes must be balanced.

    ``counts`` is (keys..., value, n)."""
    size = counts.groupBy(*keys).agg(F.count("*").alias("n_classes"), F.sum("n").alias("n_rows"), F.min("n").alias("smallest"), F.max("n").alias("largest"))
    even = (F.col("smallest") / F.col("largest")).between(low, 1.0) & (F.col("smallest") / F.col("n_rows")).between(low, high)
    return size.filter((F.col("n_rows") >= least_rows) & F.col("n_classes").between(2, most) & ((F.col("n_classes") > 2) | even))


def silo_structure(columns: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """Structural properties of each silo (A7): tables, columns, properties, types and foreign keys."""
    size = columns.groupBy("db").agg(F.count_distinct("table_name").alias("n_tables"), F.count("*").alias("n_columns"), F.count("prop").alias("n_props"), F.count_distinct("dtype").alias("n_types"))
    fk = foreign_keys.groupBy("db").agg(F.count("*").alias("n_fks"))
    out = size.join(fk, "db", "left").withColumn("n_fks", F.coalesce("n_fks", F.lit(0)))
    return out.withColumn("fk_density", F.col("n_fks") / F.col("n_columns"))


def type_shares(columns: DataFrame) -> DataFrame:
    """(db, dtype, n, share): share of each data type among the typed columns of a silo."""
    typed = columns.filter("dtype is not null").groupBy("db", "dtype").agg(F.count("*").alias("n"))
    return typed.join(typed.groupBy("db").agg(F.sum("n").alias("total")), "db").select("db", "dtype", "n", (F.col("n") / F.col("total")).alias("share"))


def fk_connectivity(foreign_keys: DataFrame) -> DataFrame:
    """Neighbouring tables per table that takes part in a foreign key (A7): mean, median, least, most, by silo."""
    ends = F.inline(F.array(F.struct(F.col("src_table").alias("tab"), F.col("dst_table").alias("other")), F.struct(F.col("dst_table").alias("tab"), F.col("src_table").alias("other"))))
    degree = foreign_keys.select("db", ends).filter("tab <> other").groupBy("db", "tab").agg(F.count_distinct("other").alias("n"))
    return degree.groupBy("db").agg(F.avg("n").alias("avg_links"), F.median("n").alias("median_links"), F.min("n").alias("min_links"), F.max("n").alias("max_links"))


def spread(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(metric, min_value, max_value, avg_value, median_value): one row for each column."""
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in columns))))
    return long.groupBy("metric").agg(F.min("x").alias("min_value"), F.max("x").alias("max_value"), F.avg("x").alias("avg_value"), F.median("x").alias("median_value"))

