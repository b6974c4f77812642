"""A knowledge base of values and value pairs, and union scores of tables from it.

Input is long form (tab, row, col, value).  Four passes of grouping and joining: value to columns, column to its semantic
distribution, value pair to column pairs, and table pairs to their best column match.  Values that occur in too many columns
are left out before any value meets itself, so no value makes more than that many pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings that stand for a missing value.
NULL_WORDS = ["nan", "-", "unknown", "other (unknown)", "null", "na", "none", "", " "]


def clean_value(v: Column) -> Column:
    """A value in lower case without punctuation and repeated blanks; null for null words."""
    t = F.trim(F.regexp_replace(F.replace(F.regexp_replace(F.lower(v), r"[^\p{L}\p{N}_\s]", " "), F.lit("nbsp"), F.lit("")), r"\s+", " "))
    return F.when(~F.lower(v).isin(NULL_WORDS) & (t != ""), t)


def text_columns(cells: DataFrame, share: float = 0.5) -> DataFrame:
    """(tab, col) whose non-null values are mostly text (X9): not all digits and at most half digits."""
    digits = F.length(F.regexp_replace("value", "[^0-9]", "")) / F.length("value")
    return cells.filter("value is not null and value <> ''").groupBy("tab", "col").agg(F.avg((digits <= 0.5).cast("double")).alias("p")).filter(F.col("p") > share).select("tab", "col")


def value_index(cells: DataFrame, most_columns: int = 300) -> DataFrame:
    """(value, tab, col) of values in fewer than ``most_columns`` columns."""
    held = cells.filter("value is not null").select("value", "tab", "col").distinct()
    rare = held.groupBy("value").agg(F.count("*").alias("n")).filter(F.col("n") < most_columns).select("value")
    return held.join(rare, "value")


def column_semantics(index: DataFrame) -> DataFrame:
    """(tab, col, sem, score): for each column the columns that share values with it, by the share of its values."""
    size = index.groupBy("tab", "col").agg(F.count("*").alias("n_values"))
    other = index.select("value", F.concat_ws(".", "tab", "col").alias("sem"))
    met = index.join(other, "value").groupBy("tab", "col", "sem").agg(F.count("*").alias("n_shared"))
    return met.join(size, ["tab", "col"]).select("tab", "col", "sem", (F.col("n_shared") / F.col("n_values")).alias("score"))


def relations(cells: DataFrame, subject: str, other: str) -> DataFrame:
    """(tab, subject_value, object_value) of two columns of a row."""
    s = cells.filter(F.col("col") == subject).select("tab", "row", F.col("value").alias("subject_value"))
    o = cells.filter(F.col("col") == other).select("tab", "row", F.col("value").alias("object_value"))
    return s.join(o, ["tab", "row"]).filter("subject_value is not null and object_value is not null").select("tab", "subject_value", "object_value").distinct()


def relation_lookup(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (s, o) with the score of the known relation s-o, else of o-s."""
    key = lambda a, b: F.concat_ws("__", a, b)
    k = known.select(key("s", "o").alias("key"), "score")
    one = pairs.withColumn("key", key("s", "o")).join(k, "key", "left").withColumnRenamed("score", "forward").drop("key")
    two = one.withColumn("key", key("o", "s")).join(k.withColumnRenamed("score", "backward"), "key", "left").drop("key")
    return two.select("s", "o", F.coalesce("forward", "backward").alias("score"))


def union_scores(semantics: DataFrame) -> DataFrame:
    """(t1, t2, score): best column match of each table pair, the sum over columns of the best product of scores."""
    a = semantics.select(F.col("tab").alias("t1"), F.col("col").alias("c1"), "sem", F.col("score").alias("x"))
    b = semantics.select(F.col("tab").alias("t2"), F.col("col").alias("c2"), "sem", F.col("score").alias("y"))
    pairs = a.join(b, "sem").filter("t1 < t2").groupBy("t1", "t2", "c1", "c2").agg(F.max(F.col("x") * F.col("y")).alias("score"))
    best = pairs.groupBy("t1", "t2", "c1").agg(F.max("score").alias("score"))
    return best.groupBy("t1", "t2").agg(F.sum("score").alias("score"), F.count("*").alias("n_columns"))
