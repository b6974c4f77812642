"""Schema and table texts.

A silo's text is put together from lines with an ordinal, so its order does not depend on the plan.  A silo whose columns
are too many for one text is cut by its own tables: lines are collected by table first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _joined(rows: DataFrame, keys: list[str], order: list[str], line: str, sep: str, name: str) -> DataFrame:
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*order, line))), lambda s: s[line])
    return rows.groupBy(*keys).agg(F.array_join(listed, sep).alias(name))


def schema_text(columns: DataFrame, mode: str = "full") -> DataFrame:
    """(db, text) of (db, name, table_name, column_name, samples array).

    ``full`` lists columns with up to three samples joined by a pipe, N/A without any; ``schema`` lists columns only;
    ``tables`` lists tables only.
    """
    s = F.coalesce(F.array_join(F.slice(F.array_distinct(F.filter("samples", lambda v: v.isNotNull())), 1, 3), "|"), F.lit(""))
    line = {
        "full": F.concat(F.lit(" - "), F.col("column_name"), F.lit(", Samples: ["), F.when(s == "", "N/A").otherwise(s), F.lit("]")),
        "schema": F.concat(F.lit(" - Column: "), F.col("column_name")),
        "tables": F.lit(""),
    }[mode]
    per_table = _joined(columns.withColumn("line", line), ["db", "name", "table_name"], ["column_name"], "line", "\n", "body")
    head = F.concat(F.lit("Table: "), F.col("table_name"))
    per_table = per_table.withColumn("block", head if mode == "tables" else F.concat(head, F.lit("\n"), F.col("body")))
    out = _joined(per_table, ["db", "name"], ["table_name"], "block", "\n", "body")
    return out.select("db", F.concat(F.lit("Database Name: "), F.col("name"), F.lit("\n"), F.col("body")).alias("text"))


def bounded_text(text: Column, fallback: Column, limit: int = 1024) -> Column:
    """The text, or the fallback when the text is too long, cut at ``limit``."""
    return F.substring(F.when(F.length(text) > limit, fallback).otherwise(text), 1, limit)


def column_text(title: Column, name: Column, values: Column) -> Column:
    """``title. name contains n values (longest, shortest, mean length): v1, v2`` over the distinct values."""
    v = F.array_distinct(F.filter(values, lambda x: x.isNotNull()))
    size = F.transform(v, F.length)
    mean = F.aggregate(size, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(v), F.lit(1))
    return F.concat(title, F.lit(". "), name, F.lit(" contains "), F.size(v).cast("string"), F.lit(" values ("), F.array_max(size).cast("string"), F.lit(", "), F.array_min(size).cast("string"), F.lit(", "), F.round(mean, 2).cast("string"), F.lit("): "), F.array_join(v, ", "))


def row_text(columns: list[str], limit: int = 100) -> Column:
    """``[col]: value`` of each column joined by `` | `` with values stripped and cut."""
    return F.concat_ws(" | ", *(F.concat(F.lit(f"[{c}]: "), F.coalesce(F.substring(F.trim(F.col(c).cast("string")), 1, limit), F.lit(""))) for c in columns))


#: Column encoders that take a header and tokens.
ENCODERS = {
    "header-values": lambda h, t: F.concat_ws(" ", h, F.array_join(t, " ")),
    "header-values-repeat": lambda h, t: F.concat_ws(" ", F.array_join(F.array_repeat(h, 5), " "), F.array_join(t, " ")),
    "header-comma": lambda h, t: F.concat(h, F.lit(": "), F.array_join(t, ", ")),
    "header-only": lambda h, t: h,
}


def camel_split(c: Column) -> Column:
    """Blanks between the words of a camel-case name."""
    return F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")


def byte_size(n: Column) -> Column:
    """A number of bytes with two decimals in B, KB, MB or GB (X18); halves round up."""
    in_unit = lambda size, unit: F.concat(F.format_string("%.2f", F.floor(n * 100 / float(size) + 0.5) / 100), F.lit(f" {unit}"))
    return F.when(n >= 1 << 30, in_unit(1 << 30, "GB")).when(n >= 1 << 20, in_unit(1 << 20, "MB")).when(n >= 1 << 10, in_unit(1 << 10, "KB")).otherwise(in_unit(1, "B"))


def legacy_text(columns: DataFrame, sep: str = ", ", tables_only: bool = False, properties: bool = False) -> DataFrame:
    """(db, text) in the older forms (X11): one line for each table with its columns between separators, or table names
    alone; ``properties`` adds the property id of a column in brackets.  ``columns`` is (db, table_name, column_name, prop)."""
    shown = F.concat("column_name", F.when(F.col("prop").isNotNull(), F.concat(F.lit(" ("), "prop", F.lit(")"))).otherwise(F.lit(""))) if properties else F.col("column_name")
    body = _joined(columns.withColumn("line", shown), ["db", "table_name"], ["column_name"], "line", sep, "body")
    line = F.col("table_name") if tables_only else F.concat("table_name", F.lit(": "), "body")
    return _joined(body.withColumn("row", line), ["db"], ["table_name"], "row", "\n", "text").select("db", "text")
