"""References to records that do not exist, from signed reference and existence counts per key.

A key is (silo number, table name, column name) under the name rule, kept as a digest.  A column is a change of +1 to its
key's existence count when it is added and of -1 when it is removed; a reference is a change of +1 to its key's reference
count at the time it was recorded.  The state holds the sum of all changes of a key at each time; further loads, late or
taken back, are further signed changes.  A key with references at a time at which its existence count isn't above zero is
an orphan.

Rows without a usable key or without their own time say nothing: a column without ``added_at`` never exists, a column
removed at or before its addition neither.  A reference whose time is null comes before everything, so it is an orphan.
Repeated rows raise counts and change no verdict; names that are blank after the name rule match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silomesh.functions.names import name_key
from silomesh.operators.skew import heavy_hashes, split_heavy
from silomesh.operators.value_counts import ValueCountTable, digest
from silomesh.runtime import Workspace

KEY = ["k1", "k2"]


def _silo() -> Column:
    return F.expr("try_cast(trim(db_id) AS BIGINT)")


_NAMED = ["silo", "tab", "col"]


def _names(table: str, column: str) -> list[Column]:
    """The parts of a key; the caller selects them before ``_key`` reads each of them several times."""
    return [_silo().alias("silo"), name_key(table).alias("tab"), name_key(column).alias("col")]


def _key() -> list[Column]:
    """The digest of a key's parts; null when one of them is null, so it has no existence."""
    usable = F.expr("silo is not null and tab is not null and col is not null")
    return [F.when(usable, k).alias(n) for n, k in zip(KEY, digest(*_NAMED))]


def existence_changes(columns: DataFrame, sign: int = 1) -> DataFrame:
    """Signed changes (key, ts, kind, n) of existence counts; ``sign=-1`` takes columns back."""
    lives = columns.filter("added_at is not null and (removed_at is null or removed_at > added_at)")
    mark = lambda ts, n: F.struct(F.col(ts).alias("ts"), F.lit(n * sign).cast("bigint").alias("n"))
    marks = F.array(mark("added_at", 1), mark("removed_at", -1))
    ends = lives.select(*_names("table_name", "column_name"), F.when(F.col("removed_at").isNull(), F.slice(marks, 1, 1)).otherwise(marks).alias("marks"))
    return ends.select(*_key(), "marks").filter("k1 is not null").select(*KEY, F.inline("marks")).select(*KEY, "ts", F.lit("exists").alias("kind"), "n")


def reference_sides(references: DataFrame) -> DataFrame:
    """Both sides (key, ts, kind, fk_id, silo, of_table) of each reference whose two names are neither null nor blank."""
    side = lambda name, t, c: F.struct(F.lit(name).alias("kind"), F.col(t).alias("side_table"), F.col(c).alias("side_column"))
    both = references.select("fk_id", "db_id", F.col("recorded_at").alias("ts"), F.col("table_name").alias("of_table"), F.inline(F.array(side("source", "table_name", "column_name"), side("target", "reference_table_name", "reference_column_name"))))
    held = both.filter(F.col("side_table").rlike(r"\S") & F.col("side_column").rlike(r"\S"))
    return held.select(*_names("side_table", "side_column"), "ts", "kind", "fk_id", "of_table").select(*_key(), "ts", "kind", "fk_id", "silo", "of_table")


def reference_changes(references: DataFrame, sign: int = 1) -> DataFrame:
    """Signed changes (key, ts, kind, n) of reference counts; ``kind`` is the side."""
    return reference_sides(references).select(*KEY, "ts", "kind", F.lit(sign).cast("bigint").alias("n"))


def signed_counts(changes: DataFrame) -> DataFrame:
    """Changes added up per key, time and kind before they are exchanged."""
    return changes.groupBy(*KEY, "ts", "kind").agg(F.sum("n").alias("n"))


def orphan_keys(state: DataFrame, heavy_share: float = 0.02) -> DataFrame:
    """(key, ts, kind, n) of the state with references and no existence at that time.

    The existence count of a key is the running sum of its changes up to and including the time.  A key that may hold more
    than ``heavy_share`` of all changes is summed up by month first, so no task holds all of its changes.
    """
    exists = F.when(F.col("kind") == "exists", F.col("n"))
    usable = state.filter("k1 is not null")
    light, hot = split_heavy(usable, F.col("k1"), heavy_hashes(usable, F.col("k1"), heavy_share))
    run = light.withColumn("held", F.sum(exists).over(Window.partitionBy(*KEY).orderBy("ts")))
    if hot is not None:
        cut = hot.withColumn("month", F.date_trunc("month", "ts"))
        by_month = cut.groupBy(*KEY, "month").agg(F.sum(exists).alias("change"))
        before = by_month.select(*KEY, "month", F.sum("change").over(Window.partitionBy(*KEY).orderBy("month").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
        inside = cut.withColumn("own", F.sum(exists).over(Window.partitionBy(*KEY, "month").orderBy("ts"))).alias("i")
        on = (F.col("i.k1") == F.col("b.k1")) & (F.col("i.k2") == F.col("b.k2")) & F.col("i.month").eqNullSafe(F.col("b.month"))
        met = inside.join(before.alias("b"), on).select(*(F.col(f"i.{c}") for c in state.columns), (F.coalesce("before", F.lit(0)) + F.coalesce("own", F.lit(0))).alias("held"))
        run = run.select(*state.columns, "held").unionByName(met)
    lost = run.filter("kind <> 'exists' and n > 0 and coalesce(held, 0) <= 0").select(*state.columns)
    return lost.unionByName(state.filter("k1 is null and kind <> 'exists' and n > 0"))


def orphans(columns: DataFrame, references: DataFrame) -> DataFrame:
    """Reference sides without an existing key at their time (fk_id, side, ts, silo, of_table), one for each row.

    The changes of both tables are applied as one load to an empty state in the shared folder; the orphan keys come from
    that state, and their references are looked up by key, time and side.
    """
    table = ValueCountTable(columns.sparkSession, Workspace(columns.sparkSession, "reference-counts").root)
    state = table.apply(signed_counts(existence_changes(columns).unionByName(reference_changes(references))), summed=True)
    return lost_references(orphan_keys(state), references)


def lost_references(keys: DataFrame, references: DataFrame) -> DataFrame:
    """The reference sides (fk_id, side, ts, silo, of_table) of orphan keys."""
    refs, lost = reference_sides(references).alias("r"), keys.alias("o")
    on = F.col("r.k1").eqNullSafe(F.col("o.k1")) & F.col("r.k2").eqNullSafe(F.col("o.k2")) & F.col("r.ts").eqNullSafe(F.col("o.ts")) & (F.col("r.kind") == F.col("o.kind"))
    return refs.join(lost.hint("merge"), on, "left_semi").select("fk_id", F.col("kind").alias("side"), "ts", "silo", "of_table")


def orphan_cases(columns: DataFrame, references: DataFrame) -> DataFrame:
    """Distinct orphan sides (fk_id, side)."""
    return orphans(columns, references).select("fk_id", "side").distinct()


def orphan_report(columns: DataFrame, references: DataFrame) -> DataFrame:
    """Orphans per referring table and month: distinct references and their counts by side."""
    cases = orphans(columns, references).select("fk_id", "side", "silo", name_key("of_table").alias("table_key"), F.date_format("ts", "yyyy-MM").alias("period")).distinct()
    return cases.groupBy("silo", "table_key", "period").agg(
        F.count_if(F.col("side") == "source").alias("n_source"), F.count_if(F.col("side") == "target").alias("n_target"), F.count_distinct("fk_id").alias("n_references")
    )
