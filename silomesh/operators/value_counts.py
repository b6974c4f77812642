"""Column-level data quality profile on maintained value-count tables.

The state of a profile is a table of (group..., value, n): how often each value of a column occurs now.  A load changes it
by signed deltas: +1 for a row that arrives, -1 for a row that goes.  Every metric (null rate, distinct values, range,
entropy, pattern violations, distance between two loads, drift of a column's current values) is a function of the counts.

Nulls are a value of their own (``value`` is null), NaN counts as null, an empty table has an empty state, repeated rows
raise a count, and columns that aren't named are never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silomesh.operators.skew import heavy_hashes, split_heavy
from silomesh.runtime import Workspace, is_nan

#: Fixed value: what a well-formed silo id is.
ID_PATTERN = r"\A[0-9]{7}\z"


def value_deltas(df: DataFrame, groups: Sequence[str], value: Column, sign: Column | int = 1) -> DataFrame:
    """Signed, pre-aggregated count changes (groups..., value, n) of the rows of ``df``."""
    sign = F.lit(sign) if isinstance(sign, int) else sign
    return df.select(*groups, value.alias("value"), sign.cast("bigint").alias("n")).groupBy(*groups, "value").agg(F.sum("n").alias("n"))


def apply_deltas(state: DataFrame | None, deltas: DataFrame) -> DataFrame:
    """The value-count state after ``deltas``; values whose count falls to zero leave it."""
    if state is None:
        return deltas.filter("n <> 0")
    groups = [c for c in state.columns if c != "n"]
    return state.unionByName(deltas).groupBy(*groups).agg(F.sum("n").alias("n")).filter("n <> 0")


class ValueCountTable:
    """A value-count state kept as numbered versions in a folder; each applied load writes the next version.

    A version counts only when its write was completed, so a failed load leaves the previous state in force.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _fs(self):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def versions(self) -> list[int]:
        fs, target = self._fs()
        if not fs.exists(target):
            return []
        make = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in fs.listStatus(target)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and fs.exists(make(f"{self.path}/{n}/_SUCCESS")))

    def state(self) -> DataFrame | None:
        found = self.versions()
        return self.spark.read.parquet(f"{self.path}/v{found[-1]:06d}") if found else None

    def apply(self, deltas: DataFrame, summed: bool = False) -> DataFrame:
        """The state after ``deltas``; ``summed`` deltas have one row for each value, so a first load needs no exchange."""
        found = self.versions()
        new = f"{self.path}/v{(found[-1] + 1 if found else 0):06d}"
        if not found and not summed:
            deltas = deltas.groupBy(*(c for c in deltas.columns if c != "n")).agg(F.sum("n").alias("n"))
        apply_deltas(self.state(), deltas).write.mode("overwrite").parquet(new)
        fs, _ = self._fs()
        make = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for old in self.versions()[: -self.keep]:
            fs.delete(make(f"{self.path}/v{old:06d}"), True)
        return self.spark.read.parquet(new)


def profile(state: DataFrame, groups: Sequence[str], pattern: str | None = None) -> DataFrame:
    """Exact metrics of each group from its counts.

    ``n_rows``, ``n_null``, ``null_rate``, ``n_distinct`` (non-null values), ``min_value``, ``max_value``, ``entropy``
    (bits, nulls left out, 0 when there is no value) and, with ``pattern``, ``n_pattern`` (rows whose value doesn't
    match).  Entropy is log2(N) - sum(n log2 n) / N, which needs one pass over the counts.
    """
    n, v = F.col("n"), F.col("value")
    held = F.when(v.isNotNull(), n)
    total = F.sum(held)
    out = [
        F.sum(n).alias("n_rows"),
        F.coalesce(F.sum(F.when(v.isNull(), n)), F.lit(0)).cast("bigint").alias("n_null"),
        F.count(v).alias("n_distinct"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
        F.coalesce(F.log2(total) - F.sum(held * F.log2(held)) / total, F.lit(0.0)).alias("entropy"),
    ]
    if pattern:
        out.append(F.coalesce(F.sum(F.when(~v.cast("string").rlike(pattern), n)), F.lit(0)).cast("bigint").alias("n_pattern"))
    res = state.groupBy(*groups).agg(*out)
    return res.withColumn("null_rate", F.col("n_null") / F.col("n_rows"))


def distribution_change(state: DataFrame, groups: Sequence[str], load: str) -> DataFrame:
    """Total variation distance between the value distributions of each load and the load before it in the same group.

    The distance is half the sum of |p - q| over all values; nulls are a value.  It is 1 - sum(min(p, q)), so only values
    that occur in both loads have to meet.
    """
    groups = list(groups)
    size = state.groupBy(*groups, load).agg(F.sum("n").alias("total"))
    order = Window.partitionBy(*groups).orderBy(load)
    size = size.withColumn("load_before", F.lag(load).over(order)).withColumn("total_before", F.lag("total").over(order))
    now = state.join(size.filter("load_before is not null"), [*groups, load])
    before = state.select(*groups, F.col(load).alias("load_before"), "value", F.col("n").alias("n_before"))
    on = [now[c].eqNullSafe(before[c]) for c in [*groups, "load_before", "value"]]
    both = now.join(before, on).groupBy(*(now[c] for c in groups), now[load]).agg(F.sum(F.least(F.col("n") / F.col("total"), F.col("n_before") / F.col("total_before"))).alias("shared"))
    left = size.filter("load_before is not null")
    on = [left[c].eqNullSafe(both[c]) for c in [*groups, load]]
    return left.join(both, on, "left").select(*(left[c] for c in groups), left[load], "load_before", (1 - F.coalesce("shared", F.lit(0.0))).alias("total_variation"))


def digest(*cols: Column | str) -> list[Column]:
    """Two independent 64-bit hashes of some columns; a null differs from every value.

    Together they stand for the columns in shuffles and states: among 10^11 keys two collide with a chance below 10^-16.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in cols]
    marked = [x for c in cols for x in (c, c.isNull())]
    return [F.xxhash64(F.lit(seed), *marked) for seed in (17, 71)]


#: What one value count of a load is kept by: the column (as a digest), the form of its id, whether the value is
#: impossible for another reason than itself, and the value.
COUNT_KEY = ["field_name", "k1", "k2", "load_no", "id_form", "over", "named", "value"]
_SOUND = "(id_form = 'sound' and value is not null and not over and named)"


def observations(cardinality: DataFrame, sparsity: DataFrame) -> DataFrame:
    """(COUNT_KEY..., k3, stat_id): what every row of both statistics tables says, NaN as null."""
    form = F.when(F.col("db_id").isNull(), "null").when(~F.col("db_id").rlike(ID_PATTERN), "pattern").otherwise("sound")
    named = F.col("table_name").isNotNull() & F.col("column_name").isNotNull()
    s = F.col("sparsity")

    def told(df: DataFrame, field: str, value: Column, over: Column) -> DataFrame:
        k1, k2 = digest(F.lit(field), "db_id", "table_name", "column_name")
        return df.select(F.lit(field).alias("field_name"), k1.alias("k1"), k2.alias("k2"), F.col("load_no").cast("int").alias("load_no"), form.alias("id_form"), F.coalesce(over, F.lit(False)).alias("over"), named.alias("named"), value.alias("value"), "stat_id")

    card = told(cardinality, "n_distinct", F.col("n_distinct").cast("double"), (F.col("n_distinct") < 0) | (F.col("n_distinct") > F.col("n_rows")))
    both = card.unionByName(told(sparsity, "sparsity", F.when(~is_nan(s), s), (s < 0) | (s > 1)))
    return both.withColumn("k3", digest("load_no", "id_form", "over", "value")[0])


def _far(v: Column, share: float, factor: int) -> Column:
    """Whether a value is far from either end of its column's values before; the distance is largest at an end."""

    def drifts(b: Column) -> Column:
        low, high = F.least(v, b), F.greatest(v, b)
        return F.when(F.col("field_name") == "sparsity", F.abs(v - b) >= share).otherwise(high + 1 >= factor * (low + 1))

    return F.coalesce(drifts(F.col("lo_before")) | drifts(F.col("hi_before")), F.lit(False))


def replace_values(state: DataFrame | None, deltas: DataFrame, heavy: Sequence[int] = ()) -> DataFrame:
    """The value counts after a load, with what they were before.

    ``deltas`` are the signed rows (COUNT_KEY..., n) of one load.  For each column that the load has sound values of, they
    replace its current ones: the old counts leave the state and the new ones enter it, with the least and the largest
    value replaced (``lo_before``, ``hi_before``).  Columns the load says nothing about stay as they are.  Values that
    aren't sound are counted for the load and replace nothing.

    Rows of light columns meet in one exchange.  Columns whose ``k1`` is in ``heavy`` are summed up before they are
    exchanged and meet the few ranges of their own.
    """
    if state is None:
        state = deltas.limit(0)
    old = state.filter(_SOUND).select(*COUNT_KEY, "n", F.lit(False).alias("new"))
    new = deltas.select(*COUNT_KEY, "n", F.lit(True).alias("new"))
    h = F.col("k1")

    def light(rows: DataFrame) -> DataFrame:
        by = Window.partitionBy("k1", "k2")
        summed = rows.repartition("k1", "k2").groupBy(*COUNT_KEY, "new").agg(F.sum("n").alias("n")).filter("n <> 0")
        seen = summed.withColumns({"lo_before": F.min(F.when(~F.col("new"), F.col("value"))).over(by), "hi_before": F.max(F.when(~F.col("new"), F.col("value"))).over(by), "replaced": F.max(F.expr(f"new and {_SOUND}")).over(by)})
        return seen.filter("new or not replaced").select(*COUNT_KEY, "n", "new", "lo_before", "hi_before")

    def hot(before: DataFrame, came: DataFrame) -> DataFrame:
        now = came.groupBy(*COUNT_KEY, "new").agg(F.sum("n").alias("n")).filter("n <> 0")
        ranges = before.groupBy("k1", "k2").agg(F.min("value").alias("lo_before"), F.max("value").alias("hi_before"))  # one row for each heavy column
        fresh = now.filter(_SOUND).select("k1", "k2").distinct()
        stays = before.join(fresh, ["k1", "k2"], "left_anti").select(*COUNT_KEY, "n", "new", F.lit(None).cast("double").alias("lo_before"), F.lit(None).cast("double").alias("hi_before"))
        return now.join(ranges, ["k1", "k2"], "left").select(*COUNT_KEY, "n", "new", "lo_before", "hi_before").unionByName(stays)

    (old, old_hot), (new, new_hot) = split_heavy(old, h, list(heavy)), split_heavy(new, h, list(heavy))
    out = light(new.unionByName(old))
    return out if new_hot is None else out.unionByName(hot(old_hot, new_hot))


def quality_findings(cardinality: DataFrame, sparsity: DataFrame, share: float = 0.3, factor: int = 5, heavy_share: float = 0.02) -> DataFrame:
    """All findings (stat_table, stat_id, field_name, finding) over the column statistics of every load.

    The loads are applied in order to a maintained state, the current value counts of every column: each load's rows are
    signed deltas, and ``replace_values`` writes the next version of the state from the last one and the load alone.  All
    findings are verdicts on value counts of the version in which they came: null and ill-formed ids, null and impossible
    values, and drift of sound values against those they replaced, which are the column's values in the nearest earlier
    load that has any.  The rows that a finding is about are then looked up by the digest of their column and value.

    NaN counts as null.  A null ``n_rows`` allows any ``n_distinct``.  Rows without a load number have findings of their
    own but no earlier load, columns without a table or column name don't drift.  A finding that several rows of one
    ``stat_id`` share comes out once; empty tables have none; other columns aren't read.
    """
    work = Workspace(cardinality.sparkSession, "value-counts")
    rows = observations(cardinality, sparsity)
    heavy = heavy_hashes(rows, F.col("k1"), heavy_share)
    loads = sorted(r[0] for r in rows.select("load_no").distinct().collect() if r[0] is not None)  # one number for each load
    state, found = None, []
    for load in [None, *loads]:
        came = rows.filter(F.col("load_no").eqNullSafe(F.lit(load)))
        deltas = came.select(*COUNT_KEY, F.lit(1).cast("bigint").alias("n"))
        if load is None:
            counted = deltas.groupBy(*COUNT_KEY).agg(F.sum("n").alias("n")).withColumns({"new": F.lit(True), "lo_before": F.lit(None).cast("double"), "hi_before": F.lit(None).cast("double")})
            found.append(counted)
            continue
        state = work.write(replace_values(state, deltas, heavy))
        found.append(state.filter("new"))
    verdict = lambda field, finding: F.struct(F.coalesce(field, F.lit("")).alias("field_name"), finding.alias("finding"))
    field = F.col("field_name")
    of_id = verdict(F.lit("db_id"), F.when(F.col("id_form") != "sound", F.col("id_form")))
    of_value = verdict(field, F.when(F.col("value").isNull(), "null").when(F.col("over"), "range").when(F.expr(_SOUND) & _far(F.col("value"), share, factor), "drift"))
    told = lambda df: df.select("k1", "k2", digest("load_no", "id_form", "over", "value")[0].alias("k3"), F.filter(F.array(of_id, of_value), lambda x: x["finding"].isNotNull()).alias("found")).filter(F.size("found") > 0)
    cases = told(found[0])
    for part in found[1:]:
        cases = cases.unionByName(told(part))
    table = F.when(field == "sparsity", "column_sparsity").otherwise("column_cardinality").alias("stat_table")
    met = rows.select(table, "stat_id", "k1", "k2", "k3").join(cases.hint("merge"), ["k1", "k2", "k3"])
    return met.select("stat_table", "stat_id", F.inline("found")).distinct()
