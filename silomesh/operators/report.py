"""Roll-ups of experiment results.

Results are long form (pair_id, method, seed, client, metric value); means skip nulls and are null on empty input.  Numpy's
deviation is ``stddev_pop`` and pandas' is ``stddev_samp``; column names say which one a function gives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """n, mean, sample deviation, range and quartiles of ``x`` by group."""
    p = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std_samp"), F.min(x).alias("least"), F.max(x).alias("most"), p.alias("p"))
    return out.select(*keys, "n", "mean", "std_samp", "least", "most", *(F.col("p")[i].alias(c) for i, c in enumerate(("q25", "median", "q75"))))


def mean_of_seeds(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Mean and population deviation over the seeds of each group."""
    per_seed = df.groupBy(*keys, "seed").agg(F.avg(x).alias("v"))
    return per_seed.groupBy(*keys).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std_pop"), F.count("*").alias("n_seeds"))


def wide(df: DataFrame, x: str, methods: Sequence[str]) -> DataFrame:
    """One row for each pair with a column for each method (P16, J28); a pivot over a given list of methods."""
    return df.groupBy("pair_id").pivot("method", list(methods)).agg(F.avg(x))


def improvements(df: DataFrame, methods: Sequence[str], base: str) -> DataFrame:
    """(method, n_valid, n_better, ratio): pairs in which a method beats the base."""
    long = df.select(F.col(base).alias("base"), F.inline(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("v")) for m in methods))))
    valid = F.col("v").isNotNull() & F.col("base").isNotNull()
    out = long.groupBy("method").agg(F.count_if(valid).alias("n_valid"), F.count_if(valid & (F.col("v") > F.col("base"))).alias("n_better"))
    return out.withColumn("ratio", F.coalesce(F.col("n_better") / F.nullif("n_valid", F.lit(0)), F.lit(0.0)))


def gains(df: DataFrame, gain: Column, size: Column, cuts: Sequence[int] = (500, 2000)) -> DataFrame:
    """(bin, n, mean, median, std_samp, n_positive, n_neutral, n_negative, n_bad) of gains by size bin."""
    b = F.when(size < cuts[0], "small").when(size < cuts[1], "medium").otherwise("large")
    g = df.select(gain.alias("g"), b.alias("bin"))
    return g.groupBy("bin").agg(F.count("g").alias("n"), F.avg("g").alias("mean"), F.median("g").alias("median"), F.stddev_samp("g").alias("std_samp"), F.count_if(F.col("g") > 0).alias("n_positive"), F.count_if(F.col("g") == 0).alias("n_neutral"), F.count_if(F.col("g") < 0).alias("n_negative"), F.count_if(F.col("g") < -0.01).alias("n_bad"))


def worst_client(df: DataFrame, keys: Sequence[str], x: str, error: bool = False) -> DataFrame:
    """The worst client of each group, NaN and null as 0."""
    v = F.coalesce(F.nanvl(F.col(x), F.lit(0.0)), F.lit(0.0))
    return df.groupBy(*keys).agg((F.max(v) if error else F.min(v)).alias("worst"))


def ranking(df: DataFrame, keys: Sequence[str], x: str, top: int = 2) -> DataFrame:
    """The best and second best row of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(x), *[c for c in df.columns if c not in (*keys, x)]))).filter(F.col("rank") <= top)


def linear_fit(df: DataFrame, x: str, y: str, width: float) -> DataFrame:
    """One row: slope and intercept of the bin means over bins of ``width``."""
    b = df.groupBy((F.floor(F.col(x) / width) * width).alias("bin")).agg(F.avg(y).alias("mean"))
    return b.agg(F.regr_slope("mean", "bin").alias("slope"), F.regr_intercept("mean", "bin").alias("intercept"), F.count("*").alias("n_bins"))


def log_bins(df: DataFrame, x: str, y: str, n: int = 20) -> DataFrame:
    """(bin, centre, n, mean, std_pop) over ``n`` log-spaced bins of x > 0, the last one closed."""
    ends = df.filter(F.col(x) > 0).agg(F.log(F.min(x)).alias("lo"), F.log(F.max(x)).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / n
    b = df.filter(F.col(x) > 0).join(F.broadcast(ends)).withColumn("bin", F.least(F.floor((F.log(x) - F.col("lo")) / F.nullif(step, F.lit(0.0)) + 1e-9), F.lit(n - 1)).cast("int"))
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.stddev_pop(y).alias("std_pop"), F.exp(F.first("lo") + (F.col("bin") + 0.5) * F.first(step)).alias("centre"))


def shares_below(df: DataFrame, x: str, cuts: Sequence[float]) -> DataFrame:
    """(cut, share): share of rows below each cut."""
    row = df.filter(F.col(x).isNotNull()).agg(F.array(*(F.struct(F.lit(float(c)).alias("cut"), F.avg((F.col(x) < c).cast("double")).alias("share")) for c in cuts)).alias("s"))
    return row.select(F.inline("s"))


def finite(col: str) -> Column:
    """Neither null, NaN nor infinite (F16)."""
    c = F.col(col).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
