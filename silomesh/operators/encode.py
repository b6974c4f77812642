"""Sampling, splitting, encoding and scaling.

Random choices are hashes of a key and a seed, so a repeated run chooses the same rows whatever the partitioning.  Ranks
over a whole table are taken in slices (`position`), never in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silomesh.runtime import Workspace


ROWS = 250_000  # rows that one slice of a hash order holds on average


def token(*by: Column | str) -> Column:
    """A text that is random in the values of ``by`` and depends on nothing else; nulls are left out of it."""
    return F.md5(F.concat_ws("|", *((F.col(c) if isinstance(c, str) else c).cast("string") for c in by)))


def draw(key: Column | str, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    return F.conv(F.substring(token(key, F.lit(seed)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def position(df: DataFrame, keys: Sequence[str], by: Sequence[Column | str]) -> DataFrame:
    """``df`` with its 0-based ``pos`` in hash order within each group; slices of the hash range are numbered apart, as many
    as ``ROWS`` rows each need."""
    parts = min(1 << 16, -(-df.count() // ROWS) or 1)
    cut = df.withColumn("_h", token(*by)).withColumn("_p", F.floor(F.conv(F.substring("_h", 1, 4), 16, 10).cast("int") * parts / (1 << 16)).cast("int"))
    sizes = cut.groupBy(*keys, "_p").agg(F.count("*").alias("_n"))
    shift = sizes.withColumn("_s", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_p")) - F.col("_n")).drop("_n")
    own = cut.withColumn("_o", F.row_number().over(Window.partitionBy(*keys, "_p").orderBy("_h", *by)) - 1)
    on = F.col("c._p") == F.col("s._p")
    for k in keys:
        on &= F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}"))
    kept = [F.col(f"c.{c}") for c in df.columns]
    return own.alias("c").join(shift.alias("s"), on).select(*kept, (F.col("s._s") + F.col("c._o")).alias("pos"))


def range_slices(df: DataFrame, order: Sequence[Column], name: str = "_slice") -> DataFrame:
    """``df`` written in ranges of ``order``, with the number of its range: rows of a lower number come first.

    Ranges are cut by a sample, so they are about equal, but what is computed over them in order doesn't depend on the cuts.
    """
    parts = max(1, -(-df.count() // ROWS))
    ranged = df.repartitionByRange(parts, *order) if parts > 1 else df
    return Workspace(df.sparkSession, "ranges").write(ranged.withColumn(name, F.spark_partition_id() if parts > 1 else F.lit(0)))


def split(df: DataFrame, key: str, test: float = 0.2, seed: int = 42, strata: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``part`` train or test (E1, E2, E3); the test part is rounded up in each stratum.

    A stratum with one row goes to train.
    """
    ranked = position(df, strata, [F.col(key), F.lit(seed)])
    n = df.groupBy(*strata).agg(F.count("*").alias("_n"))
    on = [ranked[c].eqNullSafe(n[c]) for c in strata]
    with_n = (ranked.join(n, on) if strata else ranked.join(F.broadcast(n))).select(ranked["*"], "_n")
    cut = F.when(F.col("_n") > 1, F.ceil(F.col("_n") * test)).otherwise(0)
    return with_n.withColumn("part", F.when(F.col("pos") < cut, "test").otherwise("train")).drop("_n", "pos")


def dictionary(values: DataFrame, col: str) -> DataFrame:
    """(value, code): codes 0.. of the sorted distinct values (E13, E15); nulls have no code.

    Values are numbered in ranges and shifted by the sizes of the ranges before, so no task orders them all.
    """
    held = range_slices(values.select(F.col(col).alias("value")).filter("value is not null").distinct(), [F.col("value")])
    sizes = held.groupBy("_slice").agg(F.count("*").alias("_n"))  # one row for each range
    shift = sizes.select("_slice", (F.sum("_n").over(Window.orderBy("_slice")) - F.col("_n")).alias("_s"))
    own = held.withColumn("_o", F.row_number().over(Window.partitionBy("_slice").orderBy("value")) - 1)
    return own.join(F.broadcast(shift), "_slice").select("value", (F.col("_s") + F.col("_o")).cast("int").alias("code"))


def encode(df: DataFrame, col: str, codes: DataFrame, unseen: int | None = None) -> DataFrame:
    """``df`` with ``<col>_code``; unseen and null values get ``unseen``."""
    code = F.col("code") if unseen is None else F.coalesce("code", F.lit(unseen))
    return df.join(codes.withColumnRenamed("value", col), col, "left").withColumn(f"{col}_code", code).drop("code")


def scale_terms(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row (<col>_mean, <col>_sd) with nulls as 0 and population deviation, 1 for a constant column."""
    x = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols}
    agg = [f(x[c]).alias(f"{c}_{n}") for c in cols for n, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    row = train.agg(*agg)
    return row.withColumns({f"{c}_sd": F.when(F.col(f"{c}_sd") > 0, F.col(f"{c}_sd")).otherwise(1.0) for c in cols})


def standardise(df: DataFrame, cols: Sequence[str], terms: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    with_terms = df.join(terms, list(keys)) if keys else df.join(F.broadcast(terms))
    return with_terms.withColumns({c: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.col(f"{c}_mean")) / F.col(f"{c}_sd") for c in cols}).drop(*(f"{c}_{n}" for c in cols for n in ("mean", "sd")))


def nearest_bin(x: Column, bins: Sequence[float]) -> Column:
    """The nearest of the given bins, the first on ties, with values outside clamped."""
    best = F.array_min(F.array(*(F.struct(F.abs(x - F.lit(float(b))).alias("gap"), F.lit(i).alias("i"), F.lit(float(b)).alias("bin")) for i, b in enumerate(bins))))
    return F.when(x.isNotNull(), best["bin"])


def top_classes(df: DataFrame, col: str, k: int) -> DataFrame:
    """(value, idx): the k - 1 most frequent classes as 1.., all others are class 0."""
    n = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), "value").limit(k - 1)
    return top.withColumn("idx", F.row_number().over(Window.orderBy(F.desc("n"), "value"))).drop("n")


def clean_plan(profile: DataFrame) -> DataFrame:
    """(column_name, kind, keep): numeric if most rows parse, dropped without variation; else text, nan a value."""
    numeric = F.col("numeric_share") > 0.5
    words = F.col("n_distinct") + F.when(F.col("n_null") > 0, 1).otherwise(0)
    return profile.select("column_name", F.when(numeric, "numeric").otherwise("text").alias("kind"), F.when(numeric, F.col("n_distinct") > 1).otherwise(words > 1).alias("keep"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mutual information of two columns in nats (E25); nulls are left out."""
    n = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    na, nb = n.groupBy("a").agg(F.sum("n").alias("na")), n.groupBy("b").agg(F.sum("n").alias("nb"))
    total = n.agg(F.sum("n").alias("t"))
    j = n.join(na, "a").join(nb, "b").join(F.broadcast(total))
    return j.agg(F.coalesce(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))), F.lit(0.0)).alias("mi"))


def outliers(df: DataFrame, cols: Sequence[str], key: str, seed: int = 3) -> DataFrame:
    """(key, cols..., outlier): synthetic outliers of numeric rows (E24): each row three deviations out, to the side its hash says."""
    terms = scale_terms(df, cols)
    side = F.when(draw(key, seed) < 0.5, 1).otherwise(-1)
    return df.join(F.broadcast(terms)).select(key, *((F.col(c) + side * 3 * F.col(f"{c}_sd")).alias(c) for c in cols), F.lit(1).alias("outlier"))


#: Chances that a Poisson number with mean 1 is at most 0, 1, 2, ...
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402]


def poisson_bootstrap(df: DataFrame, value: str, key: str, draws: int = 20, seed: int = 9) -> DataFrame:
    """(draw, mean): bootstrap means by Poisson(1) weights of each row and draw.

    Every task weights its own rows and sends one pair of sums for each draw; a mean without weight is null.
    """
    rows = df.filter(F.col(value).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(value).cast("double").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    u = draw(F.concat_ws("-", "k", "draw"), seed)
    weight = sum((F.when(u >= p, 1).otherwise(0) for p in POISSON), F.lit(0))
    return rows.select("draw", "v", weight.alias("w")).groupBy("draw").agg((F.sum(F.col("w") * F.col("v")) / F.nullif(F.sum("w"), F.lit(0))).alias("mean"))


def sample_values(counts: DataFrame, keys: Sequence[str], n: int, mode: str, seed: int = 0) -> DataFrame:
    """Up to ``n`` values of each column from (keys..., value, n) (E10): frequent, random, weighted, or priority,
    which divides the frequency by a hash in place of a Fibonacci hash (M6)."""
    h = draw(F.col("value"), seed)
    order = {"frequent": F.desc("n"), "random": h, "weighted": F.desc(F.log(1 - h) / F.col("n")), "priority": F.desc(F.col("n") / (h + 1e-9))}[mode]
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order, "value"))).filter(F.col("rank") <= n)


def sample_clients(clients: DataFrame, rounds: int, share: float, seed: int = 4) -> DataFrame:
    """(round, client): max(1, floor(n share)) clients of each round without repetition."""
    n = clients.agg(F.greatest(F.lit(1), F.floor(F.count("*") * share)).alias("take"))
    each = clients.select("client", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).join(F.broadcast(n))
    return each.withColumn("r", F.row_number().over(Window.partitionBy("round").orderBy(token("client", "round", F.lit(seed)), "client"))).filter("r <= take").select("round", "client")


def sample_ids(ids: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``k`` different ids (id) in a random order that depends on the seed alone (E9, O11); all of them if there are fewer."""
    return ids.select("id").filter("id is not null").distinct().orderBy(token("id", F.lit(seed)), "id").limit(k)


#: Fixed value: the text that stands for a missing one.
MISSING = "__MISSING__"


def filled(df: DataFrame, numeric: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """``df`` without missing values (E16): numbers that are null, NaN or infinite become 0, texts that are null ``MISSING``."""
    number = lambda c: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")), 0.0).otherwise(F.col(c).cast("double"))
    return df.withColumns({c: number(c) for c in numeric} | {c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in texts})


def class_labels(df: DataFrame, col: str, binary: bool) -> DataFrame:
    """``df`` with ``y`` (E22): the code of its class, or whether it lies above the mean (numbers) or is the most frequent
    class (texts).  A column of one class is an error and isn't tampered with; null labels are left out."""
    held = df.filter(F.col(col).isNotNull())
    kinds = held.select(col).distinct().limit(2).count()
    if kinds < 2:
        raise ValueError(f"{col} has {kinds} class(es)")
    if not binary:
        return encode(held, col, dictionary(held, col)).withColumnRenamed(f"{col}_code", "y")
    if dict(df.dtypes)[col] == "string":
        top = top_classes(held, col, 2).select(F.col("value").alias("_top"))
        return held.join(F.broadcast(top)).withColumn("y", (F.col(col) == F.col("_top")).cast("int")).drop("_top")
    mean = held.agg(F.avg(col).alias("_mean"))
    return held.join(F.broadcast(mean)).withColumn("y", (F.col(col) > F.col("_mean")).cast("int")).drop("_mean")


def hash_labels(df: DataFrame, col: str) -> DataFrame:
    """``df`` with ``y`` 0 or 1 from a hash of the value (E23), the same in every process; null stays null."""
    return df.withColumn("y", F.when(F.col(col).isNotNull(), (draw(col, 0) < 0.5).cast("int")))


#: Names of a target column, and parts of names.
TARGETS, TARGET_PARTS = ["label", "target", "class", "y"], ["protein", "gene", "classification"]


def target_column(columns: Sequence[str]) -> str:
    """The target among columns (L11): the first with a known name or part of one, else the last."""
    known = (c for c in columns if c.lower() in TARGETS or any(p in c.lower() for p in TARGET_PARTS))
    return next(known, columns[-1])


def varying(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> list[str]:
    """The columns that aren't constant in both splits."""
    two = [df.agg(*((F.min(c) != F.max(c)).alias(c) for c in cols)).first() for df in (train, test)]
    return [c for c in cols if any(r[c] for r in two)]
