"""The dataflow core of collaborative learning.

Weights are long form (client, layer, idx, value); aggregations are weighted sums per (layer, idx).  Local training adds up
gradients over the rows of each client.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silomesh.runtime import Workspace


def fedavg(weights: DataFrame, sizes: DataFrame) -> DataFrame:
    """(layer, idx, value): mean of the clients' weights by their rows (L1, L2); ``sizes`` is (client, n)."""
    w = weights.join(sizes, "client")
    return w.groupBy("layer", "idx").agg((F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("value"))


def masked_mean(weights: DataFrame, masks: DataFrame) -> DataFrame:
    """(layer, idx, value): input weights over the clients that own the feature, others plain.

    ``masks`` is (client, layer, idx, mask) and covers the input layer.
    """
    m = weights.join(masks, ["client", "layer", "idx"], "left").withColumn("mask", F.coalesce("mask", F.lit(1.0)))
    masked = F.sum(F.col("value") * F.col("mask")) / (F.sum("mask") + 1e-8)
    return m.groupBy("layer", "idx").agg(F.when(F.max("layer") == "input", masked).otherwise(F.avg("value")).alias("value"))


def attention_mean(weights: DataFrame, edges: DataFrame, self_weight: float = 0.7) -> DataFrame:
    """(client, layer, idx, value): own weights and the softmax-weighted neighbours' (L8); ``edges`` is (client, other, score)."""
    by = Window.partitionBy("client")
    e = edges.withColumn("m", F.max("score").over(by)).withColumn("x", F.exp(F.col("score") - F.col("m")))
    a = e.withColumn("a", F.col("x") / F.sum("x").over(by)).select("client", "other", "a")
    near = a.join(weights.withColumnRenamed("client", "other"), "other").groupBy("client", "layer", "idx").agg(F.sum(F.col("a") * F.col("value")).alias("near"))
    out = weights.join(near, ["client", "layer", "idx"], "left")
    return out.select("client", "layer", "idx", F.when(F.col("near").isNull(), F.col("value")).otherwise(self_weight * F.col("value") + (1 - self_weight) * F.col("near")).alias("value"))


def scaffold_step(global_c: DataFrame, delta_c: DataFrame, sizes: DataFrame, textbook: bool = True) -> DataFrame:
    """(layer, idx, value): the new global control variate c + mean delta (L3); ``textbook=False`` overwrites it."""
    mean = fedavg(delta_c, sizes)
    if not textbook:
        return mean
    return global_c.join(mean.withColumnRenamed("value", "d"), ["layer", "idx"], "left").select("layer", "idx", (F.col("value") + F.coalesce("d", F.lit(0.0))).alias("value"))


def vote(predictions: DataFrame, votes: int) -> DataFrame:
    """(sample, class): class with the largest probability sum over the clients with the lowest outlier score (L4).

    ``predictions`` is (sample, client, outlier, class, prob).
    """
    best = predictions.select("sample", "client", "outlier").distinct().withColumn("r", F.row_number().over(Window.partitionBy("sample").orderBy("outlier", "client"))).filter(F.col("r") <= votes)
    s = predictions.join(best.select("sample", "client"), ["sample", "client"]).groupBy("sample", "class").agg(F.sum("prob").alias("p"))
    return s.groupBy("sample").agg(F.max_by("class", F.struct(F.round("p", 9), -F.col("class"))).alias("class"))


def confidence_weights(soft: DataFrame, classes: int) -> DataFrame:
    """(client, weight): share of smoothing confidence sum deg p ln p + sum deg classes / e.

    ``soft`` is (client, node, degree, p) rows for each node and class.
    """
    c = soft.groupBy("client").agg(F.sum(F.col("degree") * F.col("p") * F.log(F.col("p") + 1e-12)).alias("h"), (F.sum("degree") / classes).alias("deg"))
    conf = c.withColumn("conf", F.col("h") + F.col("deg") * classes * float(np.exp(-1)))
    return conf.select("client", (F.col("conf") / F.sum("conf").over(Window.partitionBy())).alias("weight"))


def train_logistic(rows: DataFrame, features: Sequence[str], label: str, start: DataFrame | None = None, steps: int = 20, rate: float = 0.5, mu: float = 0.0) -> DataFrame:
    """(client, layer, idx, value, n): logistic regression of each client by full gradient descent.

    ``start`` gives the global weights; ``mu`` pulls the local weights towards them.  A step adds up the gradients of all
    rows where they are and moves one row of weights for each client, so a client of any size is trained as a whole.  Rows
    with nulls are left out; the last weight is the intercept.
    """
    spark, d = rows.sparkSession, len(features) + 1
    first = [0.0] * d
    if start is not None:
        for r in start.collect():  # as many rows as features
            first[r["idx"]] = r["value"]
    work = Workspace(spark, "logistic")
    held = work.write(rows.select("client", *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)), F.lit(1.0).alias(f"x{d - 1}"), F.col(label).cast("double").alias("y")).dropna())
    weights = work.write(held.groupBy("client").agg(F.count("*").alias("n"), *(F.lit(w).alias(f"w{i}") for i, w in enumerate(first))))
    for _ in range(steps):
        z = sum((F.col(f"w{i}") * F.col(f"x{i}") for i in range(1, d)), F.col("w0") * F.col("x0"))
        gap = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))) - F.col("y")
        sums = held.join(weights, "client").groupBy("client").agg(*(F.sum(gap * F.col(f"x{i}")).alias(f"g{i}") for i in range(d)))
        step = [(F.col(f"w{i}") - rate * (F.col(f"g{i}") / F.col("n") + mu * (F.col(f"w{i}") - first[i]))).alias(f"w{i}") for i in range(d)]
        new = work.write(weights.join(sums, "client").select("client", "n", *step))
        work.drop(weights)
        weights = new
    long = F.array(*(F.struct(F.lit("linear").alias("layer"), F.lit(i).alias("idx"), F.col(f"w{i}").alias("value")) for i in range(d)))
    return weights.select("client", F.inline(long), "n")


def rounds(rows: DataFrame, features: Sequence[str], label: str, n_rounds: int = 3, mu: float = 0.0, steps: int = 20) -> DataFrame:
    """Global weights after rounds of local training and averaging."""
    state = None
    for _ in range(n_rounds):
        local = train_logistic(rows, features, label, state, steps, mu=mu)
        state = rows.sparkSession.createDataFrame(fedavg(local.drop("n"), local.select("client", "n").distinct()).collect(), "layer string, idx int, value double")
    return state


def baselines(rows: DataFrame, features: Sequence[str], label: str, steps: int = 20) -> DataFrame:
    """(kind, client, n, accuracy): each client trained alone and scored on its own rows (solo), and all rows trained as one
    party and scored by client (combined) (L10)."""
    alone = train_logistic(rows, features, label, steps=steps)
    one = train_logistic(rows.withColumn("client", F.lit("all")), features, label, steps=steps)
    wide = lambda w, *keys: w.groupBy(*keys).agg(*(F.max(F.when(F.col("idx") == i, F.col("value"))).alias(f"_w{i}") for i in range(len(features) + 1)))
    z = sum((F.col(c) * F.col(f"_w{i}") for i, c in enumerate(features)), F.col(f"_w{len(features)}"))
    right = ((z >= 0).cast("int") == F.col(label)).cast("double")
    score = lambda met, kind: met.groupBy("client").agg(F.count("*").alias("n"), F.avg(right).alias("accuracy")).select(F.lit(kind).alias("kind"), "client", "n", "accuracy")
    held = rows.dropna(subset=[*features, label])
    return score(held.join(wide(alone, "client"), "client"), "solo").unionByName(score(held.join(F.broadcast(wide(one, F.lit(1).alias("_one")).drop("_one"))), "combined"))


def tree_model(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, trees: int = 50, depth: int = 6) -> DataFrame:
    """``test`` with ``score``, the probability by boosted trees over pooled or aligned rows (L6); nulls count as 0."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    held = VectorAssembler(inputCols=list(features), outputCol="_x")
    zero = lambda df: df.fillna(0, subset=list(features))
    model = GBTClassifier(featuresCol="_x", labelCol=label, maxIter=trees, maxDepth=depth, seed=1).fit(held.transform(zero(train)))
    return model.transform(held.transform(zero(test))).withColumn("score", F.element_at(vector_to_array("probability"), 2)).drop("_x", "rawPrediction", "probability", "prediction")


def predict(rows: DataFrame, features: Sequence[str], weights: DataFrame) -> DataFrame:
    """``rows`` with ``score``, the sigmoid of the weighted features (M7)."""
    w = {r["idx"]: r["value"] for r in weights.collect()}
    z = sum((F.col(c) * w.get(i, 0.0) for i, c in enumerate(features)), F.lit(w.get(len(features), 0.0)))
    return rows.withColumn("score", 1 / (1 + F.exp(-z)))
