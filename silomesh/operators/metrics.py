"""Evaluation metrics over (y, score) or (y, pred) rows.

Counts come from one aggregation over distinct scores, so ties share one point of a curve.  A metric whose denominator is
zero is 0; AUC and AP are null when one class is missing.  Null labels and scores are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silomesh.operators.encode import range_slices


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def curve(scored: DataFrame) -> DataFrame:
    """(score, tp, fp, n_pos, n_neg): cumulative counts at each distinct score, from the highest.

    Running sums are taken inside ranges of the score and shifted by the sums of the ranges above, so no task orders all
    scores.
    """
    held = scored.filter("y is not null and score is not null")
    by_score = range_slices(held.groupBy("score").agg(F.sum(F.col("y").cast("bigint")).alias("pos"), F.count("*").alias("n")), [F.desc("score")])
    totals = by_score.groupBy("_slice").agg(F.sum("pos").alias("_p"), F.sum("n").alias("_n"))  # one row for each range
    above = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select("_slice", F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_p"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_n"), F.sum("_p").over(Window.partitionBy()).alias("n_pos"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    down = Window.partitionBy("_slice").orderBy(F.desc("score"))
    run = by_score.withColumns({"_tp": F.sum("pos").over(down), "_seen": F.sum("n").over(down)}).join(F.broadcast(shift), "_slice")
    tp, seen = F.col("_tp") + F.col("_p"), F.col("_seen") + F.col("_n")
    return run.select("score", tp.alias("tp"), (seen - tp).alias("fp"), "n_pos", (F.col("_all") - F.col("n_pos")).alias("n_neg"), "pos", "n")


def roc(scored: DataFrame) -> DataFrame:
    """One row: AUC, the score with the largest tpr - fpr (the highest on ties) and that difference (Q1)."""
    c = curve(scored).withColumns({"tpr": F.col("tp") / F.col("n_pos"), "fpr": F.col("fp") / F.col("n_neg")})
    neg = F.col("n") - F.col("pos")
    area = F.sum(neg * (F.col("tp") - F.col("pos") / 2)) / F.nullif(F.max(F.col("n_pos") * F.col("n_neg")), F.lit(0))
    j = F.col("tpr") - F.col("fpr")
    return c.agg(area.alias("auc"), F.max_by("score", F.struct(j, "score")).alias("threshold"), F.max(j).alias("youden"))


def at_threshold(scored: DataFrame, t: float) -> DataFrame:
    """One row: precision, recall, F1 and accuracy of score >= t (Q2)."""
    hit, y = F.col("score") >= t, F.col("y") == 1
    c = scored.filter("y is not null and score is not null").agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("tp", "fp", "fn", "tn", p.alias("precision"), r.alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("accuracy"))


def average_precision(scored: DataFrame) -> DataFrame:
    """One row: average precision and the best F1 of the precision-recall curve with its score (Q3)."""
    c = curve(scored)
    p = F.col("tp") / (F.col("tp") + F.col("fp"))
    r = F.col("tp") / F.col("n_pos")
    f1 = 2 * p * r / (p + r + 1e-8)
    return c.agg(F.sum(F.col("pos") / F.col("n_pos") * p).alias("average_precision"), F.max(f1).alias("best_f1"), F.max_by("score", F.struct(f1, "score")).alias("best_score"))


def confusion(rows: DataFrame) -> DataFrame:
    """(y, pred, n, percent): percent within the true class (Q4)."""
    n = rows.groupBy("y", "pred").agg(F.count("*").alias("n"))
    return n.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("y")))


def class_scores(rows: DataFrame) -> DataFrame:
    """(class, support, precision, recall, f1) (Q5, Q6)."""
    n = confusion(rows)
    true = n.groupBy(F.col("y").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    said = n.groupBy(F.col("pred").alias("class")).agg(F.sum("n").alias("said"))
    c = true.join(said, "class", "full").fillna(0)
    return c.select("class", "support", ratio(F.col("tp"), F.col("said")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("said") + F.col("support")).alias("f1"))


def averaged(rows: DataFrame, how: str = "weighted") -> DataFrame:
    """One row: weighted by support (Q5) or macro (Q6) precision, recall and F1, and accuracy."""
    c = class_scores(rows)
    mean = (lambda x: F.sum(F.col(x) * F.col("support")) / F.sum("support")) if how == "weighted" else F.avg
    acc = F.sum(F.col("recall") * F.col("support")) / F.sum("support")
    return c.agg(*(mean(x).alias(x) for x in ("precision", "recall", "f1")), acc.alias("accuracy"))


def regression(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """MSE, RMSE, MAE and R2 of (y, pred) (Q7); R2 is null for a constant y."""
    e = F.col("y") - F.col("pred")
    ss = F.var_pop("y") * F.count("*")
    return rows.filter("y is not null and pred is not null").groupBy(*keys).agg(F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / F.nullif(ss, F.lit(0.0))).alias("r2"))


def dirichlet_alpha(labels: DataFrame) -> DataFrame:
    """(pair, alpha) by the method of moments from (pair, side, class) rows (Q9): sum q (1 - q) / sum var - 1.

    One class gives 100, equal sides give infinity, a negative estimate gives 0.
    """
    n = labels.groupBy("pair", "side", "class").agg(F.count("*").alias("n"))
    total = n.groupBy("pair", "side").agg(F.sum("n").alias("total"))
    sides = total.join(n.select("pair", "class").distinct(), "pair").join(n, ["pair", "side", "class"], "left")
    p = sides.withColumn("p", F.coalesce("n", F.lit(0)) / F.col("total")).groupBy("pair", "class").agg(F.avg("p").alias("q"), F.var_samp("p").alias("v"))
    s = p.groupBy("pair").agg(F.sum(F.col("q") * (1 - F.col("q"))).alias("a"), F.sum("v").alias("v"), F.count("*").alias("k"))
    return s.select("pair", F.when(F.col("k") <= 1, 100.0).when(F.col("v") <= 1e-15, F.lit(float("inf"))).otherwise(F.greatest(F.lit(0.0), F.col("a") / F.col("v") - 1)).alias("alpha"))


def info_nce(rows: DataFrame, temperature: float = 0.5) -> DataFrame:
    """(anchor, loss): -log softmax of the positive among (anchor, is_positive, s) (Q11)."""
    z = F.col("s") / temperature
    top = rows.groupBy("anchor").agg(F.max(z).alias("m"))
    return rows.join(top, "anchor").groupBy("anchor").agg((F.max("m") + F.log(F.sum(F.exp(z - F.col("m")))) - F.max(F.when(F.col("is_positive"), z))).alias("loss"))


def outlying_negatives(scored: DataFrame) -> DataFrame:
    """Rows with label 0 at or above the score with the best F1 (F18), with that score as ``bar``."""
    return scored.filter("y = 0").join(F.broadcast(average_precision(scored).select(F.col("best_score").alias("bar")))).filter("score >= bar")
