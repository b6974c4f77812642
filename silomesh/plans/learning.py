"""Queries over metrics, encodings and collaborative learning, with their SQL.

Orders and their lines stand for labelled rows: a party is a customer segment, the label is whether a line was returned and
the score is a function of price and discount.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from silomesh.operators import encode, federated, metrics, profile
from silomesh.runtime import read
from silomesh.sources import catalog as cat

R6 = lambda c: F.round(c, 6).alias(c)


def _scored(spark, d):
    s = F.col("l_extendedprice") / 10000 + F.col("l_discount")
    return read(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), s.alias("score"), "l_orderkey", "l_linenumber", "l_suppkey")


def _classed(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_returnflag").alias("y"), F.when(F.col("l_discount") > 0.06, "A").when(F.col("l_quantity") > 30, "N").otherwise("R").alias("pred"), "l_linestatus", "l_suppkey")


def q1_roc(spark, d):
    """AUC and the threshold with the largest difference of rates."""
    return metrics.roc(_scored(spark, d)).select(R6("auc"), R6("threshold"), R6("youden"))


def q2_at_threshold(spark, d):
    """Q2: counts, precision, recall, F1 and accuracy at a threshold."""
    return metrics.at_threshold(_scored(spark, d), 3.0).select("tp", "fp", "fn", "tn", R6("precision"), R6("recall"), R6("f1"), R6("accuracy"))


def f18_outlying_negatives(spark, d):
    """lines that weren't returned with a score at or above the one with the best F1."""
    return metrics.outlying_negatives(_scored(spark, d)).select("l_orderkey", "l_linenumber", R6("score"), R6("bar"))


def q3_average_precision(spark, d):
    """Q3: average precision and the best F1."""
    return metrics.average_precision(_scored(spark, d)).select(R6("average_precision"), R6("best_f1"), R6("best_score"))


def q4_confusion(spark, d):
    """Q4: confusion matrix with percentages."""
    return metrics.confusion(_classed(spark, d)).select("y", "pred", "n", R6("percent"))


def q5_weighted_scores(spark, d):
    """Q5: support-weighted precision, recall, F1 and accuracy."""
    return metrics.averaged(_classed(spark, d)).select(R6("precision"), R6("recall"), R6("f1"), R6("accuracy"))


def q6_macro_scores(spark, d):
    """Q6: macro precision, recall and F1."""
    return metrics.averaged(_classed(spark, d), "macro").select(R6("precision"), R6("recall"), R6("f1"))


def q7_regression(spark, d):
    """Q7: regression errors by line status."""
    rows = read(spark, d, "lineitem").select("l_linestatus", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("pred"))
    return metrics.regression(rows, ["l_linestatus"]).select("l_linestatus", *(F.round(c, 3).alias(c) for c in ("mse", "rmse", "mae")), R6("r2"))


def q9_dirichlet_alpha(spark, d):
    """Q9: label skew between two parties for each supplier group."""
    rows = read(spark, d, "lineitem").select((F.col("l_suppkey") % 7).alias("pair"), F.when(F.col("l_linestatus") == "O", 0).otherwise(1).alias("side"), F.col("l_returnflag").alias("class"))
    return metrics.dirichlet_alpha(rows).select("pair", F.round("alpha", 3).alias("alpha"))


def q11_info_nce(spark, d):
    """Q11: contrastive loss of each order with its first line as the positive."""
    rows = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("anchor"), F.col("l_linenumber").alias("k")).agg((F.max("l_discount") * 5).alias("s"))
    first = rows.groupBy("anchor").agg(F.min("k").alias("k1"))
    return metrics.info_nce(rows.join(first, "anchor").withColumn("is_positive", F.col("k") == F.col("k1"))).select("anchor", R6("loss"))


def q12_client_accuracy(spark, d):
    """Accuracy by client, weighted by rows and as a macro mean."""
    by = _classed(spark, d).groupBy((F.col("l_suppkey") % 10).alias("client")).agg(F.avg((F.col("y") == F.col("pred")).cast("double")).alias("acc"), F.count("*").alias("n"))
    return by.agg(F.round(F.sum(F.col("acc") * F.col("n")) / F.sum("n"), 6).alias("weighted"), F.round(F.avg("acc"), 6).alias("macro"))


def q14_pooled_scores(spark, d):
    """Q14: metrics of the test rows of all clients pooled: AUC and the scores at a threshold."""
    rows = _scored(spark, d).filter("l_linenumber % 2 = 0")
    one = metrics.roc(rows).select(R6("auc"))
    return one.join(F.broadcast(metrics.at_threshold(rows, 3.0).select(R6("f1"), R6("accuracy"))))


def q13_unseen_classes(spark, d):
    """Part types coded by what the cheapest parts have; unseen ones get the fallback."""
    part = read(spark, d, "part")
    seen = part.filter("p_retailprice < 902")
    return encode.encode(part.select("p_type"), "p_type", encode.dictionary(seen, "p_type"), 0).groupBy("p_type_code").agg(F.count("*").alias("n"))


def e1_split_counts(spark, d):
    """Stratified split, counted by class."""
    o = encode.split(read(spark, d, "orders"), "o_orderkey", 0.2, 42, ["o_orderstatus"])
    return o.groupBy("o_orderstatus", "part").agg(F.count("*").alias("n"))


def e1_split_rows(spark, d):
    """The part of every order in the stratified split."""
    return encode.split(read(spark, d, "orders"), "o_orderkey", 0.2, 42, ["o_orderstatus"]).select("o_orderkey", "o_orderstatus", "part")


def e4_pair_split(spark, d):
    """Links of silos in train, validation and test parts of 70, 10 and 20 %, in a random order."""
    e = cat.edges(spark, d).filter("similarity >= 0.9").select("src", "tgt")
    n = e.agg(F.count("*").alias("n"))
    at = encode.position(e, [], ["src", "tgt", F.lit(1)]).join(F.broadcast(n))
    part = F.when(F.col("pos") < F.floor(F.col("n") * 0.7), "train").when(F.col("pos") < F.floor(F.col("n") * 0.7) + F.floor(F.col("n") * 0.1), "val").otherwise("test")
    return at.select("src", "tgt", part.alias("part"))


def e9_sampled_silos(spark, d):
    """Forty silos drawn without replacement."""
    return encode.sample_ids(cat.tables(spark, d).select(F.col("db").alias("id")), 40, 7)


def e16_filled(spark, d):
    """Statistics with null, NaN and infinite numbers as 0 and missing ids as text, counted by id."""
    s = read(spark, d, "column_sparsity").select("stat_id", "db_id", "sparsity", "load_no")
    return encode.filled(s, ["sparsity"], ["db_id"]).groupBy("db_id").agg(F.count("*").alias("n"), F.round(F.sum("sparsity"), 6).alias("total"))


def e22_class_labels(spark, d):
    """Binary labels of a number and of a text, and codes of its classes."""
    c = read(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    one = encode.class_labels(c, "c_acctbal", True).select("c_custkey", F.col("y").alias("rich"))
    two = encode.class_labels(c, "c_mktsegment", True).select("c_custkey", F.col("y").alias("frequent"))
    three = encode.class_labels(c, "c_mktsegment", False).select("c_custkey", F.col("y").alias("segment"))
    return one.join(two, "c_custkey").join(three, "c_custkey")


def e23_hash_labels(spark, d):
    """Labels from a hash of the customer's name."""
    return encode.hash_labels(read(spark, d, "customer").select("c_custkey", "c_name"), "c_name").select("c_custkey", "y")


def l11_target_columns(spark, d):
    """The target column of each table."""
    names = ("customer", "orders", "part", "supplier", "embeddings", "events")
    return spark.createDataFrame([(n, encode.target_column(read(spark, d, n).columns)) for n in names], "table_name string, target string")


def l6_varying_columns(spark, d):
    """Pooled rows of two parties without the columns that are constant in both splits, as rows for a tree model."""
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", F.lit(1.0).alias("unit"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    at = encode.split(li.withColumn("key", F.concat_ws("|", "l_orderkey", "l_linenumber")), "key", 0.2, 5)
    cols = encode.varying(at.filter("part = 'train'"), at.filter("part = 'test'"), ["l_quantity", "l_discount", "unit"])
    ready = encode.filled(at, cols, [])
    return ready.groupBy("part").agg(F.count("*").alias("n"), F.lit(",".join(cols)).alias("features"), *(F.round(F.avg(c), 5).alias(f"mean_{c}") for c in ("l_quantity", "l_discount")))


def l5_aligned_parties(spark, d):
    """Rows of two parties aligned on the linking column in one order, as batches for training on both sides."""
    a = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    b = read(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey", "c_acctbal")
    met = a.join(b, F.col("o_custkey") == F.col("c_custkey"))
    batch = F.floor(F.col("pos") / 256)
    return encode.position(met, [], ["o_orderkey", F.lit(3)]).groupBy(batch.alias("batch")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("left_sum"), F.round(F.sum("c_acctbal"), 2).alias("right_sum"))


def e13_label_codes(spark, d):
    """One dictionary over all parties."""
    return encode.dictionary(read(spark, d, "customer"), "c_mktsegment").select("value", F.col("code").cast("bigint").alias("code"))


def e15_local_codes(spark, d):
    """Contiguous class codes of each client."""
    c = read(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct()
    return c.withColumn("code", F.dense_rank().over(Window.partitionBy("c_nationkey").orderBy("c_mktsegment")) - 1)


def e17_standardised(spark, d):
    """Customers scaled by the terms of the train part, summarised by segment."""
    c = read(spark, d, "customer")
    train = c.filter("c_custkey % 5 <> 0")
    z = encode.standardise(c, ["c_acctbal"], encode.scale_terms(train, ["c_acctbal"]))
    return z.groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 5).alias("mean_z"), F.round(F.max("c_acctbal"), 5).alias("max_z"))


def e18_standardised_by_client(spark, d):
    """Scaling by each nation's own mean and deviation."""
    c = read(spark, d, "customer")
    t = c.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("c_acctbal_mean"), F.stddev_pop("c_acctbal").alias("s")).select("c_nationkey", "c_acctbal_mean", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("c_acctbal_sd"))
    return encode.standardise(c, ["c_acctbal"], t, ["c_nationkey"]).select("c_custkey", F.round("c_acctbal", 5).alias("z"))


def e19_min_max(spark, d):
    """Labels scaled to [0, 1] by the pooled range."""
    p = read(spark, d, "part")
    m = p.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    return p.join(F.broadcast(m)).select("p_partkey", F.round((F.col("p_retailprice") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), 6).alias("scaled"))


def e20_clean_plan(spark, d):
    """Kind of each column of the customers and whether it stays."""
    c = read(spark, d, "customer").withColumn("constant", F.lit("x"))
    return encode.clean_plan(profile.column_profile(profile.cells(c, ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "constant"])))


def e21_binned_labels(spark, d):
    """Prices at the nearest of four bins."""
    return read(spark, d, "part").groupBy(encode.nearest_bin(F.col("p_retailprice"), [900, 1200, 1500, 1800]).alias("bin")).agg(F.count("*").alias("n"))


def e25_feature_signal(spark, d):
    """Mutual information and correlation with the label."""
    li = read(spark, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return encode.mutual_information(li, "l_linestatus", "l_returnflag").join(F.broadcast(li.agg(F.abs(F.corr("l_quantity", "y")).alias("corr")))).select(R6("mi"), R6("corr"))


def e10_value_samples(spark, d):
    """The three most frequent values of the categorical columns."""
    counts = profile.cells(read(spark, d, "part"), ["p_brand", "p_type"]).groupBy("column_name", "value").agg(F.count("*").alias("n"))
    return encode.sample_values(counts, ["column_name"], 3, "frequent").select("column_name", "rank", "value", "n")


def e10_value_samples_random(spark, d):
    """Random, weighted and priority samples."""
    counts = profile.cells(read(spark, d, "part"), ["p_brand", "p_type"]).groupBy("column_name", "value").agg(F.count("*").alias("n"))
    out = None
    for mode in ("random", "weighted", "priority"):
        one = encode.sample_values(counts, ["column_name"], 3, mode).select(F.lit(mode).alias("mode"), "column_name", "rank", "value")
        out = one if out is None else out.unionByName(one)
    return out


def e11_bootstrap(spark, d):
    """Twenty bootstrap means of the account balance."""
    return encode.poisson_bootstrap(read(spark, d, "customer"), "c_acctbal", "c_custkey").select("draw", F.round("mean", 5).alias("mean"))


def e24_outliers(spark, d):
    """Synthetic outliers, as many as rows."""
    return encode.outliers(read(spark, d, "part"), ["p_retailprice", "p_size"], "p_partkey").select("p_partkey", F.round("p_retailprice", 4).alias("p_retailprice"), F.round("p_size", 4).alias("p_size"), "outlier")


def e28_sampled_clients(spark, d):
    """The clients that take part in each of three rounds."""
    c = read(spark, d, "nation").select(F.col("n_nationkey").alias("client"))
    return encode.sample_clients(c, 3, 0.3)


def o6_top_classes(spark, d):
    """Part types as nine frequent classes and the rest."""
    part = read(spark, d, "part")
    return encode.encode(part.select("p_type"), "p_type", encode.top_classes(part, "p_type", 4).withColumnRenamed("idx", "code"), 0).groupBy("p_type_code").agg(F.count("*").alias("n"))


def _weights(spark, d):
    li = read(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 5).cast("int").alias("client"), F.when(F.col("l_linestatus") == "O", "input").otherwise("head").alias("layer"), F.col("l_linenumber").alias("idx"))
    return li.agg(F.round(F.avg("l_discount"), 6).alias("value"), F.count("*").alias("rows"))


def _sizes(spark, d):
    return read(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 5).cast("int").alias("client")).agg(F.count("*").alias("n"))


def l1_fedavg(spark, d):
    """L1: weights averaged by client size."""
    return federated.fedavg(_weights(spark, d), _sizes(spark, d)).select("layer", "idx", F.round("value", 8).alias("value"))


def l3_scaffold(spark, d):
    """The textbook control variate update."""
    w = _weights(spark, d)
    c = w.groupBy("layer", "idx").agg(F.lit(0.5).alias("value"))
    return federated.scaffold_step(c, w, _sizes(spark, d)).select("layer", "idx", F.round("value", 8).alias("value"))


def l4_vote(spark, d):
    """L4: one-shot votes of the two least outlying clients."""
    w = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample"), (F.col("l_suppkey") % 3).cast("int").alias("client"))
    p = w.agg(F.round(F.max("l_tax"), 4).alias("outlier"), F.round(F.avg("l_discount"), 4).alias("p")).select("sample", "client", "outlier", F.inline(F.array(F.struct(F.lit(0).alias("class"), F.col("p").alias("prob")), F.struct(F.lit(1).alias("class"), (0.1 - F.col("p")).alias("prob")))))
    return federated.vote(p, 2)


def l7_masked_mean(spark, d):
    """Input weights averaged over the clients that own the feature."""
    w = _weights(spark, d)
    masks = w.filter("layer = 'input'").select("client", "layer", "idx", F.when((F.col("client") + F.col("idx")) % 2 == 0, 1.0).otherwise(0.0).alias("mask"))
    return federated.masked_mean(w, masks).select("layer", "idx", F.round("value", 7).alias("value"))


def l8_attention(spark, d):
    """neighbours' weights by softmax attention, over given links of each client to the next two."""
    w = _weights(spark, d)
    e = w.select("client").distinct().select("client", F.explode(F.array((F.col("client") + 1) % 5, (F.col("client") + 2) % 5)).alias("other")).withColumn("score", (F.col("client") * F.col("other")) / 10.0)
    return federated.attention_mean(w, e).select("client", "layer", "idx", F.round("value", 7).alias("value"))


def l9_confidence(spark, d):
    """Aggregation weights from smoothing confidence."""
    n = read(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 5).cast("int").alias("client"), F.col("l_linenumber").alias("node"), "l_returnflag").agg(F.count("*").alias("k"))
    t = n.groupBy("client", "node").agg(F.sum("k").alias("degree"))
    return federated.confidence_weights(n.join(t, ["client", "node"]).select("client", "node", F.col("degree").cast("double").alias("degree"), (F.col("k") / F.col("degree")).alias("p")), 3).select("client", R6("weight"))


def _trained(spark, d):
    return read(spark, d, "lineitem").select((F.col("l_suppkey") % 4).cast("int").alias("client"), (F.col("l_quantity") / 50).alias("q"), (F.col("l_discount") * 10).alias("x"), (F.col("l_returnflag") == "R").cast("int").alias("y"))


def l15_local_training(spark, d):
    """Logistic weights of each client after eight steps over all of its rows."""
    return federated.train_logistic(_trained(spark, d), ["q", "x"], "y", steps=8).select("client", "idx", R6("value"), "n")


def l10_baselines(spark, d):
    """Accuracy of each client by its own model and by one model of all rows."""
    return federated.baselines(_trained(spark, d), ["q", "x"], "y", 4).select("kind", F.col("client").cast("int").alias("client"), "n", R6("accuracy"))


def l6_tree_model(spark, d):
    """Boosted trees on pooled rows, which must do no worse than the larger class on the rows held out."""
    li = read(spark, d, "lineitem").select(F.concat_ws("|", "l_orderkey", "l_linenumber").alias("key"), "l_quantity", "l_discount", "l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    at = encode.split(li, "key", 0.2, 5)
    scored = federated.tree_model(at.filter("part = 'train'"), at.filter("part = 'test'"), ["l_quantity", "l_discount", "l_extendedprice"], "y", 3, 3)
    acc, share = F.avg(((F.col("score") >= 0.5).cast("int") == F.col("y")).cast("double")), F.avg("y")
    return scored.agg(F.count("*").alias("n"), (acc >= F.greatest(share, 1 - share) - 0.01).alias("no_worse"))


def l16_federated_rounds(spark, d):
    """Two rounds of training with a pull to the global weights, and averaging, scored on all rows."""
    rows = _trained(spark, d)
    w = federated.rounds(rows, ["q", "x"], "y", 2, 0.1, 4)
    return metrics.at_threshold(federated.predict(rows, ["q", "x"], w), 0.25).select("tp", "fp", "fn", "tn", R6("f1"), R6("accuracy"))


QUERIES = {f.__name__: f for f in (
    q1_roc, q2_at_threshold, q3_average_precision, q4_confusion, q5_weighted_scores, q6_macro_scores, q7_regression, q9_dirichlet_alpha, q11_info_nce, q12_client_accuracy, q13_unseen_classes, q14_pooled_scores, e1_split_counts, e1_split_rows, e4_pair_split, e9_sampled_silos, e16_filled, e22_class_labels, e23_hash_labels, l11_target_columns, l6_varying_columns, l5_aligned_parties, f18_outlying_negatives, e13_label_codes, e15_local_codes, e17_standardised,
    e18_standardised_by_client, e19_min_max, e20_clean_plan, e21_binned_labels, e25_feature_signal, e10_value_samples, e10_value_samples_random, e11_bootstrap, e24_outliers, e28_sampled_clients, o6_top_classes, l1_fedavg, l3_scaffold, l4_vote, l7_masked_mean, l8_attention,
    l9_confidence, l15_local_training, l10_baselines, l6_tree_model, l16_federated_rounds,
)}

_SC = "s AS (SELECT CAST(l_returnflag = 'R' AS INT) AS y, l_extendedprice / 10000 + l_discount AS score, l_orderkey, l_linenumber FROM lineitem)"
_CU = f"""{_SC}, g AS (SELECT score, sum(y) AS pos, count(*) AS n FROM s GROUP BY 1), c AS (SELECT score, pos, n, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n - pos) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS np, sum(n - pos) OVER () AS nn FROM g)"""
_CL = "s AS (SELECT l_returnflag AS y, CASE WHEN l_discount > 0.06 THEN 'A' WHEN l_quantity > 30 THEN 'N' ELSE 'R' END AS pred, l_suppkey FROM lineitem)"
_PC = f"{_CL}, k AS (SELECT x AS class, count(*) FILTER (y = x) AS support, count(*) FILTER (pred = x) AS said, count(*) FILTER (y = x AND pred = x) AS tp FROM s, (SELECT unnest(['A', 'N', 'R']) AS x) GROUP BY 1), m AS (SELECT class, support, tp, coalesce(tp / nullif(said, 0), 0) AS p, tp / support AS r, 2 * tp / (said + support) AS f FROM k)"
_W = "w AS (SELECT CAST(l_suppkey % 5 AS INT) AS client, CASE WHEN l_linestatus = 'O' THEN 'input' ELSE 'head' END AS layer, l_linenumber AS idx, round(avg(l_discount), 6) AS value FROM lineitem GROUP BY 1, 2, 3), n AS (SELECT CAST(l_suppkey % 5 AS INT) AS client, count(*) AS n FROM lineitem GROUP BY 1)"

_EDGES = cat.SQL_EDGES
_ROWS = "r AS (SELECT CAST(l_suppkey % 4 AS INT) AS client, l_quantity / 50 AS q, l_discount * 10 AS x, CAST(l_returnflag = 'R' AS INT) AS y FROM lineitem), n AS (SELECT client, count(*) AS n FROM r GROUP BY 1)"


def _draw(key, seed):
    return f"CAST('0x' || substr(md5(concat_ws('|', {key}, {seed})), 1, 13) AS BIGINT) / 4503599627370496.0"


def _descend(name, a, b, c, steps, mu):
    """A recursive table (client, step, w0, w1, w2) of gradient steps over the rows of each client."""
    p = "1 / (1 + exp(-(w.w0 * r.q + w.w1 * r.x + w.w2))) - r.y"
    step = lambda w, x, start: f"any_value(w.{w}) - 0.5 * (avg(({p}) * {x}) + {mu} * (any_value(w.{w}) - {start}))"
    return f"""{name} AS (SELECT client, 0 AS step, CAST({a} AS DOUBLE) AS w0, CAST({b} AS DOUBLE) AS w1, CAST({c} AS DOUBLE) AS w2 FROM n
  UNION ALL SELECT w.client, w.step + 1, {step('w0', 'r.q', a)}, {step('w1', 'r.x', b)}, {step('w2', '1', c)} FROM {name} w JOIN r ON r.client = w.client WHERE w.step < {steps} GROUP BY w.client, w.step)"""


SQL = {
    "q1_roc": f"WITH {_CU} SELECT round(sum((n - pos) * (tp - pos / 2)) / max(np * nn), 6) AS auc, round(arg_max(score, ROW(tp / np - fp / nn, score)), 6) AS threshold, round(max(tp / np - fp / nn), 6) AS youden FROM c",
    "q2_at_threshold": f"WITH {_SC}, c AS (SELECT count(*) FILTER (score >= 3 AND y = 1) AS tp, count(*) FILTER (score >= 3 AND y = 0) AS fp, count(*) FILTER (score < 3 AND y = 1) AS fn, count(*) FILTER (score < 3 AND y = 0) AS tn FROM s) SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c",
    "q3_average_precision": f"WITH {_CU}, f AS (SELECT *, tp / (tp + fp) AS p, tp / np AS r FROM c), h AS (SELECT *, 2 * p * r / (p + r + 1e-8) AS f1 FROM f) SELECT round(sum(pos / np * p), 6) AS average_precision, round(max(f1), 6) AS best_f1, round(arg_max(score, ROW(f1, score)), 6) AS best_score FROM h",
    "q4_confusion": f"WITH {_CL} SELECT y, pred, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY y), 6) AS percent FROM s GROUP BY 1, 2",
    "q5_weighted_scores": f"WITH {_PC} SELECT round(sum(p * support) / sum(support), 6) AS precision, round(sum(r * support) / sum(support), 6) AS recall, round(sum(f * support) / sum(support), 6) AS f1, round(sum(tp) / sum(support), 6) AS accuracy FROM m",
    "q6_macro_scores": f"WITH {_PC} SELECT round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f), 6) AS f1 FROM m",
    "q7_regression": "WITH s AS (SELECT l_linestatus, l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem) SELECT l_linestatus, round(avg((y - p) ** 2), 3) AS mse, round(sqrt(avg((y - p) ** 2)), 3) AS rmse, round(avg(abs(y - p)), 3) AS mae, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2 FROM s GROUP BY 1",
    "q9_dirichlet_alpha": """WITH s AS (SELECT l_suppkey % 7 AS pair, CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS side, l_returnflag AS class FROM lineitem), n AS (SELECT pair, side, class, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT pair, side, count(*) AS t FROM s GROUP BY ALL), k AS (SELECT DISTINCT pair, class FROM s),
p AS (SELECT t.pair, k.class, avg(coalesce(n.n, 0) / t.t) AS q, var_samp(coalesce(n.n, 0) / t.t) AS v FROM t JOIN k ON k.pair = t.pair LEFT JOIN n ON n.pair = t.pair AND n.side = t.side AND n.class = k.class GROUP BY 1, 2)
SELECT pair, round(CASE WHEN count(*) <= 1 THEN 100 WHEN sum(v) <= 1e-15 THEN CAST('inf' AS DOUBLE) ELSE greatest(0, sum(q * (1 - q)) / sum(v) - 1) END, 3) AS alpha FROM p GROUP BY 1""",
    "q11_info_nce": """WITH r AS (SELECT l_orderkey AS anchor, l_linenumber AS k, max(l_discount) * 5 AS s FROM lineitem GROUP BY 1, 2), f AS (SELECT anchor, min(k) AS k1 FROM r GROUP BY 1)
SELECT r.anchor, round(ln(sum(exp(s / 0.5))) - max(CASE WHEN k = k1 THEN s / 0.5 END), 6) AS loss FROM r JOIN f ON f.anchor = r.anchor GROUP BY 1""",
    "q12_client_accuracy": f"WITH {_CL}, c AS (SELECT l_suppkey % 10 AS client, avg(CAST(y = pred AS INT)) AS acc, count(*) AS n FROM s GROUP BY 1) SELECT round(sum(acc * n) / sum(n), 6) AS weighted, round(avg(acc), 6) AS macro FROM c",
    "q14_pooled_scores": f"""WITH {_SC.replace('FROM lineitem', 'FROM lineitem WHERE l_linenumber % 2 = 0')}, g AS (SELECT score, sum(y) AS pos, count(*) AS n FROM s GROUP BY 1), c AS (SELECT pos, n, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(pos) OVER () AS np, sum(n - pos) OVER () AS nn FROM g),
k AS (SELECT count(*) FILTER (score >= 3 AND y = 1) AS tp, count(*) FILTER (score >= 3 AND y = 0) AS fp, count(*) FILTER (score < 3 AND y = 1) AS fn, count(*) AS n FROM s)
SELECT round((SELECT sum((n - pos) * (tp - pos / 2)) / max(np * nn) FROM c), 6) AS auc, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((n - fp - fn) / n, 6) AS accuracy FROM k""",
    "q13_unseen_classes": "WITH k AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM part WHERE p_retailprice < 902)) SELECT CAST(coalesce(code, 0) AS INT) AS p_type_code, count(*) AS n FROM part LEFT JOIN k USING (p_type) GROUP BY 1",
    "e1_split_counts": "WITH n AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT o_orderstatus, n, CAST(CASE WHEN n > 1 THEN ceil(n * 0.2) ELSE 0 END AS BIGINT) AS t FROM n) SELECT o_orderstatus, 'test' AS part, t AS n FROM s WHERE t > 0 UNION ALL SELECT o_orderstatus, 'train', n - t FROM s WHERE n > t",
    "e13_label_codes": "SELECT c_mktsegment AS value, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (SELECT DISTINCT c_mktsegment FROM customer)",
    "e15_local_codes": "SELECT DISTINCT c_nationkey, c_mktsegment, CAST(dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) - 1 AS INT) AS code FROM customer",
    "e17_standardised": "WITH t AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer WHERE c_custkey % 5 <> 0) SELECT c_mktsegment, round(avg((c_acctbal - m) / s), 5) AS mean_z, round(max((c_acctbal - m) / s), 5) AS max_z FROM customer, t GROUP BY 1",
    "e18_standardised_by_client": "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER w) / CASE WHEN stddev_pop(c_acctbal) OVER w > 0 THEN stddev_pop(c_acctbal) OVER w ELSE 1 END, 5) AS z FROM customer WINDOW w AS (PARTITION BY c_nationkey)",
    "e19_min_max": "SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS scaled FROM part",
    "e20_clean_plan": "SELECT 'constant' AS column_name, 'text' AS kind, false AS keep UNION ALL SELECT 'c_name', 'text', count(DISTINCT c_name) > 1 FROM customer UNION ALL SELECT 'c_nationkey', 'numeric', count(DISTINCT c_nationkey) > 1 FROM customer UNION ALL SELECT 'c_acctbal', 'numeric', count(DISTINCT c_acctbal) > 1 FROM customer UNION ALL SELECT 'c_mktsegment', 'text', count(DISTINCT c_mktsegment) > 1 FROM customer",
    "e21_binned_labels": "SELECT CAST(CASE WHEN p_retailprice <= 1050 THEN 900 WHEN p_retailprice <= 1350 THEN 1200 WHEN p_retailprice <= 1650 THEN 1500 ELSE 1800 END AS DOUBLE) AS bin, count(*) AS n FROM part GROUP BY 1",
    "e25_feature_signal": "WITH n AS (SELECT l_linestatus AS a, l_returnflag AS b, count(*) AS n FROM lineitem GROUP BY 1, 2), q AS (SELECT n, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM n) SELECT round(sum(n / t * ln(n * t / (na * nb))), 6) AS mi, (SELECT round(abs(corr(l_quantity, CAST(l_returnflag = 'R' AS INT))), 6) FROM lineitem) AS corr FROM q",
    "e10_value_samples": "WITH c AS (SELECT 'p_brand' AS column_name, p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part), n AS (SELECT column_name, value, count(*) AS n FROM c GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank FROM n) SELECT column_name, CAST(rank AS INT) AS rank, value, n FROM r WHERE rank <= 3",
    "e24_outliers": f"WITH t AS (SELECT stddev_pop(p_retailprice) AS a, stddev_pop(p_size) AS b FROM part), s AS (SELECT *, CASE WHEN {_draw('p_partkey', 3)} < 0.5 THEN 1 ELSE -1 END AS w FROM part) SELECT p_partkey, round(p_retailprice + w * 3 * a, 4) AS p_retailprice, round(p_size + w * 3 * b, 4) AS p_size, 1 AS outlier FROM s, t",
    "e28_sampled_clients": "WITH c AS (SELECT n_nationkey AS client, CAST(r AS INT) AS round, row_number() OVER (PARTITION BY r ORDER BY md5(concat_ws('|', n_nationkey, r, 4)), n_nationkey) AS k FROM nation, range(1, 4) x(r)) SELECT round, client FROM c WHERE k <= (SELECT greatest(1, floor(count(*) * 0.3)) FROM nation)",
    "e1_split_rows": "WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(concat_ws('|', o_orderkey, 42)), o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) SELECT o_orderkey, o_orderstatus, CASE WHEN n > 1 AND k <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS part FROM r",
    "e4_pair_split": f"WITH {_EDGES}, r AS (SELECT src, tgt, row_number() OVER (ORDER BY md5(concat_ws('|', src, tgt, 1)), src, tgt) - 1 AS k, count(*) OVER () AS n FROM e WHERE similarity >= 0.9) SELECT src, tgt, CASE WHEN k < floor(n * 0.7) THEN 'train' WHEN k < floor(n * 0.7) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS part FROM r",
    "e9_sampled_silos": "WITH t AS (SELECT DISTINCT try_cast(trim(db_id) AS BIGINT) AS id FROM schema_tables WHERE table_name IS NOT NULL AND try_cast(trim(db_id) AS BIGINT) IS NOT NULL) SELECT id FROM t ORDER BY md5(concat_ws('|', id, 7)), id LIMIT 40",
    "e16_filled": "SELECT coalesce(db_id, '__MISSING__') AS db_id, count(*) AS n, round(sum(CASE WHEN sparsity IS NULL OR isnan(sparsity) OR isinf(sparsity) THEN 0 ELSE sparsity END), 6) AS total FROM column_sparsity GROUP BY 1",
    "e22_class_labels": "WITH t AS (SELECT c_mktsegment AS s FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT c_custkey, CAST(c_acctbal > (SELECT avg(c_acctbal) FROM customer) AS INT) AS rich, CAST(c_mktsegment = (SELECT s FROM t) AS INT) AS frequent, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INT) AS segment FROM customer",
    "e23_hash_labels": f"SELECT c_custkey, CAST({_draw('c_name', 0)} < 0.5 AS INT) AS y FROM customer",
    "l11_target_columns": "SELECT * FROM (VALUES ('customer', 'c_mktsegment'), ('orders', 'o_orderpriority'), ('part', 'p_retailprice'), ('supplier', 's_acctbal'), ('embeddings', 'label'), ('events', 'props')) v(table_name, target)",
    "l6_varying_columns": "WITH r AS (SELECT l_quantity, l_discount, row_number() OVER (ORDER BY md5(concat_ws('|', l_orderkey, l_linenumber, 5)), l_orderkey, l_linenumber) AS k, count(*) OVER () AS n FROM lineitem) SELECT CASE WHEN k <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS part, count(*) AS n, 'l_quantity,l_discount' AS features, round(avg(l_quantity), 5) AS mean_l_quantity, round(avg(l_discount), 5) AS mean_l_discount FROM r GROUP BY 1",
    "l5_aligned_parties": "WITH r AS (SELECT o_totalprice, c_acctbal, row_number() OVER (ORDER BY md5(concat_ws('|', o_orderkey, 3)), o_orderkey) - 1 AS k FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0) SELECT CAST(floor(k / 256) AS BIGINT) AS batch, count(*) AS n, round(sum(o_totalprice), 2) AS left_sum, round(sum(c_acctbal), 2) AS right_sum FROM r GROUP BY 1",
    "f18_outlying_negatives": f"WITH {_CU}, f AS (SELECT score, 2 * (tp / (tp + fp)) * (tp / np) / (tp / (tp + fp) + tp / np + 1e-8) AS f1 FROM c), b AS (SELECT arg_max(score, ROW(f1, score)) AS bar FROM f) SELECT l_orderkey, l_linenumber, round(score, 6) AS score, round(bar, 6) AS bar FROM s, b WHERE y = 0 AND score >= bar",
    "e10_value_samples_random": f"""WITH c AS (SELECT 'p_brand' AS column_name, p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part), n AS (SELECT column_name, value, count(*) AS n, {_draw('value', 0)} AS h FROM c GROUP BY 1, 2),
r AS (SELECT 'random' AS mode, column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY h, value) AS rank FROM n UNION ALL SELECT 'weighted', column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY ln(1 - h) / n DESC, value) FROM n
  UNION ALL SELECT 'priority', column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY n / (h + 1e-9) DESC, value) FROM n) SELECT mode, column_name, CAST(rank AS INT) AS rank, value FROM r WHERE rank <= 3""",
    "e11_bootstrap": f"""WITH u AS (SELECT r AS draw, c_acctbal AS v, {_draw("concat_ws('-', c_custkey, r)", 9)} AS u FROM customer, range(20) x(r) WHERE c_acctbal IS NOT NULL), w AS (SELECT draw, v, list_sum(list_transform({encode.POISSON}, lambda p: CASE WHEN u >= p THEN 1 ELSE 0 END)) AS w FROM u)
SELECT CAST(draw AS INT) AS draw, round(sum(w * v) / sum(w), 5) AS mean FROM w GROUP BY 1""",
    "l15_local_training": f"WITH RECURSIVE {_ROWS}, {_descend('w', '0.0', '0.0', '0.0', 8, 0.0)} SELECT w.client, CAST(i AS INT) AS idx, round(CASE i WHEN 0 THEN w0 WHEN 1 THEN w1 ELSE w2 END, 6) AS value, n FROM w JOIN n USING (client), range(3) x(i) WHERE step = 8",
    "l10_baselines": f"""WITH RECURSIVE {_ROWS}, {_descend('w', '0.0', '0.0', '0.0', 4, 0.0)}, z AS (SELECT client AS at, q, x, y FROM r),
b AS (SELECT 0 AS step, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2 UNION ALL SELECT b.step + 1, any_value(w0) - 0.5 * avg((1 / (1 + exp(-(w0 * q + w1 * x + w2))) - y) * q), any_value(w1) - 0.5 * avg((1 / (1 + exp(-(w0 * q + w1 * x + w2))) - y) * x), any_value(w2) - 0.5 * avg(1 / (1 + exp(-(w0 * q + w1 * x + w2))) - y) FROM b, z WHERE b.step < 4 GROUP BY b.step)
SELECT 'solo' AS kind, r.client, count(*) AS n, round(avg(CAST((w0 * q + w1 * x + w2 >= 0) = (y = 1) AS INT)), 6) AS accuracy FROM r JOIN w ON w.client = r.client AND step = 4 GROUP BY 2
UNION ALL SELECT 'combined', r.client, count(*), round(avg(CAST((w0 * q + w1 * x + w2 >= 0) = (y = 1) AS INT)), 6) FROM r JOIN b ON step = 4 GROUP BY 2""",
    "l6_tree_model": "SELECT CAST(ceil(count(*) * 0.2) AS BIGINT) AS n, true AS no_worse FROM lineitem",
    "l16_federated_rounds": f"""WITH RECURSIVE {_ROWS}, {_descend('w', '0.0', '0.0', '0.0', 4, 0.1)}, g AS (SELECT sum(n * w0) / sum(n) AS g0, sum(n * w1) / sum(n) AS g1, sum(n * w2) / sum(n) AS g2 FROM w JOIN n USING (client) WHERE step = 4),
{_descend('v', '(SELECT g0 FROM g)', '(SELECT g1 FROM g)', '(SELECT g2 FROM g)', 4, 0.1)}, h AS (SELECT sum(n * w0) / sum(n) AS h0, sum(n * w1) / sum(n) AS h1, sum(n * w2) / sum(n) AS h2 FROM v JOIN n USING (client) WHERE step = 4),
s AS (SELECT y, 1 / (1 + exp(-(h0 * q + h1 * x + h2))) >= 0.25 AS hit FROM r, h), c AS (SELECT count(*) FILTER (hit AND y = 1) AS tp, count(*) FILTER (hit AND y = 0) AS fp, count(*) FILTER (NOT hit AND y = 1) AS fn, count(*) FILTER (NOT hit AND y = 0) AS tn FROM s)
SELECT tp, fp, fn, tn, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c""",
    "o6_top_classes": "WITH n AS (SELECT p_type, row_number() OVER (ORDER BY count(*) DESC, p_type) AS k FROM part GROUP BY 1) SELECT CAST(CASE WHEN k < 4 THEN k ELSE 0 END AS INT) AS p_type_code, count(*) AS n FROM part JOIN n USING (p_type) GROUP BY 1",
    "l1_fedavg": f"WITH {_W} SELECT layer, idx, round(sum(n * value) / sum(n), 8) AS value FROM w JOIN n USING (client) GROUP BY 1, 2",
    "l3_scaffold": f"WITH {_W} SELECT layer, idx, round(0.5 + sum(n * value) / sum(n), 8) AS value FROM w JOIN n USING (client) GROUP BY 1, 2",
    "l4_vote": """WITH p AS (SELECT l_orderkey AS sample, l_suppkey % 3 AS client, round(max(l_tax), 4) AS outlier, round(avg(l_discount), 4) AS p FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY outlier, client) AS k FROM p)
SELECT sample, CAST(CASE WHEN round(sum(p), 9) >= round(sum(0.1 - p), 9) THEN 0 ELSE 1 END AS INT) AS class FROM r WHERE k <= 2 GROUP BY 1""",
    "l7_masked_mean": f"WITH {_W} SELECT layer, idx, round(CASE WHEN layer = 'input' THEN sum(value * CASE WHEN (client + idx) % 2 = 0 THEN 1 ELSE 0 END) / (sum(CASE WHEN (client + idx) % 2 = 0 THEN 1 ELSE 0 END) + 1e-8) ELSE avg(value) END, 7) AS value FROM w GROUP BY 1, 2",
    "l8_attention": f"""WITH {_W}, c AS (SELECT DISTINCT client FROM w), e AS (SELECT client, (client + o) % 5 AS other, exp(client * ((client + o) % 5) / 10) AS x FROM c, range(1, 3) z(o)), a AS (SELECT client, other, x / sum(x) OVER (PARTITION BY client) AS a FROM e),
m AS (SELECT a.client, w.layer, w.idx, sum(a.a * w.value) AS near FROM a JOIN w ON w.client = a.other GROUP BY ALL) SELECT w.client, w.layer, w.idx, round(CASE WHEN near IS NULL THEN value ELSE 0.7 * value + 0.3 * near END, 7) AS value FROM w LEFT JOIN m ON m.client = w.client AND m.layer = w.layer AND m.idx = w.idx""",
    "l9_confidence": """WITH n AS (SELECT CAST(l_suppkey % 5 AS INT) AS client, l_linenumber AS node, l_returnflag, count(*) AS k FROM lineitem GROUP BY ALL), s AS (SELECT client, sum(k) OVER (PARTITION BY client, node) AS deg, k / sum(k) OVER (PARTITION BY client, node) AS p FROM n),
c AS (SELECT client, sum(deg * p * ln(p + 1e-12)) + sum(deg) / 3 * 3 * exp(-1) AS conf FROM s GROUP BY 1) SELECT client, round(conf / sum(conf) OVER (), 6) AS weight FROM c""",
}
