"""Queries over experiment results, with their SQL.

A result is a mean discount: the supplier is the pair, the return flag the method, the line number gives seed and client.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from silomesh.operators import encode, report
from silomesh.runtime import read
from silomesh.sources import catalog as cat

R6 = lambda c: F.round(c, 6).alias(c)
METHODS = ["A", "N", "R"]


def _results(spark, d):
    li = read(spark, d, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("pair_id"), F.col("l_returnflag").alias("method"), (F.col("l_linenumber") % 3).alias("seed"), F.col("l_linestatus").alias("client")).agg(F.avg("l_discount").alias("value"), F.sum("l_quantity").alias("size"))


def a18_source_summary(spark, d):
    """Spread of the similarity by number of common columns."""
    return report.summary(cat.edges(spark, d), ["n_common"], "similarity").select("n_common", "n", *(R6(c) for c in ("mean", "std_samp", "least", "most", "q25", "median", "q75")))


def a19_distribution(spark, d):
    """Finite sparsities: counts, share above a cut, mean and population deviation."""
    s = read(spark, d, "column_sparsity").filter(report.finite("sparsity"))
    return s.groupBy("load_no").agg(F.count("*").alias("n"), F.round(F.avg((F.col("sparsity") > 0.5).cast("double")), 6).alias("share_above"), F.round(F.avg("sparsity"), 6).alias("mean"), F.round(F.stddev_pop("sparsity"), 6).alias("std_pop"))


def a24_improvements(spark, d):
    """Pairs in which a method beats the base."""
    return report.improvements(report.wide(_results(spark, d), "value", METHODS), ["N", "R"], "A").select("method", "n_valid", "n_better", R6("ratio"))


def p16_wide_results(spark, d):
    """One row for each pair with a column for each method."""
    return report.wide(_results(spark, d), "value", METHODS).select("pair_id", *(R6(m) for m in METHODS))


def a25_gains(spark, d):
    """Gains of one method over another by size bin."""
    w = report.wide(_results(spark, d), "value", METHODS).join(_results(spark, d).groupBy("pair_id").agg(F.sum("size").alias("size")), "pair_id")
    return report.gains(w, F.round(F.col("R") - F.col("A"), 9), F.col("size") / 20).select("bin", "n", R6("mean"), R6("median"), R6("std_samp"), "n_positive", "n_neutral", "n_negative", "n_bad")


def a26_raw_and_changed(spark, d):
    """Means of two methods over their common pairs, and how often the second is better."""
    w = report.wide(_results(spark, d), "value", METHODS).filter("A is not null and N is not null")
    return w.agg(F.count("*").alias("n"), F.round(F.avg("A"), 6).alias("mean_first"), F.round(F.avg("N"), 6).alias("mean_second"), F.count_if(F.col("N") > F.col("A")).alias("n_better"))


def a27_gain_percent(spark, d):
    """Percentage of pairs above the base by seed, then mean and population deviation."""
    r = _results(spark, d).groupBy("pair_id", "seed").pivot("method", ["A", "R"]).agg(F.avg("value")).filter("A is not null and R is not null")
    s = r.groupBy("seed").agg((100 * F.avg((F.col("R") > F.col("A")).cast("double"))).alias("p"))
    return s.agg(F.round(F.avg("p"), 5).alias("mean"), F.round(F.stddev_pop("p"), 5).alias("std_pop"))


def a29_seed_means(spark, d):
    """Mean and population deviation over seeds by method and client."""
    return report.mean_of_seeds(_results(spark, d), ["method", "client"], "value").select("method", "client", R6("mean"), R6("std_pop"), "n_seeds")


def a31_worst_clients(spark, d):
    """The worst client of each pair, averaged by method."""
    return report.worst_client(_results(spark, d), ["pair_id", "method"], "value").groupBy("method").agg(F.round(F.avg("worst"), 6).alias("avg_worst"))


def a34_ratios(spark, d):
    """Overlap and balance ratios of the linked silos' sizes."""
    rows = read(spark, d, "column_cardinality").filter("db_id rlike '^[0-9]{7}$'").groupBy(F.col("db_id").cast("bigint").alias("id")).agg(F.max("n_rows").alias("rows"))
    e = cat.edges(spark, d).join(rows.select(F.col("id").alias("src"), F.col("rows").alias("a")), "src").join(rows.select(F.col("id").alias("tgt"), F.col("rows").alias("b")), "tgt")
    return e.agg(F.count("*").alias("n"), F.round(F.avg(F.least("a", "b") / F.nullif(F.greatest("a", "b"), F.lit(0))), 6).alias("balance"), F.round(F.avg((F.col("n_common") == 0).cast("double")), 6).alias("no_overlap"))


def a39_trend(spark, d):
    """Linear fit of the mean similarity over common columns."""
    return report.linear_fit(cat.edges(spark, d), "n_common", "similarity", 2).select(R6("slope"), R6("intercept"), "n_bins")


def a40_log_bins(spark, d):
    """Similarity over log-spaced bins of common columns."""
    return report.log_bins(cat.edges(spark, d), "n_common", "similarity", 4).select("bin", "n", R6("mean"), R6("std_pop"), R6("centre"))


def a41_shares_below(spark, d):
    """Shares of the similarity below some cuts."""
    return report.shares_below(cat.edges(spark, d), "similarity", [0.5, 0.7, 0.8, 0.9]).select("cut", R6("share"))


def a44_mean_without_nulls(spark, d):
    """Mean of a statistic that is often null, null for silos without any."""
    return read(spark, d, "column_cardinality").filter("db_id rlike '^[0-9]{7}$'").groupBy("db_id").agg(F.round(F.avg("n_distinct"), 5).alias("mean"), F.count("*").alias("n"))


def o9_best_methods(spark, d):
    """Best and second best method of each client."""
    m = _results(spark, d).groupBy("client", "method").agg(F.round(F.avg("value"), 9).alias("value"))
    return report.ranking(m, ["client"], "value").select("client", "rank", "method", R6("value"))


def p17_labelled_sources(spark, d):
    """Documents by a label made from the beginning of their source."""
    label = F.when(F.col("source").startswith("silo"), "silo").when(F.col("source").endswith("cards"), "cards").otherwise("other")
    return read(spark, d, "documents").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def p15_feature_matrix(spark, d):
    """Node properties as one vector in the order of their names, absent ones as 0."""
    c = cat.columns(spark, d).groupBy("db").agg(F.count("*").alias("n_columns"), F.count_distinct("table_name").alias("n_tables"), F.count("prop").alias("n_props"))
    k = cat.foreign_keys(spark, d).groupBy("db").agg(F.count("*").alias("n_fks"))
    names = sorted(["n_columns", "n_tables", "n_props", "n_fks"])
    return c.join(k, "db", "left").select("db", F.array_join(F.array(*(F.coalesce(n, F.lit(0)).cast("string") for n in names)), ",").alias("features"))


def f10_dynamic_labels(spark, d):
    """one-against-rest labels whose positive share is in range and that a feature tells something about."""
    o = read(spark, d, "lineitem")
    parts = None
    for flag in METHODS:
        y = o.withColumn("y", (F.col("l_returnflag") == flag).cast("int"))
        row = encode.mutual_information(y, "l_linestatus", "y").join(F.broadcast(y.agg(F.avg("y").alias("share"), F.count("*").alias("n")))).select(F.lit(flag).alias("positive"), "n", R6("share"), R6("mi"))
        parts = row if parts is None else parts.unionByName(row)
    return parts.filter("n >= 200 and share between 0.2 and 0.8 and mi >= 0")


def x19_path_ids(spark, d):
    """Silo id and table key taken from paths."""
    p = read(spark, d, "pair_metadata").select(F.concat(F.lit("/data/"), F.col("folder1"), F.lit("/tables/t.csv")).alias("path")).dropna().distinct()
    return p.select(F.regexp_extract("path", r"/(\d+) [^/]*/", 1).alias("db"), F.concat_ws("/", F.regexp_extract("path", r"/(\d+) [^/]*/", 1), F.regexp_extract("path", r"/([^/]+\.csv)$", 1)).alias("key"))


def m3_math(spark, d):
    """M3, M7: logarithm, root, exponential, power and sigmoid of prices and balances."""
    p = read(spark, d, "part")
    x = F.col("p_retailprice") / 1000
    return p.select("p_partkey", F.round(F.log2(x), 6).alias("log"), F.round(F.sqrt(x), 6).alias("root"), F.round(F.exp(-x), 6).alias("decay"), F.round(F.pow(x, F.lit(1.5)), 6).alias("power"), F.round(1 / (1 + F.exp(-x)), 6).alias("sigmoid"))


def l17_missing_experiments(spark, d):
    """Pairs and methods that have no result yet; each would be one task."""
    r = _results(spark, d)
    expected = r.select("pair_id").distinct().select("pair_id", F.explode(F.array(*map(F.lit, [*METHODS, "Z"]))).alias("method"))
    return expected.join(r.select("pair_id", "method").distinct(), ["pair_id", "method"], "left_anti")


def o7_first_rows(spark, d):
    """The first thousand orders by price, where a limit is what is asked for."""
    return read(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1000).select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


QUERIES = {f.__name__: f for f in (
    f10_dynamic_labels, x19_path_ids, m3_math, l17_missing_experiments, o7_first_rows, a18_source_summary, a19_distribution, a24_improvements, a25_gains, a26_raw_and_changed, a27_gain_percent, a29_seed_means, a31_worst_clients, a34_ratios, a39_trend, a40_log_bins, a41_shares_below, a44_mean_without_nulls, o9_best_methods,
)}
QUERIES |= {"feature_matrix": p15_feature_matrix, "wide_results": p16_wide_results, "labelled_sources": p17_labelled_sources}

_E = cat.SQL_EDGES
_R = "r AS (SELECT l_suppkey AS pair_id, l_returnflag AS method, l_linenumber % 3 AS seed, l_linestatus AS client, avg(l_discount) AS value, sum(l_quantity) AS size FROM lineitem GROUP BY 1, 2, 3, 4)"
_W = f"{_R}, w AS (SELECT pair_id, avg(value) FILTER (method = 'A') AS a, avg(value) FILTER (method = 'N') AS n, avg(value) FILTER (method = 'R') AS r, sum(size) AS size FROM r GROUP BY 1)"

SQL = {
    "a18_source_summary": f"WITH {_E} SELECT n_common, count(similarity) AS n, round(avg(similarity), 6) AS mean, round(stddev_samp(similarity), 6) AS std_samp, round(min(similarity), 6) AS least, round(max(similarity), 6) AS most, round(quantile_cont(similarity, 0.25), 6) AS q25, round(median(similarity), 6) AS median, round(quantile_cont(similarity, 0.75), 6) AS q75 FROM e GROUP BY 1",
    "a19_distribution": "SELECT load_no, count(*) AS n, round(avg(CAST(sparsity > 0.5 AS INT)), 6) AS share_above, round(avg(sparsity), 6) AS mean, round(stddev_pop(sparsity), 6) AS std_pop FROM column_sparsity WHERE isfinite(sparsity) GROUP BY 1",
    "a24_improvements": f"WITH {_W} SELECT 'N' AS method, count(*) FILTER (n IS NOT NULL AND a IS NOT NULL) AS n_valid, count(*) FILTER (n > a) AS n_better, round(count(*) FILTER (n > a) / count(*) FILTER (n IS NOT NULL AND a IS NOT NULL), 6) AS ratio FROM w UNION ALL SELECT 'R', count(*) FILTER (r IS NOT NULL AND a IS NOT NULL), count(*) FILTER (r > a), round(count(*) FILTER (r > a) / count(*) FILTER (r IS NOT NULL AND a IS NOT NULL), 6) FROM w",
    "wide_results": f"WITH {_W} SELECT pair_id, round(a, 6) AS \"A\", round(n, 6) AS \"N\", round(r, 6) AS \"R\" FROM w",
    "a25_gains": f"""WITH {_W}, g AS (SELECT round(r - a, 9) AS g, CASE WHEN size / 20 < 500 THEN 'small' WHEN size / 20 < 2000 THEN 'medium' ELSE 'large' END AS bin FROM w)
SELECT bin, count(g) AS n, round(avg(g), 6) AS mean, round(median(g), 6) AS median, round(stddev_samp(g), 6) AS std_samp, count(*) FILTER (g > 0) AS n_positive, count(*) FILTER (g = 0) AS n_neutral, count(*) FILTER (g < 0) AS n_negative, count(*) FILTER (g < -0.01) AS n_bad FROM g GROUP BY 1""",
    "a26_raw_and_changed": f"WITH {_W} SELECT count(*) AS n, round(avg(a), 6) AS mean_first, round(avg(n), 6) AS mean_second, count(*) FILTER (n > a) AS n_better FROM w WHERE a IS NOT NULL AND n IS NOT NULL",
    "a27_gain_percent": f"WITH {_R}, x AS (SELECT pair_id, seed, avg(value) FILTER (method = 'A') AS a, avg(value) FILTER (method = 'R') AS b FROM r GROUP BY 1, 2), s AS (SELECT seed, 100 * avg(CAST(b > a AS INT)) AS p FROM x WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1) SELECT round(avg(p), 5) AS mean, round(stddev_pop(p), 5) AS std_pop FROM s",
    "a29_seed_means": f"WITH {_R}, s AS (SELECT method, client, seed, avg(value) AS v FROM r GROUP BY 1, 2, 3) SELECT method, client, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std_pop, count(*) AS n_seeds FROM s GROUP BY 1, 2",
    "a31_worst_clients": f"WITH {_R}, s AS (SELECT pair_id, method, min(value) AS w FROM r GROUP BY 1, 2) SELECT method, round(avg(w), 6) AS avg_worst FROM s GROUP BY 1",
    "a34_ratios": f"WITH {_E}, q AS (SELECT CAST(db_id AS BIGINT) AS id, max(n_rows) AS n FROM column_cardinality WHERE regexp_full_match(db_id, '[0-9]{{7}}') GROUP BY 1) SELECT count(*) AS n, round(avg(least(a.n, b.n) / nullif(greatest(a.n, b.n), 0)), 6) AS balance, round(avg(CAST(n_common = 0 AS INT)), 6) AS no_overlap FROM e JOIN q a ON a.id = src JOIN q b ON b.id = tgt",
    "a39_trend": f"WITH {_E}, b AS (SELECT floor(n_common / 2) * 2 AS b, avg(similarity) AS m FROM e WHERE n_common IS NOT NULL GROUP BY 1) SELECT round(regr_slope(m, b), 6) AS slope, round(regr_intercept(m, b), 6) AS intercept, count(*) AS n_bins FROM b",
    "a40_log_bins": f"WITH {_E}, q AS (SELECT ln(min(n_common)) AS lo, (ln(max(n_common)) - ln(min(n_common))) / 4 AS s FROM e WHERE n_common > 0), b AS (SELECT CAST(least(floor((ln(n_common) - lo) / s + 1e-9), 3) AS INT) AS bin, similarity, lo, s FROM e, q WHERE n_common > 0) SELECT bin, count(*) AS n, round(avg(similarity), 6) AS mean, round(stddev_pop(similarity), 6) AS std_pop, round(exp(any_value(lo) + (bin + 0.5) * any_value(s)), 6) AS centre FROM b GROUP BY bin",
    "a41_shares_below": f"WITH {_E} SELECT CAST(c AS DOUBLE) AS cut, round(avg(CAST(similarity < c AS INT)), 6) AS share FROM e, (VALUES (0.5), (0.7), (0.8), (0.9)) v(c) GROUP BY 1",
    "a44_mean_without_nulls": "SELECT db_id, round(avg(n_distinct), 5) AS mean, count(*) AS n FROM column_cardinality WHERE regexp_full_match(db_id, '[0-9]{7}') GROUP BY 1",
    "o9_best_methods": f"WITH {_R}, m AS (SELECT client, method, round(avg(value), 9) AS value FROM r GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY value DESC, method) AS rank FROM m) SELECT client, CAST(rank AS INT) AS rank, method, round(value, 6) AS value FROM k WHERE rank <= 2",
    "labelled_sources": "SELECT CASE WHEN starts_with(source, 'silo') THEN 'silo' WHEN ends_with(source, 'cards') THEN 'cards' ELSE 'other' END AS label, count(*) AS n FROM documents GROUP BY 1",
    "feature_matrix": f"WITH {cat.SQL_COLUMNS}, {cat.SQL_FKS}, f AS (SELECT db, count(*) AS n FROM k GROUP BY 1) SELECT c.db, count(*) || ',' || coalesce(any_value(f.n), 0) || ',' || count(prop) || ',' || count(DISTINCT table_name) AS features FROM c LEFT JOIN f ON f.db = c.db GROUP BY c.db",
    "f10_dynamic_labels": """WITH p AS (SELECT unnest(['A', 'N', 'R']) AS positive), n AS (SELECT positive, l_linestatus AS a, l_returnflag = positive AS b, count(*) AS n FROM lineitem, p GROUP BY ALL),
q AS (SELECT *, sum(n) OVER (PARTITION BY positive, a) AS na, sum(n) OVER (PARTITION BY positive, b) AS nb, sum(n) OVER (PARTITION BY positive) AS t FROM n)
SELECT positive, CAST(any_value(t) AS BIGINT) AS n, round(sum(n) FILTER (b) / any_value(t), 6) AS share, round(sum(n / t * ln(n * t / (na * nb))), 6) AS mi FROM q GROUP BY 1 HAVING any_value(t) >= 200 AND sum(n) FILTER (b) / any_value(t) BETWEEN 0.2 AND 0.8 AND round(sum(n / t * ln(n * t / (na * nb))), 6) >= 0""",
    "x19_path_ids": "SELECT DISTINCT regexp_extract(folder1, '^(\\d+) ', 1) AS db, concat_ws('/', regexp_extract(folder1, '^(\\d+) ', 1), 't.csv') AS key FROM pair_metadata WHERE folder1 IS NOT NULL",
    "m3_math": "SELECT p_partkey, round(log2(p_retailprice / 1000), 6) AS log, round(sqrt(p_retailprice / 1000), 6) AS root, round(exp(-p_retailprice / 1000), 6) AS decay, round(pow(p_retailprice / 1000, 1.5), 6) AS power, round(1 / (1 + exp(-p_retailprice / 1000)), 6) AS sigmoid FROM part",
    "l17_missing_experiments": f"WITH {_R} SELECT pair_id, m AS method FROM (SELECT DISTINCT pair_id FROM r), (SELECT unnest(['A', 'N', 'R', 'Z']) AS m) EXCEPT SELECT pair_id, method FROM r",
    "o7_first_rows": "SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY orders.o_totalprice DESC, o_orderkey LIMIT 1000",
}
