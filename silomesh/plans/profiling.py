"""Queries over column and silo profiles, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silomesh.operators import profile
from silomesh.runtime import is_nan, read
from silomesh.sources import catalog as cat

R6 = lambda c: F.round(c, 6).alias(c)

#: The tables of one relational silo, with the columns that are profiled.
SILO = {
    "customer": ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "part": ["p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderstatus", "o_orderpriority", "o_custkey"],
    "supplier": ["s_nationkey", "s_acctbal"],
}


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the silo's tables; account balances below zero, the urgent priority and size 1 stand for missing values."""
    out = None
    for name, cols in SILO.items():
        df = read(spark, d, name)
        if name == "customer":
            df = df.withColumn("c_acctbal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
        if name == "orders":
            df = df.withColumn("o_orderpriority", F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT")))
        if name == "part":
            df = df.withColumn("p_size", F.nullif(F.col("p_size"), F.lit(1)))
        long = profile.cells(df, cols).withColumn("table_name", F.lit(name))
        out = long if out is None else out.unionByName(long)
    return out.withColumn("value", F.when(F.col("column_name").isin("c_acctbal", "p_retailprice", "s_acctbal"), F.round(F.col("value").cast("double"), 2).cast("string")).otherwise(F.col("value")))


def _sql_cells() -> str:
    change = {"c_acctbal": "CASE WHEN c_acctbal >= 0 THEN c_acctbal END", "o_orderpriority": "nullif(o_orderpriority, '1-URGENT')", "p_size": "nullif(p_size, 1)"}
    rows = [f"SELECT '{t}' AS table_name, '{c}' AS column_name, {i} AS ordinal, CAST({change.get(c, c)} AS VARCHAR) AS value FROM {t}" for t, cs in SILO.items() for i, c in enumerate(cs)]
    return "w AS (" + " UNION ALL ".join(rows) + ")"


KEYS = ["table_name", "column_name"]


def a1_column_cardinality(spark, d):
    """A1: distinct non-null values of every column."""
    return profile.column_profile(_cells(spark, d), KEYS).select(*KEYS, "n_distinct")


def a2_column_sparsity(spark, d):
    """A2: share of nulls of every column."""
    return profile.column_profile(_cells(spark, d), KEYS).select(*KEYS, "n_rows", R6("sparsity"))


def a3_column_entropy(spark, d):
    """A3: Shannon entropy in bits of every column."""
    return profile.column_profile(_cells(spark, d), KEYS).select(*KEYS, R6("entropy"))


def a4_data_volume(spark, d):
    """A4: bytes of text of each silo, and documents."""
    docs = read(spark, d, "documents").filter("db_id is not null")
    return docs.groupBy("db_id").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("bigint").alias("n_bytes"))


def _db_means(spark, d):
    card = read(spark, d, "column_cardinality").filter("db_id rlike '^[0-9]{7}$' and n_distinct >= 0 and n_distinct <= n_rows").groupBy("db_id").agg(F.avg("n_distinct").alias("avg_cardinality"), F.count("*").alias("n"))
    spars = read(spark, d, "column_sparsity").filter(F.col("db_id").rlike("^[0-9]{7}$") & ~is_nan(F.col("sparsity")) & F.col("sparsity").between(0, 1)).groupBy("db_id").agg(F.avg("sparsity").alias("avg_sparsity"))
    return card.join(spars, "db_id", "full")


def a5_silo_means(spark, d):
    """Mean cardinality and sparsity of each silo's columns, outer-joined."""
    return _db_means(spark, d).select("db_id", R6("avg_cardinality"), R6("avg_sparsity"))


def a6_mean_of_means(spark, d):
    """Least, largest, mean and median of the silo means, from partial aggregates."""
    return profile.spread(_db_means(spark, d), ["avg_cardinality", "avg_sparsity"]).select("metric", *(R6(c) for c in ("min_value", "max_value", "avg_value", "median_value")))


def a7_silo_structure(spark, d):
    """Tables, columns, properties, types and foreign-key density of each silo."""
    return profile.silo_structure(cat.columns(spark, d), cat.foreign_keys(spark, d)).select("db", "n_tables", "n_columns", "n_props", "n_types", "n_fks", R6("fk_density"))


def a7_type_shares(spark, d):
    """Data types of each silo with their shares."""
    return profile.type_shares(cat.columns(spark, d)).select("db", "dtype", "n", R6("share"))


def a7_fk_connectivity(spark, d):
    """How many tables a table is linked to, by silo."""
    return profile.fk_connectivity(cat.foreign_keys(spark, d)).select("db", R6("avg_links"), R6("median_links"), "min_links", "max_links")


def a8_largest_table(spark, d):
    """Rows of the largest table of each silo."""
    return read(spark, d, "column_cardinality").filter("db_id rlike '^[0-9]{7}$'").groupBy("db_id").agg(F.max("n_rows").alias("max_rows"))


def a9_link_spread(spark, d):
    """Least, largest, mean and median of link properties."""
    return profile.spread(cat.edges(spark, d), ["similarity", "n_common"]).select("metric", *(R6(c) for c in ("min_value", "max_value", "avg_value", "median_value")))


def a10_categorical_share(spark, d):
    """A10: share of string and entity columns of each silo, averaged."""
    shares = profile.type_shares(cat.columns(spark, d))
    per_db = shares.groupBy("db").agg(F.sum(F.when(F.col("dtype").isin("string", "wikibase-entityid"), F.col("share")).otherwise(0.0)).alias("categorical"))
    return per_db.agg(F.count("*").alias("n_silos"), F.round(F.avg("categorical"), 6).alias("avg_categorical"))


def a16_label_threshold(spark, d):
    """Lower quantiles of the similarity of pairs that share at least three columns."""
    q = [0.05, 0.1, 0.15, 0.2]
    got = cat.edges(spark, d).filter("n_common >= 3").agg(F.percentile("similarity", F.array(*map(F.lit, q))).alias("p"))
    return got.select(F.posexplode("p").alias("i", "t")).select(F.element_at(F.array(*map(F.lit, q)), F.col("i") + 1).alias("quantile"), F.round("t", 6).alias("threshold"))


def a22_class_distribution(spark, d):
    """How often each value of the categorical columns occurs."""
    return _cells(spark, d).filter("column_name in ('c_mktsegment', 'o_orderstatus', 'o_orderpriority', 'p_brand')").groupBy(*KEYS, "value").agg(F.count("*").alias("n"))


def f8_label_candidates(spark, d):
    """F8, M1, M2: columns that can serve as a label, with the task they make."""
    return profile.label_candidates(profile.column_profile(_cells(spark, d), KEYS)).select(*KEYS, "task", "n_distinct")


def f9_balanced_labels(spark, d):
    """columns with two to ten classes that are balanced enough."""
    counts = _cells(spark, d).filter("value is not null").groupBy(*KEYS, "value").agg(F.count("*").alias("n"))
    return profile.balanced_labels(counts, KEYS).select(*KEYS, "n_classes", "n_rows")


def a21_best_label(spark, d):
    """The label column of the orders table."""
    long = _cells(spark, d).filter("table_name = 'orders'")
    ordinal = long.select("column_name", "ordinal").distinct()
    return profile.best_label(profile.label_candidates(profile.column_profile(long)).join(ordinal, "column_name").withColumn("variance", F.lit(0.0))).select("column_name", "task", "n_distinct")


def a20_best_label_table(spark, d):
    """The table with the best label, by 1000 - classes; the first table wins ties."""
    cand = f8_label_candidates(spark, d).filter("task = 'classification'").groupBy("table_name").agg(F.max(F.lit(1000) - F.col("n_distinct")).alias("score"))
    return cand.orderBy(F.desc("score"), "table_name").limit(1)


def p2_kept_columns(spark, d):
    """Columns of the silo that aren't constant."""
    prof = profile.varying_columns(profile.column_profile(_cells(spark, d).withColumn("value", F.when(F.col("column_name") == "s_nationkey", F.lit("1")).otherwise(F.col("value"))), KEYS))
    return prof.select(*KEYS, "keep")


def p3_kept_pair_columns(spark, d):
    """Common columns of two parties, urgent and other orders, that are worth keeping."""
    orders = read(spark, d, "orders").withColumn("urgent", F.col("o_orderpriority") == "1-URGENT")
    side = lambda cond: profile.cells(orders.filter(cond), ["o_orderstatus", "o_orderpriority", "o_custkey", "urgent"]).groupBy("column_name").agg(F.count_distinct("value").alias("n_distinct"), F.min("value").alias("single"))
    return profile.pair_varying_columns(side("urgent"), side("not urgent and o_orderpriority = '5-LOW'"))


def k16_top_values(spark, d):
    """Top values of the columns with few distinct ones."""
    return profile.top_values(_cells(spark, d), KEYS).select(*KEYS, "rank", "value", "n", R6("share"))


QUERIES = {f.__name__: f for f in (
    a1_column_cardinality, a2_column_sparsity, a3_column_entropy, a4_data_volume, a5_silo_means, a6_mean_of_means, a7_silo_structure, a7_type_shares, a7_fk_connectivity, a8_largest_table, a9_link_spread,
    a10_categorical_share, a16_label_threshold, a20_best_label_table, a21_best_label, a22_class_distribution, f8_label_candidates, f9_balanced_labels, k16_top_values,
)}
QUERIES |= {"col_keep_varying": p2_kept_columns, "col_keep_pair": p3_kept_pair_columns}

_C = _sql_cells()
_MEANS = """m AS (SELECT coalesce(a.db_id, b.db_id) AS db_id, avg_cardinality, avg_sparsity FROM
  (SELECT db_id, avg(n_distinct) AS avg_cardinality FROM column_cardinality WHERE regexp_full_match(db_id, '[0-9]{7}') AND n_distinct >= 0 AND n_distinct <= n_rows GROUP BY 1) a FULL JOIN
  (SELECT db_id, avg(sparsity) AS avg_sparsity FROM column_sparsity WHERE regexp_full_match(db_id, '[0-9]{7}') AND NOT isnan(sparsity) AND sparsity BETWEEN 0 AND 1 GROUP BY 1) b ON a.db_id = b.db_id)"""
_PROF = f"""{_C}, q AS (SELECT table_name, column_name, any_value(ordinal) AS ordinal, count(*) AS n_rows, count(value) AS n_held, count(DISTINCT value) AS n_distinct, count(try_cast(value AS DOUBLE)) / count(*) AS numeric_share FROM w GROUP BY 1, 2),
l AS (SELECT *, CASE WHEN numeric_share > 0.5 AND n_distinct > 50 THEN 'regression' WHEN n_distinct BETWEEN 2 AND 50 THEN 'classification' END AS task FROM q WHERE 1 - n_held / n_rows <= 0.5)"""
_SPREAD = "SELECT '{0}' AS metric, round(min({0}), 6) AS min_value, round(max({0}), 6) AS max_value, round(avg({0}), 6) AS avg_value, round(median({0}), 6) AS median_value FROM {1}"

SQL = {
    "a1_column_cardinality": f"WITH {_C} SELECT table_name, column_name, count(DISTINCT value) AS n_distinct FROM w GROUP BY 1, 2",
    "a2_column_sparsity": f"WITH {_C} SELECT table_name, column_name, count(*) AS n_rows, round(1 - count(value) / count(*), 6) AS sparsity FROM w GROUP BY 1, 2",
    "a3_column_entropy": f"WITH {_C} SELECT table_name, column_name, round(entropy(value), 6) AS entropy FROM w WHERE value IS NOT NULL GROUP BY 1, 2",
    "a4_data_volume": "SELECT db_id, count(*) AS n_docs, CAST(coalesce(sum(octet_length(encode(text))), 0) AS BIGINT) AS n_bytes FROM documents WHERE db_id IS NOT NULL GROUP BY 1",
    "a5_silo_means": f"WITH {_MEANS} SELECT db_id, round(avg_cardinality, 6) AS avg_cardinality, round(avg_sparsity, 6) AS avg_sparsity FROM m",
    "a6_mean_of_means": f"WITH {_MEANS} {_SPREAD.format('avg_cardinality', 'm')} UNION ALL {_SPREAD.format('avg_sparsity', 'm')}",
    "a7_silo_structure": f"""WITH {cat.SQL_COLUMNS}, {cat.SQL_FKS}, f AS (SELECT db, count(*) AS n FROM k GROUP BY 1)
SELECT c.db, count(DISTINCT table_name) AS n_tables, count(*) AS n_columns, count(prop) AS n_props, count(DISTINCT dtype) AS n_types, coalesce(any_value(f.n), 0) AS n_fks, round(coalesce(any_value(f.n), 0) / count(*), 6) AS fk_density FROM c LEFT JOIN f ON f.db = c.db GROUP BY c.db""",
    "a7_type_shares": f"WITH {cat.SQL_COLUMNS} SELECT db, dtype, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY db), 6) AS share FROM c WHERE dtype IS NOT NULL GROUP BY 1, 2",
    "a7_fk_connectivity": f"""WITH {cat.SQL_FKS}, s AS (SELECT db, src_table AS t, dst_table AS o FROM k UNION SELECT db, dst_table, src_table FROM k), n AS (SELECT db, t, count(DISTINCT o) AS n FROM s WHERE t <> o GROUP BY 1, 2)
SELECT db, round(avg(n), 6) AS avg_links, round(median(n), 6) AS median_links, min(n) AS min_links, max(n) AS max_links FROM n GROUP BY 1""",
    "a8_largest_table": "SELECT db_id, max(n_rows) AS max_rows FROM column_cardinality WHERE regexp_full_match(db_id, '[0-9]{7}') GROUP BY 1",
    "a9_link_spread": f"WITH {cat.SQL_EDGES} {_SPREAD.format('similarity', 'e')} UNION ALL {_SPREAD.format('n_common', 'e')}",
    "a10_categorical_share": f"WITH {cat.SQL_COLUMNS}, s AS (SELECT db, sum(CASE WHEN dtype IN ('string', 'wikibase-entityid') THEN 1 ELSE 0 END) / count(*) AS x FROM c WHERE dtype IS NOT NULL GROUP BY 1) SELECT count(*) AS n_silos, round(avg(x), 6) AS avg_categorical FROM s",
    "a16_label_threshold": f"WITH {cat.SQL_EDGES} SELECT CAST(q AS DOUBLE) AS quantile, round((SELECT quantile_cont(similarity, [0.05, 0.1, 0.15, 0.2]) FROM e WHERE n_common >= 3)[i], 6) AS threshold FROM (VALUES (1, 0.05), (2, 0.1), (3, 0.15), (4, 0.2)) x(i, q)",
    "a22_class_distribution": f"WITH {_C} SELECT table_name, column_name, value, count(*) AS n FROM w WHERE column_name IN ('c_mktsegment', 'o_orderstatus', 'o_orderpriority', 'p_brand') GROUP BY 1, 2, 3",
    "f8_label_candidates": f"WITH {_PROF} SELECT table_name, column_name, task, n_distinct FROM l WHERE task IS NOT NULL",
    "f9_balanced_labels": f"""WITH {_C}, n AS (SELECT table_name, column_name, value, count(*) AS n FROM w WHERE value IS NOT NULL GROUP BY 1, 2, 3)
SELECT table_name, column_name, count(*) AS n_classes, CAST(sum(n) AS BIGINT) AS n_rows FROM n GROUP BY 1, 2 HAVING sum(n) >= 200 AND count(*) BETWEEN 2 AND 10 AND (count(*) > 2 OR (min(n) / max(n) BETWEEN 0.2 AND 1 AND min(n) / sum(n) BETWEEN 0.2 AND 0.8))""",
    "a21_best_label": f"WITH {_PROF} SELECT column_name, task, n_distinct FROM l WHERE table_name = 'orders' AND task IS NOT NULL ORDER BY task <> 'classification', n_distinct, ordinal LIMIT 1",
    "a20_best_label_table": f"WITH {_PROF} SELECT table_name, max(1000 - n_distinct) AS score FROM l WHERE task = 'classification' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
    "k16_top_values": f"""WITH {_C}, n AS (SELECT table_name, column_name, value, count(*) AS n FROM w WHERE value IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY n DESC, value) AS rank, count(*) OVER (PARTITION BY table_name, column_name) AS k, sum(n) OVER (PARTITION BY table_name, column_name) AS total FROM n)
SELECT table_name, column_name, CAST(rank AS INT) AS rank, value, n, round(n / total, 6) AS share FROM r WHERE k <= 10 AND rank <= 5""",
    "col_keep_varying": f"WITH {_C} SELECT table_name, column_name, CASE WHEN column_name = 's_nationkey' THEN false ELSE count(DISTINCT value) > 1 OR (count(DISTINCT value) = 1 AND count(value) < count(*)) END AS keep FROM w GROUP BY 1, 2",
    "col_keep_pair": """WITH s AS (SELECT o_orderpriority = '1-URGENT' AS urgent, x.* FROM orders, LATERAL (VALUES ('o_orderstatus', o_orderstatus), ('o_orderpriority', o_orderpriority), ('o_custkey', CAST(o_custkey AS VARCHAR)), ('urgent', CAST(o_orderpriority = '1-URGENT' AS VARCHAR))) x(column_name, value) WHERE o_orderpriority IN ('1-URGENT', '5-LOW')),
g AS (SELECT urgent, column_name, count(DISTINCT value) AS n, min(value) AS v FROM s GROUP BY 1, 2)
SELECT a.column_name, a.n > 1 OR b.n > 1 OR (a.n = 1 AND b.n = 1 AND a.v <> b.v) OR a.n + b.n = 1 AS keep FROM g a JOIN g b ON a.column_name = b.column_name AND a.urgent AND NOT b.urgent""",
}
