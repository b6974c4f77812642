"""Registered queries of the column profile (problem 2) and of missing references (problem 5), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silomesh.operators import references, value_counts
from silomesh.runtime import Workspace, is_nan, read


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return value_counts.quality_findings(read(spark, d, "column_cardinality"), read(spark, d, "column_sparsity"))


def _field_counts(spark: SparkSession, d: str) -> DataFrame:
    """Value counts of every profiled statistics column by load: a maintained table to which each load is applied."""
    card, spars = read(spark, d, "column_cardinality"), read(spark, d, "column_sparsity")
    s = F.col("sparsity")
    parts = [(card, "column_cardinality", "db_id", F.col("db_id")), (card, "column_cardinality", "n_distinct", F.col("n_distinct")), (spars, "column_sparsity", "db_id", F.col("db_id")), (spars, "column_sparsity", "sparsity", F.when(~is_nan(s), s))]
    table = value_counts.ValueCountTable(spark, Workspace(spark, "field-counts").root)
    loads = {r[0] for df in (card, spars) for r in df.select("load_no").distinct().collect()}
    for load in sorted(loads, key=lambda x: (x is not None, x)):
        deltas = None
        for df, name, field, value in parts:
            tagged = df.filter(F.col("load_no").eqNullSafe(F.lit(load))).withColumns({"stat_table": F.lit(name), "field_name": F.lit(field)})
            text = value if field == "db_id" else value.cast("double").cast("string")
            delta = value_counts.value_deltas(tagged, ["stat_table", "field_name", "load_no"], text)
            deltas = delta if deltas is None else deltas.unionByName(delta)
        table.apply(deltas, summed=True)
    return table.state() if loads else value_counts.value_deltas(card.limit(0).withColumns({"stat_table": F.lit(""), "field_name": F.lit("")}), ["stat_table", "field_name", "load_no"], F.col("db_id"))


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    """Profile of each statistics column and load from its value counts."""
    state = _field_counts(spark, d)
    prof = value_counts.profile(state, ["stat_table", "field_name", "load_no"], value_counts.ID_PATTERN)
    numeric = F.col("field_name") != "db_id"
    span = state.filter(numeric).groupBy("stat_table", "field_name", "load_no").agg(F.min(F.expr("try_cast(value AS DOUBLE)")).alias("low"), F.max(F.expr("try_cast(value AS DOUBLE)")).alias("high"))
    out = prof.join(span, ["stat_table", "field_name", "load_no"], "left")
    return out.select("stat_table", "field_name", "load_no", "n_rows", "n_null", F.round("null_rate", 6).alias("null_rate"), "n_distinct", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), F.round("entropy", 4).alias("entropy"), F.when(~numeric, F.col("n_pattern")).alias("n_pattern"))


def p2_load_change(spark: SparkSession, d: str) -> DataFrame:
    """Total variation distance of each statistics column between consecutive loads."""
    out = value_counts.distribution_change(_field_counts(spark, d), ["stat_table", "field_name"], "load_no")
    return out.select("stat_table", "field_name", "load_no", "load_before", F.round("total_variation", 6).alias("total_variation"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_cases(read(spark, d, "schema_columns"), read(spark, d, "foreign_keys"))


def p5_orphans_by_month(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(read(spark, d, "schema_columns"), read(spark, d, "foreign_keys"))


QUERIES = {f.__name__: f for f in (p2_found, p2_profile, p2_load_change, p5_found, p5_orphans_by_month)}

_FIELDS = """f AS (
  SELECT 'column_cardinality' AS stat_table, 'db_id' AS field_name, load_no, db_id AS v FROM column_cardinality
  UNION ALL SELECT 'column_cardinality', 'n_distinct', load_no, CAST(n_distinct AS VARCHAR) FROM column_cardinality
  UNION ALL SELECT 'column_sparsity', 'db_id', load_no, db_id FROM column_sparsity
  UNION ALL SELECT 'column_sparsity', 'sparsity', load_no, CASE WHEN isnan(sparsity) THEN NULL ELSE CAST(sparsity AS VARCHAR) END FROM column_sparsity)"""

_KEY = "nullif(regexp_replace(lower({}), '[^a-z0-9]', '', 'g'), '')"
_ORPHANS = f"""r AS (
  SELECT fk_id, 'source' AS side, try_cast(trim(db_id) AS BIGINT) AS silo, recorded_at, table_name AS of_table, table_name AS t, column_name AS c FROM foreign_keys
  UNION ALL SELECT fk_id, 'target', try_cast(trim(db_id) AS BIGINT), recorded_at, table_name, reference_table_name, reference_column_name FROM foreign_keys),
k AS (SELECT *, {_KEY.format('t')} AS tab, {_KEY.format('c')} AS col FROM r WHERE regexp_matches(t, '\\S') AND regexp_matches(c, '\\S')),
s AS (SELECT try_cast(db_id AS BIGINT) AS silo, {_KEY.format('table_name')} AS tab, {_KEY.format('column_name')} AS col, added_at, removed_at FROM schema_columns),
o AS (SELECT DISTINCT fk_id, side, silo, {_KEY.format('of_table')} AS table_key, strftime(recorded_at, '%Y-%m') AS period FROM k WHERE NOT EXISTS (
  SELECT 1 FROM s WHERE s.silo = k.silo AND s.tab = k.tab AND s.col = k.col AND s.added_at <= k.recorded_at AND (s.removed_at IS NULL OR s.removed_at > k.recorded_at)))"""

SQL = {
    "p2_found": """WITH r AS (
  SELECT 'column_cardinality' AS stat_table, stat_id, db_id, table_name, column_name, load_no, 'n_distinct' AS field_name, CAST(n_distinct AS DOUBLE) AS v,
    CASE WHEN n_distinct IS NULL THEN 'null' WHEN n_distinct < 0 OR n_distinct > n_rows THEN 'range' END AS bv FROM column_cardinality
  UNION ALL SELECT 'column_sparsity', stat_id, db_id, table_name, column_name, load_no, 'sparsity', sparsity,
    CASE WHEN sparsity IS NULL OR isnan(sparsity) THEN 'null' WHEN sparsity < 0 OR sparsity > 1 THEN 'range' END FROM column_sparsity),
q AS (SELECT *, CASE WHEN db_id IS NULL THEN 'null' WHEN NOT regexp_full_match(db_id, '[0-9]{7}') THEN 'pattern' END AS bi FROM r),
c AS (SELECT * FROM q WHERE bi IS NULL AND bv IS NULL),
p AS (SELECT a.stat_table, a.stat_id, a.field_name, a.v, max(b.load_no) AS lb, a.db_id, a.table_name, a.column_name FROM c a JOIN c b
  ON a.field_name = b.field_name AND a.db_id = b.db_id AND a.table_name = b.table_name AND a.column_name = b.column_name AND b.load_no < a.load_no GROUP BY ALL),
m AS (SELECT p.stat_table, p.stat_id, p.field_name FROM p JOIN c b ON p.field_name = b.field_name AND p.db_id = b.db_id AND p.table_name = b.table_name AND p.column_name = b.column_name AND b.load_no = p.lb
  WHERE (p.field_name = 'sparsity' AND abs(p.v - b.v) >= 0.3) OR (p.field_name = 'n_distinct' AND greatest(p.v, b.v) + 1 >= 5 * (least(p.v, b.v) + 1)))
SELECT DISTINCT stat_table, stat_id, field_name, finding FROM (
  SELECT stat_table, stat_id, 'db_id' AS field_name, bi AS finding FROM q WHERE bi IS NOT NULL
  UNION ALL SELECT stat_table, stat_id, field_name, bv FROM q WHERE bv IS NOT NULL
  UNION ALL SELECT stat_table, stat_id, field_name, 'drift' FROM m)""",
    "p2_profile": f"""WITH {_FIELDS}, c AS (SELECT stat_table, field_name, load_no, v, count(*) AS n FROM f GROUP BY ALL)
SELECT stat_table, field_name, load_no, CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (v IS NULL), 0) AS BIGINT) AS n_null,
  round(coalesce(sum(n) FILTER (v IS NULL), 0) / sum(n), 6) AS null_rate, count(v) AS n_distinct,
  round(min(CASE WHEN field_name <> 'db_id' THEN try_cast(v AS DOUBLE) END), 4) AS low, round(max(CASE WHEN field_name <> 'db_id' THEN try_cast(v AS DOUBLE) END), 4) AS high,
  round(coalesce(log2(sum(n) FILTER (v IS NOT NULL)) - sum(n * log2(n)) FILTER (v IS NOT NULL) / sum(n) FILTER (v IS NOT NULL), 0), 4) AS entropy,
  CASE WHEN field_name = 'db_id' THEN CAST(coalesce(sum(n) FILTER (NOT regexp_full_match(v, '[0-9]{{7}}')), 0) AS BIGINT) END AS n_pattern
FROM c GROUP BY stat_table, field_name, load_no""",
    "p2_load_change": f"""WITH {_FIELDS}, c AS (SELECT stat_table, field_name, load_no, v, count(*) AS n FROM f GROUP BY ALL),
t AS (SELECT stat_table, field_name, load_no, sum(n) AS total, lag(load_no) OVER (PARTITION BY stat_table, field_name ORDER BY load_no) AS load_before FROM c GROUP BY 1, 2, 3)
SELECT t.stat_table, t.field_name, t.load_no, t.load_before, round(1 - coalesce((SELECT sum(least(a.n / t.total, b.n / u.total)) FROM c a JOIN c b ON a.stat_table = b.stat_table AND a.field_name = b.field_name AND a.v IS NOT DISTINCT FROM b.v
  WHERE a.stat_table = t.stat_table AND a.field_name = t.field_name AND a.load_no = t.load_no AND b.load_no = t.load_before), 0), 6) AS total_variation
FROM t JOIN t u ON u.stat_table = t.stat_table AND u.field_name = t.field_name AND u.load_no = t.load_before""",
    "p5_found": f"WITH {_ORPHANS} SELECT DISTINCT fk_id, side FROM o",
    "p5_orphans_by_month": f"""WITH {_ORPHANS} SELECT silo, table_key, period, count(*) FILTER (side = 'source') AS n_source, count(*) FILTER (side = 'target') AS n_target, count(DISTINCT fk_id) AS n_references
FROM o GROUP BY silo, table_key, period""",
}
