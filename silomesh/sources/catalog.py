"""The silo catalogue: tables, columns, foreign keys, links and vectors of all silos, one clean row each.

Every function reads one table, keeps the columns it needs and removes repeated rows; a field that one copy of a row lost
is taken from the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silomesh.runtime import is_nan, read


def silo_id(col: str = "db_id"):
    return F.expr(f"try_cast(trim({col}) AS BIGINT)")


def tables(spark: SparkSession, d: str) -> DataFrame:
    """(db, table_name)."""
    return read(spark, d, "schema_tables").select(silo_id().alias("db"), "table_name").dropna().distinct()


def columns(spark: SparkSession, d: str) -> DataFrame:
    """(db, table_name, column_name, dtype, prop) of existing columns; the type is lower-cased."""
    held = read(spark, d, "schema_columns").filter("removed_at is null")
    named = held.select(silo_id().alias("db"), "table_name", "column_name", F.lower("data_type").alias("dtype"), F.col("wikidata_property_id").alias("prop"))
    return named.dropna(subset=["db", "table_name", "column_name"]).groupBy("db", "table_name", "column_name").agg(F.min("dtype").alias("dtype"), F.min("prop").alias("prop"))


def foreign_keys(spark: SparkSession, d: str) -> DataFrame:
    """(db, src_table, src_column, dst_table, dst_column)."""
    fk = read(spark, d, "foreign_keys").select(silo_id().alias("db"), F.col("table_name").alias("src_table"), F.col("column_name").alias("src_column"), F.col("reference_table_name").alias("dst_table"), F.col("reference_column_name").alias("dst_column"))
    return fk.dropna().filter((F.trim("dst_table") != "") & (F.trim("dst_column") != "")).distinct()


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, tgt, similarity, n_common): one row for each unordered pair, with its largest sound similarity."""
    p = read(spark, d, "pair_metadata").filter((F.col("db_id1") != F.col("db_id2")) & ~is_nan(F.col("similarity")) & F.col("similarity").between(-1, 1))
    pair = p.select(F.least("db_id1", "db_id2").alias("src"), F.greatest("db_id1", "db_id2").alias("tgt"), "similarity", "num_common_columns")
    return pair.groupBy("src", "tgt").agg(F.max("similarity").alias("similarity"), F.max("num_common_columns").alias("n_common"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(id, v): the unit-norm test vectors in double precision."""
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


#: The same views in SQL.
SQL_TABLES = "t AS (SELECT DISTINCT try_cast(trim(db_id) AS BIGINT) AS db, table_name FROM schema_tables WHERE table_name IS NOT NULL AND try_cast(trim(db_id) AS BIGINT) IS NOT NULL)"
SQL_COLUMNS = """c AS (SELECT try_cast(trim(db_id) AS BIGINT) AS db, table_name, column_name, min(lower(data_type)) AS dtype, min(wikidata_property_id) AS prop FROM schema_columns
  WHERE removed_at IS NULL AND table_name IS NOT NULL AND column_name IS NOT NULL AND try_cast(trim(db_id) AS BIGINT) IS NOT NULL GROUP BY 1, 2, 3)"""
SQL_FKS = """k AS (SELECT DISTINCT try_cast(trim(db_id) AS BIGINT) AS db, table_name AS src_table, column_name AS src_column, reference_table_name AS dst_table, reference_column_name AS dst_column FROM foreign_keys
  WHERE try_cast(trim(db_id) AS BIGINT) IS NOT NULL AND table_name IS NOT NULL AND column_name IS NOT NULL AND trim(reference_table_name) <> '' AND trim(reference_column_name) <> '')"""
SQL_EDGES = """e AS (SELECT least(db_id1, db_id2) AS src, greatest(db_id1, db_id2) AS tgt, max(similarity) AS similarity, max(num_common_columns) AS n_common FROM pair_metadata
  WHERE db_id1 <> db_id2 AND NOT isnan(similarity) AND similarity BETWEEN -1 AND 1 GROUP BY 1, 2)"""
SQL_VECTORS = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
