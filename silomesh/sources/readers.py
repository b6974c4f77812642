"""Readers (S1-S37): schema documents, data tables, pairs, triplets, predictions, properties, results and logs.

Every reader declares its schema; a missing optional file gives an empty frame with that schema, bad rows become nulls.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silomesh.functions.names import padded_id

S, A = T.StringType(), T.ArrayType
_COLUMN = T.StructType([T.StructField("column_name", S), T.StructField("alternative_column_names", A(S)), T.StructField("data_type", S), T.StructField("wikidata_property_id", S)])
_FK = T.StructType([T.StructField(c, S) for c in ("column_name", "reference_column_name", "reference_table_name")])
_TABLE = T.StructType([T.StructField("table_name", S), T.StructField("alternative_table_names", A(S)), T.StructField("file_name", S), T.StructField("columns", A(_COLUMN)), T.StructField("foreign_keys", A(_FK))])
#: A schema document; a bare table document has the table's fields at the top.
SILO = T.StructType([T.StructField("database_name", S), T.StructField("alternative_database_names", A(S)), T.StructField("wikidata_topic_item_id", S), T.StructField("tables", A(_TABLE)), *_TABLE.fields])
PAIRS = "qid string, db_1 string, db_2 string"
TRIPLETS = "anchor string, positive string, negatives array<string>"
PREDICTIONS = "src bigint, tgt bigint, similarity double, label int, edge int"
NULL_TOKENS = ["", "NA", "null", "NaN", "nan"]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def schema_documents(spark: SparkSession, path: str) -> DataFrame:
    """(db_id, database_name, tables): silos from JSON files ``<id>_<name>.json``, or files in folders ``db_id=<id>``
    (S1, S4, S5); the first file of an id wins.

    A bare table document is a silo of one table; column types are lower-cased.
    """
    docs = spark.read.schema(SILO).json(path, multiLine=True).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    one = F.struct(*(F.col(f.name) for f in _TABLE.fields))
    lower = lambda t: t.withField("columns", F.transform(t["columns"], lambda c: c.withField("data_type", F.lower(c["data_type"]))))
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/db_id=(\d+)/[^/]*$", 1)
    held = docs.select(F.coalesce(F.nullif(F.regexp_extract("file", r"^(\d+)", 1), F.lit("")), folder).alias("db_id"), "file", F.coalesce("database_name", "table_name").alias("database_name"), F.transform(F.coalesce("tables", F.array(one)), lower).alias("tables"))
    first = held.filter("db_id <> ''").groupBy("db_id").agg(F.min(F.struct("file", "database_name", "tables")).alias("d"))
    return first.select(padded_id("db_id").alias("db_id"), "d.database_name", "d.tables")


def schema_columns(docs: DataFrame) -> DataFrame:
    """(db_id, table_name, column_name, data_type) of schema documents."""
    return docs.select("db_id", F.inline("tables")).select("db_id", "table_name", F.inline("columns")).select("db_id", "table_name", "column_name", "data_type")


def schema_foreign_keys(docs: DataFrame) -> DataFrame:
    """Foreign keys of schema documents whose columns both have a name."""
    return docs.select("db_id", F.inline("tables")).select("db_id", "table_name", F.inline("foreign_keys")).filter("column_name is not null and reference_column_name is not null")


def listed(df: DataFrame, spark: SparkSession, path: str, col: str = "db_id") -> DataFrame:
    """Rows whose id is a line of a text file."""
    return df.join(spark.read.text(path).select(F.trim("value").alias(col)).distinct(), col, "left_semi")


def csv_table(spark: SparkSession, path: str, schema: str | None = None, sample: int | None = None, seed: int = 42) -> DataFrame:
    """A CSV table with a header, all strings unless a schema is given (S6, S10, S11, S21); ``sample`` rows in hash order."""
    r = spark.read.option("header", True).option("encoding", "UTF-8").option("mode", "PERMISSIVE")
    df = (r.schema(schema) if schema else r).csv(path)
    if not schema:
        df = df.select(*(F.when(~F.col(f"`{c}`").isin(NULL_TOKENS), F.col(f"`{c}`")).alias(c) for c in df.columns))
    return df if sample is None else df.orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], F.lit(seed))).limit(sample)


def headerless_csv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A CSV file without a header under given names."""
    return spark.read.csv(path).toDF(*names)


def web_tables(spark: SparkSession, path: str, least_columns: int = 6, least_rows: int = 50) -> DataFrame:
    """(file, n_columns, n_rows, valid_vertical, valid_horizontal) of Parquet tables.

    Counts come from one scan grouped by file; the columns of a file are those that are not null throughout.
    """
    df = spark.read.option("mergeSchema", True).parquet(path)
    cols = df.columns
    by_file = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n_rows"), *(F.count(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(cols)))
    n = sum((F.when(F.col(f"_c{i}") > 0, 1).otherwise(0) for i in range(1, len(cols))), F.when(F.col("_c0") > 0, 1).otherwise(0))
    out = by_file.select("file", n.alias("n_columns"), "n_rows")
    return out.withColumns({"valid_vertical": F.col("n_columns") >= least_columns, "valid_horizontal": F.col("n_rows") >= least_rows}).filter("valid_vertical or valid_horizontal")


def pairs(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(qid, db_1, db_2) with padded ids, each unordered pair once."""
    p = spark.read.option("header", True).option("sep", sep).schema(PAIRS).csv(path)
    a, b = padded_id("db_1"), padded_id("db_2")
    return p.select("qid", F.least(a, b).alias("db_1"), F.greatest(a, b).alias("db_2")).distinct()


def triplets(spark: SparkSession, path: str) -> DataFrame:
    """(anchor, positive, negatives) from JSON lines."""
    return spark.read.schema(TRIPLETS).json(path)


def predictions(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """(src, tgt, similarity, label, edge); a file without label or edge has nulls there."""
    if kind == "csv":
        df = spark.read.option("header", True).csv(path)
    else:
        df = spark.read.parquet(path)
    types = dict(t.split(" ") for t in PREDICTIONS.split(", "))
    return df.select(*(F.try_to_number(F.lit(None), F.lit("9")).cast(t).alias(c) if c not in df.columns else F.col(c).try_cast(t).alias(c) for c, t in types.items()))


def properties(spark: SparkSession, path: str, schema: str, key: str = "db_id") -> DataFrame:
    """A property table with its id coerced through a number and padded; empty when the file is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.option("header", True).schema(schema).csv(path)
    return df.withColumn(key, padded_id(F.col(key).try_cast("double").cast("bigint").cast("string")))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """(db_id) of a one-column CSV with a header."""
    return spark.read.option("header", True).schema("db_id string").csv(path).select(padded_id("db_id").alias("db_id"))


def folder_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(db_id, name, n_files, n_bytes) of folders ``<id> <name>`` (S29, A4); reads file facts only, no content."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    part = F.regexp_replace(F.col("path"), "%20", " ")
    named = f.select(F.regexp_extract(part, r"/(\d+) ([^/]+)/", 1).alias("id"), F.regexp_extract(part, r"/\d+ ([^/]+)/", 1).alias("name"), "length").filter("id <> ''")
    return named.groupBy(padded_id("id").alias("db_id"), "name").agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))


def results(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(pair_id, algorithm, client, accuracy, f1) of result files, or JSON lines, in any of the three layouts."""
    m = "accuracy double, f1 double"
    schema = f"pair_id string, algorithm string, {m}, weighted_metrics struct<{m}>, client_0 struct<{m}>, client_1 struct<{m}>"
    df = spark.read.schema(schema).json(path, multiLine=not lines)
    flat = F.struct(F.lit("all").alias("client"), F.coalesce("accuracy", "weighted_metrics.accuracy").alias("accuracy"), F.coalesce("f1", "weighted_metrics.f1").alias("f1"))
    each = [F.struct(F.lit(c).alias("client"), F.col(f"{c}.accuracy").alias("accuracy"), F.col(f"{c}.f1").alias("f1")) for c in ("client_0", "client_1")]
    clients = F.when(F.col("client_0").isNotNull() | F.col("client_1").isNotNull(), F.array(*each)).otherwise(F.array(flat))
    return df.select("pair_id", "algorithm", F.inline(clients)).select("pair_id", "algorithm", "client", F.nanvl("accuracy", F.lit(0.0)).alias("accuracy"), F.nanvl("f1", F.lit(0.0)).alias("f1"))


def summaries(spark: SparkSession, path: str, names: tuple[str, ...] = ("AUC", "F1", "Precision", "Recall", "Accuracy")) -> DataFrame:
    """(file, metric, value) of ``Name: 0.123`` lines in text files."""
    t = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = F.array(*(F.struct(F.lit(n).alias("metric"), F.regexp_extract("value", rf"(?i)\b{n}\s*[:=]\s*([0-9.]+)", 1).try_cast("double").alias("number")) for n in names))
    return t.select("file", F.inline(rows)).filter("number is not null").withColumnRenamed("number", "value")


def failed_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(a, b) of ``pair <a>-<b>:`` lines of an error log, padded."""
    t = spark.read.text(path).select(F.regexp_extract("value", r"pair (\d+)[-_](\d+):", 1).alias("a"), F.regexp_extract("value", r"pair (\d+)[-_](\d+):", 2).alias("b"))
    return t.filter("a <> ''").select(padded_id("a").alias("a"), padded_id("b").alias("b")).distinct()


def party_split(spark: SparkSession, path: str, client: str, part: str) -> DataFrame | None:
    """Rows of one client and part of a partitioned table, None when it has no such part."""
    if not exists(spark, f"{path}/client={client}/part={part}"):
        return None
    return spark.read.parquet(path).filter((F.col("client") == client) & (F.col("part") == part))


def vectors(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """(db_id, v) of a Parquet file of embeddings (S14); vectors of another length or with missing or NaN elements are dropped."""
    held = spark.read.parquet(path).select("db_id", F.col("embedding").cast("array<double>").alias("v"))
    return held.filter((F.size("v") == dims) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))


def metric_columns(columns: list[str]) -> list[str]:
    """The probability columns of a prediction file (F19): ``prob_pos`` of a binary one, else the sorted ``prob_<k>``."""
    if "prob_pos" in columns:
        return ["prob_pos"]
    return sorted((c for c in columns if c.startswith("prob_") and c[5:].isdigit()), key=lambda c: int(c[5:]))


def sqlite_tables(path: str) -> dict[str, list[tuple[str, str]]]:
    """Table to its (column, declared type) in a SQLite file (S9); read on the driver, as it is the file's catalogue."""
    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as con:
        names = [r[0] for r in con.execute("select name from sqlite_master where type = 'table' order by name")]
        return {t: [(r[1], r[2]) for r in con.execute(f'pragma table_info("{t}")')] for t in names}


def sqlite_table(spark: SparkSession, path: str, table: str, rows: int = 100_000) -> DataFrame:
    """All columns of a SQLite table as text (S7, S8); the file lies where all executors see it.

    Tasks read ranges of about ``rows`` row numbers of their own, so no task and no copy in memory holds the table.
    """
    names = [c for c, _ in sqlite_tables(path)[table]]
    quoted = ", ".join(f'"{c}"' for c in names)
    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as con:
        low, high = con.execute(f'select min(rowid), max(rowid) from "{table}"').fetchone()
    starts = [] if low is None else list(range(low, high + 1, rows))

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start in b["id"]:
                with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as con:
                    got = con.execute(f'select {quoted} from "{table}" where rowid >= ? and rowid < ?', (int(start), int(start) + rows)).fetchall()
                yield pd.DataFrame([[None if v is None else str(v) for v in r] for r in got], columns=names, dtype=object)

    schema = ", ".join(f"`{c}` string" for c in names)
    return spark.createDataFrame([(s,) for s in starts], "id long").repartition(max(1, len(starts))).mapInPandas(fetch, schema)
