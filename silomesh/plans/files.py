"""Readers and writers in round trips: each query writes what a table holds and returns what is read back, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from silomesh.functions.names import name_key
from silomesh.operators import graph
from silomesh.runtime import Workspace, read
from silomesh.sources import catalog as cat
from silomesh.sources import readers, writers

R6 = lambda c: F.round(c, 6).alias(c)


def _place(spark, name):
    return f"{Workspace(spark, 'files').root}/{name}"


def _links(spark, d):
    return graph.above(cat.edges(spark, d), 0.9).select("src", "tgt", "similarity")


def k1_csv_table(spark, d):
    """Customers as CSV with a header, read as text."""
    p = _place(spark, "customer")
    writers.csv(read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"), p)
    t = readers.csv_table(spark, p)
    return t.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum(F.col("c_nationkey").cast("bigint")).alias("total"), F.max("c_name").alias("last_name"))


def k2_first_writer(spark, d):
    """K2: a result that is there isn't written again."""
    p = _place(spark, "once")
    writers.csv(read(spark, d, "nation").select("n_nationkey", "n_name"), p, first_wins=True)
    writers.csv(read(spark, d, "region").select("r_regionkey", "r_name"), p, first_wins=True)
    return readers.csv_table(spark, p, "n_nationkey int, n_name string")


def k3_batches(spark, d):
    """K3: rows written in five batches; a second run finds them all complete."""
    p, o = _place(spark, "batches"), read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    first, second = writers.batches(o, p, "o_orderkey", 5), writers.batches(o, p, "o_orderkey", 5)
    back = spark.read.option("basePath", p).parquet(p)
    return back.agg(F.lit(first).alias("n_first"), F.lit(second).alias("n_second"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def k4_jsonl_triplets(spark, d):
    """Links with the neighbouring ids as negatives, as JSON lines."""
    p = _place(spark, "triplets")
    negatives = F.array((F.col("src") + 1).cast("string"), (F.col("tgt") + 1).cast("string"))
    writers.jsonl(_links(spark, d).select(F.col("src").cast("string").alias("anchor"), F.col("tgt").cast("string").alias("positive"), negatives.alias("negatives")), p)
    return readers.triplets(spark, p).select("anchor", "positive", F.array_join("negatives", ",").alias("negatives"))


def k6_graph(spark, d):
    """A property graph as node and edge tables."""
    p, e = _place(spark, "graph"), _links(spark, d)
    writers.graph(graph.degrees(e), e, p)
    nodes, edges = spark.read.parquet(f"{p}/nodes"), spark.read.parquet(f"{p}/edges")
    return edges.join(nodes, edges.src == nodes.id).select("src", "tgt", R6("similarity"), "degree")


def k8_schema_documents(spark, d):
    """The catalogue as one schema document for each silo, and its columns read from them."""
    p = _place(spark, "documents")
    col = F.struct("column_name", F.upper("dtype").alias("data_type"), F.col("prop").alias("wikidata_property_id"))
    c = cat.columns(spark, d).groupBy("db", "table_name").agg(F.collect_list(col).alias("columns"))
    k = cat.foreign_keys(spark, d).groupBy("db", F.col("src_table").alias("table_name")).agg(F.collect_list(F.struct(F.col("src_column").alias("column_name"), F.col("dst_column").alias("reference_column_name"), F.col("dst_table").alias("reference_table_name"))).alias("foreign_keys"))
    table = F.struct("table_name", F.col("columns"), F.col("foreign_keys"))
    docs = c.join(k, ["db", "table_name"], "left").groupBy("db").agg(F.collect_list(table).alias("tables")).select(F.lpad(F.col("db").cast("string"), 7, "0").alias("db_id"), F.concat(F.lit("silo "), F.col("db").cast("string")).alias("database_name"), "tables")
    writers.jsonl(docs.repartition("db_id"), p, by="db_id")
    back = readers.schema_documents(spark, f"{p}/*/*.json")
    n = readers.schema_columns(back).groupBy("db_id").agg(F.count("*").alias("n_columns"), F.count_distinct("table_name").alias("n_tables"), F.count_distinct("data_type").alias("n_types"))
    fk = readers.schema_foreign_keys(back).groupBy("db_id").agg(F.count("*").alias("n_keys"))
    return n.join(fk, "db_id", "left").select(F.col("db_id").cast("bigint").alias("db"), "n_columns", "n_tables", "n_types", F.coalesce("n_keys", F.lit(0)).alias("n_keys"))


def k10_column_mapping(spark, d):
    """Original names of union columns by silo."""
    p = _place(spark, "mapping")
    writers.column_mapping(cat.columns(spark, d).select("db", name_key("column_name").alias("name"), "column_name").dropna(), p)
    return spark.read.schema("db bigint, name string, original string").json(p)


def k11_latex_lines(spark, d):
    """A report as lines of a LaTeX table."""
    text = writers.latex(read(spark, d, "nation").orderBy("n_nationkey").select("n_nationkey", "n_name", (F.col("n_regionkey") / 3).alias("share")), 2)
    return spark.createDataFrame([(line,) for line in text.split("\n")], "line string")


def k14_prediction_rows(spark, d):
    """Predictions of each nation as rows with their position, and their probability column."""
    p, n = _place(spark, "predictions"), read(spark, d, "nation")
    ints = F.array(F.lit(0), F.lit(1), F.pmod("n_nationkey", F.lit(2)).cast("int"))
    writers.prediction_rows(n.select(F.col("n_nationkey").alias("db_id"), ints.alias("y_true"), F.reverse(ints).alias("y_pred"), F.transform(ints, lambda x: x / 4 + 0.5).alias("prob_pos")), p)
    t = readers.csv_table(spark, p)
    score = readers.metric_columns(t.columns)[0]
    return t.select(F.col("db_id").cast("int").alias("db_id"), F.col("index").cast("int").alias("index"), F.col("y_true").cast("int").alias("y_true"), F.col("y_pred").cast("int").alias("y_pred"), F.lit(score).alias("column"), F.col(score).cast("double").alias("score"))


def k15_status_report(spark, d):
    """Tasks and mean duration by status."""
    p = _place(spark, "status")
    writers.status_report(read(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("seconds")), p)
    return spark.read.schema("status string, n bigint, avg_seconds double").json(p).select("status", "n", F.round("avg_seconds", 2).alias("avg_seconds"))


def s2_listed_tables(spark, d):
    """Tables of the silos that a list of ids in a text file, and one in a CSV file, both name."""
    text, table = _place(spark, "ids_text"), _place(spark, "ids_csv")
    ids = _links(spark, d).select(F.explode(F.array("src", "tgt")).alias("id")).distinct()
    ids.select(F.concat(F.lit(" "), F.lpad(F.col("id").cast("string"), 5, "0"), F.lit(" "))).write.text(text)
    writers.csv(ids.filter("id > 20").select(F.col("id").cast("string").alias("db_id")), table)
    t = cat.tables(spark, d).select(F.lpad(F.col("db").cast("string"), 5, "0").alias("db_id"), "table_name")
    return readers.listed(t, spark, text).join(readers.id_list(spark, table).distinct(), "db_id", "left_semi")


def s7_sqlite_table(spark, d):
    """Customers loaded into a SQLite file and read back in ranges of rows, with the file's catalogue.

    SQLite needs a folder in a file system, so the shared folder has to be one.
    """
    import os

    root = _place(spark, "").removeprefix("file://").rstrip("/")
    os.makedirs(root, exist_ok=True)
    p = f"{root}/silo.db"
    writers.sqlite(read(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), p, "customer")
    held = ",".join(c for c, _ in readers.sqlite_tables(p)["customer"])
    t = readers.sqlite_table(spark, p, "customer", 500)
    return t.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("int").alias("c_nationkey"), F.lit(held).alias("columns"))


def s12_web_tables(spark, d):
    """Parquet tables of a folder with the splits they are large enough for."""
    p = _place(spark, "web")
    for i, t in enumerate(("region", "customer", "part")):
        read(spark, d, t).toDF(*(f"t{i}_{c}" for c in read(spark, d, t).columns)).coalesce(1).write.mode("append").parquet(p)
    return readers.web_tables(spark, p).select("n_columns", "n_rows", "valid_vertical", "valid_horizontal")


def s14_embedding_file(spark, d):
    """Sound vectors of an embedding file."""
    return readers.vectors(spark, f"{d}/database_embeddings.parquet", 64).groupBy("db_id").agg(F.count("*").alias("n"))


def s15_predictions(spark, d):
    """Predictions of a Parquet file without labels and of a CSV file with them."""
    one, two = _place(spark, "parquet"), _place(spark, "csv")
    e = _links(spark, d)
    e.select(F.col("src").cast("int").alias("src"), F.col("tgt").cast("int").alias("tgt"), "similarity").write.parquet(one)
    writers.csv(e.withColumn("label", (F.col("similarity") > 0.95).cast("int")), two)
    got = readers.predictions(spark, one).withColumn("kind", F.lit("parquet")).unionByName(readers.predictions(spark, two, "csv").withColumn("kind", F.lit("csv")))
    return got.groupBy("kind", "label", "edge").agg(F.count("*").alias("n"), F.round(F.sum("similarity"), 4).alias("total"))


def s16_pair_files(spark, d):
    """Pairs of a CSV and a TSV file in either order, once each, with padded ids."""
    e, out = _links(spark, d), None
    rows = e.select(F.lit("Q1").alias("qid"), F.col("tgt").alias("db_1"), F.col("src").alias("db_2")).unionByName(e.select(F.lit("Q1").alias("qid"), F.col("src").alias("db_1"), F.col("tgt").alias("db_2")))
    for kind, sep in (("csv", ","), ("tsv", "\t")):
        p = _place(spark, kind)
        rows.write.option("header", True).option("sep", sep).csv(p)
        got = readers.pairs(spark, p, sep).withColumn("kind", F.lit(kind))
        out = got if out is None else out.unionByName(got)
    return out


def s20_properties(spark, d):
    """A property file with ids as decimal numbers; a missing file has no rows."""
    p = _place(spark, "sizes")
    writers.csv(cat.tables(spark, d).groupBy("db").agg(F.count("*").alias("n_tables")).select(F.concat(F.col("db").cast("string"), F.lit(".0")).alias("db_id"), "n_tables"), p)
    got = readers.properties(spark, p, "db_id string, n_tables bigint")
    return got.unionByName(readers.properties(spark, p + "-none", "db_id string, n_tables bigint"))


def s23_results(spark, d):
    """Results in three layouts."""
    p, n = _place(spark, "results"), read(spark, d, "nation")
    m = F.struct((F.col("n_nationkey") / 100).alias("accuracy"), (F.col("n_regionkey") / 10).alias("f1"))
    key = [F.col("n_nationkey").cast("string").alias("pair_id"), F.col("n_name").alias("algorithm")]
    for rows in (n.filter("n_regionkey < 2").select(*key, m.alias("m")).select("pair_id", "algorithm", "m.*"), n.filter("n_regionkey = 2").select(*key, m.alias("weighted_metrics")), n.filter("n_regionkey > 2").select(*key, m.alias("client_0"), m.alias("client_1"))):
        rows.write.mode("append").json(p)
    return readers.results(spark, p, lines=True)


def s24_summary_texts(spark, d):
    """Metrics of a summary text."""
    p = _place(spark, "summary")
    m = _links(spark, d).agg(F.round(F.avg("similarity"), 4).alias("auc"), F.count("*").alias("n"))
    m.select(F.concat(F.lit("run of today\nAUC: "), F.format_string("%.4f", "auc"), F.lit("\nRecall = "), F.col("n").cast("string"), F.lit("\n"))).coalesce(1).write.text(p)
    return readers.summaries(spark, p).select("metric", "value")


def s25_failed_pairs(spark, d):
    """Failed pairs of an error log."""
    p = _place(spark, "log")
    lines = F.when(F.col("similarity") > 0.95, F.concat(F.lit("ERROR pair "), F.col("src").cast("string"), F.lit("-"), F.col("tgt").cast("string"), F.lit(": failed"))).otherwise(F.concat(F.lit("ok "), F.col("src").cast("string")))
    _links(spark, d).select(lines).write.text(p)
    return readers.failed_pairs(spark, p)


def f12_unfailed_links(spark, d):
    """links without the pairs that an error log calls failed."""
    p, e = _place(spark, "failures"), _links(spark, d)
    e.filter("src % 3 = 0").select(F.concat(F.lit("WARN pair "), F.col("src").cast("string"), F.lit("_"), F.col("tgt").cast("string"), F.lit(": retry"))).write.text(p)
    lost = readers.failed_pairs(spark, p).select(F.col("a").cast("bigint").alias("src"), F.col("b").cast("bigint").alias("tgt"))
    return e.join(lost, ["src", "tgt"], "left_anti").select("src", "tgt", R6("similarity"))


def s27_headerless_table(spark, d):
    """A table without a header under given names."""
    p = _place(spark, "bare")
    read(spark, d, "nation").select("n_nationkey", "n_name").write.csv(p)
    return readers.headerless_csv(spark, p, ["key", "name"]).select(F.col("key").cast("int").alias("key"), "name")


def s35_party_rows(spark, d):
    """Rows of one party and part of a partitioned table; a part that is missing is none."""
    p = _place(spark, "parties")
    o = read(spark, d, "orders").select(F.col("o_orderstatus").alias("client"), F.when(F.col("o_orderkey") % 5 == 0, "test").otherwise("train").alias("part"), "o_orderkey", "o_totalprice")
    o.write.partitionBy("client", "part").parquet(p)
    got = [readers.party_split(spark, p, c, s) for c in ("F", "O", "none") for s in ("train", "test")]
    out = None
    for rows in (g for g in got if g is not None):
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("client", "part").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


QUERIES = {f.__name__: f for f in (
    k1_csv_table, k2_first_writer, k3_batches, k4_jsonl_triplets, k6_graph, k8_schema_documents, k10_column_mapping, k11_latex_lines, k14_prediction_rows, k15_status_report, s2_listed_tables, s7_sqlite_table, s12_web_tables, s14_embedding_file, s15_predictions, s16_pair_files,
    s20_properties, s23_results, s24_summary_texts, s25_failed_pairs, f12_unfailed_links, s27_headerless_table, s35_party_rows,
)}

_L = f"{cat.SQL_EDGES}, l AS (SELECT src, tgt, similarity FROM e WHERE similarity >= 0.9)"
_KEY = "nullif(regexp_replace(lower(column_name), '[^a-z0-9]', '', 'g'), '')"

SQL = {
    "k1_csv_table": "SELECT c_mktsegment, count(*) AS n, CAST(sum(c_nationkey) AS BIGINT) AS total, max(c_name) AS last_name FROM customer GROUP BY 1",
    "k2_first_writer": "SELECT n_nationkey, n_name FROM nation",
    "k3_batches": "SELECT 5 AS n_first, 0 AS n_second, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders",
    "k4_jsonl_triplets": f"WITH {_L} SELECT CAST(src AS VARCHAR) AS anchor, CAST(tgt AS VARCHAR) AS positive, (src + 1) || ',' || (tgt + 1) AS negatives FROM l",
    "k6_graph": f"WITH {_L}, g AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM l UNION ALL SELECT tgt FROM l) GROUP BY 1) SELECT src, tgt, round(similarity, 6) AS similarity, degree FROM l JOIN g ON g.id = src",
    "k8_schema_documents": f"WITH {cat.SQL_COLUMNS}, {cat.SQL_FKS}, n AS (SELECT db, count(*) AS n_columns, count(DISTINCT table_name) AS n_tables, count(DISTINCT dtype) AS n_types FROM c GROUP BY 1), t AS (SELECT DISTINCT db, table_name FROM c), f AS (SELECT k.db, count(*) AS n_keys FROM k JOIN t ON t.db = k.db AND t.table_name = k.src_table GROUP BY 1) SELECT n.db, n_columns, n_tables, n_types, coalesce(n_keys, 0) AS n_keys FROM n LEFT JOIN f ON f.db = n.db",
    "k10_column_mapping": f"WITH {cat.SQL_COLUMNS} SELECT db, {_KEY} AS name, min(column_name) AS original FROM c WHERE {_KEY} IS NOT NULL GROUP BY 1, 2",
    "k11_latex_lines": "SELECT n_nationkey || ' & ' || n_name || ' & ' || printf('%.2f', n_regionkey / 3) || ' \\\\' AS line FROM nation",
    "k14_prediction_rows": "WITH a AS (SELECT n_nationkey AS db_id, unnest([0, 1, 2]) AS index, unnest([0, 1, n_nationkey % 2]) AS y_true, unnest([n_nationkey % 2, 1, 0]) AS y_pred FROM nation) SELECT CAST(db_id AS INT) AS db_id, index, CAST(y_true AS INT) AS y_true, CAST(y_pred AS INT) AS y_pred, 'prob_pos' AS column, y_true / 4 + 0.5 AS score FROM a",
    "k15_status_report": "SELECT o_orderstatus AS status, count(*) AS n, round(avg(o_totalprice), 2) AS avg_seconds FROM orders GROUP BY 1",
    "s2_listed_tables": f"WITH {_L}, {cat.SQL_TABLES}, i AS (SELECT src AS id FROM l UNION SELECT tgt FROM l) SELECT lpad(CAST(db AS VARCHAR), 5, '0') AS db_id, table_name FROM t WHERE db IN (SELECT id FROM i) AND db > 20",
    "s7_sqlite_table": "SELECT c_custkey, c_name, CAST(c_nationkey AS INT) AS c_nationkey, 'c_custkey,c_name,c_nationkey' AS columns FROM customer",
    "s12_web_tables": "SELECT * FROM (SELECT 5 AS n_columns, count(*) AS n_rows, false AS valid_vertical, count(*) >= 50 AS valid_horizontal FROM customer UNION ALL SELECT 6, count(*), true, count(*) >= 50 FROM part)",
    "s14_embedding_file": "SELECT db_id, count(*) AS n FROM database_embeddings WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND NOT isnan(x))) GROUP BY 1",
    "s15_predictions": f"WITH {_L} SELECT 'parquet' AS kind, CAST(NULL AS INT) AS label, CAST(NULL AS INT) AS edge, count(*) AS n, round(sum(similarity), 4) AS total FROM l UNION ALL SELECT 'csv', CAST(similarity > 0.95 AS INT), NULL, count(*), round(sum(similarity), 4) FROM l GROUP BY 2",
    "s16_pair_files": f"WITH {_L}, p AS (SELECT lpad(CAST(src AS VARCHAR), 5, '0') AS a, lpad(CAST(tgt AS VARCHAR), 5, '0') AS b FROM l) SELECT 'Q1' AS qid, least(a, b) AS db_1, greatest(a, b) AS db_2, kind FROM p, (VALUES ('csv'), ('tsv')) k(kind)",
    "s20_properties": f"WITH {cat.SQL_TABLES} SELECT lpad(CAST(db AS VARCHAR), 5, '0') AS db_id, count(*) AS n_tables FROM t GROUP BY 1",
    "s23_results": "SELECT CAST(n_nationkey AS VARCHAR) AS pair_id, n_name AS algorithm, c AS client, n_nationkey / 100 AS accuracy, n_regionkey / 10 AS f1 FROM nation, (VALUES ('all'), ('client_0'), ('client_1')) v(c) WHERE (n_regionkey > 2) = (c <> 'all')",
    "s24_summary_texts": f"WITH {_L} SELECT 'AUC' AS metric, round(avg(similarity), 4) AS value FROM l UNION ALL SELECT 'Recall', count(*) FROM l",
    "s25_failed_pairs": f"WITH {_L} SELECT lpad(CAST(src AS VARCHAR), 5, '0') AS a, lpad(CAST(tgt AS VARCHAR), 5, '0') AS b FROM l WHERE similarity > 0.95",
    "f12_unfailed_links": f"WITH {_L} SELECT src, tgt, round(similarity, 6) AS similarity FROM l WHERE src % 3 <> 0",
    "s27_headerless_table": "SELECT CAST(n_nationkey AS INT) AS key, n_name AS name FROM nation",
    "s35_party_rows": "SELECT o_orderstatus AS client, CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS part, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2",
}
