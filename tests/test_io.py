"""Readers and writers in round trips, and the streaming forms."""

import json

from conftest import rows
from pyspark.sql import functions as F

from silomesh.operators.value_counts import ValueCountTable
from silomesh.sources import readers, writers
from silomesh.streaming import events


def test_schema_documents(spark, tmp_path):
    col = lambda n: {"column_name": n, "data_type": "STRING"}
    (tmp_path / "7_one.json").write_text(json.dumps({"database_name": "one", "tables": [{"table_name": "t", "columns": [col("a"), col("b")], "foreign_keys": [{"column_name": "a", "reference_column_name": "x", "reference_table_name": "u"}]}]}))
    (tmp_path / "8_bare.json").write_text(json.dumps({"table_name": "solo", "columns": [col("c")]}))
    (tmp_path / "readme.json").write_text("{}")
    docs = readers.schema_documents(spark, f"file://{tmp_path}/*.json")
    assert rows(readers.schema_columns(docs)) == [("00007", "t", "a", "string"), ("00007", "t", "b", "string"), ("00008", "solo", "c", "string")]
    assert readers.schema_foreign_keys(docs).count() == 1


def test_pairs_results_and_logs(spark, tmp_path):
    (tmp_path / "p.csv").write_text("qid,db_1,db_2\nQ1,9,3\nQ1,3,9\n")
    assert rows(readers.pairs(spark, f"file://{tmp_path}/p.csv")) == [("Q1", "00003", "00009")]
    (tmp_path / "r").mkdir()
    (tmp_path / "r/a.json").write_text(json.dumps({"pair_id": "1", "algorithm": "x", "accuracy": 0.5, "f1": 0.4}))
    (tmp_path / "r/b.json").write_text(json.dumps({"pair_id": "2", "algorithm": "x", "weighted_metrics": {"accuracy": 0.6, "f1": 0.1}}))
    (tmp_path / "r/c.json").write_text(json.dumps({"pair_id": "3", "algorithm": "solo", "client_0": {"accuracy": 0.7, "f1": 0.2}, "client_1": {"accuracy": 0.8, "f1": 0.3}}))
    assert rows(readers.results(spark, f"file://{tmp_path}/r"), "pair_id", "client", "accuracy") == [("1", "all", 0.5), ("2", "all", 0.6), ("3", "client_0", 0.7), ("3", "client_1", 0.8)]
    (tmp_path / "log.txt").write_text("x\nERROR pair 12-34: failed\nok\n")
    assert rows(readers.failed_pairs(spark, f"file://{tmp_path}/log.txt")) == [("00012", "00034")]
    (tmp_path / "s.txt").write_text("AUC: 0.91\nF1 = 0.8\n")
    assert rows(readers.summaries(spark, f"file://{tmp_path}/s.txt"), "metric", "value") == [("AUC", 0.91), ("F1", 0.8)]


def test_tables_and_properties(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,NA\n,x\n")
    assert rows(readers.csv_table(spark, f"file://{tmp_path}/t.csv")) == [("1", None), (None, "x")]
    assert readers.csv_table(spark, f"file://{tmp_path}/t.csv", sample=1).count() == 1
    assert readers.properties(spark, f"file://{tmp_path}/none.csv", "db_id string, x double").count() == 0
    (tmp_path / "q.csv").write_text("db_id,x\n12.0,0.5\n")
    assert rows(readers.properties(spark, f"file://{tmp_path}/q.csv", "db_id string, x double")) == [("00012", 0.5)]
    spark.range(60).selectExpr("id a", "id b").coalesce(1).write.parquet(f"file://{tmp_path}/w")
    assert rows(readers.web_tables(spark, f"file://{tmp_path}/w"), "n_columns", "n_rows", "valid_horizontal") == [(2, 60, True)]
    (tmp_path / "f/12 Name").mkdir(parents=True)
    (tmp_path / "f/12 Name/x.csv").write_text("abc")
    assert rows(readers.folder_catalog(spark, f"file://{tmp_path}/f")) == [("00012", "Name", 1, 3)]


def test_predictions_and_parties(spark, tmp_path):
    spark.createDataFrame([(1, 2, 0.5)], "src int, tgt int, similarity float").write.parquet(f"file://{tmp_path}/p")
    assert rows(readers.predictions(spark, f"file://{tmp_path}/p")) == [(1, 2, 0.5, None, None)]
    spark.createDataFrame([("a", "train", 1), ("a", "test", 2)], "client string, part string, x int").write.partitionBy("client", "part").parquet(f"file://{tmp_path}/s")
    assert readers.party_split(spark, f"file://{tmp_path}/s", "a", "test").first().x == 2
    assert readers.party_split(spark, f"file://{tmp_path}/s", "b", "test") is None


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    writers.csv(df, f"file://{tmp_path}/c")
    writers.csv(df.limit(1), f"file://{tmp_path}/c", first_wins=True)
    assert readers.csv_table(spark, f"file://{tmp_path}/c").count() == 2
    assert (writers.batches(df, f"file://{tmp_path}/b", "id", 3), writers.batches(df, f"file://{tmp_path}/b", "id", 3)) == (3, 0)
    assert spark.read.parquet(f"file://{tmp_path}/b").count() == 2
    t = spark.createDataFrame([("x", "y", ["z"])], readers.TRIPLETS)
    writers.jsonl(t, f"file://{tmp_path}/t")
    assert readers.triplets(spark, f"file://{tmp_path}/t").collect() == t.collect()
    writers.prediction_rows(spark.createDataFrame([("1", [0, 1], [1, 1], [0.6, 0.7])], "db_id string, y_true array<int>, y_pred array<int>, prob_pos array<double>"), f"file://{tmp_path}/pr")
    assert readers.csv_table(spark, f"file://{tmp_path}/pr").count() == 2
    assert writers.latex(df.orderBy("id")) == "1 & a \\\\\n2 & b \\\\"


def test_streams_agree_with_tables(spark, tmp_path):
    df = spark.range(200).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 3600).alias("ts"), (F.col("id") % 3).cast("string").alias("event_type"), F.col("id").cast("double").alias("value"))
    df.coalesce(1).write.parquet(f"file://{tmp_path}/e")
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/e")
    q = events.windowed(stream).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("w")) == rows(events.windowed(df, streaming=False))
    table = ValueCountTable(spark, f"file://{tmp_path}/counts")
    events.follow_counts(stream, table, [], "event_type", f"file://{tmp_path}/ck").awaitTermination(60)
    assert rows(table.state()) == [("0", 67), ("1", 67), ("2", 66)]


def test_entry_module_registers_all():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) > 100


def test_release_and_shipping(spark):
    from silomesh import runtime

    work = runtime.Workspace(spark, "kept")
    df = work.write(spark.range(5))
    assert df.count() == 5 and readers.exists(spark, work.root)
    assert runtime.release(spark) >= 1 and not readers.exists(spark, work.root) and runtime.release(spark) == 0
    runtime.ship_package(spark)


def test_sqlite_in_ranges(spark, tmp_path):
    p = str(tmp_path / "a.db")
    df = spark.createDataFrame([(i, None if i % 3 else f"v{i}") for i in range(50)], "k int, v string")
    assert writers.sqlite(df, p, "t") == 50 and writers.sqlite(df.limit(0), p, "none") == 0
    assert [c for c, _ in readers.sqlite_tables(p)["t"]] == ["k", "v"]
    got = readers.sqlite_table(spark, p, "t", 7)
    assert got.count() == 50 and got.filter("v is null").count() == 33 and readers.sqlite_table(spark, p, "none").count() == 0


def test_prediction_columns_and_vectors(spark, tmp_path):
    assert readers.metric_columns(["a", "prob_pos", "prob_1"]) == ["prob_pos"] and readers.metric_columns(["prob_10", "prob_2", "prob_x"]) == ["prob_2", "prob_10"]
    df = spark.createDataFrame([("1", [1.0, 2.0]), ("2", [1.0]), ("3", None), ("4", [1.0, float("nan")]), ("5", [None, 1.0])], "db_id string, embedding array<float>")
    df.write.parquet(f"file://{tmp_path}/e")
    assert rows(readers.vectors(spark, f"file://{tmp_path}/e", 2), "db_id") == [("1",)]
