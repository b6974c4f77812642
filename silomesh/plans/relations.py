"""Queries over names, texts, joins, pairs and triplets, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from silomesh.functions.names import name_key, padded_id
from silomesh.operators import graph, pairs, serialize
from silomesh.runtime import read
from silomesh.sources import catalog as cat

R6 = lambda c: F.round(c, 6).alias(c)


def x1_name_keys(spark, d):
    """Distinct column names under the five name rules."""
    c = cat.columns(spark, d)
    return c.agg(F.count_distinct("column_name").alias("n_names"), *(F.count_distinct(name_key("column_name", k)).alias(f"n_{k}") for k in ("unicode", "ascii", "separators", "dotted", "lower")))


def x5_base_entity(spark, d):
    """First two dot segments of dotted column names."""
    c = cat.columns(spark, d).filter("column_name like '%.%'")
    return c.select(F.array_join(F.slice(F.split("column_name", r"\."), 1, 2), ".").alias("base")).groupBy("base").agg(F.count("*").alias("n"))


def x6_padded_ids(spark, d):
    """Silo ids of folder names, padded to five digits."""
    p = read(spark, d, "pair_metadata").select(F.regexp_extract("folder1", r"^(\d+) ", 1).alias("id"), F.regexp_extract("folder1", r"^\d+ (.*)$", 1).alias("name")).filter("id <> ''").distinct()
    return p.select(padded_id(F.col("id").cast("bigint").cast("string")).alias("db"), "name")


def _described(spark, d):
    names = read(spark, d, "schema_tables").filter("database_name is not null").groupBy(cat.silo_id().alias("db")).agg(F.min("database_name").alias("name"))
    return cat.columns(spark, d).join(names, "db")


def x10_schema_text(spark, d):
    """Text of each silo's schema, as its length and checksum."""
    return serialize.schema_text(_described(spark, d).withColumn("samples", F.lit(None).cast("array<string>")), "schema").select("db", F.length("text").alias("n"), F.md5("text").alias("digest"))


def x10_full_text(spark, d):
    """The form with samples; types stand for values."""
    s = _described(spark, d).withColumn("samples", F.array("dtype", "prop", "dtype"))
    return serialize.schema_text(s, "full").select("db", F.length("text").alias("n"), F.md5("text").alias("digest"))


def x20_prompt_text(spark, d):
    """The schema text, or the table names when it is too long, cut."""
    base = _described(spark, d).withColumn("samples", F.lit(None).cast("array<string>"))
    full, short = serialize.schema_text(base, "schema"), serialize.schema_text(base, "tables").withColumnRenamed("text", "short")
    return full.join(short, "db").select("db", F.length(serialize.bounded_text(F.col("text"), F.col("short"))).alias("n"))


def x12_row_text(spark, d):
    """Rows of a table as text."""
    return read(spark, d, "customer").select("c_custkey", serialize.row_text(["c_name", "c_mktsegment", "c_nationkey"]).alias("text"))


def x13_column_text(spark, d):
    """The text of a column from its distinct values."""
    v = read(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("v"))
    return v.select("c_nationkey", serialize.column_text(F.lit("customer"), F.lit("c_mktsegment"), F.col("v")).alias("text"))


def x14_encoded_columns(spark, d):
    """Four encoders of a header and its values."""
    v = read(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("v"))
    return v.select("c_nationkey", *(f(F.lit("seg"), F.col("v")).alias(k.replace("-", "_")) for k, f in serialize.ENCODERS.items()))


def x15_camel_names(spark, d):
    """Camel-case silo names as words."""
    n = read(spark, d, "schema_tables").filter("database_name is not null").select("database_name").distinct()
    return n.select("database_name", serialize.camel_split(F.col("database_name")).alias("words"))


def x18_byte_sizes(spark, d):
    """Sizes of the largest texts with their unit."""
    return read(spark, d, "documents").filter("text is not null").select("doc_id", serialize.byte_size(F.octet_length("text")).alias("size"))


def x16_log_metrics(spark, d):
    """Client losses extracted from log texts."""
    docs = read(spark, d, "documents").filter("doc_type = 'run_log' and text is not null")
    hit = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"client \d+ loss (\d+\.\d+)"), 1)).alias("loss"))
    return hit.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.avg(F.col("loss").cast("double")), 6).alias("avg_loss"))


def x17_contains(spark, d):
    """Columns whose name holds a word, by silo."""
    return cat.columns(spark, d).filter(F.lower("column_name").contains("date")).groupBy("db").agg(F.count("*").alias("n"))


def r3_json_props(spark, d):
    """Numbers of a JSON column by event type."""
    e = read(spark, d, "events").select("event_type", F.from_json("props", "map<string,double>").alias("m"))
    return e.select("event_type", F.explode("m").alias("k", "v")).groupBy("event_type", "k").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"))


def r7_cache_keys(spark, d):
    """Short digest of the sorted suppliers of each part size."""
    p = read(spark, d, "part").groupBy("p_size").agg(F.array_join(F.array_sort(F.collect_set(F.col("p_partkey").cast("string"))), "_").alias("ids"))
    return p.select("p_size", F.substring(F.md5("ids"), 1, 12).alias("digest"))


def j1_fk_join_chain(spark, d):
    """Orders with customer and nation along foreign keys."""
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = read(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey", "c_nationkey", "c_mktsegment")
    j = pairs.fk_left_join(o, c, "o_custkey", "c_custkey", "customer")
    return pairs.fk_left_join(j, read(spark, d, "nation"), "c_nationkey", "n_nationkey", "nation").groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def j4_deduplicated_join(spark, d):
    """Customers with their first order only."""
    c = read(spark, d, "customer").select("c_custkey", "c_name")
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return pairs.fk_left_join(c, o, "c_custkey", "o_custkey", "orders", ["o_orderkey"]).select("c_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


def j6_join_size(spark, d):
    """Rows of the join of four tables, without building it."""
    t = {n: read(spark, d, n) for n in ("lineitem", "orders", "customer", "nation")}
    return pairs.join_size({"lineitem": t["lineitem"].select("l_orderkey"), "orders": t["orders"].select("o_orderkey", "o_custkey"), "customer": t["customer"].select("c_custkey", "c_nationkey"), "nation": t["nation"].select("n_nationkey")}, [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey")])


def j7_join_size_estimate(spark, d):
    """The estimate of a join from sizes and distinct keys: parents keep the size of the largest table, children of its
    parents multiply it by their rows for each key."""
    names = {"orders": ["o_custkey"], "customer": ["c_nationkey"], "nation": [], "supplier": ["s_nationkey"]}
    sizes, distinct = {}, {}
    for t, keys in names.items():
        row = read(spark, d, t).agg(F.count("*").alias("n"), *(F.count_distinct(k).alias(k) for k in keys)).first()
        sizes[t] = row["n"]
        distinct |= {(t, k): row[k] for k in keys}
    e = pairs.estimated_join_size(sizes, distinct, [("orders", "o_custkey", "customer"), ("customer", "c_nationkey", "nation"), ("supplier", "s_nationkey", "nation")])
    return spark.createDataFrame([(float(e),)], "estimate double").select(R6("estimate"))


def _silo_tables(spark, d):
    """The order tables with the key names that their foreign keys use on both sides."""
    named = lambda t, **cols: read(spark, d, t).select(*(F.col(c).alias(n) for n, c in cols.items()))
    return {
        "orders": named("orders", orderkey="o_orderkey", custkey="o_custkey", price="o_totalprice", status="o_orderstatus"),
        "region": named("region", regionkey="r_regionkey", name="r_name"),
        "customer": named("customer", custkey="c_custkey", nationkey="c_nationkey", name="c_mktsegment", balance="c_acctbal"),
        "nation": named("nation", nationkey="n_nationkey", name="n_name", regionkey="n_regionkey"),
        "one_status": named("orders", orderkey="o_orderkey", status="o_orderstatus").filter("orderkey = 1").drop("orderkey"),
        "lonely": named("part", partkey="p_partkey"),
    }


_KEYS = [("orders", "custkey", "customer", "custkey"), ("customer", "nationkey", "nation", "nationkey"), ("nation", "regionkey", "region", "regionkey"), ("orders", "status", "one_status", "status"), ("lonely", "partkey", "orders", "orderkey")]


def j1_automated_chain(spark, d):
    """Orders, as the table of the label, with all tables that foreign keys reach from it; a region that comes
    before its key does is left out, as are a table whose key has one value and one without a usable key."""
    out = pairs.join_chain(_silo_tables(spark, d), _KEYS, "orders")
    return out.groupBy("name", "name_nation", F.lit(",".join(sorted(out.columns))).alias("columns")).agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))


def j2_capped_chain(spark, d):
    """The chain from the largest table, which ends at the first thousand rows in the order of all columns."""
    out = pairs.join_chain(_silo_tables(spark, d), _KEYS, None, 1000)
    return out.select("custkey", "orderkey", F.round("price", 2).alias("price"), "name")


def j3_joinable_keys(spark, d):
    """For each pair of tables of a silo the first foreign key whose two columns have one name and exist."""
    fk = cat.foreign_keys(spark, d).select("db", "src_table", "dst_table", F.lower("src_column").alias("src_column"), F.lower("dst_column").alias("dst_column")).filter("src_column = dst_column")
    c = cat.columns(spark, d).select("db", F.lower("table_name").alias("tab"), F.lower("column_name").alias("col")).distinct()
    side = lambda t: c.select("db", F.col("tab").alias(t), F.col("col").alias("src_column"))
    low = fk.select("db", F.lower("src_table").alias("child"), F.lower("dst_table").alias("parent"), "src_column")
    usable = low.join(side("child"), ["db", "child", "src_column"], "left_semi").join(side("parent"), ["db", "parent", "src_column"], "left_semi")
    return usable.groupBy("db", "child", "parent").agg(F.min("src_column").alias("key"))


def union_schema(spark, d):
    """Three parties under the union of their columns, zeros and masks for what they lack."""
    p = {"buyers": read(spark, d, "customer").select(F.col("c_acctbal").alias("Acct_Bal"), F.col("c_nationkey").alias("nation key")), "sellers": read(spark, d, "supplier").select(F.col("s_acctbal").alias("acctbal"), F.col("s_suppkey").alias("ID")), "goods": read(spark, d, "part").select(F.col("p_size").alias("SIZE"), F.col("p_partkey").alias("id"))}
    u = pairs.union_schema(p)
    mask = F.array_join(F.transform("mask", lambda m: m.cast("int").cast("string")), "").alias("mask")
    return u.groupBy("party", mask).agg(F.count("*").alias("n"), *(F.round(F.sum(c), 2).alias(c) for c in ("acctbal", "id", "nationkey", "size")))


def column_map(spark, d):
    """The original name of every union column in each silo."""
    c = cat.columns(spark, d).select("db", name_key("column_name", "separators").alias("name"), "column_name").filter("name <> ''")
    return pairs.column_map(c)


def column_renames(spark, d):
    """For each pair of linked silos the column of the second that is renamed to the first's of the same key."""
    c = cat.columns(spark, d).select("db", name_key("column_name", "unicode").alias("key"), "column_name").dropna().groupBy("db", "key").agg(F.min("column_name").alias("column_name"))
    e = graph.above(cat.edges(spark, d), 0.95).select("src", "tgt")
    side = lambda end, name: c.select(F.col("db").alias(end), "key", F.col("column_name").alias(name))
    return e.join(side("src", "column_name"), "src").join(side("tgt", "renamed"), ["tgt", "key"]).select("src", "tgt", "renamed", "column_name")


def vertical_sides(spark, d):
    """The side or sides of every column of a table that is split vertically with a fifth of its columns on both.

    Columns of one key count once; tables with fewer than four aren't split.
    """
    c = cat.columns(spark, d).select("db", "table_name", name_key("column_name", "unicode").alias("key"), "column_name").dropna()
    return pairs.vertical_sides(c.groupBy("db", "table_name", "key").agg(F.min("column_name").alias("column_name")).drop("key"), 0.2)


def f7_complete_labels(spark, d):
    """loads of both statistics tables without the rows that miss the label."""
    c, s = (read(spark, d, t).select("load_no", F.col("db_id").alias("label")) for t in ("column_cardinality", "column_sparsity"))
    l, r = pairs.complete_labels(c, s, "label")  # noqa: E741
    count = lambda df, n: df.groupBy("load_no").agg(F.count("*").alias(n))
    return count(l, "n_left").join(count(r, "n_right"), "load_no", "full")


def f11_shared_labels(spark, d):
    """possible labels of the order tables by name, classes and rows."""
    from silomesh.operators import profile

    out = None
    for db, t, cols in ((1, "customer", ["c_mktsegment", "c_name"]), (1, "orders", ["o_orderstatus", "o_orderpriority"]), (2, "part", ["p_type", "p_brand", "p_size"]), (2, "region", ["r_name"])):
        c = profile.cells(read(spark, d, t), cols).groupBy("column_name", "value").agg(F.count("*").alias("n")).select(F.lit(db).alias("db"), F.lit(t).alias("table_name"), "column_name", "value", "n")
        out = c if out is None else out.unionByName(c)
    return pairs.shared_labels(out, ["mkt_segment", "status", "priority", "type", "name"])


def f14_linked_folders(spark, d):
    """folders whose id belongs to a linked silo."""
    p = read(spark, d, "pair_metadata").select(F.explode(F.array("folder1", "folder2")).alias("folder")).distinct()
    ids = graph.above(cat.edges(spark, d), 0.9).select(F.explode(F.array("src", "tgt")).alias("id")).distinct()
    return p.withColumn("id", F.expr("try_cast(regexp_extract(folder, '^([0-9]+) ', 1) AS BIGINT)")).join(ids, "id", "left_semi").select("id", "folder")


def s28_column_counts(spark, d):
    """Number of columns of the silo that a longer id begins with."""
    n = cat.columns(spark, d).groupBy(F.lpad(F.col("db").cast("string"), 7, "0").alias("db")).agg(F.count("*").alias("n_columns"))
    asked = cat.tables(spark, d).select(F.concat_ws("_", F.lpad(F.col("db").cast("string"), 7, "0"), "table_name").alias("key"))
    return asked.withColumn("db", F.element_at(F.split("key", "_"), 1)).join(n, "db", "left").select("key", F.coalesce("n_columns", F.lit(0)).alias("n_columns"))


def s33_display_names(spark, d):
    """The name of each linked silo, or a text in its place."""
    names = read(spark, d, "schema_tables").filter("database_name is not null").groupBy(cat.silo_id().alias("id")).agg(F.min("database_name").alias("name"))
    ids = cat.edges(spark, d).select(F.explode(F.array("src", "tgt")).alias("id")).distinct()
    return ids.join(names, "id", "left").select("id", F.coalesce("name", F.concat(F.lit("Database "), F.col("id").cast("string"))).alias("name"))


def x11_legacy_text(spark, d):
    """X11: the older schema texts, as length and checksum of each form."""
    c, out = cat.columns(spark, d).select("db", "table_name", "column_name", "prop"), None
    for form, args in (("plain", {}), ("tables", {"tables_only": True}), ("properties", {"sep": " | ", "properties": True})):
        t = serialize.legacy_text(c, **args).select("db", F.lit(form).alias("form"), F.length("text").alias("n"), F.md5("text").alias("digest"))
        out = t if out is None else out.unionByName(t)
    return out


def x8_null_words(spark, d):
    """Which spellings of a missing value count as one."""
    from silomesh.operators import knowledge

    words = F.explode(F.array(*(F.lit(w) for w in ("NaN", "-", "Unknown", "other (unknown)", "nil", "n/a", "None", "", " ", "null", "NA", "x y", "a--b!"))))
    said = read(spark, d, "region").select("r_regionkey", words.alias("word"))
    return said.select("r_regionkey", "word", knowledge.clean_value(F.col("word")).alias("clean"))


def j23_full_negatives(spark, d):
    """Every other silo as a negative of the links whose first silo is divisible by 50."""
    e = graph.above(cat.edges(spark, d), 0.8).filter("src % 50 = 0").select(F.col("src").alias("anchor"), F.col("tgt").alias("positive"))
    ids = cat.tables(spark, d).select(F.col("db").alias("id")).distinct()
    return pairs.full_negatives(e, ids).groupBy("anchor", "positive").agg(F.count("*").alias("n_negatives"), F.sum("negative").alias("sum_negatives"))


def e6_table_triplets(spark, d):
    """Split tables with three random sides of other tables as negatives."""
    c = cat.columns(spark, d).groupBy("db", "table_name").agg(F.count("*").alias("n_columns"))
    r = read(spark, d, "column_cardinality").groupBy(cat.silo_id().alias("db"), "table_name").agg(F.max("n_rows").alias("n_rows"))
    t = c.join(r, ["db", "table_name"], "left").select(F.concat_ws("/", "db", "table_name").alias("table_id"), (F.col("n_columns") >= 6).alias("valid_vertical"), (F.coalesce("n_rows", F.lit(0)) >= 50).alias("valid_horizontal"))
    return pairs.table_triplets(t, 3)


def l14_attempts(spark, d):
    """Attempts of a queue of tasks on six slots, of which some are done and some fail."""
    tasks = read(spark, d, "orders").filter("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("task"), F.pmod(F.col("o_custkey"), F.lit(5)).cast("int").alias("failures"))
    done = read(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("task"))
    return pairs.attempts(tasks, done, 6)


def j8_entity_join(spark, d):
    """Two parties joined on the entity string, with prefixed columns."""
    a = read(spark, d, "customer").select(F.concat(F.lit("C."), F.col("c_custkey").cast("string")).alias("entity"), F.col("c_acctbal").alias("primary_acctbal"))
    b = read(spark, d, "orders").select(F.concat(F.lit("C."), F.col("o_custkey").cast("string"), F.lit(".x")).alias("k"), F.col("o_totalprice").alias("secondary_price")).withColumn("entity", F.array_join(F.slice(F.split("k", r"\."), 1, 2), "."))
    return a.join(b, "entity", "left").groupBy("entity").agg(F.count("secondary_price").alias("n"), F.round(F.max("secondary_price"), 2).alias("top"))


def j9_linked_inner_join(spark, d):
    """Rows that both parties hold."""
    return read(spark, d, "orders").join(read(spark, d, "customer").filter("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def _topics(spark, d):
    t = read(spark, d, "schema_tables").select(cat.silo_id().alias("db"), F.col("wikidata_topic_item_id").alias("qid"))
    return pairs.members_in_groups(t, "qid", "db")


def j22_topic_links(spark, d):
    """Silos by topic, with the number of silos that each is paired with through it."""
    return _topics(spark, d).select("qid", "db", "n_linked")


def j20_negative_pool(spark, d):
    """Silos that no shared topic pairs with another."""
    linked = _topics(spark, d).filter("n_linked > 0").select(F.col("db").alias("id"))
    return pairs.negative_pool(cat.tables(spark, d).select(F.col("db").alias("id")).distinct(), linked).select("id")


def _triplets(spark, d):
    pool = cat.tables(spark, d).select(F.col("db").alias("id")).distinct()
    return pairs.triplets(graph.above(cat.edges(spark, d), 0.9).select(F.col("src").alias("a"), F.col("tgt").alias("b")), pool, 3)


def e5_triplets(spark, d):
    """Triplets with three consecutive negatives of the shuffled pool each."""
    return _triplets(spark, d).select("anchor", "positive", F.array_join(F.transform("negatives", lambda x: x.cast("string")), ",").alias("negatives"))


def p10_exploded_triplets(spark, d):
    """One row for each positive and negative, and one negative of each triplet (label 2)."""
    t = _triplets(spark, d)
    return pairs.explode_triplets(t).unionByName(pairs.one_negative(t, 1).select("anchor", F.col("negative").alias("other"), F.lit(2).alias("label")))


def a36_repeated_anchors(spark, d):
    """Silos that are first in more than one link."""
    return graph.above(cat.edges(spark, d), 0.9).groupBy("src").agg(F.count("*").alias("n")).filter("n > 1")


def a37_split_overlap(spark, d):
    """Silos in both halves of the links."""
    e = graph.above(cat.edges(spark, d), 0.8)
    ids = lambda cond: e.filter(cond).select(F.explode(F.array("src", "tgt")).alias("id")).distinct()
    a, b = ids("(src + tgt) % 2 = 0"), ids("(src + tgt) % 2 = 1")
    return a.join(b.withColumn("hit", F.lit(1)), "id", "left").agg(F.count("*").alias("n_first"), F.count("hit").alias("n_both"), F.round(100 * F.count("hit") / F.count("*"), 4).alias("percent"))


def p7_column_masks(spark, d):
    """Union of the column names of all silos, and those all of them have."""
    c = cat.columns(spark, d).select("db", name_key("column_name", "separators").alias("name")).filter("name <> ''").distinct()
    return pairs.column_masks(c, c.select("db").distinct().count())


def p12_horizontal_halves(spark, d):
    """The half of every row, cut at a share."""
    return pairs.horizontal_halves(read(spark, d, "part"), "p_partkey", 0.3).select("p_partkey", "half")


def u1_union_parties(spark, d):
    """Rows of two parties under one schema, absent columns as null."""
    a = read(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = read(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("nation").agg(F.count("*").alias("n"), F.count("segment").alias("n_segments"), F.round(F.sum("balance"), 2).alias("balance"))


def u3_common_labels(spark, d):
    """Segments that customers of every nation have."""
    c = read(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct()
    n = c.select("c_nationkey").distinct().count()
    return c.groupBy("c_mktsegment").agg(F.count("*").alias("k")).filter(F.col("k") == n).select("c_mktsegment")


def k5_upserted_results(spark, d):
    """Retried results replace the old ones by key, then statuses are counted."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("pair_id"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("ok").alias("status"))
    retry = o.filter("status = 'failed' and pair_id % 2 = 0").withColumn("status", F.lit("ok"))
    return pairs.upsert(o, retry, ["pair_id"]).groupBy("status").agg(F.count("*").alias("n"))


def j10_zip_join(spark, d):
    """Two projections of a table joined by position."""
    p = read(spark, d, "part")
    return pairs.zip_join(p.select("p_partkey", "p_brand"), p.select("p_partkey", "p_size"), "p_partkey").groupBy("p_brand").agg(F.sum("p_size").alias("total"))


QUERIES = {f.__name__: f for f in (
    x1_name_keys, x5_base_entity, x6_padded_ids, x10_schema_text, x10_full_text, x20_prompt_text, x12_row_text, x13_column_text, x14_encoded_columns, x15_camel_names, x18_byte_sizes, x16_log_metrics, x17_contains, r3_json_props, r7_cache_keys, j1_fk_join_chain,
    j4_deduplicated_join, j6_join_size, j7_join_size_estimate, j8_entity_join, j9_linked_inner_join, j22_topic_links, j20_negative_pool, e5_triplets, a36_repeated_anchors, a37_split_overlap, u1_union_parties, u3_common_labels, k5_upserted_results, j10_zip_join,
)}
QUERIES |= {f.__name__: f for f in (j1_automated_chain, j2_capped_chain, j3_joinable_keys, union_schema, column_map, column_renames, vertical_sides, f7_complete_labels, f11_shared_labels, f14_linked_folders, s28_column_counts, s33_display_names, x11_legacy_text, x8_null_words, j23_full_negatives, e6_table_triplets, l14_attempts)}
QUERIES |= {"triplets_exploded": p10_exploded_triplets, "column_masks": p7_column_masks, "horizontal_halves": p12_horizontal_halves}

_C, _E, _T = cat.SQL_COLUMNS, cat.SQL_EDGES, cat.SQL_TABLES
_NM = f"{_C}, m AS (SELECT try_cast(trim(db_id) AS BIGINT) AS db, min(database_name) AS name FROM schema_tables WHERE database_name IS NOT NULL GROUP BY 1), s AS (SELECT c.*, m.name FROM c JOIN m ON m.db = c.db)"
_TEXT = "b AS (SELECT db, name, table_name, string_agg({0}, chr(10) ORDER BY column_name) AS body FROM s GROUP BY 1, 2, 3), z AS (SELECT db, 'Database Name: ' || name || chr(10) || string_agg('Table: ' || table_name || chr(10) || body, chr(10) ORDER BY table_name) AS text, 'Database Name: ' || name || chr(10) || string_agg('Table: ' || table_name, chr(10) ORDER BY table_name) AS short FROM b GROUP BY db, name)"
_COL = "' - Column: ' || column_name"
_FULL = "' - ' || column_name || ', Samples: [' || CASE WHEN dtype IS NULL AND prop IS NULL THEN 'N/A' ELSE concat_ws('|', dtype, prop) END || ']'"
_TP = "q AS (SELECT DISTINCT try_cast(trim(db_id) AS BIGINT) AS db, wikidata_topic_item_id AS qid FROM schema_tables WHERE wikidata_topic_item_id IS NOT NULL AND try_cast(trim(db_id) AS BIGINT) IS NOT NULL), f AS (SELECT *, count(*) OVER (PARTITION BY qid) - 1 AS n_linked FROM q)"
_SEG = "v AS (SELECT c_nationkey, list_sort(list(DISTINCT c_mktsegment)) AS v FROM customer GROUP BY 1)"



def _draw(key, seed):
    return f"CAST('0x' || substr(md5(concat_ws('|', {key}, {seed})), 1, 13) AS BIGINT) / 4503599627370496.0"


_UKEY = "nullif(regexp_replace(lower(column_name), '[^\\\\p{L}\\\\p{N}]', '', 'g'), '')".replace("\\\\", "\\")
_TR = f"""{_E}, {_T}, o AS (SELECT DISTINCT db AS id FROM t), p AS (SELECT id, row_number() OVER (ORDER BY md5(concat_ws('|', id, 0)), id) - 1 AS pos, count(*) OVER () AS size FROM o),
l AS (SELECT src AS anchor, tgt AS positive, row_number() OVER (ORDER BY md5(concat_ws('|', src, tgt, 0)), src, tgt) - 1 AS pos FROM e WHERE similarity >= 0.9),
g AS (SELECT l.anchor, l.positive, i, p.id AS negative FROM l, range(3) x(i), (SELECT count(*) AS size FROM o) z JOIN p ON p.pos = (l.pos * 3 + i) % z.size)"""
_CHAIN = "orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey"

SQL = {
    "j7_join_size_estimate": "SELECT round(CAST((SELECT count(*) FROM orders) AS DOUBLE) * (SELECT count(*) FROM supplier) / (SELECT count(DISTINCT s_nationkey) FROM supplier), 6) AS estimate",
    "j1_automated_chain": f"SELECT c_mktsegment AS name, n_name AS name_nation, 'balance,custkey,name,name_nation,nationkey,orderkey,price,regionkey,status' AS columns, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {_CHAIN} GROUP BY 1, 2",
    "j2_capped_chain": "SELECT o_custkey AS custkey, o_orderkey AS orderkey, round(o_totalprice, 2) AS price, c_mktsegment AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey ORDER BY o_custkey, o_orderkey LIMIT 1000",
    "j3_joinable_keys": f"""WITH {cat.SQL_FKS}, {_C}, x AS (SELECT DISTINCT db, lower(table_name) AS tab, lower(column_name) AS col FROM c) SELECT k.db, lower(src_table) AS child, lower(dst_table) AS parent, min(lower(src_column)) AS key FROM k
  JOIN x a ON a.db = k.db AND a.tab = lower(src_table) AND a.col = lower(src_column) JOIN x b ON b.db = k.db AND b.tab = lower(dst_table) AND b.col = lower(src_column) WHERE lower(src_column) = lower(dst_column) GROUP BY 1, 2, 3""",
    "union_schema": "SELECT 'buyers' AS party, '1010' AS mask, count(*) AS n, round(sum(c_acctbal), 2) AS acctbal, 0.0 AS id, CAST(sum(c_nationkey) AS DOUBLE) AS nationkey, 0.0 AS size FROM customer UNION ALL SELECT 'sellers', '1100', count(*), round(sum(s_acctbal), 2), sum(s_suppkey), 0, 0 FROM supplier UNION ALL SELECT 'goods', '0101', count(*), 0, sum(p_partkey), 0, sum(p_size) FROM part",
    "column_map": f"WITH {_C}, s AS (SELECT db, regexp_replace(lower(column_name), '[_\\s\\-]', '', 'g') AS name, min(column_name) AS original FROM c GROUP BY 1, 2), n AS (SELECT name, count(*) AS n_silos FROM s WHERE name <> '' GROUP BY 1) SELECT db, s.name, original, n_silos, n_silos = (SELECT count(DISTINCT db) FROM s WHERE name <> '') AS everywhere FROM s JOIN n ON n.name = s.name",
    "column_renames": f"WITH {_E}, {_C}, q AS (SELECT db, {_UKEY} AS key, min(column_name) AS column_name FROM c WHERE {_UKEY} IS NOT NULL GROUP BY 1, 2) SELECT src, tgt, b.column_name AS renamed, a.column_name FROM e JOIN q a ON a.db = src JOIN q b ON b.db = tgt AND b.key = a.key WHERE similarity >= 0.95",
    "vertical_sides": f"""WITH {_C}, q AS (SELECT db, table_name, {_UKEY} AS key, min(column_name) AS column_name FROM c WHERE {_UKEY} IS NOT NULL GROUP BY 1, 2, 3), r AS (SELECT db, table_name, column_name, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY db, table_name) AS n FROM q WINDOW w AS (PARTITION BY db, table_name ORDER BY column_name)),
z AS (SELECT *, CAST(floor(n * 0.2) AS BIGINT) AS shared, (n + CAST(floor(n * 0.2) AS BIGINT)) // 2 AS cut FROM r WHERE n >= 4) SELECT db, table_name, column_name, pos < cut AS on_left, pos >= cut - shared AS on_right FROM z""",
    "f7_complete_labels": "WITH l AS (SELECT load_no, count(*) AS n_left FROM column_cardinality WHERE db_id IS NOT NULL GROUP BY 1), r AS (SELECT load_no, count(*) AS n_right FROM column_sparsity WHERE db_id IS NOT NULL GROUP BY 1) SELECT coalesce(l.load_no, r.load_no) AS load_no, n_left, n_right FROM l FULL JOIN r ON r.load_no = l.load_no",
    "f11_shared_labels": """WITH v AS (SELECT 1 AS db, 'customer' AS table_name, 'c_mktsegment' AS column_name, c_mktsegment AS value FROM customer UNION ALL SELECT 1, 'customer', 'c_name', c_name FROM customer UNION ALL SELECT 1, 'orders', 'o_orderstatus', o_orderstatus FROM orders UNION ALL SELECT 1, 'orders', 'o_orderpriority', o_orderpriority FROM orders
  UNION ALL SELECT 2, 'part', 'p_type', p_type FROM part UNION ALL SELECT 2, 'region', 'r_name', r_name FROM region) SELECT db, table_name, column_name, count(*) AS n_rows, count(DISTINCT value) AS n_classes FROM v WHERE value IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 10 AND count(DISTINCT value) BETWEEN 2 AND 10""",
    "f14_linked_folders": f"WITH {_E}, i AS (SELECT src AS id FROM e WHERE similarity >= 0.9 UNION SELECT tgt FROM e WHERE similarity >= 0.9), p AS (SELECT folder1 AS folder FROM pair_metadata UNION SELECT folder2 FROM pair_metadata) SELECT try_cast(regexp_extract(folder, '^([0-9]+) ', 1) AS BIGINT) AS id, folder FROM p WHERE try_cast(regexp_extract(folder, '^([0-9]+) ', 1) AS BIGINT) IN (SELECT id FROM i)",
    "s28_column_counts": f"WITH {_C}, {_T}, n AS (SELECT db, count(*) AS k FROM c GROUP BY 1) SELECT lpad(CAST(t.db AS VARCHAR), 7, '0') || '_' || t.table_name AS key, coalesce(k, 0) AS n_columns FROM t LEFT JOIN n ON n.db = t.db",
    "s33_display_names": f"WITH {_E}, i AS (SELECT src AS id FROM e UNION SELECT tgt FROM e), m AS (SELECT try_cast(trim(db_id) AS BIGINT) AS id, min(database_name) AS name FROM schema_tables WHERE database_name IS NOT NULL GROUP BY 1) SELECT i.id, coalesce(m.name, 'Database ' || i.id) AS name FROM i LEFT JOIN m ON m.id = i.id",
    "x11_legacy_text": f"""WITH {_C}, f AS (SELECT db, table_name, string_agg(column_name, ', ' ORDER BY column_name) AS a, string_agg(column_name || coalesce(' (' || prop || ')', ''), ' | ' ORDER BY column_name) AS b FROM c GROUP BY 1, 2),
x AS (SELECT db, unnest(['plain', 'tables', 'properties']) AS form, unnest([string_agg(table_name || ': ' || a, chr(10) ORDER BY table_name), string_agg(table_name, chr(10) ORDER BY table_name), string_agg(table_name || ': ' || b, chr(10) ORDER BY table_name)]) AS text FROM f GROUP BY db) SELECT db, form, CAST(length(text) AS INT) AS n, md5(text) AS digest FROM x""",
    "x8_null_words": "SELECT r_regionkey, w AS word, c AS clean FROM region, (VALUES ('NaN', NULL), ('-', NULL), ('Unknown', NULL), ('other (unknown)', NULL), ('nil', 'nil'), ('n/a', 'n a'), ('None', NULL), ('', NULL), (' ', NULL), ('null', NULL), ('NA', NULL), ('x y', 'x y'), ('a--b!', 'a b')) v(w, c)",
    "j23_full_negatives": f"WITH {_E}, {_T}, o AS (SELECT DISTINCT db AS id FROM t) SELECT src AS anchor, tgt AS positive, count(*) AS n_negatives, CAST(sum(id) AS BIGINT) AS sum_negatives FROM e JOIN o ON o.id <> e.src AND o.id <> e.tgt WHERE similarity >= 0.8 AND src % 50 = 0 GROUP BY 1, 2",
    "e6_table_triplets": f"""WITH {_C}, n AS (SELECT db, table_name, count(*) AS k FROM c GROUP BY 1, 2), r AS (SELECT try_cast(trim(db_id) AS BIGINT) AS db, table_name, max(n_rows) AS n_rows FROM column_cardinality GROUP BY 1, 2),
v AS (SELECT concat_ws('/', n.db, n.table_name) AS id, k, coalesce(n_rows, 0) AS n_rows FROM n LEFT JOIN r ON r.db = n.db AND r.table_name = n.table_name), u AS (SELECT 'vertical' AS split, id FROM v WHERE k >= 6 UNION ALL SELECT 'horizontal', id FROM v WHERE n_rows >= 50),
p AS (SELECT split, id, row_number() OVER (PARTITION BY split ORDER BY md5(concat_ws('|', id, 0)), id) - 1 AS pos, count(*) OVER (PARTITION BY split) AS n FROM u),
a AS (SELECT split, id, i, (pos + CAST(floor({_draw("concat_ws('-', split, id, i)", 0)} * (n - 1)) AS BIGINT) + 1) % n AS at, CASE WHEN {_draw("concat_ws('-', split, id, i)", 1)} < 0.5 THEN 'first' ELSE 'second' END AS side FROM p, range(3) x(i) WHERE n > 1)
SELECT a.split, a.id AS table_id, CAST(i AS INT) AS i, p.id AS negative, side FROM a JOIN p ON p.split = a.split AND p.pos = a.at""",
    "l14_attempts": """WITH t AS (SELECT o_orderkey AS task, o_custkey % 5 AS f, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderstatus <> 'P')
SELECT task, CAST(a AS INT) AS attempt, CASE WHEN a > f THEN 'done' WHEN a > 2 THEN 'given up' ELSE 'failed' END AS status, CAST(floor(pos / 6) AS BIGINT) AS wave, pos % 6 AS slot FROM t, range(1, 4) x(a) WHERE a <= least(f + 1, 3)""",
    "e5_triplets": f"WITH {_TR} SELECT anchor, positive, string_agg(CAST(negative AS VARCHAR), ',' ORDER BY i) AS negatives FROM g GROUP BY 1, 2",
    "triplets_exploded": f"""WITH {_TR} SELECT anchor, positive AS other, 1 AS label FROM l UNION ALL SELECT anchor, negative, 0 FROM g
UNION ALL SELECT anchor, negative, 2 FROM g WHERE i = CAST(floor({_draw("concat_ws('-', anchor, positive)", 1)} * 3) AS BIGINT)""",
    "horizontal_halves": "WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY md5(concat_ws('|', p_partkey, 0)), p_partkey) - 1 AS pos, count(*) OVER () AS n FROM part) SELECT p_partkey, CAST(pos >= floor(n * 0.3) AS INT) AS half FROM r",
    "x1_name_keys": f"""WITH {_C} SELECT count(DISTINCT column_name) AS n_names, count(DISTINCT nullif(regexp_replace(lower(column_name), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '')) AS n_unicode, count(DISTINCT nullif(regexp_replace(lower(column_name), '[^a-z0-9]', '', 'g'), '')) AS n_ascii,
  count(DISTINCT nullif(regexp_replace(lower(column_name), '[_\\s\\-]', '', 'g'), '')) AS n_separators, count(DISTINCT nullif(regexp_replace(lower(string_split(column_name, '.')[-1]), '[^a-z0-9]', '', 'g'), '')) AS n_dotted, count(DISTINCT nullif(lower(column_name), '')) AS n_lower FROM c""",
    "x5_base_entity": f"WITH {_C} SELECT array_to_string(string_split(column_name, '.')[1:2], '.') AS base, count(*) AS n FROM c WHERE column_name LIKE '%.%' GROUP BY 1",
    "x6_padded_ids": "SELECT DISTINCT CASE WHEN length(CAST(CAST(i AS BIGINT) AS VARCHAR)) >= 5 THEN CAST(CAST(i AS BIGINT) AS VARCHAR) ELSE lpad(CAST(CAST(i AS BIGINT) AS VARCHAR), 5, '0') END AS db, n AS name FROM (SELECT regexp_extract(folder1, '^(\\d+) ', 1) AS i, regexp_extract(folder1, '^\\d+ (.*)$', 1) AS n FROM pair_metadata) WHERE i <> ''",
    "x10_schema_text": f"WITH {_NM}, {_TEXT.format(_COL)} SELECT db, CAST(length(text) AS INT) AS n, md5(text) AS digest FROM z",
    "x10_full_text": f"WITH {_NM}, {_TEXT.format(_FULL)} SELECT db, CAST(length(text) AS INT) AS n, md5(text) AS digest FROM z",
    "x20_prompt_text": f"WITH {_NM}, {_TEXT.format(_COL)} SELECT db, CAST(least(1024, CASE WHEN length(text) > 1024 THEN length(short) ELSE length(text) END) AS INT) AS n FROM z",
    "x12_row_text": "SELECT c_custkey, '[c_name]: ' || substring(trim(c_name), 1, 100) || ' | [c_mktsegment]: ' || c_mktsegment || ' | [c_nationkey]: ' || c_nationkey AS text FROM customer",
    "x13_column_text": f"WITH {_SEG}, l AS (SELECT *, list_transform(v, lambda x: length(x)) AS s FROM v) SELECT c_nationkey, 'customer. c_mktsegment contains ' || len(v) || ' values (' || list_max(s) || ', ' || list_min(s) || ', ' || CAST(round(CAST(list_sum(s) AS DOUBLE) / len(v), 2) AS VARCHAR) || '): ' || array_to_string(v, ', ') AS text FROM l",
    "x14_encoded_columns": f"WITH {_SEG} SELECT c_nationkey, 'seg ' || array_to_string(v, ' ') AS header_values, 'seg seg seg seg seg ' || array_to_string(v, ' ') AS header_values_repeat, 'seg: ' || array_to_string(v, ', ') AS header_comma, 'seg' AS header_only FROM v",
    "x15_camel_names": "SELECT DISTINCT database_name, regexp_replace(regexp_replace(database_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g') AS words FROM schema_tables WHERE database_name IS NOT NULL",
    "x18_byte_sizes": "SELECT doc_id, CASE WHEN strlen(text) >= 1048576 THEN printf('%.2f MB', floor(strlen(text) * 100 / 1048576 + 0.5) / 100) WHEN strlen(text) >= 1024 THEN printf('%.2f KB', floor(strlen(text) * 100 / 1024 + 0.5) / 100) ELSE printf('%.2f B', CAST(strlen(text) AS DOUBLE)) END AS size FROM documents WHERE text IS NOT NULL",
    "x16_log_metrics": "WITH l AS (SELECT doc_id, unnest(regexp_extract_all(text, 'client \\d+ loss (\\d+\\.\\d+)', 1)) AS x FROM documents WHERE doc_type = 'run_log' AND text IS NOT NULL) SELECT doc_id, count(*) AS n, round(avg(CAST(x AS DOUBLE)), 6) AS avg_loss FROM l GROUP BY 1",
    "x17_contains": f"WITH {_C} SELECT db, count(*) AS n FROM c WHERE contains(lower(column_name), 'date') GROUP BY 1",
    "r3_json_props": "WITH e AS (SELECT event_type, unnest(map_entries(CAST(CAST(props AS JSON) AS MAP(VARCHAR, DOUBLE)))) AS m FROM events) SELECT event_type, m.key AS k, count(*) AS n, round(sum(m.value), 4) AS total FROM e GROUP BY 1, 2",
    "r7_cache_keys": "SELECT p_size, substring(md5(string_agg(DISTINCT CAST(p_partkey AS VARCHAR), '_' ORDER BY CAST(p_partkey AS VARCHAR))), 1, 12) AS digest FROM part GROUP BY 1",
    "j1_fk_join_chain": "SELECT n_name, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2",
    "j4_deduplicated_join": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) SELECT c_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM customer LEFT JOIN r ON o_custkey = c_custkey AND k = 1",
    "j6_join_size": "SELECT count(*) AS n_rows FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey",
    "j8_entity_join": "WITH b AS (SELECT 'C.' || o_custkey AS entity, o_totalprice FROM orders) SELECT a.entity, count(b.o_totalprice) AS n, round(max(b.o_totalprice), 2) AS top FROM (SELECT 'C.' || c_custkey AS entity FROM customer) a LEFT JOIN b ON b.entity = a.entity GROUP BY 1",
    "j9_linked_inner_join": "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0 GROUP BY 1",
    "j22_topic_links": f"WITH {_TP} SELECT qid, db, n_linked FROM f",
    "j20_negative_pool": f"WITH {_T}, {_TP} SELECT DISTINCT db AS id FROM t WHERE db NOT IN (SELECT db FROM f WHERE n_linked > 0)",
    "a36_repeated_anchors": f"WITH {_E} SELECT src, count(*) AS n FROM e WHERE similarity >= 0.9 GROUP BY 1 HAVING count(*) > 1",
    "a37_split_overlap": f"WITH {_E}, i AS (SELECT DISTINCT (src + tgt) % 2 AS h, unnest([src, tgt]) AS id FROM e WHERE similarity >= 0.8), c AS (SELECT count(*) AS n, count(*) FILTER (id IN (SELECT id FROM i WHERE h = 1)) AS b FROM i WHERE h = 0) SELECT n AS n_first, b AS n_both, round(100 * b / n, 4) AS percent FROM c",
    "column_masks": f"WITH {_C}, s AS (SELECT DISTINCT db, regexp_replace(lower(column_name), '[_\\s\\-]', '', 'g') AS name FROM c) SELECT name, count(DISTINCT db) AS n_silos, count(DISTINCT db) = (SELECT count(DISTINCT db) FROM s WHERE name <> '') AS everywhere FROM s WHERE name <> '' GROUP BY 1",
    "u1_union_parties": "SELECT nation, count(*) AS n, count(segment) AS n_segments, round(sum(balance), 2) AS balance FROM (SELECT c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_nationkey, s_acctbal, NULL FROM supplier) GROUP BY 1",
    "u3_common_labels": "SELECT c_mktsegment FROM customer GROUP BY 1 HAVING count(DISTINCT c_nationkey) = (SELECT count(DISTINCT c_nationkey) FROM customer)",
    "k5_upserted_results": "SELECT CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 <> 0 THEN 'failed' ELSE 'ok' END AS status, count(*) AS n FROM orders GROUP BY 1",
    "j10_zip_join": "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY 1",
}
