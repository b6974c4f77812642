"""Queries over vectors, sets, distributions and the value knowledge base, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from silomesh.functions.names import name_key
from silomesh.operators import graph, knowledge, vector
from silomesh.runtime import read
from silomesh.sources import catalog as cat

R6 = lambda c: F.round(c, 6).alias(c)


def v1_unit_vectors(spark, d):
    """V1: length of each raw silo vector and of the normalised one."""
    v = read(spark, d, "database_embeddings").filter("size(embedding) = 64").select("db_id", F.col("embedding").cast("array<double>").alias("v")).filter(~F.exists("v", F.isnan)).distinct()
    return v.select("db_id", F.round(vector.norm(F.col("v")), 4).alias("length"), F.round(vector.norm(vector.unit(F.col("v"))), 6).alias("unit_length"))


def v2_all_pairs(spark, d):
    """All pairs of vectors with a cosine above 0.35, by matrix blocks."""
    return vector.similarity_join(cat.vectors(spark, d), 0.35).select("src", "tgt", R6("similarity"))


def v3_labelled_pairs(spark, d):
    """V3: all pairs above 0.3 with the flag of equal labels."""
    v = cat.vectors(spark, d)
    lab = v.select("id", "label")
    out = vector.similarity_join(v, 0.3).join(lab.select(F.col("id").alias("src"), F.col("label").alias("l1")), "src").join(lab.select(F.col("id").alias("tgt"), F.col("label").alias("l2")), "tgt")
    return out.select("src", "tgt", R6("similarity"), (F.col("l1") == F.col("l2")).cast("int").alias("same_label"))


def v4_nearest_neighbours(spark, d):
    """Pairs in which one vector is among the other's three nearest."""
    return vector.knn(cat.vectors(spark, d), 3).select("src", "tgt", R6("similarity"))


def v4_nearest_one_sided(spark, d):
    """V4: the one-sided form that keeps src < tgt only."""
    return vector.knn(cat.vectors(spark, d), 3, symmetric=False).select("src", "tgt", R6("similarity"))


def v5_closest_to_query(spark, d):
    """The ten vectors most similar to a given one."""
    q = [1.0 if i % 2 else -1.0 for i in range(64)]
    return vector.closest_to(cat.vectors(spark, d), q, 10).select("id", R6("similarity"))


def v6_pair_cosine(spark, d):
    """Cosine of given pairs; those without a vector are dropped."""
    v = cat.vectors(spark, d)
    pairs = v.select(F.col("id").alias("a"), (F.col("id") + 7).alias("b"))
    return vector.pair_cosine(pairs, v).select("a", "b", R6("similarity"))


def _column_vectors(spark, d):
    v = cat.vectors(spark, d)
    return v.select(F.concat(F.lit("t"), F.col("label").cast("string")).alias("tab"), F.concat(F.lit("c"), F.lpad((F.col("id") % 37).cast("string"), 2, "0"), F.lit("_"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("col"), "v")


def v7_weighted_column_match(spark, d):
    """V7: best column pair of each table pair by least idf times cosine."""
    cols = _column_vectors(spark, d)
    idf = cols.filter("substring(col, 2, 1) = '0'").select("col", F.lit(0.5).alias("idf")).distinct()
    return vector.best_weighted_match(cols, idf).select("t1", "t2", "c1", "c2", R6("score"))


def v8_top_matrix(spark, d):
    """V8: the two most similar columns of another table for every column."""
    c = _column_vectors(spark, d).withColumn("id", F.regexp_extract("col", r"_(\d+)$", 1).cast("bigint"))
    top = vector.nearest(c.select("id", "tab", "v"), 2, "tab")
    name = lambda i: c.select(F.col("id").alias(i), F.col("col").alias("c1" if i == "src" else "c2"))
    named = top.join(name("src"), "src").join(name("tgt"), "tgt")
    return named.select("c1", "c2", "rank", R6("similarity"))


def w3_greedy_column_match(spark, d):
    """One-to-one column matches of each table pair in falling cosine."""
    s = vector.column_scores(_column_vectors(spark, d), 0.2)
    return vector.greedy_match(s.select("t1", "t2", F.col("c1").alias("a"), F.col("c2").alias("b"), F.round("similarity", 9).alias("score")), ["t1", "t2"]).select("t1", "t2", "a", "b", R6("score"))


def w3_best_of_both(spark, d):
    """The matches that come first for both of their columns, which the greedy match always holds."""
    s = vector.column_scores(_column_vectors(spark, d), 0.2).select("t1", "t2", F.col("c1").alias("a"), F.col("c2").alias("b"), F.round("similarity", 9).alias("score"))
    first = lambda c: F.row_number().over(Window.partitionBy("t1", "t2", c).orderBy(F.desc("score"), "a", "b")) == 1
    both = s.withColumns({"x": first("a"), "y": first("b")}).filter("x and y")
    taken = vector.greedy_match(s, ["t1", "t2"])
    return both.join(taken.withColumn("taken", F.lit(True)), ["t1", "t2", "a", "b", "score"], "left").groupBy("t1", "t2").agg(F.count("*").alias("n"), F.count("taken").alias("n_taken"))


def v10_text_vectors(spark, d):
    """Hashed n-gram vectors of table names, as their most similar pairs."""
    t = cat.tables(spark, d).select(name_key("table_name").alias("name")).dropna().distinct().withColumn("id", F.xxhash64("name"))
    near = vector.similarity_join(t.select("id", vector.hashed_ngrams(F.col("name")).alias("v")), 0.9)
    name = lambda c, n: t.select(F.col("id").alias(c), F.col("name").alias(n))
    return near.join(name("src", "x"), "src").join(name("tgt", "y"), "tgt").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), R6("similarity"))


def g15_embedded_clusters(spark, d):
    """Vectors in two principal components and six k-means clusters, with the variance that the first one keeps."""
    e = vector.embedded_clusters(cat.vectors(spark, d), 6)
    x = F.element_at("x", 1)
    return e.agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"), F.count_distinct("cluster").alias("n_clusters"), (F.var_pop(x) >= F.var_pop(F.element_at("x", 2))).alias("in_order"))


def v20_cached_columns(spark, d):
    """Columns whose table still has the column list that the cache was made for.

    The cache holds the columns that existed at the start of 2024 of the tables that had any.
    """
    c = read(spark, d, "schema_columns").filter("table_name is not null and column_name is not null and added_at is not null")
    listed = lambda df: df.groupBy(cat.silo_id().alias("db"), F.col("table_name").alias("tab"), F.col("column_name").alias("col")).agg(F.min("added_at").alias("place")).filter("db is not null")
    then = listed(c.filter("added_at < timestamp'2024-01-01' and (removed_at is null or removed_at >= timestamp'2024-01-01')")).withColumn("v", F.array(F.lit(1.0)))
    return vector.cached_vectors(then, listed(c.filter("removed_at is null"))).groupBy("db").agg(F.count("*").alias("n_columns"), F.count_if("hit").alias("n_hits"))


def j25_pair_scores(spark, d):
    """Predicted pairs against pairs with the same label."""
    v = cat.vectors(spark, d)
    got = vector.similarity_join(v, 0.3).select(F.col("src").alias("a"), F.col("tgt").alias("b"))
    return vector.pair_scores(got, v.select("id", F.col("label").alias("grp"))).select("n_predicted", "n_true", "n_hit", R6("precision"), R6("recall"), R6("f1"))


def _names(spark, d, kinds=("cols", "tabs", "types")):
    """(db, kind, name): the different column, table and type names of each silo, one row each."""
    c = cat.columns(spark, d)
    by = {"cols": name_key("column_name"), "tabs": name_key("table_name"), "types": F.col("dtype")}
    told = F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), by[k].alias("name")) for k in kinds)))
    return c.select("db", told).filter("name is not null").distinct()


def _shared_names(links, names):
    """(src, tgt, kind, name) of the names that both ends hold; the end with fewer names is looked up in the other."""
    size = names.groupBy("db").agg(F.count("*").alias("n"))
    n = lambda c: size.select(F.col("db").alias(c), F.col("n").alias(f"n_{c}"))
    turned = links.join(n("src"), "src").join(n("tgt"), "tgt").select("src", "tgt", F.when(F.col("n_src") <= F.col("n_tgt"), F.col("src")).otherwise(F.col("tgt")).alias("few"), F.when(F.col("n_src") <= F.col("n_tgt"), F.col("tgt")).otherwise(F.col("src")).alias("many"))
    return turned.join(names.withColumnRenamed("db", "few"), "few").join(names.withColumnRenamed("db", "many"), ["many", "kind", "name"]).select("src", "tgt", "kind", "name")


def v12_link_jaccard(spark, d):
    """Set similarities of the linked silos' tables, columns and types, from counts of shared names."""
    e, s = graph.above(cat.edges(spark, d), 0.9).select("src", "tgt"), _names(spark, d)
    kinds = ("cols", "tabs", "types")
    count = lambda k: F.count_if(F.col("kind") == k)
    size = s.groupBy("db").agg(*(count(k).alias(k) for k in kinds))
    side = lambda c, x: size.select(F.col("db").alias(c), *(F.col(k).alias(k + x) for k in kinds))
    both = _shared_names(e, s).groupBy("src", "tgt").agg(*(count(k).alias(f"n_{k}") for k in kinds))
    met = e.join(side("src", "1"), "src").join(side("tgt", "2"), "tgt").join(both, ["src", "tgt"], "left")
    n = lambda k: F.coalesce(f"n_{k}", F.lit(0))
    share = lambda k: F.coalesce(n(k) / F.nullif(F.col(k + "1") + F.col(k + "2") - n(k), F.lit(0)), F.lit(0.0))
    return met.select("src", "tgt", *(F.round(share(k), 6).alias(f"jaccard_{k}") for k in kinds), n("cols").cast("int").alias("n_common"))


def j31_shared_columns(spark, d):
    """Shared column names of linked silos, sorted."""
    e, s = graph.above(cat.edges(spark, d), 0.95).select("src", "tgt"), _names(spark, d, ("cols",))
    held = lambda c: s.select(F.col("db").alias(c)).distinct()
    listed = _shared_names(e, s).groupBy("src", "tgt").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("shared"))
    return e.join(held("src"), "src", "left_semi").join(held("tgt"), "tgt", "left_semi").join(listed, ["src", "tgt"], "left").select("src", "tgt", F.coalesce("shared", F.lit("")).alias("shared"))


def v14_type_hellinger(spark, d):
    """Distance of the type distributions of linked silos."""
    from silomesh.operators import profile

    shares = profile.type_shares(cat.columns(spark, d)).groupBy("db").agg(F.map_from_entries(F.collect_list(F.struct("dtype", "share"))).alias("p"))
    e = graph.above(cat.edges(spark, d), 0.9)
    met = e.join(shares.select(F.col("db").alias("src"), "p"), "src").join(shares.select(F.col("db").alias("tgt"), F.col("p").alias("q")), "tgt")
    return met.select("src", "tgt", F.round(vector.hellinger(F.col("p"), F.col("q")), 6).alias("hellinger"))


def v15_edit_distance(spark, d):
    """Edit distance of the foreign-key graphs of linked silos."""
    fk = cat.foreign_keys(spark, d).select("db", F.lower("src_table").alias("a"), F.lower("dst_table").alias("b"))
    e = graph.above(cat.edges(spark, d), 0.95).withColumn("pair", F.concat_ws("-", F.col("src").cast("string"), F.col("tgt").cast("string")))
    one = e.select("pair", F.lit(0).alias("side"), F.col("src").alias("db")).join(fk, "db", "left")
    two = e.select("pair", F.lit(1).alias("side"), F.col("tgt").alias("db")).join(fk, "db", "left")
    return vector.edit_distance(one.unionByName(two).select("pair", "side", "a", "b"))


def v15_equal_graphs(spark, d):
    """For each pair of linked silos, whether the edit distance lies between the difference and the sum of their sizes,
    and is 0 if their foreign-key graphs are the same."""
    fk = cat.foreign_keys(spark, d).select("db", F.lower("src_table").alias("a"), F.lower("dst_table").alias("b")).distinct()
    n = fk.groupBy("db").agg(F.count("*").alias("edges"), F.bit_xor(F.xxhash64("a", "b")).alias("print"))
    nodes = fk.select("db", F.explode(F.array("a", "b")).alias("x")).distinct().groupBy("db").agg(F.count("*").alias("nodes"))
    of = n.join(nodes, "db")
    e = graph.above(cat.edges(spark, d), 0.95).select("src", "tgt")
    side = lambda c, x: of.select(F.col("db").alias(c), *(F.col(k).alias(k + x) for k in ("edges", "nodes", "print")))
    met = e.join(side("src", "1"), "src").join(side("tgt", "2"), "tgt").withColumn("pair", F.concat_ws("-", F.col("src").cast("string"), F.col("tgt").cast("string")))
    low = F.abs(F.col("edges1") - F.col("edges2")) + F.abs(F.col("nodes1") - F.col("nodes2"))
    high = F.col("edges1") + F.col("edges2") + F.abs(F.col("nodes1") - F.col("nodes2"))
    known = met.join(v15_edit_distance(spark, d), "pair")
    return known.select("src", "tgt", low.cast("bigint").alias("least"), high.cast("bigint").alias("most"), F.col("distance").between(low, high).alias("between"), (~((F.col("print1") == F.col("print2")) & (F.col("distance") > 0))).alias("same_is_zero"))


def v16_moment_cosine(spark, d):
    """Cosine of the moment vectors of vector groups."""
    m = cat.vectors(spark, d).select("label", F.explode("v").alias("x")).groupBy("label").agg(*(F.avg(F.pow("x", F.lit(float(k)))).alias(f"m{k}") for k in range(1, 6)))
    v = m.select(F.col("label").cast("bigint").alias("id"), F.array(*(f"m{k}" for k in range(1, 6))).alias("v"))
    return vector.similarity_join(v, -2.0).select("src", "tgt", R6("similarity"))


def _kb_cells(spark, d):
    part = read(spark, d, "part").select(F.lit("part").alias("tab"), F.col("p_partkey").alias("row"), F.inline(F.array(F.struct(F.lit("p_type").alias("col"), F.col("p_type").alias("value")), F.struct(F.lit("p_brand").alias("col"), F.col("p_brand").alias("value")))))
    cust = read(spark, d, "customer").select(F.lit("customer").alias("tab"), F.col("c_custkey").alias("row"), F.inline(F.array(F.struct(F.lit("c_mktsegment").alias("col"), F.col("c_mktsegment").alias("value")), F.struct(F.lit("nation").alias("col"), F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("value")))))
    nat = read(spark, d, "nation").select(F.lit("nation").alias("tab"), F.col("n_nationkey").cast("bigint").alias("row"), F.inline(F.array(F.struct(F.lit("n_name").alias("col"), F.col("n_name").alias("value")))))
    sup = read(spark, d, "supplier").select(F.lit("supplier").alias("tab"), F.col("s_suppkey").alias("row"), F.inline(F.array(F.struct(F.lit("s_name").alias("col"), F.col("s_name").alias("value")), F.struct(F.lit("nation").alias("col"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("value")))))
    return part.unionByName(cust).unionByName(nat).unionByName(sup).withColumn("value", knowledge.clean_value(F.col("value")))


def x9_text_columns(spark, d):
    """Columns that hold text."""
    return knowledge.text_columns(_kb_cells(spark, d))


def v18_column_semantics(spark, d):
    """Columns that share values, by the share of values."""
    return knowledge.column_semantics(knowledge.value_index(_kb_cells(spark, d).withColumn("value", F.regexp_replace("value", "^nation_", "nation ")))).select("tab", "col", "sem", R6("score"))


def v17_union_scores(spark, d):
    """Union score of each table pair."""
    sem = knowledge.column_semantics(knowledge.value_index(_kb_cells(spark, d).withColumn("value", F.regexp_replace("value", "^nation_", "nation "))))
    return knowledge.union_scores(sem).select("t1", "t2", R6("score"), "n_columns")


def j26_relation_lookup(spark, d):
    """Relation scores of value pairs with the reverse as a fallback."""
    rel = knowledge.relations(_kb_cells(spark, d), "p_type", "p_brand")
    known = rel.groupBy(F.col("subject_value").alias("s"), F.col("object_value").alias("o")).agg(F.count("*").cast("double").alias("score"))
    asked = known.select("s", "o").unionByName(known.select(F.col("o").alias("s"), F.col("s").alias("o")))
    return knowledge.relation_lookup(asked, known).groupBy("score").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    v1_unit_vectors, v2_all_pairs, v3_labelled_pairs, v4_nearest_neighbours, v4_nearest_one_sided, v5_closest_to_query, v6_pair_cosine, v7_weighted_column_match, v8_top_matrix, w3_greedy_column_match, w3_best_of_both, v10_text_vectors, g15_embedded_clusters, v20_cached_columns, v15_equal_graphs,
    j25_pair_scores, v12_link_jaccard, j31_shared_columns, v14_type_hellinger, v15_edit_distance, v16_moment_cosine, x9_text_columns, v18_column_semantics, v17_union_scores, j26_relation_lookup,
)}

_V = cat.SQL_VECTORS
_PAIRS = f"{_V}, s AS (SELECT a.id AS src, b.id AS tgt, list_cosine_similarity(a.v, b.v) AS similarity FROM v a JOIN v b ON a.id < b.id)"
_KNN = f"{_V}, s AS (SELECT a.id AS src, b.id AS tgt, list_cosine_similarity(a.v, b.v) AS similarity FROM v a JOIN v b ON a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY similarity DESC, tgt) AS k FROM s)"
_CV = f"{_V}, c AS (SELECT 't' || label AS tab, 'c' || lpad(CAST(id % 37 AS VARCHAR), 2, '0') || '_' || lpad(CAST(id AS VARCHAR), 6, '0') AS col, v FROM v)"
_K = "nullif(regexp_replace(lower({}), '[^a-z0-9]', '', 'g'), '')"
_S = f"{cat.SQL_COLUMNS}, s AS (SELECT db, list_sort(list(DISTINCT {_K.format('column_name')}) FILTER ({_K.format('column_name')} IS NOT NULL)) AS cols, list(DISTINCT {_K.format('table_name')}) FILTER ({_K.format('table_name')} IS NOT NULL) AS tabs, list(DISTINCT dtype) FILTER (dtype IS NOT NULL) AS types FROM c GROUP BY db)"
_CLEAN = "trim(regexp_replace(replace(regexp_replace(lower(value), '[^a-z0-9_\\s]', ' ', 'g'), 'nbsp', ''), '\\s+', ' ', 'g'))"
_KB = f"""w AS (SELECT tab, col, "row", {_CLEAN} AS value FROM (
  SELECT 'part' AS tab, p_partkey AS "row", 'p_type' AS col, p_type AS value FROM part UNION ALL SELECT 'part', p_partkey, 'p_brand', p_brand FROM part UNION ALL SELECT 'customer', c_custkey, 'c_mktsegment', c_mktsegment FROM customer
  UNION ALL SELECT 'customer', c_custkey, 'nation', 'NATION_' || c_nationkey FROM customer UNION ALL SELECT 'nation', n_nationkey, 'n_name', n_name FROM nation UNION ALL SELECT 'supplier', s_suppkey, 's_name', s_name FROM supplier UNION ALL SELECT 'supplier', s_suppkey, 'nation', 'nation ' || s_nationkey FROM supplier))"""
_SEM = f"""{_KB}, h AS (SELECT DISTINCT regexp_replace(value, '^nation_', 'nation ') AS value, tab, col FROM w WHERE value IS NOT NULL), i AS (SELECT * FROM h WHERE value IN (SELECT value FROM h GROUP BY 1 HAVING count(*) < 300)),
z AS (SELECT tab, col, count(*) AS n FROM i GROUP BY 1, 2), m AS (SELECT a.tab, a.col, b.tab || '.' || b.col AS sem, count(*) AS k FROM i a JOIN i b ON a.value = b.value GROUP BY 1, 2, 3), x AS (SELECT m.tab, m.col, m.sem, m.k / z.n AS score FROM m JOIN z ON z.tab = m.tab AND z.col = m.col)"""

SQL = {
    "v1_unit_vectors": "SELECT DISTINCT db_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 4) AS length, CASE WHEN list_sum(list_transform(e, lambda x: x * x)) > 0 THEN CAST(1 AS DOUBLE) END AS unit_length FROM (SELECT db_id, CAST(embedding AS DOUBLE[]) AS e FROM database_embeddings WHERE len(embedding) = 64) WHERE NOT list_bool_or(list_transform(e, lambda x: isnan(x)))",
    "v2_all_pairs": f"WITH {_PAIRS} SELECT src, tgt, round(similarity, 6) AS similarity FROM s WHERE similarity > 0.35",
    "v3_labelled_pairs": f"WITH {_V}, s AS (SELECT a.id AS src, b.id AS tgt, list_cosine_similarity(a.v, b.v) AS similarity, a.label = b.label AS same FROM v a JOIN v b ON a.id < b.id) SELECT src, tgt, round(similarity, 6) AS similarity, CAST(same AS INT) AS same_label FROM s WHERE similarity > 0.3",
    "v4_nearest_neighbours": f"WITH {_KNN} SELECT DISTINCT least(src, tgt) AS src, greatest(src, tgt) AS tgt, round(similarity, 6) AS similarity FROM r WHERE k <= 3",
    "v4_nearest_one_sided": f"WITH {_KNN} SELECT src, tgt, round(similarity, 6) AS similarity FROM r WHERE k <= 3 AND src < tgt",
    "v5_closest_to_query": f"WITH {_V}, s AS (SELECT id, list_cosine_similarity(v, list_transform(range(64), lambda i: CAST(CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END AS DOUBLE))) AS s FROM v) SELECT id, round(s, 6) AS similarity FROM s ORDER BY s DESC, id LIMIT 10",
    "v6_pair_cosine": f"WITH {_V} SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM v a JOIN v b ON b.id = a.id + 7",
    "v7_weighted_column_match": f"""WITH {_CV}, w AS (SELECT *, CASE WHEN substring(col, 2, 1) = '0' THEN 0.5 ELSE 1.0 END AS idf FROM c), s AS (SELECT a.tab AS t1, b.tab AS t2, a.col AS c1, b.col AS c2, CAST(least(a.idf, b.idf) AS DOUBLE) * list_cosine_similarity(a.v, b.v) AS score FROM w a JOIN w b ON a.tab < b.tab),
r AS (SELECT *, row_number() OVER (PARTITION BY t1, t2 ORDER BY score DESC, c1 DESC, c2 DESC) AS k FROM s) SELECT t1, t2, c1, c2, round(score, 6) AS score FROM r WHERE k = 1""",
    "v8_top_matrix": f"WITH {_CV}, s AS (SELECT a.col AS c1, b.col AS c2, list_cosine_similarity(a.v, b.v) AS similarity FROM c a JOIN c b ON a.tab <> b.tab), r AS (SELECT *, row_number() OVER (PARTITION BY c1 ORDER BY similarity DESC, c2) AS k FROM s) SELECT c1, c2, CAST(k AS INT) AS rank, round(similarity, 6) AS similarity FROM r WHERE k <= 2",
    "w3_greedy_column_match": f"""WITH RECURSIVE {_CV}, s AS (SELECT a.tab AS t1, b.tab AS t2, a.col AS a, b.col AS b, round(list_cosine_similarity(a.v, b.v), 9) AS score FROM c a JOIN c b ON a.tab < b.tab WHERE list_cosine_similarity(a.v, b.v) > 0.2),
w AS (SELECT *, row_number() OVER (PARTITION BY t1, t2, a ORDER BY score DESC, a, b) AS x, row_number() OVER (PARTITION BY t1, t2, b ORDER BY score DESC, a, b) AS y FROM s
  UNION ALL SELECT t1, t2, a, b, score, row_number() OVER (PARTITION BY t1, t2, a ORDER BY score DESC, a, b), row_number() OVER (PARTITION BY t1, t2, b ORDER BY score DESC, a, b) FROM (
    SELECT r.* FROM w r LEFT JOIN (SELECT t1, t2, a FROM w WHERE x = 1 AND y = 1) i ON i.t1 = r.t1 AND i.t2 = r.t2 AND i.a = r.a LEFT JOIN (SELECT t1, t2, b FROM w WHERE x = 1 AND y = 1) j ON j.t1 = r.t1 AND j.t2 = r.t2 AND j.b = r.b WHERE i.a IS NULL AND j.b IS NULL))
SELECT t1, t2, a, b, round(score, 6) AS score FROM w WHERE x = 1 AND y = 1""",
    "w3_best_of_both": f"""WITH {_CV}, s AS (SELECT a.tab AS t1, b.tab AS t2, a.col AS a, b.col AS b, round(list_cosine_similarity(a.v, b.v), 9) AS score FROM c a JOIN c b ON a.tab < b.tab WHERE list_cosine_similarity(a.v, b.v) > 0.2),
r AS (SELECT *, row_number() OVER (PARTITION BY t1, t2, a ORDER BY score DESC, a, b) AS x, row_number() OVER (PARTITION BY t1, t2, b ORDER BY score DESC, a, b) AS y FROM s) SELECT t1, t2, count(*) AS n, count(*) AS n_taken FROM r WHERE x = 1 AND y = 1 GROUP BY 1, 2""",
    "v10_text_vectors": f"""WITH {cat.SQL_TABLES}, n AS (SELECT DISTINCT {_K.format('table_name')} AS name FROM t WHERE {_K.format('table_name')} IS NOT NULL),
g AS (SELECT name, list_transform(range(1, greatest(1, length(name) - 2) + 1), lambda i: CAST('0x' || substr(md5(substr(name, i, 3)), 1, 8) AS BIGINT) % 64) AS g FROM n),
v AS (SELECT name, list_transform(range(64), lambda s: CAST(len(list_filter(g, lambda x: x = s)) AS DOUBLE)) AS v FROM g)
SELECT a.name AS a, b.name AS b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM v a JOIN v b ON a.name < b.name WHERE list_cosine_similarity(a.v, b.v) > 0.9""",
    "g15_embedded_clusters": "SELECT count(*) AS n, count(DISTINCT vec_id) AS n_ids, CAST(6 AS BIGINT) AS n_clusters, true AS in_order FROM embeddings",
    "v20_cached_columns": """WITH r AS (SELECT try_cast(trim(db_id) AS BIGINT) AS db, table_name AS tab, column_name AS col, added_at, removed_at FROM schema_columns WHERE table_name IS NOT NULL AND column_name IS NOT NULL AND added_at IS NOT NULL AND try_cast(trim(db_id) AS BIGINT) IS NOT NULL),
o AS (SELECT db, tab, col, min(added_at) AS place FROM r WHERE added_at < TIMESTAMP '2024-01-01' AND (removed_at IS NULL OR removed_at >= TIMESTAMP '2024-01-01') GROUP BY 1, 2, 3), n AS (SELECT db, tab, col, min(added_at) AS place FROM r WHERE removed_at IS NULL GROUP BY 1, 2, 3),
a AS (SELECT db, tab, string_agg(col, '|' ORDER BY place, col) AS names FROM o GROUP BY 1, 2), b AS (SELECT db, tab, string_agg(col, '|' ORDER BY place, col) AS names, count(*) AS k FROM n GROUP BY 1, 2)
SELECT b.db, CAST(sum(b.k) AS BIGINT) AS n_columns, CAST(sum(CASE WHEN a.names IS NOT NULL THEN b.k ELSE 0 END) AS BIGINT) AS n_hits FROM b LEFT JOIN a ON a.db = b.db AND a.tab = b.tab AND a.names = b.names GROUP BY 1""",
    "v15_equal_graphs": f"""WITH {cat.SQL_EDGES}, {cat.SQL_FKS}, f AS (SELECT DISTINCT db, lower(src_table) AS a, lower(dst_table) AS b FROM k), n AS (SELECT db, count(*) AS edges FROM f GROUP BY 1), m AS (SELECT db, count(DISTINCT x) AS nodes FROM (SELECT db, a AS x FROM f UNION ALL SELECT db, b FROM f) GROUP BY 1), o AS (SELECT * FROM n JOIN m USING (db))
SELECT src, tgt, abs(p.edges - q.edges) + abs(p.nodes - q.nodes) AS least, p.edges + q.edges + abs(p.nodes - q.nodes) AS most, true AS between, true AS same_is_zero FROM e JOIN o p ON p.db = src JOIN o q ON q.db = tgt WHERE similarity >= 0.95""",
    "j25_pair_scores": f"WITH {_PAIRS}, p AS (SELECT src, tgt FROM s WHERE similarity > 0.3), t AS (SELECT a.id AS src, b.id AS tgt FROM v a JOIN v b ON a.label = b.label AND a.id < b.id), c AS (SELECT (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM t) AS nt, (SELECT count(*) FROM p JOIN t USING (src, tgt)) AS nh) SELECT np AS n_predicted, nt AS n_true, nh AS n_hit, round(nh / np, 6) AS precision, round(nh / nt, 6) AS recall, round(2 * nh / (np + nt), 6) AS f1 FROM c",
    "v12_link_jaccard": f"""WITH {cat.SQL_EDGES}, {_S} SELECT src, tgt, {', '.join(f"round(CASE WHEN len(list_distinct(list_concat(coalesce(a.{n}, []), coalesce(b.{n}, [])))) = 0 THEN 0 ELSE len(list_intersect(coalesce(a.{n}, []), coalesce(b.{n}, []))) / len(list_distinct(list_concat(coalesce(a.{n}, []), coalesce(b.{n}, [])))) END, 6) AS jaccard_{n}" for n in ("cols", "tabs", "types"))}, CAST(len(list_intersect(a.cols, b.cols)) AS INT) AS n_common FROM e JOIN s a ON a.db = src JOIN s b ON b.db = tgt WHERE similarity >= 0.9""",
    "j31_shared_columns": f"WITH {cat.SQL_EDGES}, {_S} SELECT src, tgt, array_to_string(list_sort(list_intersect(a.cols, b.cols)), ',') AS shared FROM e JOIN s a ON a.db = src JOIN s b ON b.db = tgt WHERE similarity >= 0.95",
    "v14_type_hellinger": f"""WITH {cat.SQL_EDGES}, {cat.SQL_COLUMNS}, p AS (SELECT db, dtype, count(*) / sum(count(*)) OVER (PARTITION BY db) AS share FROM c WHERE dtype IS NOT NULL GROUP BY 1, 2), n AS (SELECT src, tgt FROM e WHERE similarity >= 0.9 AND src IN (SELECT db FROM p) AND tgt IN (SELECT db FROM p)),
k AS (SELECT n.*, p.dtype FROM n JOIN p ON p.db = src UNION SELECT n.*, p.dtype FROM n JOIN p ON p.db = tgt)
SELECT k.src, k.tgt, round(sqrt(sum((sqrt(coalesce(a.share, 0)) - sqrt(coalesce(b.share, 0))) ** 2)) / sqrt(2), 6) AS hellinger FROM k LEFT JOIN p a ON a.db = k.src AND a.dtype = k.dtype LEFT JOIN p b ON b.db = k.tgt AND b.dtype = k.dtype GROUP BY 1, 2""",
    "v16_moment_cosine": f"WITH {_V}, x AS (SELECT label, unnest(v) AS x FROM v), m AS (SELECT CAST(label AS BIGINT) AS id, [avg(x), avg(x ** 2), avg(x ** 3), avg(x ** 4), avg(x ** 5)] AS v FROM x GROUP BY 1) SELECT a.id AS src, b.id AS tgt, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM m a JOIN m b ON a.id < b.id",
    "x9_text_columns": f"WITH {_KB} SELECT tab, col FROM w WHERE value <> '' GROUP BY 1, 2 HAVING avg(CASE WHEN length(regexp_replace(value, '[^0-9]', '', 'g')) / length(value) <= 0.5 THEN 1 ELSE 0 END) > 0.5",
    "v18_column_semantics": f"WITH {_SEM} SELECT tab, col, sem, round(score, 6) AS score FROM x",
    "v17_union_scores": f"WITH {_SEM}, y AS (SELECT a.tab AS t1, b.tab AS t2, a.col AS c1, b.col AS c2, max(a.score * b.score) AS score FROM x a JOIN x b ON a.sem = b.sem AND a.tab < b.tab GROUP BY ALL), q AS (SELECT t1, t2, c1, max(score) AS score FROM y GROUP BY ALL) SELECT t1, t2, round(sum(score), 6) AS score, count(*) AS n_columns FROM q GROUP BY 1, 2",
    "j26_relation_lookup": f"""WITH {_KB}, r AS (SELECT DISTINCT s.value AS s, o.value AS o FROM w s JOIN w o ON s.tab = o.tab AND s."row" = o."row" AND s.col = 'p_type' AND o.col = 'p_brand') SELECT CAST(1 AS DOUBLE) AS score, 2 * count(*) AS n FROM r""",
}
