"""Queries over the similarity graph of silos, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from silomesh.operators import graph
from silomesh.runtime import Workspace, is_nan, read
from silomesh.sources import catalog as cat

T = 0.9
R6 = lambda c: F.round(c, 6).alias(c)


def _near(spark, d, t=T):
    return graph.above(cat.edges(spark, d), t)


def _nodes(spark, d):
    return cat.tables(spark, d).select(F.col("db").alias("id")).distinct()


def f1_similarity_filter(spark, d):
    """F1, K1: edges at or above a similarity, with the edge flag of the prediction table."""
    return _near(spark, d).select("src", "tgt", R6("similarity"), F.lit(1).alias("edge"))


def f2_strict_filter(spark, d):
    """F2, D3: the strict form at a similarity that occurs, counted against the inclusive one."""
    e = cat.edges(spark, d)
    t = e.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY similarity)").alias("t"))
    return e.join(F.broadcast(t)).agg(F.count_if(F.col("similarity") >= F.col("t")).alias("n_inclusive"), F.count_if(F.col("similarity") > F.col("t")).alias("n_strict"))


def f4_range_filter(spark, d):
    """edges in a closed range of similarities."""
    return cat.edges(spark, d).filter(F.col("similarity").between(0.7, 0.8)).agg(F.count("*").alias("n"), F.round(F.avg("similarity"), 6).alias("avg_similarity"))


def a14_threshold_sweep(spark, d):
    """Edges, mean degree and node coverage over a list of thresholds."""
    n = _nodes(spark, d).count()
    return graph.threshold_sweep(cat.edges(spark, d), [0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.93, 0.96, 0.98], n).select("threshold", "n_edges", R6("avg_degree"), R6("coverage"))


def a15_density(spark, d):
    """Nodes, possible pairs, edges, density and mean degree."""
    n = _nodes(spark, d).agg(F.count("*").alias("n_nodes"))
    out = _near(spark, d).agg(F.count("*").alias("n_edges")).join(F.broadcast(n))
    return out.select("n_nodes", (F.col("n_nodes") * (F.col("n_nodes") - 1) / 2).cast("bigint").alias("n_pairs"), "n_edges", F.round(2 * F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1)), 8).alias("density"), F.round(2 * F.col("n_edges") / F.col("n_nodes"), 6).alias("avg_degree"))


def g8_degrees(spark, d):
    """Degree of every silo, 0 for those without an edge."""
    return _nodes(spark, d).join(graph.degrees(_near(spark, d)), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def a11_degree_stats(spark, d):
    """Least, largest, mean and lower median degree, and the mirrored edge count."""
    deg = g8_degrees(spark, d)
    return deg.agg(F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.round(F.avg("degree"), 6).alias("avg_degree"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY degree)").cast("bigint").alias("median_degree"), F.sum("degree").alias("n_mirrored"))


def g1_mirrored_edges(spark, d):
    """The directed graph with every edge mirrored, counted by node."""
    return graph.mirrored(_near(spark, d)).groupBy("src").agg(F.count("*").alias("n_out"), F.round(F.sum("similarity"), 6).alias("weight"))


def g3_components(spark, d):
    """Connected components, named by their least silo."""
    return graph.connected_components(_near(spark, d))


def g4_component_of_seed(spark, d):
    """The component of the least silo that has an edge."""
    comp = graph.connected_components(_near(spark, d))
    seed = comp.agg(F.min("id").alias("seed"))
    own = comp.join(F.broadcast(seed), F.col("id") == F.col("seed")).select("component")
    return comp.join(own, "component", "left_semi").select("id")


def g5_fk_components(spark, d):
    """Groups of tables that foreign keys connect, by silo."""
    fk = cat.foreign_keys(spark, d).select("db", F.lower("src_table").alias("a"), F.lower("dst_table").alias("b"))
    node = lambda c: F.concat_ws("/", F.col("db").cast("string"), F.col(c))
    comp = graph.connected_components(fk.select(node("a").alias("src"), node("b").alias("tgt")))
    return comp.groupBy("component").agg(F.count("*").alias("n_tables"))


def a13_component_sizes(spark, d):
    """Number of components of each size."""
    return graph.connected_components(_near(spark, d)).groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_components"))


def a33_component_probability(spark, d):
    """Chance that two linked silos lie in different components."""
    sizes = graph.connected_components(_near(spark, d)).groupBy("component").agg(F.count("*").alias("size"))
    return graph.different_component_probability(sizes).select(R6("p_different"), "n_components")


def f17_small_components(spark, d):
    """Components of 3 to 6 silos."""
    sizes = graph.connected_components(_near(spark, d)).groupBy("component").agg(F.count("*").alias("size"))
    return sizes.filter(F.col("size").between(3, 6))


def g6_component_modularity(spark, d):
    """Modularity of the components as communities."""
    e = _near(spark, d)
    return graph.modularity(e, graph.connected_components(e).withColumnRenamed("component", "community")).select(R6("modularity"), "n_communities")


def g6_louvain(spark, d):
    """Louvain communities."""
    return graph.louvain(_near(spark, d))


def g6_louvain_checked(spark, d):
    """Communities hold every linked silo, are named by their least member, don't cross components and have a modularity
    no less than that of the components."""
    e = _near(spark, d)
    lab, comp = Workspace(spark, "checked").write(graph.louvain(e)), graph.connected_components(e)
    named = lab.groupBy("community").agg((F.min("id") == F.first("community")).alias("named"))
    across = lab.join(comp, "id").groupBy("community").agg(F.count_distinct("component").alias("k"))
    q = lambda labels: graph.modularity(e, labels).select("modularity")
    better = q(lab).join(F.broadcast(q(comp.withColumnRenamed("component", "community")).withColumnRenamed("modularity", "whole"))).select((F.col("modularity") >= F.col("whole") - 1e-9).alias("not_worse"))
    n = lab.agg(F.count("*").alias("n"))
    return n.join(F.broadcast(named.agg(F.bool_and("named").alias("least_named")))).join(F.broadcast(across.agg((F.max("k") == 1).alias("inside_components")))).join(F.broadcast(better))


def g7_label_propagation(spark, d):
    """Two rounds of propagation of the map labels over the links."""
    e = _near(spark, d)
    lab = read(spark, d, "cluster_assignments").filter("cluster >= 0").groupBy(F.col("db_id").alias("id")).agg(F.min("cluster").alias("k")).withColumn("y0", F.lit(1.0))
    nodes = graph.degrees(e).select("id")
    known = nodes.join(lab, "id").select("id", "k", "y0")
    rest = nodes.join(known, "id", "left_anti").select("id", F.lit(-1).alias("k"), F.lit(0.0).alias("y0"))
    out = graph.propagate(e, known.unionByName(rest), 0.5, 2)
    return out.filter("y > 0").select("id", "k", R6("y"))


def g9_induced_edges(spark, d):
    """Edges among the silos of one map label."""
    lab = read(spark, d, "cluster_assignments").filter("cluster = 1").select(F.col("db_id").alias("id")).distinct()
    return graph.induced(_near(spark, d, 0.7), lab).select("src", "tgt", R6("similarity"))


def g10_subgraph(spark, d):
    """Subgraph of the silos of two map labels, with every link in both directions."""
    ids = read(spark, d, "cluster_assignments").filter("cluster in (1, 2)").select(F.col("db_id").alias("id")).distinct()
    return graph.subgraph(_near(spark, d, 0.7), ids).select("src", "tgt", R6("similarity"))


def o11_random_silos(spark, d):
    """Thirty silos in a random order from the components of at most six."""
    from silomesh.operators.encode import sample_ids

    of = graph.connected_components(_near(spark, d))
    small = of.groupBy("component").agg(F.count("*").alias("size")).filter("size <= 6")
    return sample_ids(of.join(small, "component", "left_semi"), 30, 3)


def g11_collapse(spark, d):
    """Parallel links collapsed to their mean."""
    p = read(spark, d, "pair_metadata").filter(F.col("db_id1").isNotNull() & F.col("db_id2").isNotNull() & ~is_nan(F.col("similarity")) & F.col("similarity").between(-1, 1)).select(F.col("db_id1").alias("src"), F.col("db_id2").alias("tgt"), "similarity")
    return graph.collapse(p).select("src", "tgt", R6("similarity"))


def g12_random_subgraphs(spark, d):
    """Random connected sets of four silos from every linked silo, thinnest first."""
    e = _near(spark, d)
    sets = graph.grow_subgraphs(e, graph.connected_components(e), size=4, samples=2)
    return sets.orderBy("rank", "start", "sample", "id").withColumn("density", F.round("density", 6))


def g13_neighbour_lists(spark, d):
    """Neighbour table: each silo with each of its neighbours and the standardised similarity of the link."""
    z = _near(spark, d)
    m = z.agg(F.avg("similarity").alias("mean"), F.stddev_pop("similarity").alias("sd"))
    scaled = graph.mirrored(z.join(F.broadcast(m)).select("src", "tgt", ((F.col("similarity") - F.col("mean")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))).alias("z")))
    return scaled.select("src", "tgt", F.round("z", 5).alias("z"))


def o10_hub_and_low_neighbours(spark, d):
    """The silo with the most links and its five neighbours with the fewest."""
    e = _near(spark, d)
    deg = graph.degrees(e)
    hub = deg.orderBy(F.desc("degree"), "id").limit(1).select(F.col("id").alias("src"))
    near = graph.mirrored(e).join(F.broadcast(hub), "src", "left_semi").select("src", F.col("tgt").alias("id")).join(deg, "id")
    return near.orderBy("degree", "id").limit(5).select(F.col("src").alias("hub"), "id", "degree")


def o12_low_degree_pool(spark, d):
    """The twenty linked silos with the fewest links."""
    return graph.degrees(_near(spark, d)).orderBy("degree", "id").limit(20)


def o2_top_per_cluster(spark, d):
    """O2: the three most similar pairs inside each map label."""
    lab = read(spark, d, "cluster_assignments").filter("cluster >= 0").groupBy("db_id").agg(F.min("cluster").alias("cluster"))
    pairs = cat.edges(spark, d).join(lab.select(F.col("db_id").alias("src"), "cluster"), "src").join(lab.select(F.col("db_id").alias("tgt"), F.col("cluster").alias("other")), "tgt").filter("cluster = other")
    return graph.top_per_group(pairs, ["cluster"], [F.desc("similarity"), "src", "tgt"], 3).select("cluster", "rank", "src", "tgt", R6("similarity"))


def o3_closest_to_target(spark, d):
    """O3: the ten pairs whose similarity is nearest to a target."""
    gap = F.abs(F.col("similarity") - 0.8)
    return cat.edges(spark, d).orderBy(gap, "src", "tgt").limit(10).select("src", "tgt", R6("similarity"))


def o1_top_valid_pairs(spark, d):
    """The twenty most similar pairs of silos with at least 100 rows each and two common columns."""
    big = read(spark, d, "column_cardinality").filter("db_id rlike '^[0-9]{7}$'").groupBy(F.col("db_id").cast("bigint").alias("id")).agg(F.max("n_rows").alias("rows")).filter("rows >= 100").select("id")
    good = graph.induced(cat.edges(spark, d).filter("n_common >= 2"), big)
    return good.orderBy(F.desc("similarity"), "src", "tgt").limit(20).select("src", "tgt", R6("similarity"), "n_common")


def w5_top_with_ties(spark, d):
    """The top 50 pairs by similarity in steps of 1e-4; the last tie group is cut in a random order."""
    from silomesh.operators.pairs import top_tie_sample

    return top_tie_sample(cat.edges(spark, d), "similarity", ["src", "tgt"], 50).select("src", "tgt", R6("similarity"))


def j24_compare_edges(spark, d):
    """The similarity of each pair's last sample against its largest one."""
    p = read(spark, d, "pair_metadata").filter((F.col("db_id1") != F.col("db_id2")) & ~is_nan(F.col("similarity")) & F.col("similarity").between(-1, 1) & F.col("sampled_at").isNotNull())
    last = p.groupBy(F.greatest("db_id1", "db_id2").alias("src"), F.least("db_id1", "db_id2").alias("tgt")).agg(F.max(F.struct("sampled_at", "pair_id", "similarity"))["similarity"].alias("similarity"))
    return graph.compare_edges(last, cat.edges(spark, d)).select("n_common", "only_left", "only_right", "n_equal", R6("match_rate"))


def j15_edge_properties(spark, d):
    """Common columns attached to the unordered pair."""
    props = read(spark, d, "pair_metadata").filter("db_id1 <> db_id2").select(F.col("db_id1").alias("src"), F.col("db_id2").alias("tgt"), F.col("num_common_columns").alias("shared"))
    return graph.attach(_near(spark, d), props, ["shared"]).select("src", "tgt", "shared")


def j11_node_semantics(spark, d):
    """Map labels outer-joined with components; -1 for none."""
    lab = read(spark, d, "cluster_assignments").filter("cluster is not null and db_id is not null").groupBy(F.col("db_id").alias("id")).agg(F.min("cluster").alias("cluster"))
    return lab.join(graph.connected_components(_near(spark, d)), "id", "full").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("component", F.lit(-1)).alias("component"))


def a35_similarity_histogram(spark, d):
    """Fifty equal bins of the similarity over [-1, 1]."""
    return cat.edges(spark, d).groupBy(F.least(F.floor((F.col("similarity") + 1) / 0.04), F.lit(49)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def u3_common_neighbours(spark, d):
    """Pairs of linked silos and how many silos are linked to both."""
    return graph.common_neighbours(_near(spark, d))


QUERIES = {f.__name__: f for f in (
    f1_similarity_filter, f2_strict_filter, f4_range_filter, a14_threshold_sweep, a15_density, g8_degrees, a11_degree_stats, g1_mirrored_edges, g3_components, g4_component_of_seed, g5_fk_components, a13_component_sizes,
    a33_component_probability, f17_small_components, g6_component_modularity, g6_louvain, g6_louvain_checked, g7_label_propagation, g9_induced_edges, g10_subgraph, g11_collapse, g12_random_subgraphs, g13_neighbour_lists, o10_hub_and_low_neighbours,
    o12_low_degree_pool, o11_random_silos, o2_top_per_cluster, o3_closest_to_target, o1_top_valid_pairs, w5_top_with_ties, j24_compare_edges, j15_edge_properties, j11_node_semantics, a35_similarity_histogram, u3_common_neighbours,
)}

_E = cat.SQL_EDGES
_N = f"{_E}, n AS (SELECT * FROM e WHERE similarity >= 0.9)"
_M = f"{_N}, m AS (SELECT src, tgt, similarity FROM n UNION ALL SELECT tgt, src, similarity FROM n)"
_D = f"{_M}, g AS (SELECT src AS id, count(*) AS degree FROM m GROUP BY 1)"
_DB = cat.SQL_TABLES.replace("t AS", "b AS")
_R = f"RECURSIVE {_M}, r AS (SELECT src AS id, src AS seen FROM m UNION SELECT r.id, m.tgt FROM r JOIN m ON m.src = r.seen), z AS (SELECT id, min(seen) AS component FROM r GROUP BY 1)"
_LAB = "x AS (SELECT db_id, min(cluster) AS cluster FROM cluster_assignments WHERE cluster >= 0 GROUP BY 1)"
_P = "p AS (SELECT * FROM pair_metadata WHERE db_id1 <> db_id2 AND NOT isnan(similarity) AND similarity BETWEEN -1 AND 1)"
_TS = "(0.6), (0.65), (0.7), (0.75), (0.8), (0.85), (0.9), (0.93), (0.96), (0.98)"

SQL = {
    "f1_similarity_filter": f"WITH {_N} SELECT src, tgt, round(similarity, 6) AS similarity, 1 AS edge FROM n",
    "f2_strict_filter": f"WITH {_E}, q AS (SELECT quantile_disc(similarity, 0.5) AS t FROM e) SELECT count(*) FILTER (similarity >= t) AS n_inclusive, count(*) FILTER (similarity > t) AS n_strict FROM e, q",
    "f4_range_filter": f"WITH {_E} SELECT count(*) AS n, round(avg(similarity), 6) AS avg_similarity FROM e WHERE similarity BETWEEN 0.7 AND 0.8",
    "a14_threshold_sweep": f"""WITH {_E}, {_DB}, q AS (SELECT count(DISTINCT db) AS n FROM b), h AS (SELECT CAST(t AS DOUBLE) AS threshold FROM (VALUES {_TS}) v(t))
SELECT threshold, (SELECT count(*) FROM e WHERE similarity >= threshold) AS n_edges, round(2 * (SELECT count(*) FROM e WHERE similarity >= threshold) / q.n, 6) AS avg_degree,
  round(100 * (SELECT count(DISTINCT i) FROM (SELECT unnest([src, tgt]) AS i, similarity FROM e) WHERE similarity >= threshold) / q.n, 6) AS coverage FROM h, q""",
    "a15_density": f"WITH {_N}, {_DB}, q AS (SELECT count(DISTINCT db) AS k FROM b) SELECT any_value(k) AS n_nodes, CAST(any_value(k) * (any_value(k) - 1) / 2 AS BIGINT) AS n_pairs, count(*) AS n_edges, round(2 * count(*) / (any_value(k) * (any_value(k) - 1)), 8) AS density, round(2 * count(*) / any_value(k), 6) AS avg_degree FROM n, q",
    "g8_degrees": f"WITH {_D}, {_DB} SELECT DISTINCT db AS id, coalesce(degree, 0) AS degree FROM b LEFT JOIN g ON g.id = db",
    "a11_degree_stats": f"WITH {_D}, {_DB}, q AS (SELECT DISTINCT db AS id, coalesce(degree, 0) AS degree FROM b LEFT JOIN g ON g.id = db) SELECT min(degree) AS min_degree, max(degree) AS max_degree, round(avg(degree), 6) AS avg_degree, quantile_disc(degree, 0.5) AS median_degree, CAST(sum(degree) AS BIGINT) AS n_mirrored FROM q",
    "g1_mirrored_edges": f"WITH {_M} SELECT src, count(*) AS n_out, round(sum(similarity), 6) AS weight FROM m GROUP BY 1",
    "g3_components": f"WITH {_R} SELECT id, component FROM z",
    "g4_component_of_seed": f"WITH {_R} SELECT id FROM z WHERE component = (SELECT min(id) FROM z)",
    "g5_fk_components": f"""WITH RECURSIVE {cat.SQL_FKS}, l AS (SELECT db || '/' || lower(src_table) AS a, db || '/' || lower(dst_table) AS b FROM k), m AS (SELECT a, b FROM l WHERE a <> b UNION SELECT b, a FROM l WHERE a <> b),
r AS (SELECT a AS id, a AS seen FROM m UNION SELECT r.id, m.b FROM r JOIN m ON m.a = r.seen), z AS (SELECT id, min(seen) AS component FROM r GROUP BY 1) SELECT component, count(*) AS n_tables FROM z GROUP BY 1""",
    "a13_component_sizes": f"WITH {_R}, s AS (SELECT component, count(*) AS size FROM z GROUP BY 1) SELECT size, count(*) AS n_components FROM s GROUP BY 1",
    "a33_component_probability": f"WITH {_R}, s AS (SELECT count(*) AS size FROM z GROUP BY component), q AS (SELECT sum(size) AS n FROM s) SELECT round(1 - sum(size / n * ((size - 1) / (n - 1))), 6) AS p_different, count(*) AS n_components FROM s, q",
    "f17_small_components": f"WITH {_R} SELECT component, count(*) AS size FROM z GROUP BY 1 HAVING count(*) BETWEEN 3 AND 6",
    "g6_component_modularity": f"""WITH {_R}, q AS (SELECT count(*) AS m FROM n), i AS (SELECT z.component, count(*) AS k FROM n JOIN z ON z.id = n.src GROUP BY 1), d AS (SELECT z.component, count(*) AS deg FROM m JOIN z ON z.id = m.src GROUP BY 1)
SELECT round(sum(coalesce(i.k, 0) / q.m - (d.deg / (2 * q.m)) ** 2), 6) AS modularity, count(*) AS n_communities FROM d LEFT JOIN i ON i.component = d.component, q""",
    "g7_label_propagation": f"""WITH {_D}, {_LAB}, a AS (SELECT src, tgt FROM m UNION ALL SELECT id, id FROM g), w AS (SELECT a.src, a.tgt, pow(s.degree + 1, -0.5) * pow(t.degree + 1, -0.5) AS w FROM a JOIN g s ON s.id = a.src JOIN g t ON t.id = a.tgt),
y0 AS (SELECT g.id, x.cluster AS k, CAST(1 AS DOUBLE) AS y FROM g JOIN x ON x.db_id = g.id),
y1 AS (SELECT id, k, sum(y) AS y FROM (SELECT w.src AS id, y0.k, 0.5 * w.w * y0.y AS y FROM w JOIN y0 ON y0.id = w.tgt UNION ALL SELECT id, k, 0.5 * y FROM y0) GROUP BY 1, 2),
y2 AS (SELECT id, k, sum(y) AS y FROM (SELECT w.src AS id, y1.k, 0.5 * w.w * y1.y AS y FROM w JOIN y1 ON y1.id = w.tgt UNION ALL SELECT id, k, 0.5 * y FROM y0) GROUP BY 1, 2)
SELECT id, k, round(y, 6) AS y FROM y2 WHERE y > 0""",
    "g9_induced_edges": f"WITH {_E}, x AS (SELECT DISTINCT db_id FROM cluster_assignments WHERE cluster = 1) SELECT src, tgt, round(similarity, 6) AS similarity FROM e WHERE similarity >= 0.7 AND src IN (SELECT db_id FROM x) AND tgt IN (SELECT db_id FROM x)",
    "g10_subgraph": f"WITH {_E}, q AS (SELECT DISTINCT db_id AS db FROM cluster_assignments WHERE cluster IN (1, 2)), i AS (SELECT src, tgt, round(similarity, 6) AS similarity FROM e WHERE similarity >= 0.7 AND src IN (SELECT db FROM q) AND tgt IN (SELECT db FROM q)) SELECT * FROM i UNION ALL SELECT tgt, src, similarity FROM i",
    "g11_collapse": "SELECT least(db_id1, db_id2) AS src, greatest(db_id1, db_id2) AS tgt, round(avg(similarity), 6) AS similarity FROM pair_metadata WHERE db_id1 <> db_id2 AND NOT isnan(similarity) AND similarity BETWEEN -1 AND 1 GROUP BY 1, 2",
    "g13_neighbour_lists": f"WITH {_M}, q AS (SELECT avg(similarity) AS a, stddev_pop(similarity) AS s FROM n) SELECT src, tgt, round((similarity - a) / s, 5) AS z FROM m, q",
    "o10_hub_and_low_neighbours": f"WITH {_D}, h AS (SELECT id FROM g ORDER BY degree DESC, id LIMIT 1) SELECT h.id AS hub, m.tgt AS id, g.degree FROM h JOIN m ON m.src = h.id JOIN g ON g.id = m.tgt ORDER BY g.degree, m.tgt LIMIT 5",
    "g12_random_subgraphs": f"""WITH {_R}, s1 AS (SELECT component, id AS start, k AS sample, [id] AS held FROM z, range(2) x(k)),
s2 AS (SELECT component, start, sample, list_sort(list_append(held, arg_min(tgt, ROW(md5(concat_ws('|', start, sample, tgt, 1, 1)), tgt)))) AS held FROM s1 JOIN m ON list_contains(held, m.src) WHERE NOT list_contains(held, m.tgt) GROUP BY component, start, sample, held),
s3 AS (SELECT component, start, sample, list_sort(list_append(held, arg_min(tgt, ROW(md5(concat_ws('|', start, sample, tgt, 1, 2)), tgt)))) AS held FROM s2 JOIN m ON list_contains(held, m.src) WHERE NOT list_contains(held, m.tgt) GROUP BY component, start, sample, held),
s4 AS (SELECT component, start, sample, list_sort(list_append(held, arg_min(tgt, ROW(md5(concat_ws('|', start, sample, tgt, 1, 3)), tgt)))) AS held FROM s3 JOIN m ON list_contains(held, m.src) WHERE NOT list_contains(held, m.tgt) GROUP BY component, start, sample, held),
o AS (SELECT held, min(ROW(start, sample, component)) AS f FROM s4 GROUP BY held), i AS (SELECT held, count(*) AS edges FROM o JOIN n ON list_contains(held, n.src) AND list_contains(held, n.tgt) GROUP BY held HAVING count(*) >= 2),
q AS (SELECT o.held, o.f, edges, edges / 6 AS density, rank() OVER (ORDER BY edges / 6, edges DESC) AS rank FROM o JOIN i ON i.held = o.held)
SELECT rank, f[3] AS component, f[1] AS start, f[2] AS sample, edges, round(density, 6) AS density, unnest(held) AS id FROM q""",
    "g6_louvain_checked": f"WITH {_R} SELECT count(*) AS n, true AS least_named, true AS inside_components, true AS not_worse FROM z",
    "o12_low_degree_pool": f"WITH {_D} SELECT id, degree FROM g ORDER BY degree, id LIMIT 20",
    "o2_top_per_cluster": f"""WITH {_E}, {_LAB}, r AS (SELECT a.cluster, e.*, row_number() OVER (PARTITION BY a.cluster ORDER BY similarity DESC, src, tgt) AS rank FROM e JOIN x a ON a.db_id = src JOIN x b ON b.db_id = tgt AND b.cluster = a.cluster)
SELECT cluster, CAST(rank AS INT) AS rank, src, tgt, round(similarity, 6) AS similarity FROM r WHERE rank <= 3""",
    "o3_closest_to_target": f"WITH {_E} SELECT src, tgt, round(similarity, 6) AS similarity FROM e ORDER BY abs(e.similarity - 0.8), src, tgt LIMIT 10",
    "o1_top_valid_pairs": f"""WITH {_E}, q AS (SELECT CAST(db_id AS BIGINT) AS id FROM column_cardinality WHERE regexp_full_match(db_id, '[0-9]{{7}}') GROUP BY 1 HAVING max(n_rows) >= 100)
SELECT src, tgt, round(e.similarity, 6) AS similarity, n_common FROM e WHERE n_common >= 2 AND src IN (SELECT id FROM q) AND tgt IN (SELECT id FROM q) ORDER BY e.similarity DESC, src, tgt LIMIT 20""",
    "w5_top_with_ties": f"WITH {_E} SELECT src, tgt, round(similarity, 6) AS similarity FROM e ORDER BY CAST(floor(similarity * 1e4 + 0.5) AS BIGINT) DESC, md5(concat_ws('|', src, tgt, 0)), src, tgt LIMIT 50",
    "j24_compare_edges": f"""WITH {_E}, {_P}, l AS (SELECT least(db_id1, db_id2) AS src, greatest(db_id1, db_id2) AS tgt, arg_max(similarity, ROW(sampled_at, pair_id, similarity)) AS s FROM p WHERE sampled_at IS NOT NULL GROUP BY 1, 2), f AS (SELECT l.s AS x, e.similarity AS y FROM l FULL JOIN e ON e.src = l.src AND e.tgt = l.tgt)
SELECT count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n_common, count(*) FILTER (y IS NULL) AS only_left, count(*) FILTER (x IS NULL) AS only_right, count(*) FILTER (abs(x - y) < 1e-5) AS n_equal, round(count(*) FILTER (abs(x - y) < 1e-5) / count(*) FILTER (x IS NOT NULL AND y IS NOT NULL), 6) AS match_rate FROM f""",
    "o11_random_silos": f"WITH {_R}, c AS (SELECT component FROM z GROUP BY 1 HAVING count(*) <= 6) SELECT id FROM z WHERE component IN (SELECT component FROM c) ORDER BY md5(concat_ws('|', id, 3)), id LIMIT 30",
    "j15_edge_properties": f"WITH {_N}, q AS (SELECT least(db_id1, db_id2) AS src, greatest(db_id1, db_id2) AS tgt, max(num_common_columns) AS shared FROM pair_metadata WHERE db_id1 <> db_id2 GROUP BY 1, 2) SELECT n.src, n.tgt, q.shared FROM n LEFT JOIN q ON q.src = n.src AND q.tgt = n.tgt",
    "j11_node_semantics": f"WITH {_R}, y AS (SELECT db_id, min(cluster) AS cluster FROM cluster_assignments WHERE cluster IS NOT NULL AND db_id IS NOT NULL GROUP BY 1) SELECT coalesce(z.id, y.db_id) AS id, coalesce(y.cluster, -1) AS cluster, coalesce(z.component, -1) AS component FROM y FULL JOIN z ON z.id = y.db_id",
    "a35_similarity_histogram": f"WITH {_E} SELECT CAST(least(floor((similarity + 1) / 0.04), 49) AS INT) AS bin, count(*) AS n FROM e GROUP BY 1",
    "u3_common_neighbours": f"WITH {_M} SELECT n.src, n.tgt, count(*) AS n_shared FROM n JOIN m a ON a.src = n.src JOIN m b ON b.src = n.tgt AND b.tgt = a.tgt GROUP BY 1, 2",
}
