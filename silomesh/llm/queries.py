"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silomesh.functions.names import name_key
from silomesh.llm import clusters, components, forest, mixing, packing, residue, setjoin, tokens
from silomesh.runtime import Workspace, read


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """One group id for every silo that a similarity of at least 0.94 links to another."""
    groups = components.match_groups(read(spark, d, "pair_metadata"), "db_id1", "db_id2", "similarity", 0.94)
    return groups.select(F.col("root").alias("group_id"), F.col("node").alias("db_id"))


def p1_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Number of silos in each group."""
    return p1_found(spark, d).groupBy("group_id").agg(F.count("*").alias("n_silos"))


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    found = clusters.step_clusters(read(spark, d, "cluster_assignments"), "db_id", "dim_0", "dim_1", step=1.0, least=5)
    return found.select("cluster_id", F.col("member").alias("db_id"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Silos of the two-dimensional map in clusters of at least five, joined over steps of at most 1.0."""
    return _clusters(spark, d)


def p3_described(spark: SparkSession, d: str) -> DataFrame:
    """Size, centre and five most typical silos of each cluster."""
    spot = read(spark, d, "cluster_assignments").filter("dim_0 is not null and dim_1 is not null").groupBy("db_id").agg(F.avg("dim_0").alias("dim_0"), F.avg("dim_1").alias("dim_1"))
    out = clusters.typical_members(_clusters(spark, d).join(spot, "db_id"), "cluster_id", "db_id", ["dim_0", "dim_1"])
    return out.select("cluster_id", "size", F.round("c_dim_0", 9).alias("centre_0"), F.round("c_dim_1", 9).alias("centre_1"), F.array_join("typical", ",").alias("typical"))



def _names(spark: SparkSession, d: str) -> DataFrame:
    """(rec, h): table names and names of existing columns of each silo; a table and a column are never equal."""
    silo = F.expr("try_cast(trim(db_id) AS BIGINT)").alias("rec")
    tables = read(spark, d, "schema_tables").select(silo, F.lit("t").alias("kind"), name_key("table_name").alias("name"))
    columns = read(spark, d, "schema_columns").filter("removed_at is null").select(silo, F.lit("c").alias("kind"), name_key("column_name").alias("name"))
    return setjoin.hashed_names(tables.unionByName(columns).filter("name is not null").select("rec", F.concat("kind", "name").alias("name")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Silo pairs whose name sets have a Jaccard similarity of at least 0.7."""
    pairs, members = setjoin.similar_sets(_names(spark, d), 0.7)
    return setjoin.expand(pairs, members).select(F.col("x").alias("db_id1"), F.col("y").alias("db_id2"))


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    """Each silo with the class of equal name sets it belongs to and the number of silos similar to it."""
    pairs, members = setjoin.similar_sets(_names(spark, d), 0.7)
    size = members.groupBy("rep").agg(F.count("*").alias("n"))
    ends = pairs.select(F.col("a").alias("rep"), F.col("b").alias("o")).unionByName(pairs.select(F.col("b").alias("rep"), F.col("a").alias("o")))
    linked = ends.join(size.select(F.col("rep").alias("o"), F.col("n").alias("n_o")), "o").groupBy("rep").agg(F.sum("n_o").alias("n_other"))
    out = members.join(size, "rep").join(linked, "rep", "left")
    return out.select(F.col("rec").alias("db_id"), F.col("rep").alias("class_id"), (F.col("n") - 1 + F.coalesce("n_other", F.lit(0))).alias("n_similar"))



def _near_vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return forest.neighbours(read(spark, d, "database_embeddings"), "db_id", "embedding", k=5, least=0.85)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Silo pairs with a cosine of at least 0.85 in which one is among the other's five most similar."""
    near, members = _near_vectors(spark, d)
    classes = near.select(F.least("q", "s").alias("a"), F.greatest("q", "s").alias("b")).distinct()
    return setjoin.expand(classes, members.select("rec", "rep")).select(F.col("x").alias("db_id1"), F.col("y").alias("db_id2"))


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The most similar other vectors of every silo whose id is divisible by 50, at any cosine, as classes of equal vectors.

    ``class_id`` is the silo's own class; it is listed as its own neighbour, without the silo itself, if it has other members.
    """
    near, members = forest.neighbours(read(spark, d, "database_embeddings"), "db_id", "embedding", k=5, asking=F.col("rec") % 50 == 0)
    asked = members.filter("rec % 50 = 0").select(F.col("rec").alias("db_id"), F.col("rep").alias("class_id"), "n")
    size = members.filter("rec = rep").select(F.col("rep").alias("s"), F.col("n").alias("n_members"))
    others = asked.join(near, asked.class_id == near.q).join(size, "s").select("db_id", "class_id", F.col("s").alias("near_class"), "n_members", F.round("cosine", 9).alias("cosine"))
    copies = asked.filter("n > 1").select("db_id", "class_id", F.col("class_id").alias("near_class"), (F.col("n") - 1).alias("n_members"), F.lit(1.0).alias("cosine"))
    return others.unionByName(copies)


def _sized(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    """Sizes of all documents in tokens, counted once and kept in the shared folder."""
    return Workspace(spark, "sized").write(tokens.sized(read(spark, d, "documents"), keep=keep))


def _capacities(spark: SparkSession, d: str) -> list[int]:
    return [r[0] for r in read(spark, d, "pack_specs").filter("capacity_tokens > 0").select("capacity_tokens").distinct().collect()]


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every text, or piece of a text above the largest capacity, in a container; all capacities are used jointly."""
    return packing.pack(_sized(spark, d), "doc_id", "n_tokens", _capacities(spark, d))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, pieces, tokens and fill by capacity."""
    return packing.bin_report(p7_packed(spark, d)).withColumn("fill", F.round("fill", 6))


def _in_characters(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    """Sizes of all documents in characters, which SQL can count too."""
    return read(spark, d, "documents").select("doc_id", *keep, F.length("text").cast("bigint").alias("n_tokens")).filter("n_tokens > 0")


def p7_checked(spark: SparkSession, d: str) -> DataFrame:
    """The packing of texts sized in characters, with what must hold of it: items whole or cut only above the largest
    capacity, every piece once, no container above its capacity or of a capacity that a smaller one could replace."""
    caps = _capacities(spark, d)
    packed = Workspace(spark, "packed").write(packing.pack(_in_characters(spark, d), "doc_id", "n_tokens", caps))
    bins = packed.groupBy("bin", "capacity").agg(F.sum("size").alias("held"))
    smaller = F.array_max(F.filter(F.array(F.lit(0), *(F.lit(c) for c in caps)), lambda c: c < F.col("capacity")))
    of_bins = bins.agg(F.count_if(F.col("held") > F.col("capacity")).alias("n_overfull"), F.count_if(F.col("held") <= smaller).alias("n_too_large"), (F.sum("held") / F.sum("capacity") >= 0.95).alias("well_filled"))
    items = packed.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    of_items = items.agg(F.count("*").alias("n_items"), F.sum("n").alias("n_pieces"), F.sum("size").alias("total"), F.count_if(F.col("n") > 1).alias("n_cut"))
    return of_items.join(F.broadcast(of_bins))


def p8_checked(spark: SparkSession, d: str) -> DataFrame:
    """The mixes of texts sized in characters: attainable shares, and whether each source misses its own by no more than
    its longest text and uses no text more than ``max_repeats`` times."""
    sized, targets = _in_characters(spark, d, "source"), read(spark, d, "mix_targets")
    mixed = Workspace(spark, "mixed").write(mixing.mix(sized, targets))
    used = mixed.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("used"), F.max("copy").alias("copies_used"))
    longest = sized.groupBy("source").agg(F.max("n_tokens").alias("longest"))
    met = mixing.expected_copies(sized, targets).join(longest, "source").join(used, ["mix_name", "source"], "left")
    return met.select("mix_name", "source", F.round("attainable", 6).alias("attainable_share"), F.round("amount", 2).alias("amount"), (F.abs(F.coalesce("used", F.lit(0)) - F.col("amount")) <= F.col("longest")).alias("within_one"), (F.coalesce("copies_used", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"))


def p8_mixed(spark: SparkSession, d: str) -> DataFrame:
    """The documents of every mix, one row for each time a document is used."""
    return mixing.mix(_sized(spark, d, "source"), read(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of all mixes."""
    sized, targets = _sized(spark, d, "source"), read(spark, d, "mix_targets")
    return mixing.mix_report(mixing.mix(sized, targets), sized, targets).withColumn("actual_share", F.round("actual_share", 6)).withColumn("attainable_share", F.round("attainable_share", 6))



def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts that are template residue, filler, an error page or a script notice."""
    return residue.find_residue(read(spark, d, "documents")).select("doc_id")


def p9_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Number of such texts by source and reason."""
    found = residue.find_residue(read(spark, d, "documents"))
    docs = read(spark, d, "documents").select("doc_id", "source")
    return found.join(docs, "doc_id").groupBy("source", "reason").agg(F.count("*").alias("n_docs"))


QUERIES = {f.__name__: f for f in (p1_found, p1_group_sizes, p3_found, p3_described, p4_found, p4_links, p6_found, p6_neighbours, p7_packed, p7_fill, p7_checked, p8_mixed, p8_shares, p8_checked, p9_found, p9_reasons)}

_GROUPS = """RECURSIVE e AS (
  SELECT db_id1 AS a, db_id2 AS b FROM pair_metadata WHERE similarity >= 0.94 AND NOT isnan(similarity) AND db_id1 <> db_id2
  UNION SELECT db_id2, db_id1 FROM pair_metadata WHERE similarity >= 0.94 AND NOT isnan(similarity) AND db_id1 <> db_id2),
r AS (SELECT a AS db_id, a AS seen FROM e UNION SELECT r.db_id, e.b FROM r JOIN e ON e.a = r.seen)"""

_NEAR = """RECURSIVE p AS (SELECT DISTINCT db_id, dim_0 AS x, dim_1 AS y FROM cluster_assignments WHERE dim_0 IS NOT NULL AND dim_1 IS NOT NULL),
e AS (SELECT DISTINCT a.db_id AS a, b.db_id AS b FROM p a JOIN p b ON b.x BETWEEN a.x - 1.001 AND a.x + 1.001 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1.000000002),
r AS (SELECT DISTINCT db_id, db_id AS seen FROM p UNION SELECT r.db_id, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT db_id, min(seen) AS cluster_id FROM r GROUP BY db_id),
k AS (SELECT cluster_id, db_id FROM c WHERE cluster_id IN (SELECT cluster_id FROM c GROUP BY 1 HAVING count(*) >= 5))"""

_SETS = """n AS (
  SELECT try_cast(trim(db_id) AS BIGINT) AS db_id, 't' || regexp_replace(lower(table_name), '[^a-z0-9]', '', 'g') AS name FROM schema_tables WHERE regexp_replace(lower(table_name), '[^a-z0-9]', '', 'g') <> ''
  UNION SELECT try_cast(trim(db_id) AS BIGINT), 'c' || regexp_replace(lower(column_name), '[^a-z0-9]', '', 'g') FROM schema_columns WHERE removed_at IS NULL AND regexp_replace(lower(column_name), '[^a-z0-9]', '', 'g') <> ''),
l AS (SELECT db_id, count(*) AS len FROM n WHERE db_id IS NOT NULL GROUP BY 1),
i AS (SELECT a.db_id AS x, b.db_id AS y, count(*) AS n FROM n a JOIN n b ON a.name = b.name AND a.db_id < b.db_id GROUP BY 1, 2),
j AS (SELECT x, y FROM i JOIN l p ON p.db_id = x JOIN l q ON q.db_id = y WHERE i.n / (p.len + q.len - i.n) >= 0.7)"""

SQL = {
    "p1_found": f"WITH {_GROUPS} SELECT min(seen) AS group_id, db_id FROM r GROUP BY db_id",
    "p1_group_sizes": f"WITH {_GROUPS}, g AS (SELECT min(seen) AS group_id, db_id FROM r GROUP BY db_id) SELECT group_id, count(*) AS n_silos FROM g GROUP BY 1",
    "p3_found": f"WITH {_NEAR} SELECT cluster_id, db_id FROM k",
    "p4_found": f"WITH {_SETS} SELECT x AS db_id1, y AS db_id2 FROM j",
    "p3_described": f"""WITH {_NEAR}, s AS (SELECT db_id, avg(dim_0) AS x, avg(dim_1) AS y FROM cluster_assignments WHERE dim_0 IS NOT NULL AND dim_1 IS NOT NULL GROUP BY 1),
m AS (SELECT k.*, s.x, s.y, count(*) OVER w AS size, avg(s.x) OVER w AS cx, avg(s.y) OVER w AS cy FROM k JOIN s USING (db_id) WINDOW w AS (PARTITION BY cluster_id)),
t AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(sqrt((x - cx) ** 2 + (y - cy) ** 2), 9), db_id) AS r FROM m)
SELECT cluster_id, size, round(cx, 9) AS centre_0, round(cy, 9) AS centre_1, string_agg(CAST(db_id AS VARCHAR), ',' ORDER BY r) AS typical FROM t WHERE r <= 5 GROUP BY 1, 2, 3, 4""",
    "p4_links": f"""WITH {_SETS}, q AS (SELECT x, y FROM i JOIN l p ON p.db_id = x JOIN l r ON r.db_id = y WHERE i.n = p.len AND i.n = r.len), c AS (SELECT y AS db_id, min(x) AS class_id FROM q GROUP BY 1),
k AS (SELECT db_id, count(*) AS n FROM (SELECT x AS db_id FROM j UNION ALL SELECT y FROM j) GROUP BY 1)
SELECT l.db_id, coalesce(c.class_id, l.db_id) AS class_id, coalesce(k.n, 0) AS n_similar FROM l LEFT JOIN c ON c.db_id = l.db_id LEFT JOIN k ON k.db_id = l.db_id""",
    "p7_checked": """WITH d AS (SELECT length(text) AS n FROM documents WHERE length(text) > 0), m AS (SELECT max(capacity_tokens) AS most FROM pack_specs WHERE capacity_tokens > 0)
SELECT count(*) AS n_items, CAST(sum(ceil(n / most)) AS BIGINT) AS n_pieces, CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (n > most) AS n_cut, CAST(0 AS BIGINT) AS n_overfull, CAST(0 AS BIGINT) AS n_too_large, true AS well_filled FROM d, m""",
    "p8_checked": """WITH h AS (SELECT source, sum(length(text)) AS held FROM documents WHERE length(text) > 0 AND source IS NOT NULL GROUP BY 1),
p AS (SELECT mix_name, source, target_share / sum(target_share) OVER (PARTITION BY mix_name) AS share, max_repeats * held AS most FROM mix_targets JOIN h USING (source) WHERE target_share > 0 AND max_repeats > 0),
w AS (SELECT *, min(most / share) OVER (PARTITION BY mix_name) AS whole FROM p)
SELECT mix_name, source, round(share, 6) AS attainable_share, round(least(share * whole, most), 2) AS amount, true AS within_one, true AS within_repeats FROM w""",
    "p6_found": """WITH v AS (SELECT DISTINCT db_id, CAST(embedding AS DOUBLE[]) AS e FROM database_embeddings WHERE len(embedding) = 64
  AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND NOT isnan(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
c AS (SELECT a.db_id AS q, b.db_id AS s, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.db_id <> b.db_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC) AS n FROM c),
f AS (SELECT q, min(c) AS bar FROM r WHERE n <= 5 GROUP BY q)
SELECT DISTINCT least(c.q, c.s) AS db_id1, greatest(c.q, c.s) AS db_id2 FROM c JOIN f ON f.q = c.q WHERE c.c >= f.bar - 1e-9 AND c.c >= 0.85""",
}
