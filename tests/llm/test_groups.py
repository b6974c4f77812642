"""Match groups, step clusters, k-means and set joins against brute force."""

import itertools
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from silomesh.llm import clusters, components, setjoin

PAIRS = "a long, b long, s double, v long, m long"


def brute_groups(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {(x, find(x)) for x in parent}


def test_groups_match_brute_force(spark):
    g = random.Random(1)
    data = [(g.randrange(60), g.randrange(60), g.choice([0.93, 0.94, 1.5, float("nan"), None]), 1, 2) for _ in range(90)]
    data += [(None, 3, 0.99, 1, 2), (4, None, 0.99, 1, 2), (5, 5, 0.99, 1, 2)] + data[:5]
    df = spark.createDataFrame(data, PAIRS)
    links = [(a, b) for a, b, s, *_ in data if a is not None and b is not None and a != b and s is not None and s >= 0.94]
    got = components.match_groups(df, "a", "b", "s", 0.94)
    assert {tuple(r) for r in got.collect()} == brute_groups(links) and got.count() == len(brute_groups(links))


def test_long_chain_and_star(spark):
    chain = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1001, 1400).select(F.lit(1000).cast("bigint").alias("a"), F.col("id").alias("b"))
    got = components.hash_to_min(chain.unionByName(star), "a", "b")
    assert rows(got.groupBy("root").count()) == [(1, 200), (1000, 400)]


def test_no_links_no_groups(spark):
    df = spark.createDataFrame([(1, 1, 1.0, 0, 0)], PAIRS)
    assert components.match_groups(df, "a", "b", "s", 0.5).count() == 0
    assert components.match_groups(df.limit(0), "a", "b", "s", 0.5).count() == 0


def brute_steps(points, step, least):
    spots = [(i, x, y) for i, x, y in points if i is not None and x is not None and y is not None and np.isfinite(x) and np.isfinite(y)]
    links = [(a[0], b[0]) for a, b in itertools.combinations(spots, 2) if (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= (step + 1e-9) ** 2]
    links += [(s[0], s[0]) for s in spots]
    of = brute_groups(links)
    size = {}
    for _, r in of:
        size[r] = size.get(r, 0) + 1
    return {(r, i) for i, r in of if size[r] >= least}


@pytest.mark.parametrize("seed", [1, 2])
def test_step_clusters_match_brute_force(spark, seed):
    g = random.Random(seed)
    pts = [(i, round(g.gauss(10 * (i % 4), 1.5), 2), round(g.gauss(0, 3), 2)) for i in range(250)]
    pts += [(300, None, 1.0), (301, float("nan"), 1.0), (302, float("inf"), 0.0), (None, 0.0, 0.0)] + pts[:9]
    pts += [(400 + i, 500.0, 500.0) for i in range(6)] + [(500 + i, 600.0 + i, 0.0) for i in range(5)] + [(3, 900.0, 900.0), (7, 900.5, 900.0)]
    df = spark.createDataFrame(pts, "db long, x double, y double").withColumn("member", F.lit(1))
    got = clusters.step_clusters(df, "db", "x", "y", 1.0, 5, k=6)
    assert {tuple(r) for r in got.collect()} == brute_steps(pts, 1.0, 5)
    assert clusters.step_clusters(df.limit(0), "db", "x", "y").count() == 0


def test_near_miss_between_dense_spots(spark):
    g = random.Random(3)
    left = [(i, g.uniform(0, 0.5), g.uniform(0, 0.5)) for i in range(150)]
    right = [(1000 + i, g.uniform(1.505, 1.9), g.uniform(0, 0.5)) for i in range(150)]
    df = spark.createDataFrame(left + right, "db long, x double, y double")
    assert {tuple(r) for r in clusters.step_clusters(df, "db", "x", "y", 1.0, 5, k=2).collect()} == brute_steps(left + right, 1.0, 5)


def test_cells_only_divide_the_work(spark):
    g = random.Random(9)
    pts = [(i, g.uniform(0, 40), g.uniform(0, 40)) for i in range(1200)] + [(2000 + i, 100 + g.gauss(0, 0.3), g.gauss(0, 0.3)) for i in range(400)]
    df = spark.createDataFrame(pts, "db long, x double, y double")
    want = brute_steps(pts, 1.0, 5)
    for k in (1, 9):
        assert {tuple(r) for r in clusters.step_clusters(df, "db", "x", "y", 1.0, 5, k=k).collect()} == want
    lo = np.array([[0.0, 0.0]])
    assert clusters._gaps(lo, lo + 1, lo + 3, lo + 4)[0] == 8.0


def test_kmeans_finds_separate_clouds(spark):
    g = np.random.default_rng(0)
    x = np.concatenate([g.normal(c, 0.2, (60, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double").select("id", clusters.hashed_features({"a": 1.0, "b": 1.0}, dims=8).alias("x"))
    centres = clusters.kmeans(df, 3)
    sizes = sorted(r["count"] for r in clusters.assign(df, centres).groupBy("cell").count().collect())
    assert sizes == [60, 60, 60]


def test_hashed_features_keep_distances_and_take_tokens(spark):
    df = spark.createDataFrame([(0.0, 0.0, ["a"]), (3.0, 4.0, ["a", "b"]), (None, 1.0, None)], "a double, b double, t array<string>")
    v = [np.array(r[0]) for r in df.select(clusters.hashed_features({"a": 1.0, "b": 1.0})).collect()]
    assert np.linalg.norm(v[0] - v[1]) == 5.0
    t = [np.array(r[0]) for r in df.select(clusters.hashed_features({}, {"t": 2.0})).collect()]
    assert np.abs(t[0]).sum() == 2.0 and np.abs(t[2]).sum() == 0.0


def test_typical_members(spark):
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate([0, 1, 2, 3, 10])], "c long, m long, x double")
    r = clusters.typical_members(df, "c", "m", ["x"], 2).first()
    assert (r.size, r.c_x, r.typical) == (5, 3.2, [3, 2])


def brute_sets(sets, t):
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}


@pytest.mark.parametrize("seed,t", [(1, 0.7), (2, 0.7), (3, 0.5), (4, 0.9)])
def test_set_join_matches_brute_force(spark, seed, t):
    g = random.Random(seed)
    sets = {}
    for i in range(120):
        if sets and g.random() < 0.5:
            s = set(g.choice(list(sets.values())))
            for _ in range(g.randrange(0, 4)):
                s ^= {g.randrange(60)}
        else:
            s = {min(int(g.expovariate(0.1)), 59) for _ in range(g.randrange(1, 25))}
        if s:
            sets[i] = s
    data = [(i, x, 0) for i, s in sets.items() for x in s]
    data += data[:40] + [(None, 1, 0), (1, None, 0)]
    tok = spark.createDataFrame(data, "rec long, t long, len int").select("rec", F.when(F.col("t").isNotNull(), F.xxhash64("t")).alias("h"), "len")
    pairs, members = setjoin.similar_sets(tok, t)
    got = [tuple(r) for r in setjoin.expand(pairs, members).collect()]
    assert set(got) == brute_sets(sets, t) and len(got) == len(set(got))
    assert members.count() == len(sets)


def test_large_and_heavy_sets(spark):
    big = [(1, x) for x in range(5000)] + [(2, x) for x in range(300, 5200)] + [(3, x) for x in range(3000)]
    tok = spark.createDataFrame(big, "rec long, t long").select("rec", F.xxhash64("t").alias("h"))
    pairs, members = setjoin.similar_sets(tok, 0.7)
    assert rows(setjoin.expand(pairs, members)) == [(1, 2)]
    pairs, members = setjoin.similar_sets(tok.limit(0), 0.7)
    assert pairs.count() == 0 and members.count() == 0


def test_budget_covers_every_difference():
    for t in (0.5, 0.7, 0.9):
        bounds = setjoin.length_classes(t, 2000)
        for k in range(len(bounds) - 2):
            assert all(-(-int(n * t * 1e9) // 10**9) >= bounds[max(0, k - 1)] for n in range(bounds[k], bounds[k + 1]))


def test_names_get_hashes_of_their_own(spark):
    names = spark.createDataFrame([(1, "a"), (1, None), (None, "b"), (2, "b"), (2, "b"), (3, "")], "rec long, name string")
    got = setjoin.hashed_names(names)
    assert sorted(r.rec for r in got.collect()) == [1, 2, 2, 3] and got.select("h").distinct().count() == 3


def test_sets_with_one_print_are_compared_whole(spark):
    packed = spark.createDataFrame([(1, 1, 0, [5, 6]), (2, 1, 0, [6, 5]), (3, 1, 0, [5, 7]), (4, 2, 0, [1]), (4, 2, 1, [2]), (5, 2, 0, [1, 2])], "rec long, of int, chunk int, hs array<long>")
    alike = spark.createDataFrame([(2, 1, 2), (3, 1, 2), (5, 4, 2)], "rec long, rep long, len long")
    assert rows(setjoin._equal_sets(packed, alike)) == [(2, 1)]
