"""Golden cases of the operators, and invariants."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from silomesh.functions.names import name_key, padded_id
from silomesh.operators import encode, federated, graph, knowledge, metrics, pairs, profile, report, serialize, vector


def test_name_rules(spark):
    df = spark.createDataFrame([("A_b-C.d é",), (None,), ("__",)], "n string")
    got = [df.select(name_key("n", k)).collect()[0][0] for k in ("unicode", "ascii", "separators", "dotted", "lower")]
    assert got == ["abcdé", "abcd", "abc.dé", "d", "a_b-c.d é"]
    assert [r[0] for r in df.select(name_key("n")).collect()] == ["abcd", None, None]
    assert [r[0] for r in spark.createDataFrame([("7",), ("1234567",)], "i string").select(padded_id("i")).collect()] == ["00007", "1234567"]


def test_column_profile_cases(spark):
    df = spark.createDataFrame([("1", "a", None), ("1", None, None), ("2", "a", None), ("x", "a", None)], "p string, q string, r string")
    p = {r.column_name: r for r in profile.varying_columns(profile.column_profile(profile.cells(df, ["p", "q", "r"]))).collect()}
    assert (p["p"].n_distinct, p["q"].sparsity, p["r"].entropy, p["p"].numeric_share) == (3, 0.25, 0.0, 0.75)
    assert (p["p"].keep, p["q"].keep, p["r"].keep) == (True, True, False)
    same = profile.varying_columns(profile.column_profile(profile.cells(spark.createDataFrame([(1,), (1,)], "c int"), ["c"])))
    assert same.first().keep
    assert profile.column_profile(profile.cells(df.limit(0), ["p"])).count() == 0


def test_components_and_probability(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (5, 6, 1.0), (7, 7, 1.0)], "src long, tgt long, similarity double")
    assert rows(graph.connected_components(e)) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)]
    path = spark.range(1, 40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("tgt"))
    assert {r.component for r in graph.connected_components(path).collect()} == {1}
    sizes = spark.createDataFrame([(2,), (1,)], "size long")
    assert graph.different_component_probability(sizes).first().p_different == pytest.approx(2 / 3)
    assert graph.connected_components(e.limit(0)).count() == 0


def test_threshold_sides_and_sweep(spark):
    e = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.7)], "src long, tgt long, similarity double")
    assert (graph.above(e, 0.5).count(), graph.above(e, 0.5, False).count()) == (2, 1)
    assert rows(graph.threshold_sweep(e, [0.5, 0.6, 0.9], 4), "threshold", "n_edges", "coverage") == [(0.5, 2, 75.0), (0.6, 1, 50.0), (0.9, 0, 0.0)]


def test_subgraph_falls_back_to_clique(spark):
    e = spark.createDataFrame([(1, 9, 0.5)], "src long, tgt long, similarity double")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert graph.subgraph(e, ids).count() == 6
    assert graph.subgraph(e.unionByName(spark.createDataFrame([(1, 2, 0.4)], e.schema)), ids).count() == 2


def plain_louvain(links):
    """Modularity of multi-level Louvain as written down, with dense matrices."""
    ids = sorted({x for e in links for x in e})
    a = np.zeros((len(ids), len(ids)))
    for x, y in links:
        a[ids.index(x), ids.index(y)] += 1
        a[ids.index(y), ids.index(x)] += 1
    while True:
        m2, deg, com, moved = a.sum(), a.sum(1), np.arange(len(a)), True
        while moved:
            moved = False
            for v in range(len(a)):
                rest = np.arange(len(a)) != v
                score = np.array([a[v, rest & (com == c)].sum() - deg[v] * deg[rest & (com == c)].sum() / m2 for c in range(len(a))])
                if score.max() > score[com[v]] + 1e-9:
                    com[v], moved = score.argmax(), True
        one = (com[:, None] == np.unique(com)[None, :]).astype(float)
        if one.shape[1] == len(a):
            return np.trace(a) / m2 - ((deg / m2) ** 2).sum()
        a = one.T @ a @ one


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_louvain_modularity_against_plain_louvain(spark, small):
    rng = np.random.default_rng(5)
    ring = [(8 * c + i, 8 * c + i + 1) for c in range(6) for i in range(7)] + [(8 * c, (8 * c + 12) % 48) for c in range(6)]
    blocks = [(a, b) for a in range(100, 160) for b in range(a + 1, 160) if rng.random() < (0.5 if a // 15 == b // 15 else 0.03)]
    links = sorted({(min(e), max(e)) for e in ring + blocks})
    e = spark.createDataFrame(links, "src long, tgt long")
    labels = graph.louvain(e, small=small).localCheckpoint()
    assert sorted(r.id for r in labels.collect()) == sorted({x for e in links for x in e})
    assert all(min(g) == c for c, g in labels.groupBy("community").agg(F.collect_list("id")).collect())
    assert graph.modularity(e, labels).first().modularity > plain_louvain(links) - 0.02
    assert graph.louvain(e.limit(0), small=small).count() == 0


def test_louvain_raises_when_rounds_run_out(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)], "src long, tgt long")
    with pytest.raises(RuntimeError):
        graph.louvain(e, max_rounds=1, small=0)


def test_random_subgraphs_of_large_components_are_ranked(spark, tmp_path):
    from silomesh.plans.graphs import QUERIES

    path, clique = [(i, i + 1) for i in range(1, 70)], [(a, b) for a in range(100, 104) for b in range(a + 1, 104)]
    links = path + clique + [(200, 201), (201, 202)]
    spark.createDataFrame([(a, b, 0.95, 1) for a, b in links], "db_id1 long, db_id2 long, similarity double, num_common_columns long").write.parquet(str(tmp_path / "pair_metadata.parquet"))
    got = QUERIES["g12_random_subgraphs"](spark, str(tmp_path)).collect()
    sets = {}
    for r in got:
        sets.setdefault((r.start, r.sample), []).append(r)
    assert {r.id for r in got} == {*range(1, 71), *range(100, 104)}  # no set of four fits into 200 to 202
    assert len({frozenset(r.id for r in s) for s in sets.values()}) == len(sets)
    for (start, _), s in sets.items():
        ids = {r.id for r in s}
        inside = [(a, b) for a, b in links if a in ids and b in ids]
        assert len(ids) == 4 and start in ids and {(r.edges, r.density) for r in s} == {(len(inside), round(len(inside) / 6, 6))}
        near = {start}
        for _ in ids:
            near |= {x for e in inside for x in e if near & set(e)}
        assert near == ids
    assert [r.rank for r in got] == sorted(r.rank for r in got)
    assert {r.rank for r in got if r.start < 100} == {1} and {r.rank for r in got if r.start >= 100} == {len(sets)}


def test_louvain_splits_two_cliques(spark):
    left = [(a, b) for a in range(5) for b in range(a + 1, 5)]
    e = spark.createDataFrame([*left, *((a + 10, b + 10) for a, b in left), (4, 10)], "src long, tgt long")
    got = {r.id: r.community for r in graph.louvain(e).collect()}
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(10, 15)}) == 1 and got[0] != got[12]


def test_similarity_join_and_knn(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "id long, v array<double>")
    got = {(r.src, r.tgt): r.similarity for r in vector.similarity_join(v, -2.0, block=2).collect()}
    assert set(got) == {(1, 2), (1, 3), (2, 3)} and got[1, 2] == pytest.approx(math.sqrt(0.5))
    assert rows(vector.knn(v, 1), "src", "tgt") == [(1, 2), (2, 3)]
    assert vector.similarity_join(v.limit(0), 0.0).count() == 0
    g = np.random.default_rng(1)
    x = g.normal(size=(90, 6))
    many = spark.createDataFrame([(i, r.tolist(), f"t{i % 4}", f"c{i:02d}") for i, r in enumerate(x)], "id long, v array<double>, tab string, col string")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -3)
    assert rows(vector.nearest(many, 3, block=20), "src", "tgt") == rows(spark.createDataFrame([(i, int(j)) for i in range(90) for j in np.argsort(-s[i])[:3]], "src long, tgt long"))
    far = np.where(np.arange(90)[:, None] % 4 == np.arange(90)[None, :] % 4, -3, s)
    assert rows(vector.nearest(many, 2, "tab", block=20), "src", "tgt") == rows(spark.createDataFrame([(i, int(j)) for i in range(90) for j in np.argsort(-far[i])[:2]], "src long, tgt long"))
    idf = spark.createDataFrame([("c03", 0.1), ("c08", 0.4)], "col string, idf double")
    w = np.ones(90)
    w[[3, 8]] = 0.1, 0.4
    score = np.minimum(w[:, None], w[None, :]) * s
    got = {(r.t1, r.t2): r.score for r in vector.best_weighted_match(many, idf, block=20).collect()}
    assert all(got[f"t{a}", f"t{b}"] == pytest.approx(score[np.ix_(range(a, 90, 4), range(b, 90, 4))].max()) for a in range(4) for b in range(a + 1, 4)) and len(got) == 6


def test_set_and_distribution_distances(spark):
    one = spark.range(1)
    j = lambda a, b: one.select(vector.jaccard(F.array(*map(F.lit, a)).cast("array<string>"), F.array(*map(F.lit, b)).cast("array<string>"))).first()[0]
    assert (j([], []), j(["a"], ["a"]), j(["a", "b"], ["b", "c"])) == (0.0, 1.0, 1 / 3)
    m = lambda d: F.from_json(F.lit(d), "map<string,double>")
    h = lambda p, q: one.select(vector.hellinger(m(p), m(q))).first()[0]
    assert (h("{}", "{}"), h('{"a":1}', '{"a":1}')) == (0.0, 0.0) and h('{"a":1}', '{"b":1}') == pytest.approx(1.0)


def test_edit_distance(spark):
    e = spark.createDataFrame([("p", 0, "a", "b"), ("p", 0, "b", "c"), ("p", 1, "x", "y"), ("q", 0, "a", "b"), ("q", 1, None, None)], "pair string, side int, a string, b string")
    assert rows(vector.edit_distance(e)) == [("p", 2.0, True), ("q", 3.0, True)]
    path, star = {(i, i + 1) for i in range(5)}, {(0, i) for i in range(1, 6)}
    assert vector.graph_distance(path, star) == (8, True)
    g = random.Random(4)
    for _ in range(25):
        one, two = ({(g.randrange(n), g.randrange(n)) for _ in range(g.randrange(0, 8))} for n in (5, 6))
        a, b = (sorted({x for p in e for x in p}) for e in (one, two))
        if len(a) > len(b):
            a, b, one, two = b, a, two, one
        best = max(sum((m[x], m[y]) in two for x, y in one) for m in (dict(zip(a, q)) for q in itertools.permutations(b, len(a))))
        assert vector.graph_distance(one, two) == (len(b) - len(a) + len(one) + len(two) - 2 * best, True)
    wheel = {(i, (i + 1) % 40) for i in range(40)}
    assert vector.graph_distance(wheel, {(i, i + 100) for i in range(40)}, 50)[0] >= 40


def test_greedy_match_is_one_to_one(spark):
    s = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.8), ("b", "x", 0.85), ("b", "y", 0.1)], "a string, b string, score double")
    assert rows(vector.greedy_match(s)) == [("a", "x", 0.9), ("b", "y", 0.1)]
    g = random.Random(2)
    data = [(t, g.randrange(8), g.randrange(8), g.randrange(6) / 10) for t in "uv" for _ in range(30)]
    want = []
    for t in "uv":
        used_a, used_b = set(), set()
        for _, a, b, x in sorted((r for r in set(data) if r[0] == t), key=lambda r: (-r[3], r[1], r[2])):
            if a not in used_a and b not in used_b:
                used_a.add(a)
                used_b.add(b)
                want.append((t, a, b, x))
    assert rows(vector.greedy_match(spark.createDataFrame(data, "t string, a int, b int, score double"), ["t"])) == sorted(want, key=lambda t: tuple((x is None, str(x)) for x in t))
    assert vector.greedy_match(s.limit(0)).count() == 0


def test_metrics_cases(spark):
    s = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1), (None, 0.5)], "y int, score double")
    assert metrics.roc(s).first().auc == pytest.approx((0.5 + 1 + 0 + 1) / 4)
    r = metrics.at_threshold(s, 0.9).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.f1) == (1, 1, 1, 1, 0.5)
    one = spark.createDataFrame([("p", 0, "a"), ("p", 1, "a"), ("q", 0, "a"), ("q", 0, "b"), ("q", 1, "a"), ("q", 1, "b")], "pair string, side int, class string")
    assert rows(metrics.dirichlet_alpha(one)) == [("p", 100.0), ("q", math.inf)]
    assert metrics.at_threshold(s.limit(0), 0.5).first().f1 == 0.0


def test_split_and_encode(spark):
    df = spark.range(11).withColumn("c", F.when(F.col("id") < 10, "a").otherwise("b"))
    n = {(r.c, r.part): r["count"] for r in encode.split(df, "id", 0.25, 1, ["c"]).groupBy("c", "part").count().collect()}
    assert n == {("a", "test"): 3, ("a", "train"): 7, ("b", "train"): 1}
    codes = encode.dictionary(spark.createDataFrame([("x",), ("a",), (None,)], "v string"), "v")
    assert rows(codes) == [("a", 0), ("x", 1)]
    assert rows(encode.encode(spark.createDataFrame([("q",), ("x",), (None,)], "v string"), "v", codes, 0), "v", "v_code") == [("q", 0), ("x", 1), (None, 0)]
    z = encode.standardise(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double"), ["a", "b"], encode.scale_terms(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double"), ["a", "b"]))
    assert rows(z) == [(-1.0, 0.0), (-2.0, 0.0), (1.0, 0.0)]


def test_join_size_and_estimates(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (9,)], "k int")
    b = spark.createDataFrame([(1, 7), (2, 7), (2, 8)], "p int, q int")
    assert pairs.join_size({"a": a, "b": b}, [("a", "k", "b", "p")]).first().n_rows == a.join(b, a.k == b.p).count()
    assert pairs.estimated_join_size({"t": 9}, {}, []) == 9 and pairs.estimated_join_size({"t": 9, "u": 4}, {}, []) == 9
    assert pairs.estimated_join_size({"t": 9, "u": 8}, {("u", "k"): 4}, [("u", "k", "t")]) == 18


def test_columns_and_splits(spark):
    assert pairs.deduplicated_columns(["Gene_Id", "geneid", "__"]) == ["Gene_Id"]
    assert pairs.common_columns(["Gene_Id", "x"], ["geneID", "GENE-ID", "X"]) == {"geneID": "Gene_Id", "X": "x"}
    left, right = pairs.vertical_halves(list("abcdef"), 0.5)
    assert (left, right) == (list("abcd"), list("bcdef")) and pairs.vertical_halves(list("abcdef"))[0] == list("abc")
    with pytest.raises(ValueError):
        pairs.vertical_halves(["a"])
    parts = pairs.split_groups({i: 1 for i in range(10)})
    assert [list(parts.values()).count(i) for i in range(3)] == [7, 1, 2]


def test_fk_join_and_triplets(spark):
    base = spark.createDataFrame([(1, "u"), (2, "v"), (None, "w")], "k int, name string")
    right = spark.createDataFrame([(1, 5, "b"), (1, 3, "a")], "id int, o int, name string")
    assert rows(pairs.fk_left_join(base, right, "k", "id", "r", ["o"])) == [(1, "u", 3, "a"), (2, "v", None, None), (None, "w", None, None)]
    assert pairs.fk_left_join(base, right, "k", "id", "r").count() == 4
    t = pairs.triplets(spark.createDataFrame([(1, 2), (3, 4)], "a int, b int"), spark.createDataFrame([(7,), (8,), (9,)], "id int"), 2)
    assert all(len(r.negatives) == 2 and set(r.negatives) <= {7, 8, 9} for r in t.collect())
    assert pairs.explode_triplets(t).count() == 6 and pairs.one_negative(t, 3).count() == 2


def test_federated_algebra(spark):
    w = spark.createDataFrame([("a", "h", 0, 1.0), ("b", "h", 0, 4.0)], "client string, layer string, idx int, value double")
    n = spark.createDataFrame([("a", 2), ("b", 1)], "client string, n int")
    assert rows(federated.fedavg(w, n)) == [("h", 0, 2.0)]
    rowsdf = spark.createDataFrame([("a", x / 10, int(x > 5)) for x in range(10)] * 5, "client string, x double, y int")
    got = {r.idx: r.value for r in federated.train_logistic(rowsdf, ["x"], "y", steps=30, rate=3.0).collect()}
    assert got[0] > 0 > got[1]
    p = spark.createDataFrame([(1, "a", 0.1, 0, 0.9), (1, "a", 0.1, 1, 0.1), (1, "b", 0.5, 0, 0.0), (1, "b", 0.5, 1, 1.0)], "sample int, client string, outlier double, class int, prob double")
    assert (rows(federated.vote(p, 1)), rows(federated.vote(p, 2))) == ([(1, 0)], [(1, 1)])


def test_texts(spark):
    c = spark.createDataFrame([(1, "db", "t", "b", ["x", None, "x", "y"]), (1, "db", "t", "a", None)], "db int, name string, table_name string, column_name string, samples array<string>")
    assert serialize.schema_text(c).first().text == "Database Name: db\nTable: t\n - a, Samples: [N/A]\n - b, Samples: [x|y]"
    one = spark.range(1)
    assert one.select(serialize.camel_split(F.lit("HTTPServerName"))).first()[0] == "HTTP Server Name"
    assert one.select(serialize.byte_size(F.lit(1536))).first()[0] == "1.50 KB"
    assert one.select(knowledge.clean_value(F.lit(" A--b&nbsp;c "))).first()[0] == "a b c"
    assert one.select(knowledge.clean_value(F.lit("Other (unknown)"))).first()[0] is None and one.select(knowledge.clean_value(F.lit("N/A"))).first()[0] == "n a"


def test_reports(spark):
    w = spark.createDataFrame([(1, 0.5, 0.6), (2, 0.5, None), (3, 0.7, 0.7)], "pair_id int, solo double, fed double")
    assert rows(report.improvements(w, ["fed"], "solo")) == [("fed", 2, 1, 0.5)]
    assert rows(report.worst_client(spark.createDataFrame([(1, float("nan")), (1, 0.5)], "k int, x double"), ["k"], "x")) == [(1, 0.0)]


def test_ranges_and_slices_number_like_one_task(spark, monkeypatch):
    monkeypatch.setattr(encode, "ROWS", 7)
    g = random.Random(6)
    data = [(g.randrange(2), round(g.random(), 2)) for _ in range(120)] + [(None, 0.5), (1, None)]
    s = spark.createDataFrame(data, "y int, score double")
    held = [(y, x) for y, x in data if y is not None and x is not None]
    got = {r.score: (r.tp, r.fp) for r in metrics.curve(s).collect()}
    assert got == {x: (sum(y for y, z in held if z >= x), sum(1 - y for y, z in held if z >= x)) for _, x in held}
    codes = encode.dictionary(spark.range(50).select(F.concat(F.lit("v"), F.lpad("id", 3, "0")).alias("v")), "v")
    assert rows(codes) == [(f"v{i:03d}", i) for i in range(50)]
    df = spark.range(90).withColumn("g", F.when(F.col("id") % 3 == 0, F.lit("a")))
    at = encode.position(df, ["g"], [F.col("id"), F.lit(1)])
    assert sorted(r.pos for r in at.filter("g is null").collect()) == list(range(60)) and sorted(r.pos for r in at.filter("g = 'a'").collect()) == list(range(30))
    by = [r.id for r in at.filter("g = 'a'").orderBy("pos").collect()]
    assert by == sorted(by, key=lambda i: hashlib.md5(f"{i}|1".encode()).hexdigest())
    tasks = spark.range(40).select(F.col("id").alias("task"), F.lit(5).alias("failures"))
    tried = pairs.attempts(tasks, tasks.filter("task < 10"), 4)
    assert tried.count() == 90 and tried.filter("attempt = 3").select("status").distinct().first()[0] == "given up" and rows(tried.filter("task in (10, 21) and attempt = 1"), "task", "wave", "slot") == [(10, 0, 0), (21, 2, 3)]


def test_join_chain_skips_and_renames(spark):
    a = spark.createDataFrame([(1, 7, "x"), (2, 8, None), (3, None, "z")], "k int, c int, name string")
    b = spark.createDataFrame([(7, "b7"), (8, "b8")], "c int, name string")
    one = spark.createDataFrame([(7, 1), (7, 2)], "c int, other int")
    keys = [("a", "c", "b", "c"), ("one", "c", "a", "c"), ("b", "name", "a", "other")]
    assert pairs.joinable(["k", "c", "name"], "b", ["c", "name"], keys, ["a"]) == ["c"] and pairs.joinable(["k"], "b", ["c"], keys, ["a"]) == []
    out = pairs.join_chain({"a": a, "b": b, "one": one, "lonely": one.toDF("q", "r")}, keys, "a")
    assert out.columns == ["c", "k", "name", "name_b"] and rows(out, "k", "name_b") == [(1, "b7"), (2, "b8"), (3, None)]
    assert rows(pairs.join_chain({"b": b, "a": a}, keys, None, 2), "k") == rows(pairs.join_chain({"b": b, "a": a}, keys, "a", 2), "k") and pairs.join_chain({"a": a.limit(0), "b": b}, keys, "a").count() == 0


def test_union_schema_and_labels(spark):
    u = pairs.union_schema({"p": spark.createDataFrame([(1.5, None)], "Acct_Bal double, x int"), "q": spark.createDataFrame([(2,)], "X int")})
    assert [tuple(r) for r in u.orderBy("party").collect()] == [("p", 1.5, 0.0, [True, True]), ("q", 0.0, 2.0, [False, True])]
    with pytest.raises(ValueError):
        pairs.complete_labels(spark.createDataFrame([(None,)], "y int"), spark.createDataFrame([(1,)], "y int"), "y")
    with pytest.raises(ValueError):
        encode.class_labels(spark.createDataFrame([("a",), (None,)], "y string"), "y", False)
    df = spark.createDataFrame([(float("inf"), None), (float("nan"), "t"), (None, "u")], "x double, t string")
    assert rows(encode.filled(df, ["x"], ["t"])) == [(0.0, "__MISSING__"), (0.0, "t"), (0.0, "u")]
    assert encode.target_column(["a", "Gene_Kind", "z"]) == "Gene_Kind" and encode.target_column(["a", "z"]) == "z"
    counts = spark.createDataFrame([(1, "t", "Pay_Status", "a", 6), (1, "t", "Pay_Status", "b", 4), (1, "t", "status", "a", 99), (2, "t", "payStatus", None, 50)], "db int, table_name string, column_name string, value string, n int")
    assert rows(pairs.shared_labels(counts, ["pay_status", "x"])) == [(1, "t", "Pay_Status", 10, 2)]


def test_negatives_and_triplets_of_tables(spark):
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id long")
    t = spark.createDataFrame([(1, 2), (3, 9)], "anchor long, positive long")
    assert rows(pairs.full_negatives(t, ids)) == [(1, 2, 3), (1, 2, 4), (3, 9, 1), (3, 9, 2), (3, 9, 4)]
    tables = spark.createDataFrame([(f"t{i}", i % 2 == 0, i == 1) for i in range(9)], "table_id string, valid_vertical boolean, valid_horizontal boolean")
    got = pairs.table_triplets(tables, 4).collect()
    assert len(got) == 20 and all(r.split == "vertical" and r.negative != r.table_id and int(r.negative[1]) % 2 == 0 for r in got) and {r.side for r in got} == {"first", "second"}


def test_common_neighbours_and_cached_vectors(spark):
    g = random.Random(3)
    links = {(min(a, b), max(a, b)) for a, b in ((g.randrange(14), g.randrange(14)) for _ in range(60)) if a != b} | {(0, i) for i in range(1, 14)}
    near = {i: {b for a, b in links if a == i} | {a for a, b in links if b == i} for i in range(14)}
    want = [(a, b, len(near[a] & near[b])) for a, b in links if near[a] & near[b]]
    got = graph.common_neighbours(spark.createDataFrame([*links, *list(links)[:4], (5, 5)], "src long, tgt long"))
    assert rows(got) == rows(spark.createDataFrame(want, "a long, b long, n long"))
    cols = "db int, tab string, col string, place int"
    cache = spark.createDataFrame([(1, "t", "a", 0), (1, "t", "b", 1), (1, "u", "a", 0)], cols).withColumn("v", F.array(F.lit(1.0)))
    now = spark.createDataFrame([(1, "t", "a", 5), (1, "t", "b", 9), (1, "u", "a", 0), (1, "u", "c", 1), (2, "t", "a", 0)], cols)
    assert rows(vector.cached_vectors(cache, now), "db", "tab", "col", "hit") == [(1, "t", "a", True), (1, "t", "b", True), (1, "u", "a", False), (1, "u", "c", False), (2, "t", "a", False)]
