"""Vector search, packing and mixing."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from silomesh.llm import forest, mixing, packing, ranks, setjoin, tokens


def brute_near(vectors, k, least, tie=1e-9):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], dtype=float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(ids)):
        bar = np.sort(s[i])[-k] if len(ids) > k else -2
        for j in np.flatnonzero((s[i] >= bar - tie) & (s[i] >= least) & (np.arange(len(ids)) != i)):
            out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def clouds(n, dims, seed):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(12, dims))
    return {i: (centres[i % 12] + g.normal(size=dims) * 0.45).astype(np.float32).tolist() for i in range(n)}


def test_neighbours_reach_the_true_ones(spark):
    v = clouds(600, 16, 1)
    v |= {1000 + i: v[0] for i in range(8)} | {1100 + i: v[5] for i in range(2)}
    data = list(v.items()) + [(2000, None), (2001, [1.0]), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (None, v[0]), (3, v[3])]
    df = spark.createDataFrame(data, "db long, e array<float>").withColumn("rep", F.lit(1)).withColumn("n", F.lit(1))
    near, members = forest.neighbours(df, "db", "e", dims=16, k=5, least=0.85, leaf=32, trees=8, extra=8)
    classes = near.select(F.least("q", "s").alias("a"), F.greatest("q", "s").alias("b")).distinct()
    got = {tuple(r) for r in setjoin.expand(classes, members.select("rec", "rep")).collect()}
    want = brute_near(v, 5, 0.85)
    assert len(got & want) / len(want) >= 0.97 and len(got - want) / len(got) <= 0.03


def test_one_leaf_is_exact(spark):
    v = clouds(120, 8, 2)
    near, members = forest.neighbours(spark.createDataFrame(list(v.items()), "db long, e array<float>"), "db", "e", dims=8, k=3)
    got = {tuple(sorted((r.q, r.s))) for r in near.collect()}
    assert got == brute_near(v, 3, -2.0)
    none, m = forest.neighbours(spark.createDataFrame([], "db long, e array<float>"), "db", "e")
    assert none.count() == 0 and m.count() == 0


def test_shared_queue_opens_the_own_leaves_first():
    g = np.random.default_rng(0)
    x = g.normal(size=(500, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    f = forest.fit_forest(x, 500, 3, 32)
    leaves, own = forest.search_leaves(f, x, 5)
    assert leaves.shape == (500, 8) and own[:, :3].all() and not own[:, 3:].any()
    assert all(len(set(row)) == 8 for row in leaves.tolist())
    sizes = np.bincount(leaves[:, 0])
    assert sizes.max() <= 3 * 32


def test_positions_are_dense(spark):
    df = spark.range(1000).select((F.col("id") % 2 == 0).alias("g"), "id").unionByName(spark.range(1000, 1300).select(F.lit(True), "id").toDF("g", "id"))
    got = ranks.positions(df, ["g"], ["id"], ranks.hash_slice(F.col("id"), 7))
    for flag, n in ((True, 800), (False, 500)):
        assert sorted(r.pos for r in got.filter(F.col("g") == flag).collect()) == list(range(n))


def packed(spark, sizes, caps):
    df = spark.createDataFrame(list(enumerate(sizes)), "doc long, n long").withColumn("bin", F.lit("clash"))
    return packing.pack(df, "doc", "n", caps).collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_packing_is_whole_and_within_capacity(spark, seed):
    g = np.random.default_rng(seed)
    sizes = [int(s) for s in np.clip(g.lognormal(4, 1.2, 800), 1, 5000)] + [0, 256, 256, 2500]
    got = packed(spark, sizes, [256, 1024, 2048])
    by_item, bins = {}, {}
    for r in got:
        by_item.setdefault(r.doc, []).append((r.start, r.size))
        bins.setdefault(r.bin, []).append(r)
    for i, n in enumerate(sizes):
        parts = sorted(by_item.get(i, []))
        assert sum(s for _, s in parts) == n and (n <= 2048) == (len(parts) <= 1)
        assert [p[0] for p in parts] == list(np.cumsum([0, *(s for _, s in parts)])[:-1]) if parts else n == 0
    for rs in bins.values():
        total, cap = sum(r.size for r in rs), rs[0].capacity
        assert total <= cap and cap == packing.shrink(total, [256, 1024, 2048])
    assert sum(sizes) / sum(rs[0].capacity for rs in bins.values()) > 0.97


def test_packing_edge_cases(spark):
    assert packed(spark, [], [10]) == [] and packed(spark, [0], [10]) == []
    assert [(r.size, r.capacity) for r in sorted(packed(spark, [25], [4, 10]), key=lambda r: r.piece)] == [(10, 10), (10, 10), (5, 10)]
    with pytest.raises(ValueError):
        packed(spark, [1], [])


def test_patterns_equal_item_by_item_best_fit():
    def plain(sizes, cap):
        bins = []
        for s in sorted(sizes, reverse=True):
            fit = [b for b in bins if cap - sum(b) >= s]
            if fit:
                max(fit, key=sum).append(s)
            else:
                bins.append([s])
        return sorted(sum(b) for b in bins)

    g = np.random.default_rng(5)
    for _ in range(5):
        sizes = g.integers(1, 60, 200).tolist()
        got = packing.pack_sizes({s: sizes.count(s) for s in set(sizes)}, [100])
        assert sorted(sum(s * n for s, n in p.contents) for p in got for _ in range(p.bins)) == plain(sizes, 100)


SIZED = "doc_id long, source string, n_tokens long"
TARGETS = "mix_name string, source string, target_share double, max_repeats int"


def test_mixing_shares_and_caps(spark):
    docs = [(i, "big", 10) for i in range(900)] + [(1000 + i, "mid", 20) for i in range(100)] + [(2000 + i, "tiny", 5) for i in range(10)] + [(3000, None, 9)]
    targets = [("m", "big", 0.5, 2), ("m", "mid", 0.4, 5), ("m", "tiny", 0.1, 3), ("m", "absent", 0.0, 1), ("n", "big", 1.0, 1), ("n", "none", 0.2, 2), (None, "big", None, 1)]
    sized, t = spark.createDataFrame(docs, SIZED), spark.createDataFrame(targets, TARGETS)
    got = mixing.mix(sized, t)
    copies = {r["source"]: r["count"] for r in got.filter("mix_name = 'm'").groupBy("source").count().collect()}
    total = 3 * 50 / 0.1  # the tiny source at its limit
    assert abs(copies["big"] - 0.5 * total / 10) <= 1 and abs(copies["mid"] - 0.4 * total / 20) <= 1 and copies["tiny"] == 30
    large = {r["source"]: r["count"] for r in mixing.mix(sized, t, 20000).filter("mix_name = 'm'").groupBy("source").count().collect()}
    assert abs(large["big"] - 1000) <= 1 and abs(large["mid"] - 400) <= 1 and large["tiny"] == 30
    most = got.groupBy("mix_name", "source", "doc_id").count().groupBy("source").agg(F.max("count").alias("m"), F.min("count").alias("l"))
    assert {r["source"]: r.m for r in most.collect()}["tiny"] == 3 and all(r.m <= 5 for r in most.collect())
    rep = {(r.mix_name, r["source"]): r for r in mixing.mix_report(got, sized, t).collect()}
    assert rep["m", "tiny"].at_limit and not rep["m", "big"].at_limit and rep["n", "none"].n_docs == 0
    assert sum(r.actual_share for k, r in rep.items() if k[0] == "m") == pytest.approx(1.0)
    assert mixing.mix(sized.limit(0), t).count() == 0 and mixing.mix(sized, t.limit(0)).count() == 0


def test_tokens_of_a_source_miss_their_share_by_one_document(spark):
    g = np.random.default_rng(4)
    size = lambda: int(np.clip(g.lognormal(4, 2), 1, 40000))
    docs = [(i, "abc"[i % 3] if i % 7 else "d", size()) for i in range(3000)]
    t = spark.createDataFrame([("m", "a", 0.07, 4), ("m", "b", 0.5, 4), ("m", "c", 0.23, 1), ("m", "d", 0.1, 2), ("m", "none", 0.1, 2)], TARGETS)
    sized = spark.createDataFrame(docs, SIZED)
    plan = {r["source"]: r for r in mixing.expected_copies(sized, t).collect()}
    used = {r["source"]: r for r in mixing.mix_report(mixing.mix(sized, t), sized, t).collect()}
    longest = {s: max(n for _, x, n in docs if x == s) for s in "abcd"}
    for s in "abcd":
        assert abs(used[s].n_tokens - plan[s].amount) <= longest[s]
        assert plan[s].attainable == pytest.approx({"a": 0.07, "b": 0.5, "c": 0.23, "d": 0.1}[s] / 0.9)
    assert used["none"].actual_share == 0 and sum(r.at_limit for r in used.values() if r["source"] != "none") == 1


def test_leaves_split_on_where_the_sample_ends(spark):
    v = clouds(1500, 16, 6)
    df = spark.createDataFrame(list(v.items()), "db long, e array<float>")
    near, _ = forest.neighbours(df, "db", "e", dims=16, k=5, least=0.85, leaf=32, trees=8, extra=8, sample=40)
    got = {tuple(sorted((r.q, r.s))) for r in near.collect()}
    want = brute_near(v, 5, 0.85)
    assert len(got & want) / len(want) >= 0.95 and len(got - want) / len(got) <= 0.05
    x = np.random.default_rng(1).normal(size=(700, 4))
    parts = list(forest.split_leaf(x, x[:50], 64, np.random.default_rng(0)))
    assert max(len(m) for m, _ in parts) <= 64 and {int(i) for _, q in parts for i in q} == set(range(50))
    same = list(forest.split_leaf(np.ones((300, 4)), np.ones((9, 4)), 64, np.random.default_rng(0)))
    assert all(len(m) <= 64 for m, _ in same)


def test_token_counts(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("<|endoftext|>",), ("word " * 20000,)], "text string")
    got = [r[0] for r in df.select(tokens.token_count("text")).collect()]
    assert got[:3] == [2, 0, 0] and got[3] > 1 and 20000 <= got[4] <= 20001


def test_query_set_of_neighbours_is_by_record(spark, tmp_path):
    from silomesh.llm.queries import QUERIES

    x = np.random.default_rng(3).normal(size=(12, 64)).astype("float32")
    vectors = {7: 0, 50: 0, 9: 1, **{100 + i: 1 for i in range(6)}, 150: 2, **{i: i for i in range(3, 7)}, **{i + 3: i for i in range(7, 12)}}
    df = spark.createDataFrame([(k, x[v].tolist()) for k, v in vectors.items()], "db_id long, embedding array<float>")
    df.write.parquet(str(tmp_path / "database_embeddings.parquet"))
    got = QUERIES["p6_neighbours"](spark, str(tmp_path)).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rep = {v: min(k for k in vectors if vectors[k] == v) for v in vectors.values()}
    for q in (50, 100, 150):
        by_cosine = sorted(((float(unit[vectors[q]] @ unit[v]), k) for k, v in vectors.items() if k != q), reverse=True)
        want = {rep[vectors[k]] for c, k in by_cosine if c >= by_cosine[4][0] - 1e-6}
        mine = [r for r in got if r.db_id == q]
        assert {r.near_class for r in mine} == want and {r.class_id for r in mine} == {rep[vectors[q]]}
        assert all(r.n_members == sum(rep[vectors[k]] == r.near_class for k in vectors if k != q) for r in mine)
    assert {r.db_id for r in got} == {50, 100, 150}
