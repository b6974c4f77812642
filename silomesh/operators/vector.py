"""Vector and similarity operators.

Vectors are arrays of doubles.  All-pairs operators state their query set, all vectors, and work on it in blocks; searches at
scale are the business of an index.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silomesh.runtime import Workspace


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, although ``use`` names it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def unit(v: Column) -> Column:
    """The vector divided by its length (V1); null for null and all-zero vectors."""
    return bound(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)))


def _products(vectors: DataFrame, kernel: Callable, schema: str, extra: Sequence[str] = (), block: int = 2048) -> DataFrame:
    """The rows that ``kernel(left, right, similarities, same)`` gives for each unordered pair of blocks of (id, v, extra...).

    Vectors are cut into numbered blocks and each pair of blocks is one matrix product in one task; ``same`` tells that a
    block meets itself.  A kernel keeps what can still matter, so what leaves a task isn't quadratic unless the result is.
    """
    usable = vectors.select("id", *extra, unit(F.col("v")).alias("u")).filter("u is not null")
    n_blocks = max(1, math.ceil(usable.count() / block))
    mine = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("o")
    placed = usable.withColumn("b", mine).select("*", other).select("id", *extra, "u", "b", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"))
    names = [c.split()[0] for c in schema.split(", ")]

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf["bi"].iloc[0] == pdf["bj"].iloc[0]
        first = (pdf["b"] == pdf["bi"]).to_numpy()
        left, right = (pdf, pdf) if same else (pdf[first], pdf[~first])
        if not len(left) or not len(right):
            return pd.DataFrame({n: [] for n in names})  # an empty block has no products
        return kernel(left, right, np.stack(left["u"].to_numpy()) @ np.stack(right["u"].to_numpy()).T, same)[names]

    return placed.groupBy("bi", "bj").applyInPandas(product, schema)


def similarity_join(vectors: DataFrame, t: float, inclusive: bool = False, block: int = 2048) -> DataFrame:
    """(src, tgt, similarity) of all pairs src < tgt of (id, v) with a cosine above ``t``."""

    def kernel(left, right, s, same):
        i, j = np.nonzero(s >= t if inclusive else s > t)
        a, c = left["id"].to_numpy()[i], right["id"].to_numpy()[j]
        keep = a < c if same else a != c
        return pd.DataFrame({"src": np.minimum(a, c)[keep], "tgt": np.maximum(a, c)[keep], "similarity": s[i, j][keep]})

    return _products(vectors, kernel, "src long, tgt long, similarity double", block=block)


def _best(rows: pd.DataFrame, cols: pd.DataFrame, s: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` largest of each row of ``s``, and all that tie with the last; -3 marks what doesn't count."""
    bar = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -2.0)
    i, j = np.nonzero(s >= np.maximum(bar, -2.0)[:, None])
    return pd.DataFrame({"src": rows["id"].to_numpy()[i], "tgt": cols["id"].to_numpy()[j], "similarity": s[i, j]})


def nearest(vectors: DataFrame, k: int, apart: str | None = None, block: int = 2048) -> DataFrame:
    """(src, tgt, similarity, rank) of the ``k`` most similar others of each vector, ties by the smaller id.

    With ``apart`` only vectors with another value in that column count.  Each product keeps the best ``k`` of its rows and
    columns, so a vector's candidates are at most ``k`` for each block (and ties).
    """

    def kernel(left, right, s, same):
        own = left["id"].to_numpy()[:, None] == right["id"].to_numpy()[None, :]
        if apart:
            own |= left[apart].to_numpy()[:, None] == right[apart].to_numpy()[None, :]
        s = np.where(own, -3.0, s)
        parts = [_best(left, right, s, k)] + ([] if same else [_best(right, left, s.T, k)])
        return pd.concat(parts, ignore_index=True)

    some = _products(vectors, kernel, "src long, tgt long, similarity double", [apart] if apart else [], block)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("similarity"), "tgt"))).filter(F.col("rank") <= k)


def knn(vectors: DataFrame, k: int, symmetric: bool = True) -> DataFrame:
    """(src, tgt, similarity) of the ``k`` most similar other vectors of each.

    ``symmetric=False`` keeps only src < tgt, which loses neighbours that only the larger id has.
    """
    top = nearest(vectors, k).drop("rank")
    if not symmetric:
        return top.filter("src < tgt")
    return top.groupBy(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt")).agg(F.max("similarity").alias("similarity"))


def closest_to(vectors: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """The ``k`` vectors most similar to one given vector (V5)."""
    q = np.asarray(query, float)
    q = q / np.linalg.norm(q)
    s = dot(unit(F.col("v")), F.array(*map(F.lit, q.tolist())))
    return vectors.select("id", s.alias("similarity")).orderBy(F.desc("similarity"), "id").limit(k)


def pair_cosine(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, similarity) of given pairs; pairs with a missing vector are dropped."""
    u = vectors.select("id", unit(F.col("v")).alias("u"))
    met = pairs.join(u.select(F.col("id").alias("a"), F.col("u").alias("x")), "a").join(u.select(F.col("id").alias("b"), F.col("u").alias("y")), "b")
    return met.withColumn("similarity", dot(F.col("x"), F.col("y"))).drop("x", "y")


def column_scores(columns: DataFrame, least: float) -> DataFrame:
    """(t1, c1, t2, c2, similarity) of the column pairs (tab, col, v) of different tables, t1 < t2, with a cosine above
    ``least`` (P5)."""
    named = columns.withColumn("id", F.xxhash64("tab", "col"))
    end = lambda c, n: named.select(F.col("id").alias(c), F.col("tab").alias(f"t{n}"), F.col("col").alias(f"c{n}"))
    met = similarity_join(named.select("id", "v"), least).join(end("src", "a"), "src").join(end("tgt", "b"), "tgt").filter("ta <> tb")
    first = F.col("ta") < F.col("tb")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return met.select(pick("ta", "tb").alias("t1"), pick("ca", "cb").alias("c1"), pick("tb", "ta").alias("t2"), pick("cb", "ca").alias("c2"), "similarity")


def best_weighted_match(columns: DataFrame, idf: DataFrame, block: int = 2048) -> DataFrame:
    """(t1, t2, c1, c2, score): the column pair with the largest min(idf) x cosine of each table pair (V7).

    A column without an idf has 1.  Each product keeps the best of its table pairs only.
    """
    named = columns.join(idf, "col", "left").select(F.xxhash64("tab", "col").alias("id"), "tab", "col", F.coalesce("idf", F.lit(1.0)).alias("idf"), "v")

    def kernel(left, right, s, same):
        left, right = left.reset_index(drop=True), right.reset_index(drop=True)
        lo, ro = np.argsort(left["tab"].to_numpy(), kind="stable"), np.argsort(right["tab"].to_numpy(), kind="stable")
        left, right = left.iloc[lo], right.iloc[ro]
        score = s[np.ix_(lo, ro)] * np.minimum(left["idf"].to_numpy()[:, None], right["idf"].to_numpy()[None, :])
        lt, rt = left["tab"].to_numpy(), right["tab"].to_numpy()
        ls, rs = (np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) for t in (lt, rt))
        top = np.maximum.reduceat(np.maximum.reduceat(score, rs, axis=1), ls, axis=0)
        whole = np.repeat(np.repeat(top, np.diff(np.r_[ls, len(lt)]), axis=0), np.diff(np.r_[rs, len(rt)]), axis=1)
        i, j = np.nonzero((score == whole) & (lt[:, None] != rt[None, :]))
        swap = lt[i] > rt[j]
        pick = lambda x, y: np.where(swap, y, x)
        lc, rc = left["col"].to_numpy()[i], right["col"].to_numpy()[j]
        return pd.DataFrame({"t1": pick(lt[i], rt[j]), "t2": pick(rt[j], lt[i]), "c1": pick(lc, rc), "c2": pick(rc, lc), "score": score[i, j]})

    found = _products(named, kernel, "t1 string, t2 string, c1 string, c2 string, score double", ["tab", "col", "idf"], block)
    best = F.max_by(F.struct("c1", "c2", "score"), F.struct("score", "c1", "c2"))
    return found.groupBy("t1", "t2").agg(best.alias("m")).select("t1", "t2", "m.*")


def greedy_match(scores: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """One-to-one pairs (groups..., a, b, score) taken in falling score, ties by a then b.

    A pair that comes first for both of its ends is taken in any order of work, so each round takes all such pairs and
    drops what they use; the rounds end when nothing is left.  No group is gathered in one task.
    """
    groups = list(groups)
    work = Workspace(scores.sparkSession, "greedy")
    rank = F.struct((-F.col("score")).alias("s"), "a", "b")
    left, taken = work.write(scores.select(*groups, "a", "b", "score")), None
    while not left.isEmpty():
        first = lambda end: left.groupBy(*groups, end).agg(F.min(rank).alias("m")).select(*groups, "m.a", "m.b", (-F.col("m.s")).alias("score"))  # noqa: E731,B023
        both = work.write(first("a").join(first("b"), [*groups, "a", "b", "score"]))
        taken = both if taken is None else taken.unionByName(both)
        rest = work.write(left.join(both.select(*groups, "a"), [*groups, "a"], "left_anti").join(both.select(*groups, "b"), [*groups, "b"], "left_anti"))
        work.drop(left)
        left = rest
    return left.select(*groups, "a", "b", "score") if taken is None else taken.select(*groups, "a", "b", "score")


def hashed_ngrams(text: Column, dims: int = 64, n: int = 3) -> Column:
    """A deterministic text vector: counts of hashed character n-grams, unit length."""
    t = F.lower(text)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - (n - 1))), lambda i: F.pmod(F.conv(F.substring(F.md5(F.substr(t, i, F.lit(n))), 1, 8), 16, 10).cast("bigint"), F.lit(dims)).cast("int"))
    counts = lambda g: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda s: F.size(F.filter(g, lambda x: x == s)).cast("double"))
    return bound(grams, lambda g: bound(counts(g), unit))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets (V12); 0 when both are empty."""
    u = F.size(F.array_union(a, b))
    return F.when(u > 0, F.size(F.array_intersect(a, b)) / u).otherwise(0.0)


def hellinger(p: Column, q: Column) -> Column:
    """Distance of two distributions given as maps (V14, R4); 0 when both are empty."""
    keys = F.array_union(F.map_keys(p), F.map_keys(q))
    gap = lambda k: F.pow(F.sqrt(F.coalesce(F.try_element_at(p, k), F.lit(0.0))) - F.sqrt(F.coalesce(F.try_element_at(q, k), F.lit(0.0))), F.lit(2.0))
    return F.sqrt(F.aggregate(keys, F.lit(0.0), lambda s, k: s + gap(k))) / math.sqrt(2)


def graph_distance(one: set, two: set, budget: int | None = None) -> tuple[int, bool]:
    """The edit distance of two directed graphs given as sets of edges, and whether the search came to its end.

    Nodes have no labels and every insertion or deletion costs 1, so a best edit maps all nodes of the smaller graph and the
    distance is nodes + edges of both less what the mapping shares.  The search maps nodes from the best linked down, drops
    branches that can't share more edges than the best mapping so far, and tries nodes with equal neighbours once.  With a
    ``budget`` of steps it stops there with the distance of the best mapping found.
    """
    graphs = []
    for e in (one, two):
        names = {x: i for i, x in enumerate(sorted({x for p in e for x in p}, key=str))}
        out, into = [set() for _ in names], [set() for _ in names]
        for a, b in e:
            out[names[a]].add(names[b])
            into[names[b]].add(names[a])
        graphs.append((out, into, len(e)))
    graphs.sort(key=lambda g: len(g[0]))
    (o1, i1, e1), (o2, i2, e2) = graphs
    n1, n2 = len(o1), len(o2)
    degree = lambda o, i, v: len(o[v]) + len(i[v])
    order = sorted(range(n1), key=lambda v: (-degree(o1, i1, v), v))
    at = {v: k for k, v in enumerate(order)}
    ahead = [0] * (n1 + 1)  # edges of the smaller graph that a depth has yet to decide
    for a in range(n1):
        for b in o1[a]:
            ahead[max(at[a], at[b])] += 1
    for k in range(n1 - 1, -1, -1):
        ahead[k] += ahead[k + 1]
    fit = lambda x, y: sum(min(a, b) for a, b in zip(sorted(map(len, x), reverse=True), sorted(map(len, y), reverse=True)))
    most = min(e1, e2, fit(o1, o2), fit(i1, i2))
    to, used, best, steps = {}, set(), -1, 0

    def gain(v: int, w: int) -> int:
        shared = sum(to.get(x) in o2[w] for x in o1[v] if x != v and x in to) + sum(to.get(x) in i2[w] for x in i1[v] if x != v and x in to)
        return shared + (v in o1[v] and w in o2[w])

    def choices(depth: int) -> Iterator[tuple[int, int]]:
        v, seen, found = order[depth], set(), []
        for w in range(n2):
            if w not in used:
                kind = (frozenset(o2[w] - {w}), frozenset(i2[w] - {w}), w in o2[w])
                if kind not in seen:
                    seen.add(kind)
                    found.append((gain(v, w), -abs(degree(o1, i1, v) - degree(o2, i2, w)), -w))
        return iter([(g, -w) for g, _, w in sorted(found, reverse=True)])

    stack, shared = [choices(0)] if n1 else [], 0
    best = 0 if not n1 else best
    path: list[tuple[int, int]] = []
    while stack and best < most and (budget is None or steps < budget or best < 0):
        nxt = next(stack[-1], None)
        if nxt is None:
            stack.pop()
            if path:
                g, w = path.pop()
                shared -= g
                used.discard(w)
                del to[order[len(path)]]
            continue
        steps += 1
        g, w = nxt
        depth = len(path)
        if shared + g + ahead[depth + 1] <= best:
            continue
        path.append((g, w))
        shared += g
        used.add(w)
        to[order[depth]] = w
        if depth + 1 == n1:
            best = max(best, shared)
            stack.append(iter(()))
        else:
            stack.append(choices(depth + 1))
    return n2 - n1 + e1 + e2 - 2 * best, not stack or best >= most


def edit_distance(edges: DataFrame, budget: int | None = 20_000) -> DataFrame:
    """(pair, distance, exact) of two directed graphs given as (pair, side, a, b) edges.

    ``exact`` is false where the search used up its ``budget`` of steps; the distance is then that of the best edit found.
    Without a budget every distance is exact, but as the problem is NP-hard that may take forever on large graphs.
    """

    def distance(pdf: pd.DataFrame) -> pd.DataFrame:
        held = pdf[pdf["a"].notna() & pdf["b"].notna()]
        sides = [set(zip(*(held.loc[held["side"] == s, c] for c in ("a", "b")))) for s in (0, 1)]
        found, exact = graph_distance(*sides, budget)
        return pd.DataFrame({"pair": [pdf["pair"].iloc[0]], "distance": [float(found)], "exact": [exact]})

    return edges.groupBy("pair").applyInPandas(distance, f"pair {dict(edges.dtypes)['pair']}, distance double, exact boolean")


def pair_scores(predicted: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of precision, recall and F1 of predicted pairs (a, b) against all pairs of one group (id, grp).

    The true pairs are counted from the group sizes, not listed.
    """
    pairs = predicted.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    end = lambda c: groups.select(F.col("id").alias(c), F.col("grp").alias(f"g{c}"))
    hit = pairs.join(end("a"), "a").join(end("b"), "b").agg(F.count("*").alias("n_predicted"), F.count_if(F.col("ga") == F.col("gb")).alias("n_hit"))
    true = groups.groupBy("grp").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("bigint").alias("n_true"))
    ratio = lambda x, y: F.coalesce(F.col(x) / F.nullif(y, F.lit(0)), F.lit(0.0))
    return hit.join(F.broadcast(true)).withColumns({"precision": ratio("n_hit", F.col("n_predicted")), "recall": ratio("n_hit", F.col("n_true")), "f1": ratio("n_hit", (F.col("n_predicted") + F.col("n_true")) / 2)})


def cached_vectors(cache: DataFrame, columns: DataFrame) -> DataFrame:
    """(db, tab, col, v, hit): vectors of asked columns (db, tab, col, place) from a cache (db, tab, col, place, v).

    A table's cached vectors are valid only if its ordered column list is the same now; otherwise all of its columns miss.
    """
    names = lambda df: df.groupBy("db", "tab").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "col"))), lambda s: s["col"]), "|")).alias("names"))
    valid = names(cache).join(names(columns), ["db", "tab", "names"]).select("db", "tab")
    held = cache.join(valid, ["db", "tab"], "left_semi").select("db", "tab", "col", "v")
    return columns.select("db", "tab", "col").join(held, ["db", "tab", "col"], "left").withColumn("hit", F.col("v").isNotNull())


def embedded_clusters(vectors: DataFrame, k: int, dims: int = 2, seed: int = 1) -> DataFrame:
    """(id, cluster, x array): vectors projected to ``dims`` principal components and their k-means cluster there.

    Both models are fitted on all vectors by sums over partitions; rows without a vector are left out.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    held = vectors.filter("v is not null").select("id", array_to_vector("v").alias("v"))
    flat = PCA(k=dims, inputCol="v", outputCol="p").fit(held).transform(held)
    fitted = KMeans(k=k, featuresCol="p", predictionCol="cluster", seed=seed).fit(flat)
    return fitted.transform(flat).select("id", "cluster", vector_to_array("p").alias("x"))
