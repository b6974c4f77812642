"""Graph operators over (src, tgt, similarity) edges with src < tgt.

Nodes without edges exist only where a node list is given.  Repeated edges should be removed first (`collapse`).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from silomesh.operators.encode import token
from silomesh.runtime import Workspace


def above(edges: DataFrame, t: float, inclusive: bool = True) -> DataFrame:
    """Edges at or above (F1), or strictly above (F2), a similarity."""
    return edges.filter(F.col("similarity") >= t if inclusive else F.col("similarity") > t)


def mirrored(edges: DataFrame) -> DataFrame:
    """Every edge in both directions (G1)."""
    keep = [c for c in edges.columns if c not in ("src", "tgt")]
    both = F.array(F.struct(F.col("src").alias("src"), F.col("tgt").alias("tgt")), F.struct(F.col("tgt").alias("src"), F.col("src").alias("tgt")))
    return edges.select(F.inline(both), *keep)


def collapse(edges: DataFrame) -> DataFrame:
    """One edge for each unordered pair with the mean similarity; self loops go."""
    return edges.filter("src <> tgt").groupBy(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt")).agg(F.avg("similarity").alias("similarity"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) of nodes with an edge."""
    return edges.select(F.explode(F.array("src", "tgt")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def threshold_sweep(edges: DataFrame, thresholds: Sequence[float], n_nodes: int) -> DataFrame:
    """Edges, mean degree and covered nodes at each threshold.

    One pass: an edge counts for all thresholds up to its own, so edges and each node's largest similarity are added up
    per step and accumulated over the short list of thresholds.
    """
    ts = sorted(thresholds)
    step = lambda s: sum(((s >= t).cast("int") for t in ts[1:]), (s >= ts[0]).cast("int"))
    by_step = edges.groupBy(step(F.col("similarity")).alias("step")).agg(F.count("*").alias("n_edges"))
    best = edges.select(F.explode(F.array("src", "tgt")).alias("id"), "similarity").groupBy("id").agg(F.max("similarity").alias("s"))
    nodes = best.groupBy(step(F.col("s")).alias("step")).agg(F.count("*").alias("n_nodes"))
    spark = edges.sparkSession
    wanted = spark.createDataFrame([(i + 1, float(t)) for i, t in enumerate(ts)], "at int, threshold double")
    parts = by_step.join(nodes, "step", "full").fillna(0)
    out = wanted.join(parts, F.col("step") >= F.col("at"), "left").groupBy("threshold").agg(F.coalesce(F.sum("n_edges"), F.lit(0)).alias("n_edges"), F.coalesce(F.sum("n_nodes"), F.lit(0)).alias("n_nodes"))
    return out.select("threshold", "n_edges", (2 * F.col("n_edges") / n_nodes).alias("avg_degree"), (100 * F.col("n_nodes") / n_nodes).alias("coverage"))


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, component) by least-label propagation with pointer jumping (G3, G4, G5); ids with an edge only.

    Each round takes the least label among a node and its neighbours, then the label of that label; the rounds grow with
    the logarithm of the diameter.  A round is written to the shared folder, the loop ends when no label changes.
    """
    work = Workspace(edges.sparkSession, "components")
    links = work.write(mirrored(edges.select("src", "tgt").filter("src <> tgt")).distinct())
    if links.isEmpty():
        return links.select(F.col("src").alias("id"), F.col("tgt").alias("component"))
    labels = work.write(links.groupBy("src").agg(F.least(F.col("src"), F.min("tgt")).alias("label")).withColumnRenamed("src", "id"))
    for _ in range(max_rounds):
        seen = Observation()
        near = links.join(labels.withColumnRenamed("id", "tgt"), "tgt").groupBy("src").agg(F.min("label").alias("near"))
        least = labels.join(near, labels.id == near.src).select("id", F.col("label").alias("old"), F.least("label", "near").alias("m"))
        jump = labels.select(F.col("id").alias("m"), F.col("label").alias("jumped"))
        new = least.join(jump, "m", "left").select("id", "old", F.least("m", "jumped").alias("label")).observe(seen, F.count_if(F.col("label") != F.col("old")).alias("changed"))
        written = work.write(new.select("id", "label"))
        work.drop(labels)
        labels = written
        if not seen.get["changed"]:
            return labels.select("id", F.col("label").alias("component"))
    raise RuntimeError("components did not settle")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (id)."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("tgt")), "tgt", "left_semi")


def subgraph(edges: DataFrame, nodes: DataFrame, similarity: float = 1.0) -> DataFrame:
    """Mirrored induced edges; if there are none, the complete graph over the listed nodes.

    The fallback pairs are bounded by the node list, which a caller names one by one.
    """
    inner = mirrored(induced(edges, nodes).select("src", "tgt", "similarity"))
    some = inner.limit(1).select(F.lit(1).alias("some"))
    listed = nodes.agg(F.array_sort(F.collect_set("id")).alias("ids"))
    full = listed.select("ids", F.explode("ids").alias("src")).select("src", F.explode("ids").alias("tgt")).filter("src <> tgt").select("src", "tgt", F.lit(similarity).alias("similarity"))
    return inner.unionByName(full.join(some, F.lit(True), "left_anti"))


def different_component_probability(sizes: DataFrame) -> DataFrame:
    """One row: the chance that two different nodes lie in different components, from (size)."""
    total = sizes.agg(F.sum("size").alias("n"))
    same = sizes.join(F.broadcast(total)).select((F.col("size") / F.col("n") * ((F.col("size") - 1) / (F.col("n") - 1))).alias("p"))
    return same.agg((1 - F.sum("p")).alias("p_different"), F.count("*").alias("n_components"))


def propagate(edges: DataFrame, labels: DataFrame, alpha: float = 0.5, rounds: int = 5, r: float = 0.5) -> DataFrame:
    """(id, k, y): label propagation Y = alpha A Y + (1 - alpha) Y0 with A = D^(r-1) (A + I) D^(-r).

    ``labels`` is (id, k, y0) over all nodes; absent entries are 0.
    """
    work = Workspace(edges.sparkSession, "propagate")
    loops = labels.select("id").distinct()
    adjacency = mirrored(edges.select("src", "tgt")).unionByName(loops.select(F.col("id").alias("src"), F.col("id").alias("tgt")))
    deg = adjacency.groupBy("src").agg(F.count("*").alias("deg"))
    left, right = deg.select("src", F.pow("deg", F.lit(r - 1.0)).alias("ls")), deg.select(F.col("src").alias("tgt"), F.pow("deg", F.lit(-r)).alias("rs"))
    weights = work.write(adjacency.join(left, "src").join(right, "tgt").select("src", "tgt", (F.col("ls") * F.col("rs")).alias("w")))
    y = labels.select("id", "k", F.col("y0").alias("y"))
    for _ in range(rounds):
        spread = weights.join(y.withColumnRenamed("id", "tgt"), "tgt").groupBy(F.col("src").alias("id"), "k").agg((alpha * F.sum(F.col("w") * F.col("y"))).alias("moved"))
        new = spread.join(labels, ["id", "k"], "full").select("id", "k", (F.coalesce("moved", F.lit(0.0)) + (1 - alpha) * F.coalesce("y0", F.lit(0.0))).alias("y"))
        y = work.write(new)
    return y


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: modularity of (id, community) over unweighted undirected edges."""
    m = edges.agg(F.count("*").cast("double").alias("m"))
    inside = edges.join(labels.select(F.col("id").alias("src"), F.col("community").alias("c")), "src").join(labels.select(F.col("id").alias("tgt"), F.col("community").alias("o")), "tgt").filter("c = o").groupBy("c").agg(F.count("*").alias("inside"))
    total = degrees(edges).join(labels, "id").groupBy(F.col("community").alias("c")).agg(F.sum("degree").alias("deg"))
    parts = total.join(inside, "c", "left").join(F.broadcast(m))
    return parts.agg(F.sum(F.coalesce("inside", F.lit(0)) / F.col("m") - F.pow(F.col("deg") / (2 * F.col("m")), F.lit(2.0))).alias("modularity"), F.count("*").alias("n_communities"))


def louvain(edges: DataFrame, max_rounds: int = 1000, small: int = 1_000_000) -> DataFrame:
    """(id, community): multi-level Louvain (G6); communities are named by their least member.

    A level moves nodes to neighbouring communities until no move gains, then communities become nodes with added weights;
    the levels end when one moves nothing.  Levels of more than ``small`` directed links run as joins (`_settle`); as soon as
    a level has no more than that, one task of that bounded size does it and the rest node by node.
    """
    work = Workspace(edges.sparkSession, "louvain")
    links = work.write(mirrored(edges.select("src", "tgt")).groupBy("src", "tgt").agg(F.count("*").cast("double").alias("w")))
    labels = work.write(links.select(F.col("src").alias("id"), F.col("src").alias("community")).distinct())
    if labels.isEmpty():
        return labels
    while True:
        last = links.count() <= small
        if last:
            found = links.groupBy().applyInPandas(_louvain_levels, labels.schema)
        else:
            found, moved = _settle(work, links, max_rounds)
            if not moved:
                break
        found = work.write(found)
        labels = work.write(labels.join(found.select(F.col("id").alias("community"), F.col("community").alias("next")), "community").select("id", F.col("next").alias("community")))
        if last:
            break
        ends = [found.select(F.col("id").alias(c), F.col("community").alias(f"{c}_c")) for c in ("src", "tgt")]
        links = work.write(links.join(ends[0], "src").join(ends[1], "tgt").groupBy(F.col("src_c").alias("src"), F.col("tgt_c").alias("tgt")).agg(F.sum("w").alias("w")))
    names = labels.groupBy("community").agg(F.min("id").alias("name"))
    return labels.join(names, "community").select("id", F.col("name").alias("community"))


def _louvain_levels(pdf: pd.DataFrame) -> pd.DataFrame:
    """(id, community) of all levels over one table of directed weighted links, node by node in a seeded order."""
    ids, ends = np.unique(np.concatenate([pdf["src"], pdf["tgt"]]), return_inverse=True)
    links = pd.DataFrame({"s": ends[: len(pdf)], "t": ends[len(pdf) :], "w": pdf["w"].to_numpy()})
    label, two_m, rng = np.arange(len(ids)), float(pdf["w"].sum()), np.random.default_rng(1)
    while True:
        links = links.groupby(["s", "t"], as_index=False)["w"].sum()
        n = int(links["s"].max()) + 1
        at = np.searchsorted(links["s"], np.arange(n + 1)).tolist()
        near, weight, deg = links["t"].tolist(), links["w"].tolist(), links.groupby("s")["w"].sum().tolist()
        held, volume, order, moved = list(range(n)), list(deg), rng.permutation(n).tolist(), True
        while moved:
            moved = False
            for v in order:
                own, k = held[v], {}
                for i in range(at[v], at[v + 1]):
                    if near[i] != v:
                        k[held[near[i]]] = k.get(held[near[i]], 0.0) + weight[i]
                volume[own] -= deg[v]
                best, top = own, k.get(own, 0.0) - deg[v] * volume[own] / two_m
                for c, w in k.items():
                    if w - deg[v] * volume[c] / two_m > top + 1e-9:
                        best, top = c, w - deg[v] * volume[c] / two_m
                volume[best] += deg[v]
                held[v], moved = best, moved or best != own
        names, to = np.unique(held, return_inverse=True)
        if len(names) == n:
            return pd.DataFrame({"id": ids, "community": ids[np.unique(label, return_index=True)[1]][label]})
        label = to[label]
        links = pd.DataFrame({"s": to[links["s"]], "t": to[links["t"]], "w": links["w"]})


def _settle(work: Workspace, links: DataFrame, max_rounds: int) -> tuple[DataFrame, bool]:
    """(id, community) where no single move gains, and whether any node moved: one level of Louvain as joins.

    In each round every node finds its best neighbouring community, and of those that would gain a share drawn by hash moves.
    If the modularity doesn't rise by that, the round is taken back and a smaller share moves, at last only the best node,
    whose gain is certain.  So modularity rises with every round that is kept.
    """
    deg = work.write(links.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("deg")))
    two_m = deg.agg(F.sum("deg")).first()[0]
    apart = links.filter("src <> tgt")
    labels, kept, sure, thin, moved = deg.select("id", F.col("id").alias("community")), None, True, 1, False
    for i in range(max_rounds):
        seen = Observation()
        volume = labels.join(deg, "id").groupBy("community").agg(F.sum("deg").alias("vol"))
        to = apart.join(labels.select(F.col("id").alias("tgt"), "community"), "tgt").select("src", "community", "w")
        to = to.unionByName(labels.select(F.col("id").alias("src"), "community", F.lit(0.0).alias("w"))).groupBy("src", "community").agg(F.sum("w").alias("k_in"))
        here = labels.select(F.col("id").alias("src"), F.col("community").alias("own")).join(deg.withColumnRenamed("id", "src"), "src")
        own = F.col("community") == F.col("own")
        gain = to.join(here, "src").join(volume, "community").withColumn("score", F.col("k_in") - F.col("deg") * (F.col("vol") - F.when(own, F.col("deg")).otherwise(0)) / two_m)
        best = gain.groupBy("src", "own").agg(F.max_by(F.struct("community", "score"), F.struct("score", -F.col("community"))).alias("best"), F.max(F.when(own, F.col("score"))).alias("stay"), F.max(F.when(own, F.col("k_in") - F.col("deg") * F.col("vol") / two_m)).alias("q"))
        moves = best.select(F.col("src").alias("id"), F.col("own").alias("community"), F.col("best.community").alias("target"), (F.col("best.score") - F.col("stay")).alias("gain"), "q").withColumn("wants", F.col("gain") > 1e-9)
        new = work.write(moves.observe(seen, F.sum("q").alias("q"), F.count_if("wants").alias("n"), F.max(F.struct("gain", "id")).alias("top")))
        got = seen.get
        if kept is None or sure or got["q"] > kept[1]["q"]:
            if kept:
                work.drop(kept[0])
                moved, thin = True, max(1, thin - 1)
            kept = (new, got)
        else:
            work.drop(new)
            thin += 1
        table, state = kept
        if not state["n"]:
            return table.select("id", "community"), moved
        sure = 2**thin > state["n"]
        chosen = F.col("id") == state["top"]["id"] if sure else F.pmod(F.xxhash64("id", F.lit(i)), F.lit(2**thin)) == 0
        labels = table.select("id", F.when(F.col("wants") & chosen, F.col("target")).otherwise(F.col("community")).alias("community"))
    raise RuntimeError("communities did not settle")


def compare_edges(left: DataFrame, right: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """One row that compares two edge sets as unordered pairs (J24): common, one-sided, equal within the tolerance."""
    norm = lambda e, name: e.groupBy(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")).agg(F.max("similarity").alias(name))
    both = norm(left, "x").join(norm(right, "y"), ["a", "b"], "full")
    common = F.col("x").isNotNull() & F.col("y").isNotNull()
    equal = common & (F.abs(F.col("x") - F.col("y")) < tolerance)
    return both.agg(F.count_if(common).alias("n_common"), F.count_if(F.col("y").isNull()).alias("only_left"), F.count_if(F.col("x").isNull()).alias("only_right"), F.count_if(equal).alias("n_equal"), F.coalesce(F.count_if(equal) / F.nullif(F.count_if(common), F.lit(0)), F.lit(0.0)).alias("match_rate"))


def common_neighbours(edges: DataFrame) -> DataFrame:
    """(src, tgt, n_shared) of linked nodes that share neighbours.

    Links point from the end with fewer links to the other, so the wedges that are looked at number at most the 1.5th power
    of the links, even at a hub; each closed one is a triangle and counts for its three sides.
    """
    work = Workspace(edges.sparkSession, "triangles")
    once = work.write(edges.select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt")).filter("src <> tgt").distinct())
    deg = degrees(once)
    of = lambda c: deg.select(F.col("id").alias(c), F.struct(F.col("degree"), F.col("id")).alias(f"r_{c}"))
    both = once.join(of("src"), "src").join(of("tgt"), "tgt")
    up = F.col("r_src") < F.col("r_tgt")
    ahead = work.write(both.select(F.when(up, F.col("src")).otherwise(F.col("tgt")).alias("a"), F.when(up, F.col("tgt")).otherwise(F.col("src")).alias("b")))
    wedges = ahead.join(ahead.withColumnRenamed("b", "c"), "a").filter("b < c")
    closed = wedges.join(once.select(F.col("src").alias("b"), F.col("tgt").alias("c")), ["b", "c"])
    side = lambda x, y: F.struct(F.least(x, y).alias("src"), F.greatest(x, y).alias("tgt"))
    return closed.select(F.inline(F.array(side("a", "b"), side("a", "c"), side("b", "c")))).groupBy("src", "tgt").agg(F.count("*").alias("n_shared"))


def attach(edges: DataFrame, properties: DataFrame, names: Sequence[str]) -> DataFrame:
    """Edges with properties of the unordered pair (src, tgt)."""
    pair = properties.groupBy(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt")).agg(*(F.max(n).alias(n) for n in names))
    return edges.join(pair, ["src", "tgt"], "left")


def grow_subgraphs(edges: DataFrame, component: DataFrame, size: int = 5, samples: int = 3, seed: int = 1, min_edges: int = 2) -> DataFrame:
    """(rank, component, start, sample, edges, density, id): random connected node sets over the whole graph (G12), ranked.

    Every node of ``component`` (id, component) starts ``samples`` sets.  In each round a set takes one node of its frontier,
    all nodes linked to a member with equal chance, by the least hash of set, round and node.  A set that can't reach ``size``
    or has fewer than ``min_edges`` edges doesn't count, equal sets count once, as their first draw.  Ranks go by density
    ascending, edges descending and size ascending; sets with the same of all three share one.  A round reads the links of all members.
    """
    work = Workspace(edges.sparkSession, "grow")
    links = work.write(mirrored(edges.select("src", "tgt").filter("src <> tgt")).distinct())
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(samples - 1).cast("long")))
    sets = work.write(component.select("component", F.col("id").alias("start"), numbers.alias("sample"), F.array("id").alias("held")))
    for step in range(1, size):
        front = sets.withColumn("src", F.explode("held")).join(links, "src").filter(~F.array_contains("held", F.col("tgt")))
        drawn = F.min_by("tgt", F.struct(token("start", "sample", "tgt", F.lit(seed), F.lit(step)).alias("h"), "tgt"))
        new = front.groupBy("component", "start", "sample", "held").agg(drawn.alias("new"))
        grown = work.write(new.select("component", "start", "sample", F.array_sort(F.concat("held", F.array("new"))).alias("held")))
        work.drop(sets)
        sets = grown
    once = work.write(sets.groupBy("held").agg(F.min(F.struct("start", "sample", "component")).alias("first")).select("first.*", "held"))
    pairs = once.select("start", "sample", "held", F.explode("held").alias("src")).select("start", "sample", "src", F.explode(F.filter("held", lambda x: x > F.col("src"))).alias("tgt"))
    inside = pairs.join(links, ["src", "tgt"], "left_semi").groupBy("start", "sample").agg(F.count("*").alias("edges"))
    density = F.col("edges") / F.lit(max(1.0, size * (size - 1) / 2))
    found = once.join(inside, ["start", "sample"], "left").withColumn("edges", F.coalesce("edges", F.lit(0))).filter(F.col("edges") >= min_edges)
    found = work.write(found.withColumns({"density": density, "size": F.size("held")}))
    kinds = found.groupBy("density", "edges", "size").agg(F.count("*").alias("n"))  # at most one for each number of edges
    before = Window.orderBy("density", F.desc("edges"), "size").rowsBetween(Window.unboundedPreceding, -1)
    ranks = kinds.select("density", "edges", "size", (1 + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("rank"))
    return found.join(F.broadcast(ranks), ["density", "edges", "size"]).select("rank", "component", "start", "sample", "edges", "density", F.explode("held").alias("id"))


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col("rank") <= k)
