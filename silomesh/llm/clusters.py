"""Grouping records into similarity clusters: hashed weighted features, k-means with parallel oversampled seeding.

``kmeans`` gives round clusters with their sizes and most typical members.  ``step_clusters`` gives clusters of any shape,
in which each member is within a fixed step of another.  k-means can't give these by itself, so its clusters carry the work:
points are summed up to small boxes, k-means divides the boxes into cells of about ``per_cell``, each cell is clustered in
one task with the boxes around it that a step could reach, and the parts found in neighbouring cells are joined where they
share a box.  What a box can't decide is searched in ever smaller boxes.  Hash-to-min then runs over the parts of cells, not
over points, so with one cell (k = 1) one task does all of the work and with more of them each does its share.

Points with a null, NaN or infinite coordinate and null ids are left out; copies of a point are one point; an empty table
gives no clusters; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silomesh.llm.components import hash_to_min
from silomesh.runtime import Workspace, is_nan


def _slot(name: str, dims: int, seed: int) -> tuple[int, int]:
    import zlib

    h = zlib.crc32(f"{seed}:{name}".encode())
    return h % dims, 1 if (h >> 16) & 1 else -1


def _token_slots(name: str, weight: float, dims: int) -> Column:
    """The slots of one token field: +weight or -weight for each of its elements."""
    held = F.coalesce(F.filter(F.col(name), lambda t: t.isNotNull()), F.array().cast("array<string>"))

    def share(i: Column, t: Column) -> Column:
        h = F.xxhash64(F.lit(name), t)
        return F.when(F.pmod(h, F.lit(dims)) != i, 0.0).when(F.pmod(F.shiftright(h, 40), F.lit(2)) == 0, weight).otherwise(-weight)

    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.aggregate(held, F.lit(0.0), lambda acc, t: acc + share(i, t)))


def hashed_features(numeric: Mapping[str, float], tokens: Mapping[str, float] | None = None, dims: int = 16) -> Column:
    """A dense feature vector of ``dims`` slots.

    A numeric field adds value x weight to the slot of its name, each element of a token field (array of strings) adds
    its weight to the slot of name and element; signs come from the hash.  The seed is the first that gives the numeric
    fields slots of their own, so distances over numeric fields alone are exact.  Null fields add nothing.
    """
    tokens = tokens or {}
    seed = next(s for s in range(10_000) if len(numeric) > dims or len({_slot(n, dims, s)[0] for n in numeric}) == len(numeric))
    parts: dict[int, list[Column]] = {}
    for name, weight in numeric.items():
        slot, sign = _slot(name, dims, seed)
        parts.setdefault(slot, []).append(F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * float(sign * weight))
    dense = F.array(*(sum(parts[i][1:], parts[i][0]) if i in parts else F.lit(0.0) for i in range(dims)))
    for name, weight in tokens.items():
        dense = F.zip_with(dense, _token_slots(name, float(weight), dims), lambda x, y: x + y)
    return dense


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest centre."""
    d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :], 0)
    i = d.argmin(1)
    return i, ((x - centres[i]) ** 2).sum(1)


def _stack(s: pd.Series) -> np.ndarray:
    return np.stack(s.to_numpy()).astype(float) if len(s) else np.zeros((0, 1))


def seed_centres(vectors: DataFrame, k: int, rounds: int = 3, oversample: float = 2.0, seed: int = 7) -> np.ndarray:
    """k-means|| : in each round every vector is drawn with a chance in proportion to its squared distance to the centres
    so far, about ``oversample * k`` of them; the draws, weighted by the vectors nearest to them, are reduced to k on the
    driver.  About ``oversample * k`` vectors of each round reach the driver.  Draws are hashes of the id, so a
    repeated run gives the same centres."""
    first = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(1).collect()
    if not first:
        return np.zeros((0, 0))
    centres = np.array([first[0]["x"]], dtype=float)
    for r in range(rounds):
        now = centres

        def distances(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"id": b["id"], "x": b["x"], "d": _nearest(_stack(b["x"]), now)[1] if len(b) else []})

        far = vectors.mapInPandas(distances, "id long, x array<double>, d double")
        total = far.agg(F.sum("d")).first()[0]
        if not total:
            break
        chance = F.col("d") * (oversample * k / total)
        draw = F.pmod(F.xxhash64("id", F.lit(seed + 1 + r)), F.lit(1 << 30)) / float(1 << 30)
        drawn = [row["x"] for row in far.filter(draw < chance).orderBy("id").select("x").collect()]
        if drawn:
            centres = np.unique(np.vstack([centres, np.array(drawn, dtype=float)]), axis=0)
    weight = np.zeros(len(centres))
    for row in assign(vectors, centres).groupBy("cell").agg(F.count("*").alias("n")).collect():
        weight[row["cell"]] = row["n"]
    rng, chosen = np.random.default_rng(seed), [int(weight.argmax())]
    while len(chosen) < min(k, len(centres)):
        d = _nearest(centres, centres[chosen])[1] * weight
        if d.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(centres), p=d / d.sum())))
    return centres[sorted(set(chosen))]


def assign(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, x, cell, d): the nearest centre of each vector and the squared distance to it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            i, d = _nearest(_stack(b["x"]), centres) if len(b) else ([], [])
            yield pd.DataFrame({"id": b["id"], "x": b["x"], "cell": i, "d": d})

    return vectors.mapInPandas(run, "id long, x array<double>, cell int, d double")


def lloyd(vectors: DataFrame, centres: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Move the centres to the means of their vectors; each task sends one partial sum for each centre."""

    for _ in range(rounds):
        now = centres

        def sums(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            total, n = np.zeros(now.shape), np.zeros(len(now))
            for b in batches:
                if len(b):
                    x = _stack(b["x"])
                    i, _ = _nearest(x, now)
                    np.add.at(total, i, x)
                    n += np.bincount(i, minlength=len(now))
            held = np.flatnonzero(n)
            yield pd.DataFrame({"cell": held.astype("int32"), "n": n[held], "total": [total[i].tolist() for i in held]})

        parts = vectors.mapInPandas(sums, "cell int, n double, total array<double>")
        rows = parts.select("cell", "n", F.posexplode("total")).groupBy("cell", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("s")).collect()
        new = centres.copy()
        for r in rows:
            new[r["cell"], r["pos"]] = r["s"] / r["n"]
        moved, centres = float(np.abs(new - centres).max(initial=0)), new
        if moved < 1e-9:
            break
    return centres


def kmeans(vectors: DataFrame, k: int, rounds: int = 4) -> np.ndarray:
    """Centres of at most ``k`` clusters of ``vectors`` (id long, x array<double>)."""
    centres = seed_centres(vectors, k)
    return lloyd(vectors, centres, rounds) if len(centres) else centres


def typical_members(members: DataFrame, cluster: str, member: str, coordinates: list[str], top: int = 5) -> DataFrame:
    """Size, centroid and the ``top`` members nearest the centroid of each cluster (ties by the smaller member).

    Each input partition first keeps its own nearest, so a huge cluster is never gathered in one task.
    """
    centre = members.groupBy(cluster).agg(F.count("*").alias("size"), *(F.avg(c).alias(f"c_{c}") for c in coordinates))
    gap = sum(((F.col(c) - F.col(f"c_{c}")) ** 2 for c in coordinates), F.lit(0.0))
    near = members.join(centre, cluster).select(cluster, member, "size", *(f"c_{c}" for c in coordinates), F.sqrt(gap).alias("gap"), F.pmod(F.xxhash64(member), F.lit(64)).alias("part"))
    order = [F.round("gap", 9), F.col(member)]
    few = near.withColumn("r", F.row_number().over(Window.partitionBy(cluster, "part").orderBy(*order))).filter(F.col("r") <= top)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy(cluster).orderBy(*order))).filter(F.col("r") <= top)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("r", member))), lambda m: m[member])
    return few.groupBy(cluster, "size", *(f"c_{c}" for c in coordinates)).agg(listed.alias("typical"))


FINE = 8  # boxes along the side of a grid cell, and along the side of a box that is cut again


def _blocks(boxes: DataFrame, centres: np.ndarray, step: float, radius: float) -> DataFrame:
    """Each box with its nearest cell and with every cell whose boxes may hold a point within ``step`` of one of its own.

    Say points p and q lie within ``step``, q's box has its nearest centre c, and boxes have ``radius`` at most.  By the
    middles of their boxes, d(p, c) <= d(q, c) + step + 2 radius <= d(q, c') + step + 2 radius <= d(p, c') + 2 step + 4 radius
    for p's nearest centre c'.
    """
    reach = 2 * step + 4 * radius + 1e-6
    names = [c for c in boxes.columns if c not in ("id", "x")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 2048):
                part = b.iloc[at : at + 2048]
                x = _stack(part["x"])
                d = np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :], 0))
                row, block = np.nonzero(d <= d.min(1, keepdims=True) + reach)
                yield part[names].iloc[row].assign(block=block.astype("int64"))

    kinds = dict(boxes.dtypes)
    return boxes.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", block long")


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of ``n`` nodes reaches over links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    while (label[label] != label).any():
        label = label[label]
    return label


def _gaps(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared least and largest distance that points of two boxes can have; boxes are (n, 2) corners."""
    near = np.maximum(np.maximum(lo_b - hi_a, lo_a - hi_b), 0)
    far = np.maximum(hi_b - lo_a, hi_a - lo_b)
    return (near * near).sum(1), (far * far).sum(1)


def cluster_block(pdf: pd.DataFrame, limit2: float) -> pd.DataFrame:
    """The parts of one cell: (fx, fy, part) of every box, and the pairs of boxes (fx, fy, ox, oy, part, other) of
    different parts for which their corners don't tell whether a step leads from one to the other."""
    fx, fy, block = pdf["fx"].to_numpy(), pdf["fy"].to_numpy(), int(pdf["block"].iloc[0])
    lo, hi = pdf[["lo_px", "lo_py"]].to_numpy(), pdf[["hi_px", "hi_py"]].to_numpy()
    grid, of = np.unique(np.c_[fx // FINE, fy // FINE], axis=0, return_inverse=True)
    of = of.ravel()
    order = np.argsort(of, kind="stable")
    start = np.searchsorted(of[order], np.arange(len(grid) + 1))
    held = {(x, y): i for i, (x, y) in enumerate(grid.tolist())}
    sure_a, sure_b, open_i, open_j = [], [], [], []
    for i, (x, y) in enumerate(grid.tolist()):
        mine = order[start[i] : start[i + 1]]
        for dx in range(0, 3):
            for dy in range(-2, 3):
                j = held.get((x + dx, y + dy)) if (dx, dy) > (0, 0) else None
                if j is None:
                    continue
                theirs = order[start[j] : start[j + 1]]
                p, q = np.repeat(mine, len(theirs)), np.tile(theirs, len(mine))
                near, far = _gaps(lo[p], hi[p], lo[q], hi[q])
                if (far <= limit2).any():
                    sure_a.append(i)
                    sure_b.append(j)
                elif (maybe := near <= limit2).any():
                    open_i.append(p[maybe])
                    open_j.append(q[maybe])
    label = _joined(len(grid), np.array(sure_a, dtype=np.int64), np.array(sure_b, dtype=np.int64))
    part = (np.int64(block) << 40) + label[of]
    out = pd.DataFrame({"fx": fx, "fy": fy, "ox": pd.NA, "oy": pd.NA, "part": part, "other": pd.NA})
    if open_i:
        i, j = np.concatenate(open_i), np.concatenate(open_j)
        apart = part[i] != part[j]
        i, j = i[apart], j[apart]
        out = pd.concat([out, pd.DataFrame({"fx": fx[i], "fy": fy[i], "ox": fx[j], "oy": fy[j], "part": part[i], "other": part[j]})])
    return out.astype({"ox": "Int64", "oy": "Int64", "other": "Int64"})


def _boxes(spots: DataFrame, keys: list[str], side: float) -> DataFrame:
    """(keys..., fx, fy, corners) of the boxes that points (keys..., px, py) lie in."""
    cell = lambda c: F.floor(F.col(c) / side).cast("bigint")
    return spots.withColumns({"fx": cell("px"), "fy": cell("py")}).groupBy(*keys, "fx", "fy").agg(*(f(c).alias(f"{n}_{c}") for c in ("px", "py") for n, f in (("lo", F.min), ("hi", F.max))))


def _witnesses(work: Workspace, spots: DataFrame, pairs: DataFrame, side: float, limit2: float) -> DataFrame:
    """(part, other) of the box pairs (fx, fy, ox, oy, part, other) between whose points a step leads.

    The boxes are cut into smaller ones until their corners decide; two parts with a sure pair are searched no further.
    A box that holds one point decides exactly, so the search ends.
    """
    found, level = None, 0
    ends = lambda df, x, y: df.select(F.col(x).alias("bx"), F.col(y).alias("by"))
    while not pairs.isEmpty():
        whole = ends(pairs, "fx", "fy").unionByName(ends(pairs, "ox", "oy")).distinct()
        in_box = spots.withColumns({"bx": F.floor(F.col("px") / side).cast("bigint"), "by": F.floor(F.col("py") / side).cast("bigint")}).join(whole, ["bx", "by"])
        side, level = side / FINE, level + 1
        small = work.write(_boxes(in_box, ["bx", "by"], side))
        one = small.select(F.col("bx").alias("fx"), F.col("by").alias("fy"), *(F.col(c).alias(f"a_{c}") for c in small.columns[2:]))
        two = small.select(F.col("bx").alias("ox"), F.col("by").alias("oy"), *(F.col(c).alias(f"b_{c}") for c in small.columns[2:]))
        gap = lambda c: F.greatest(F.col(f"b_lo_{c}") - F.col(f"a_hi_{c}"), F.col(f"a_lo_{c}") - F.col(f"b_hi_{c}"), F.lit(0.0))
        reach = lambda c: F.greatest(F.col(f"b_hi_{c}") - F.col(f"a_lo_{c}"), F.col(f"a_hi_{c}") - F.col(f"b_lo_{c}"))
        met = pairs.join(one, ["fx", "fy"]).join(two, ["ox", "oy"]).filter(gap("px") ** 2 + gap("py") ** 2 <= limit2)
        last = level >= 10  # boxes of a side below a billionth of the first: their corners are as good as points
        sure = F.lit(True) if last else reach("px") ** 2 + reach("py") ** 2 <= limit2
        met = work.write(met.select("part", "other", sure.alias("sure"), *(F.col(c).alias(n) for c, n in (("a_fx", "fx"), ("a_fy", "fy"), ("b_fx", "ox"), ("b_fy", "oy")))))
        proven = met.filter("sure").select("part", "other").distinct()
        found = proven if found is None else found.unionByName(proven)
        pairs = met.filter("not sure").drop("sure").join(proven, ["part", "other"], "left_anti")
    return pairs.select("part", "other") if found is None else found


def step_clusters(points: DataFrame, member: str, x: str, y: str, step: float = 1.0, least: int = 5, k: int | None = None, per_cell: int = 1000, most_cells: int = 2048, slack: float = 1e-9) -> DataFrame:
    """(cluster_id, member) of clusters with at least ``least`` members, joined over steps of at most ``step``.

    ``cluster_id`` is the least member.  ``slack`` keeps decimal coordinates that are exactly one step apart linked.  There
    are ``k`` k-means cells, by default one for ``per_cell`` boxes and at most ``most_cells``, whose centres every task gets.
    """
    work = Workspace(points.sparkSession, "step-clusters")
    limit2, side = (step + slack) ** 2, step / 1.5 / FINE  # two points of one grid cell are at most 0.943 steps apart
    usable = lambda c: F.col(c).isNotNull() & ~is_nan(F.col(c)) & (F.abs(c) < float("inf"))
    placed = points.filter(usable(x) & usable(y) & F.col(member).isNotNull()).select(F.col(member).alias("member"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py")).distinct()
    placed = work.write(placed)
    spots = placed.select("px", "py")
    boxes = _boxes(spots, [], side)
    middle = boxes.withColumns({"mx": (F.col("lo_px") + F.col("hi_px")) / 2, "my": (F.col("lo_py") + F.col("hi_py")) / 2})
    boxes = work.write(middle.withColumns({"x": hashed_features({"mx": 1.0, "my": 1.0}, dims=4), "id": F.xxhash64("fx", "fy")}).drop("mx", "my"))
    n, furthest = boxes.agg(F.count("*"), F.coalesce(F.max(F.greatest(F.abs("fx"), F.abs("fy"))), F.lit(0))).first()
    if not n:
        return placed.select(F.col("member").alias("cluster_id"), "member")
    if furthest >= 1 << 60:
        raise ValueError("coordinates are too large to be told apart by a step")
    centres = kmeans(boxes.select("id", "x"), k or min(most_cells, -(-n // per_cell)))
    inside = _blocks(boxes, centres, step, side * 0.71)
    shape = "fx long, fy long, ox long, oy long, part long, other long"
    found = work.write(inside.groupBy("block").applyInPandas(lambda pdf: cluster_block(pdf, limit2), shape))
    of_box = found.filter("ox is null").select("fx", "fy", "part")
    of_cell = work.write(of_box.groupBy(F.floor(F.col("fx") / FINE).alias("gx"), F.floor(F.col("fy") / FINE).alias("gy"), "part").agg(F.lit(1).alias("held")).drop("held"))
    node = of_cell.groupBy("gx", "gy").agg(F.min("part").alias("node"))
    shared = of_cell.join(node, ["gx", "gy"]).select(F.col("node").alias("a"), F.col("part").alias("b"))
    proven = _witnesses(work, spots, found.filter("ox is not null"), side, limit2).toDF("a", "b")
    grid = lambda c: F.floor(F.floor(F.col(c) / side) / FINE).cast("bigint")
    lies = placed.select("member", grid("px").alias("gx"), grid("py").alias("gy")).distinct().join(node, ["gx", "gy"]).select("member", "node")
    own = work.write(lies.groupBy("member").agg(F.min("node").alias("a"), F.max("node").alias("z")))
    moved = lies.join(own.filter("a <> z"), "member").select("a", F.col("node").alias("b"))
    roots = hash_to_min(shared.unionByName(proven).unionByName(moved).filter("a <> b").distinct(), "a", "b")
    of = own.select("member", F.col("a").alias("node")).join(roots, "node", "left").select("member", F.coalesce("root", "node").alias("root"))
    named = of.groupBy("root").agg(F.min("member").alias("cluster_id"), F.count("*").alias("size")).filter(F.col("size") >= least)
    return of.join(named, "root").select("cluster_id", "member")
