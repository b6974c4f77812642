"""Joining and aligning the tables of silos, and training pairs.

First and last rows need an order; every function that keeps a first row takes the columns that give it.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silomesh.operators.encode import draw, position, range_slices, token


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key (W4).  The least row is found by a pre-aggregated struct, so a hot key costs no sort."""
    rest = [c for c in df.columns if c not in keys]
    ordered = [*order, *(c for c in rest if c not in order)]
    first = df.groupBy(*keys).agg(F.min(F.struct(*ordered)).alias("_r"))
    return first.select(*keys, *(F.col("_r")[c].alias(c) for c in rest))


def fk_left_join(base: DataFrame, right: DataFrame, left_key: str, right_key: str, name: str, dedup_order: Sequence[str] | None = None, cap: int | None = None) -> DataFrame:
    """Left join along a foreign key (J1, J2, J4, J30): clashing columns of the right side get the suffix ``_<name>``.

    With ``dedup_order`` the first right row of each key joins, so no row is multiplied; ``cap`` keeps that many rows of the
    result, the first in the order of all its columns.
    """
    r = first_rows(right, [right_key], dedup_order) if dedup_order else right
    r = r.select(F.col(right_key).alias("_key"), *(F.col(c).alias(f"{c}_{name}" if c in base.columns else c) for c in r.columns if c != right_key))
    out = base.join(r, base[left_key] == F.col("_key"), "left").drop("_key")
    return out if cap is None else out.orderBy(*out.columns).limit(cap)


def joinable(left: Sequence[str], right_name: str, right: Sequence[str], keys: Sequence[tuple[str, str, str, str]], held: Sequence[str]) -> list[str]:
    """The columns on which a table can join along foreign keys (J3), in order: first the keys of the table itself, then
    the keys that point at it from the tables ``held`` on the left side.

    ``keys`` are (table, column, reference table, reference column); a key counts when both sides have its column and the
    two names are equal.
    """
    own = [(c, r) for t, c, _, r in keys if t == right_name]
    back = [(c, r) for t, c, rt, r in keys if rt == right_name and t in held]
    return [c for c, r in own if c == r and c in right and c in left] + [c for c, r in back if c == r and c in left and c in right]


def join_chain(tables: dict[str, DataFrame], keys: Sequence[tuple[str, str, str, str]], base: str | None = None, cap: int | None = None) -> DataFrame:
    """Left joins of all tables that foreign keys reach, in the order given.

    ``base`` is the table of the label, by default the largest.  A table joins on the first key that ``joinable`` finds, if
    its side of the key has more than one value; other columns that both sides have get the suffix ``_<table>``.  The chain
    ends when more than ``cap`` rows are reached; the first ``cap`` in the order of all columns are kept then.
    """
    if base is None:
        sizes = {t: df.count() for t, df in tables.items()}
        base = max(sizes, key=lambda t: sizes[t])
    out, held = tables[base], [base]
    for name, df in tables.items():
        found = joinable(out.columns, name, df.columns, keys, held) if name != base else []
        if not found or df.select(found[0]).dropna().distinct().limit(2).count() < 2:
            continue
        right = df.select(*(F.col(c).alias(f"{c}_{name}" if c in out.columns and c != found[0] else c) for c in df.columns))
        out, held = out.join(right, found[0], "left"), [*held, name]
        if cap is not None and out.limit(cap + 1).count() > cap:
            return out.orderBy(*out.columns).limit(cap)
    return out


def union_schema(parties: dict[str, DataFrame]) -> DataFrame:
    """(party, columns..., mask) of all rows under the sorted union of the parties' normalised names.

    A column that a party lacks, or a value that is missing, is 0; ``mask`` tells for each column in order whether the party
    has it.
    """
    key = lambda c: "".join(ch for ch in c.lower() if ch.isalnum())
    of = {p: {key(c): c for c in reversed(df.columns) if key(c)} for p, df in parties.items()}
    names = sorted({n for m in of.values() for n in m})
    out = None
    for p, df in parties.items():
        held = [F.coalesce(F.col(of[p][n]).cast("double"), F.lit(0.0)).alias(n) if n in of[p] else F.lit(0.0).alias(n) for n in names]
        rows = df.select(F.lit(p).alias("party"), *held, F.array(*(F.lit(n in of[p]) for n in names)).alias("mask"))
        out = rows if out is None else out.unionByName(rows)
    return out


def column_map(columns: DataFrame) -> DataFrame:
    """(db, name, original, n_silos, everywhere): the original of every union name in each silo that has it.

    ``columns`` is (db, name, column_name).  A silo's mask is true for the names it has a row for; names that aren't
    everywhere are the ones that a common schema omits.
    """
    own = columns.groupBy("db", "name").agg(F.min("column_name").alias("original"))
    n = own.groupBy("name").agg(F.count("*").alias("n_silos"))
    whole = own.agg(F.count_distinct("db").alias("whole"))
    return own.join(n, "name").join(F.broadcast(whole)).select("db", "name", "original", "n_silos", (F.col("n_silos") == F.col("whole")).alias("everywhere"))


def complete_labels(left: DataFrame, right: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Both sides without the rows that miss their label (F7); an error if that leaves a side empty."""
    out = left.dropna(subset=[label]), right.dropna(subset=[label])
    for name, df in zip(("left", "right"), out):
        if df.isEmpty():
            raise ValueError(f"no row of the {name} side has {label}")
    return out


def shared_labels(counts: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """(db, table_name, column_name, n_rows, n_classes): possible labels (F11) whose name holds one of ``wanted``, case and
    underscores aside, with at least ten rows and two to ten classes, from (db, table_name, column_name, value, n)."""
    plain = F.replace(F.lower("column_name"), F.lit("_"), F.lit(""))
    named = counts.filter("value is not null").filter(sum((plain.contains(w.replace("_", "")).cast("int") for w in wanted), F.lit(0)) > 0)
    return named.groupBy("db", "table_name", "column_name").agg(F.sum("n").alias("n_rows"), F.count_distinct("value").alias("n_classes")).filter("n_rows >= 10 and n_classes between 2 and 10")


def full_negatives(triplets: DataFrame, ids: DataFrame, blocks: int = 16) -> DataFrame:
    """(anchor, positive, negative): every id but its own two for each triplet of a stated query set.

    Ids are cut into blocks and every triplet is sent to each block once, so a task holds one block and its triplets.
    """
    cut = ids.select(F.col("id").alias("negative"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    asked = triplets.select("anchor", "positive", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    return asked.join(cut, "block").filter("negative <> anchor and negative <> positive").select("anchor", "positive", "negative")


def table_triplets(tables: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(split, table_id, i, negative, side): web-table triplets.

    ``tables`` is (table_id, valid_vertical, valid_horizontal).  A table valid for a split is cut into an anchor and its
    positive; each of its ``k`` negatives is a random ``side`` of another table that is valid for the split.
    """
    kinds = F.inline(F.array(*(F.struct(F.lit(s).alias("split"), F.col(f"valid_{s}").alias("valid")) for s in ("vertical", "horizontal"))))
    valid = tables.select("table_id", kinds).filter("valid").select("split", "table_id")
    placed = position(valid, ["split"], ["table_id", F.lit(seed)])
    n = valid.groupBy("split").agg(F.count("*").alias("n"))
    asked = placed.join(F.broadcast(n), "split").filter("n > 1").select("split", "table_id", "pos", "n", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"))
    name = F.concat_ws("-", "split", "table_id", "i")
    step = F.floor(draw(name, seed) * (F.col("n") - 1)) + 1
    asked = asked.select("split", "table_id", "i", F.pmod(F.col("pos") + step, F.col("n")).alias("at"), F.when(draw(name, seed + 1) < 0.5, "first").otherwise("second").alias("side"))
    return asked.join(placed.select("split", F.col("pos").alias("at"), F.col("table_id").alias("negative")), ["split", "at"]).select("split", "table_id", "i", "negative", "side")


def attempts(tasks: DataFrame, done: DataFrame, slots: int, retries: int = 2) -> DataFrame:
    """(task, attempt, status, wave, slot): what a queue runs.

    ``tasks`` is (task, failures): how often a task fails before it succeeds.  Tasks that are ``done`` are skipped; the rest
    start in the order of their ids, ``slots`` at a time, and run again after a failure, ``retries`` times at most.
    """
    left = tasks.join(done.select("task"), "task", "left_anti")
    at = _in_order(left, "task")
    tried = at.select("task", "failures", "pos", F.explode(F.sequence(F.lit(1), F.least(F.col("failures") + 1, F.lit(retries + 1)).cast("int"))).alias("attempt"))
    status = F.when(F.col("attempt") > F.col("failures"), "done").when(F.col("attempt") > retries, "given up").otherwise("failed")
    return tried.select("task", "attempt", status.alias("status"), F.floor(F.col("pos") / slots).cast("bigint").alias("wave"), F.pmod(F.col("pos"), F.lit(slots)).cast("bigint").alias("slot"))


def _in_order(df: DataFrame, key: str) -> DataFrame:
    """``df`` with its 0-based ``pos`` in the order of a key, numbered in ranges."""
    held = range_slices(df, [F.col(key)])
    sizes = held.groupBy("_slice").agg(F.count("*").alias("_n"))  # one row for each range
    shift = sizes.select("_slice", (F.sum("_n").over(Window.orderBy("_slice")) - F.col("_n")).alias("_s"))
    own = held.withColumn("_o", F.row_number().over(Window.partitionBy("_slice").orderBy(key)) - 1)
    return own.join(F.broadcast(shift), "_slice").withColumn("pos", F.col("_s") + F.col("_o")).drop("_slice", "_s", "_o")


def join_size(tables: dict[str, DataFrame], links: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """One row: rows of the inner join of a tree of foreign keys, from key counts alone.

    ``links`` are (child, child key, parent, parent key), each table once as a child, children before parents.  Counts are
    multiplied up the tree, so the join itself is never built.
    """
    weight = {t: df.withColumn("_w", F.lit(1).cast("bigint")) for t, df in tables.items()}
    for child, ck, parent, pk in links:
        up = weight[child].groupBy(F.col(ck).alias("_k")).agg(F.sum("_w").alias("_c"))
        p = weight[parent].join(up, F.col(pk) == F.col("_k"))
        weight[parent] = p.withColumn("_w", F.col("_w") * F.col("_c")).drop("_k", "_c")
    return weight[links[-1][2]].agg(F.coalesce(F.sum("_w"), F.lit(0)).alias("n_rows"))


def estimated_join_size(sizes: dict[str, int], distinct: dict[tuple[str, str], int], links: Sequence[tuple[str, str, str]]) -> float:
    """Estimate from table sizes and distinct key counts (J7): from the largest table, a parent keeps the size, a child
    multiplies by rows per distinct key; unlinked tables don't count."""
    base = max(sizes, key=lambda t: (sizes[t], t))
    joined, estimate, grown = {base}, float(sizes[base]), True
    while grown:
        grown = False
        for child, key, parent in links:
            if child in joined and parent not in joined:
                joined.add(parent)
                grown = True
            elif parent in joined and child not in joined:
                joined.add(child)
                estimate *= sizes[child] / max(distinct[(child, key)], 1)
                grown = True
    return estimate


def deduplicated_columns(columns: Sequence[str]) -> list[str]:
    """The first column of each key of letters and digits; names without any are dropped."""
    seen: dict[str, str] = {}
    for c in columns:
        key = "".join(ch for ch in c.lower() if ch.isalnum())
        if key and key not in seen:
            seen[key] = c
    return list(seen.values())


def common_columns(left: Sequence[str], right: Sequence[str]) -> dict[str, str]:
    """Right column to left column of equal keys."""
    key = lambda c: "".join(ch for ch in c.lower() if ch.isalnum())
    l = {key(c): c for c in reversed(left) if key(c)}  # noqa: E741
    out: dict[str, str] = {}
    for c in right:
        if key(c) in l and l[key(c)] not in out.values():
            out[c] = l[key(c)]
    return out


def align(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables on their common columns, under the left names."""
    names = common_columns(left.columns, right.columns)
    return left.select(*names.values()), right.select(*(F.col(r).alias(n) for r, n in names.items()))


def column_masks(columns: DataFrame, silos: int) -> DataFrame:
    """(name, n_silos, everywhere): union of the column names of some silos and where each is present."""
    n = columns.groupBy("name").agg(F.count_distinct("db").alias("n_silos"))
    return n.withColumn("everywhere", F.col("n_silos") == silos)


def vertical_halves(columns: Sequence[str], overlap: float = 0.0, least: int = 2) -> tuple[list[str], list[str]]:
    """Left and right columns of a vertical split."""
    n = len(columns)
    if n < 2 * least:
        raise ValueError("too few columns to split")
    shared = int(n * overlap)
    left = (n + shared) // 2
    return list(columns[:left]), list(columns[left - shared :])


def vertical_sides(columns: DataFrame, overlap: float = 0.0, least: int = 2) -> DataFrame:
    """(db, table_name, column_name, on_left, on_right): the vertical split (P11) of every table of a catalogue at once.

    Columns are split in the order of their names; tables with fewer than ``2 * least`` columns are left out.
    """
    by = Window.partitionBy("db", "table_name")
    placed = columns.withColumns({"pos": F.row_number().over(by.orderBy("column_name")) - 1, "n": F.count("*").over(by)}).filter(F.col("n") >= 2 * least)
    shared = F.floor(F.col("n") * overlap)
    left = F.floor((F.col("n") + shared) / 2)
    return placed.select("db", "table_name", "column_name", (F.col("pos") < left).alias("on_left"), (F.col("pos") >= left - shared).alias("on_right"))


def horizontal_halves(df: DataFrame, key: str, ratio: float = 0.5, seed: int = 0) -> DataFrame:
    """``df`` with ``half`` 0 or 1; the first holds floor(n x ratio) rows in hash order."""
    n = df.agg(F.floor(F.count("*") * ratio).alias("_cut"))
    return position(df, [], [F.col(key), F.lit(seed)]).join(F.broadcast(n)).withColumn("half", (F.col("pos") >= F.col("_cut")).cast("int")).drop("pos", "_cut")


def members_in_groups(df: DataFrame, group: str, member: str) -> DataFrame:
    """(group, member, n_linked): every member with the number of others in its group.

    The pairs of a group are given by the group itself; they are never listed, so a group with a third of all members costs
    no more than its rows.
    """
    d = df.select(F.col(group).alias(group), F.col(member).alias(member)).dropna().distinct()
    return d.join(d.groupBy(group).agg((F.count("*") - 1).alias("n_linked")), group)


def negative_pool(ids: DataFrame, linked: DataFrame) -> DataFrame:
    """Ids (id) that no positive pair holds; ``linked`` lists those that some pair does."""
    return ids.join(linked.select("id"), "id", "left_anti")


def split_groups(sizes: dict, shares: Sequence[float] = (0.7, 0.1, 0.2), seed: int = 0) -> dict:
    """Group to part, filled in a seeded order without splitting a group (W6); a group that fits nowhere goes to the last."""
    import random

    order = sorted(sizes)
    random.Random(seed).shuffle(order)
    total, held, out = sum(sizes.values()), [0.0] * len(shares), {}
    for g in order:
        part = next((i for i, s in enumerate(shares) if held[i] + sizes[g] <= s * total), len(shares) - 1)
        held[part] += sizes[g]
        out[g] = part
    return out


def triplets(pairs: DataFrame, pool: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(anchor, positive, negatives): ``k`` consecutive ids of the shuffled pool for each pair, wrapping around."""
    p = position(pairs, [], [F.col("a"), F.col("b"), F.lit(seed)])
    n = position(pool, [], [F.col("id"), F.lit(seed)]).select(F.col("pos").alias("at"), F.col("id").alias("negative"))
    size = pool.agg(F.count("*").alias("size"))
    asked = p.join(F.broadcast(size)).select("a", "b", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(F.col("pos") * k + i, F.col("size")))).alias("i", "at"))
    got = asked.join(n, "at").groupBy("a", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "negative"))), lambda s: s["negative"]).alias("negatives"))
    return got.select(F.col("a").alias("anchor"), F.col("b").alias("positive"), "negatives")


def explode_triplets(t: DataFrame) -> DataFrame:
    """(anchor, other, label): one positive and all negatives of each triplet (P10)."""
    both = F.concat(F.array("positive"), "negatives")
    return t.select("anchor", F.posexplode(both).alias("i", "other")).select("anchor", "other", (F.col("i") == 0).cast("int").alias("label"))


def one_negative(t: DataFrame, seed: int) -> DataFrame:
    """(anchor, positive, negative): one negative for each triplet and seed."""
    i = F.floor(draw(F.concat_ws("-", "anchor", "positive"), seed) * F.size("negatives")).cast("int") + 1
    return t.filter(F.size("negatives") > 0).select("anchor", "positive", F.element_at("negatives", i).alias("negative"))


def repaired_directions(pairs: pd.DataFrame) -> pd.DataFrame:
    """Pairs swapped where the first id was first before (E8); order matters, so it is meant for one file."""
    seen, rows = set(), []
    for a, b in pairs.itertuples(index=False):
        if a in seen and b not in seen:
            a, b = b, a
        seen.add(a)
        rows.append((a, b))
    return pd.DataFrame(rows, columns=pairs.columns)


def zip_join(left: DataFrame, right: DataFrame, order: str) -> DataFrame:
    """Column-wise concatenation by position in ``order`` (J10); both tables must have that column."""
    number = lambda df: position(df, [], [F.col(order)])
    return number(left).join(number(right).drop(order), "pos").drop("pos")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` without a new row."""
    return new.unionByName(old.join(new.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def top_tie_sample(df: DataFrame, score: str, keys: Sequence[str], k: int, seed: int = 0) -> DataFrame:
    """The ``k`` rows with the highest score in steps of 1e-4; the last tie group is cut in hash order."""
    stepped = df.withColumn("_s", F.floor(F.col(score) * 1e4 + 0.5).cast("bigint"))
    return stepped.orderBy(F.desc("_s"), token(*keys, F.lit(seed)), *keys).limit(k).drop("_s")


def running_share(df: DataFrame, order: Sequence[str], size: str) -> DataFrame:
    """``df`` with the running sum of ``size`` in order; for short lists such as split parts."""
    return df.withColumn("upto", F.sum(size).over(Window.orderBy(*order)))
