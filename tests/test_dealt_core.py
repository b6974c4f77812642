"""The column profile and the missing references (problems 2 and 5) on small cases and against brute force."""

import datetime as dt
import random

from conftest import rows

from silomesh.operators import references, skew, value_counts
from pyspark.sql import functions as F

CARD = "stat_id long, db_id string, table_name string, column_name string, n_distinct long, n_rows long, load_no int, extra string"
SPARS = "stat_id long, db_id string, table_name string, column_name string, sparsity double, load_no int, finding string"


def test_counts_follow_signed_deltas(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), ("b", 2)], "g string, v int")
    table = value_counts.ValueCountTable(spark, f"file://{tmp_path}/counts")
    assert table.state() is None
    table.apply(value_counts.value_deltas(df, ["g"], F.col("v")))
    table.apply(value_counts.value_deltas(df.filter("v = 1").limit(1), ["g"], F.col("v"), -1))
    table.apply(value_counts.value_deltas(df.filter("g = 'b'"), ["g"], F.col("v"), -1))
    assert rows(table.state()) == [("a", 1, 1), ("a", None, 1)]
    p = value_counts.profile(table.state(), ["g"]).first()
    assert (p.n_rows, p.n_null, p.null_rate, p.n_distinct, p.min_value, p.entropy) == (2, 1, 0.5, 1, 1, 0.0)
    assert len(table.versions()) == 2


def test_profile_entropy_and_change(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (1, "y"), (2, "x"), (2, "x"), (2, None), (2, None)], "load int, v string").withColumn("g", F.lit(0))
    state = value_counts.apply_deltas(None, value_counts.value_deltas(df, ["g", "load"], F.col("v")))
    assert value_counts.profile(state, ["load"]).filter("load = 1").first().entropy == 1.0
    assert rows(value_counts.distribution_change(state, ["g"], "load"), "load", "total_variation") == [(2, 0.5)]


def brute_findings(card, spars):
    out, clean = set(), []
    for table, data, field in (("column_cardinality", card, "n_distinct"), ("column_sparsity", spars, "sparsity")):
        for r in data:
            i, db, t, c, v = r[:5]
            load = r[6] if field == "n_distinct" else r[5]
            ok = True
            if db is None:
                out.add((table, i, "db_id", "null"))
                ok = False
            elif not (len(db) == 7 and all(ch in "0123456789" for ch in db)):
                out.add((table, i, "db_id", "pattern"))
                ok = False
            if v is None or v != v:
                out.add((table, i, field, "null"))
                ok = False
            elif v < 0 or (field == "n_distinct" and r[5] is not None and v > r[5]) or (field == "sparsity" and v > 1):
                out.add((table, i, field, "range"))
                ok = False
            if ok:
                clean.append((table, field, (db, t, c), load, v, i))
    for table, field, key, load, v, i in clean:
        before = [x for x in clean if x[0] == table and x[2] == key and None not in key and x[3] < load]
        if before:
            last = max(x[3] for x in before)
            for x in before:
                far = abs(v - x[4]) >= 0.3 if field == "sparsity" else max(v, x[4]) + 1 >= 5 * (min(v, x[4]) + 1)
                if x[3] == last and far:
                    out.add((table, i, field, "drift"))
    return out


def make_stats(seed, n=300):
    g = random.Random(seed)
    db = lambda: g.choice(["0000001", "0000001", "0000002", None, "1", "000000a", "0000001\n"])
    card = [(g.randrange(n), db(), "t", g.choice("abc"), g.choice([None, -1, 0, 3, 50, 500]), g.choice([None, 100, 1000]), g.randrange(1, 5), "x") for _ in range(n)]
    spars = [(g.randrange(n), db(), "t", g.choice("abc"), g.choice([None, float("nan"), -0.1, 0.0, 0.29, 0.3, 0.9, 1.2]), g.randrange(1, 4), "x") for _ in range(n)]
    return card, spars


def test_findings_match_brute_force(spark):
    for seed in (1, 2):
        card, spars = make_stats(seed)
        for heavy in (0.02, 2.0):  # all keys heavy, no key heavy
            got = value_counts.quality_findings(spark.createDataFrame(card, CARD), spark.createDataFrame(spars, SPARS), heavy_share=min(heavy, 0.9))
            assert {tuple(r) for r in got.collect()} == brute_findings(card, spars)
            assert got.count() == len(brute_findings(card, spars))


def test_findings_of_empty_tables(spark):
    assert value_counts.quality_findings(spark.createDataFrame([], CARD), spark.createDataFrame([], SPARS)).count() == 0


def test_heavy_keys(spark):
    df = spark.createDataFrame([(1,)] * 60 + [(i,) for i in range(2, 42)], "k long")
    h = skew.heavy_hashes(df, F.xxhash64("k"), 0.3)
    assert h == [df.select(F.xxhash64(F.lit(1).cast("bigint"))).first()[0]]
    assert skew.heavy_hashes(df.limit(0), F.xxhash64("k")) == []


COLS = "db_id string, table_name string, column_name string, added_at timestamp, removed_at timestamp, fk_id long"
FKS = "fk_id long, db_id string, table_name string, column_name string, reference_table_name string, reference_column_name string, recorded_at timestamp, added_at timestamp"


def t(n):
    return None if n is None else dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


def test_orphans_match_brute_force(spark):
    g = random.Random(5)
    name = lambda: g.choice(["a", "A ", "b_", "B", "c", "???"])
    cols = [(g.choice(["0000001", "0000002"]), name(), g.choice(["x", "X-", "y", None]), t(g.choice([None, *range(10)])), t(g.choice([None, None, *range(10)])), 1) for _ in range(60)]
    fks = [(i, g.choice(["1", "0000001", "0000002", None]), name(), g.choice(["x", "y", "z"]), g.choice([None, " ", "a", "b", "\t"]), g.choice([None, "x", "y"]), t(g.choice([None, *range(12)])), None) for i in range(120)]
    fks += fks[:10]
    key = lambda s: "".join(ch for ch in (s or "").lower() if ch in "abcdefghijklmnopqrstuvwxyz0123456789")
    want = set()
    for f in fks:
        for side, tab, col in (("source", f[2], f[3]), ("target", f[4], f[5])):
            if not (tab or "").strip() or not (col or "").strip():
                continue
            held = any(f[1] and c[0] and int(c[0]) == int(f[1]) and key(c[1]) and key(c[2]) and key(c[1]) == key(tab) and key(c[2]) == key(col) and c[3] and f[6] and c[3] <= f[6] and (c[4] is None or c[4] > f[6]) for c in cols)
            if not held:
                want.add((f[0], side))
    got = references.orphan_cases(spark.createDataFrame(cols, COLS), spark.createDataFrame(fks, FKS))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_orphans_of_empty_tables(spark):
    none, fk = spark.createDataFrame([], COLS), spark.createDataFrame([(1, "1", "a", "b", "c", "d", t(1), None)], FKS)
    assert rows(references.orphan_cases(none, fk)) == [(1, "source"), (1, "target")]
    assert references.orphan_cases(none, fk.limit(0)).count() == 0
    assert rows(references.orphan_report(none, fk), "period", "n_source", "n_target", "n_references") == [("2025-01", 1, 1, 1)]


def test_orphans_follow_columns_that_go_and_come_back(spark, tmp_path):
    cols = spark.createDataFrame([("1", "a", "x", t(0), None, 0), ("1", "a", "y", t(0), t(5), 0)], COLS)
    fks = spark.createDataFrame([(1, "1", "a", "x", "a", "y", t(3), None), (2, "1", "a", "x", "a", "y", t(6), None)], FKS)
    table = value_counts.ValueCountTable(spark, f"file://{tmp_path}/refs")
    lost = lambda s: rows(references.lost_references(references.orphan_keys(s), fks), "fk_id", "side")
    state = table.apply(references.signed_counts(references.reference_changes(fks)))
    assert lost(state) == [(1, "source"), (1, "target"), (2, "source"), (2, "target")]
    state = table.apply(references.signed_counts(references.existence_changes(cols)))
    assert lost(state) == [(2, "target")]
    gone = references.signed_counts(references.existence_changes(cols.filter("column_name = 'x'"), -1))
    assert lost(table.apply(gone)) == [(1, "source"), (2, "source"), (2, "target")]
    state = table.apply(references.signed_counts(references.existence_changes(cols.filter("column_name = 'x'"))))
    assert lost(state) == [(2, "target")]
    back = spark.createDataFrame([("1", "A", "y ", t(6), None, 0)], COLS)
    assert lost(table.apply(references.signed_counts(references.existence_changes(back)))) == []


def test_hot_keys_are_summed_by_month(spark):
    g = random.Random(8)
    cols = spark.createDataFrame([("1", "a", "x", t(a), t(a + g.randrange(1, 20)), 0) for a in range(0, 400, 15)], COLS)
    fks = spark.createDataFrame([(i, "1", "a", "x", "a", "x", t(g.choice([None, *range(420)])), None) for i in range(200)], FKS)
    state = references.signed_counts(references.existence_changes(cols).unionByName(references.reference_changes(fks)))
    assert rows(references.orphan_keys(state, 0.01)) == rows(references.orphan_keys(state, 0.99)) != []


def test_a_load_replaces_values_and_can_be_taken_back(spark):
    load = lambda n, v, sign=1: value_counts.observations(spark.createDataFrame([(1, "0000001", "t", "c", v, 1000, n, "x")], CARD), spark.createDataFrame([], SPARS)).withColumn("n", F.lit(sign).cast("bigint"))
    one = value_counts.replace_values(None, load(1, 10))
    two = value_counts.replace_values(one, load(2, 100))
    assert rows(two, "load_no", "value", "n", "lo_before", "new") == [(2, 100.0, 1, 10.0, True)]
    three = value_counts.replace_values(two, load(4, None))
    assert rows(three, "load_no", "value", "new") == [(2, 100.0, False), (4, None, True)]
    nothing = load(3, 5).unionByName(load(3, 5, -1))
    assert rows(value_counts.replace_values(two, nothing), "load_no", "value") == [(2, 100.0)]
