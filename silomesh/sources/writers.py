"""Writers (K1-K16): tables, JSON lines, checkpoints that continue, reports."""

from __future__ import annotations

import sqlite3
from contextlib import closing

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silomesh.sources.readers import exists


def csv(df: DataFrame, path: str, first_wins: bool = False) -> None:
    """CSV with a header (K1); ``first_wins`` leaves an existing result as it is (K2)."""
    df.write.mode("ignore" if first_wins else "overwrite").option("header", True).csv(path)


def jsonl(df: DataFrame, path: str, by: str | None = None) -> None:
    """One JSON object in a line (K4, K8, K9); ``by`` makes one folder for each value."""
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).json(path)


def graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A property graph as two Parquet tables."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def batches(df: DataFrame, path: str, key: str, n: int) -> int:
    """Write ``df`` in ``n`` hash batches, leaving out those that are complete, and return how many were written (K3)."""
    done = 0
    for b in range(n):
        target = f"{path}/batch={b}"
        if not exists(df.sparkSession, f"{target}/_SUCCESS"):
            df.filter(F.pmod(F.xxhash64(key), F.lit(n)) == b).write.mode("overwrite").parquet(target)
            done += 1
    return done


def column_mapping(columns: DataFrame, path: str) -> None:
    """(db, name, original): the original name of each union column in each silo, as JSON lines."""
    columns.groupBy("db", "name").agg(F.min("column_name").alias("original")).write.mode("overwrite").json(path)


def prediction_rows(df: DataFrame, path: str) -> None:
    """(db_id, index, y_true, y_pred, prob_pos) from arrays of one silo each."""
    z = F.arrays_zip("y_true", "y_pred", "prob_pos")
    df.select("db_id", F.posexplode(z).alias("index", "r")).select("db_id", "index", "r.*").write.mode("overwrite").option("header", True).csv(path)


def status_report(df: DataFrame, path: str) -> None:
    """Tasks and mean duration by status."""
    df.groupBy("status").agg(F.count("*").alias("n"), F.avg("seconds").alias("avg_seconds")).write.mode("overwrite").json(path)


def latex(df: DataFrame, digits: int = 4) -> str:
    """A result as the body of a LaTeX table (K11), all rows in the order of ``df``, fetched part by part."""
    cell = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    return "\n".join(" & ".join(cell(v) for v in r) + r" \\" for r in df.toLocalIterator())


def sqlite(df: DataFrame, path: str, table: str) -> int:
    """Load a table into a SQLite file (S10) and return its rows; the file has one writer, which takes part after part."""
    names = ", ".join(f'"{c}"' for c in df.columns)
    n = 0
    with closing(sqlite3.connect(path)) as con, con:
        con.execute(f'create table "{table}" ({names})')
        for r in df.toLocalIterator():
            con.execute(f'insert into "{table}" values ({", ".join("?" * len(r))})', tuple(r))
            n += 1
    return n
