"""Session facts and materialisation shared by all operators.

Iterative operators cut their lineage by writing a table to the folder named by ``spark.checkpoint.dir``.  Such a table
is on storage that all executors share, so a lost executor never loses the state of a loop.
"""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local master without that setting gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="silomesh-")
    return "file://" + _LOCAL_DIRS[app]


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, whatever their working directory is."""
    env = spark.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster that doesn't see the driver's files; call it once per session.

    The archive is put into the shared folder.  Where executors share the driver's folders it isn't needed.
    """
    root = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    path = f"{shared_dir(spark)}/package-{uuid.uuid4().hex}.zip"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(path)


_WRITTEN: dict[str, list[str]] = {}


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables of all operator calls so far and return how many calls had some.

    A result is read from such tables until it is consumed, so this is for the caller to say: after results were written or
    collected.  What is left when the driver ends is deleted then.
    """
    roots = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for root in roots:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return len(roots)


def _release_at_exit() -> None:
    try:
        spark = SparkSession.getActiveSession()
        if spark is not None and spark.sparkContext._jsc is not None:
            release(spark)
    except Exception:  # the JVM may be gone already
        pass


atexit.register(_release_at_exit)


class Workspace:
    """Written intermediate tables of one operator call; :meth:`drop` frees those that are no longer read, ``release`` all."""

    def __init__(self, spark: SparkSession, name: str):
        share_package(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(self.root)

    def write(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return it as read back, with a plan that starts at the written files."""
        path = f"{self.root}/{self._n:04d}"
        self._n += 1
        df.write.mode("overwrite").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._silomesh_path = path
        return back

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_silomesh_path", None)
        if path:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def is_nan(col):
    """NaN test that is false for null."""
    return F.coalesce(F.isnan(col), F.lit(False))
