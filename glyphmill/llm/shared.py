"""Tables and folders that every executor can see, used to cut lineage between the steps of an operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only where that is unset (tests), a fresh temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        key = spark.sparkContext.applicationId
        if key not in _LOCAL:
            _LOCAL[key] = tempfile.mkdtemp(prefix="glyphmill-")
            atexit.register(shutil.rmtree, _LOCAL[key], ignore_errors=True)
        found = _LOCAL[key]
    return found.rstrip("/")


class Workspace:
    """Parquet tables of one operator run, in a folder of their own below :func:`shared_dir`.

    ``save`` writes a frame and returns it reread, so a lost executor costs at most the step that
    it was in; ``drop`` removes tables that no later step reads. What the returned frame of an
    operator still reads stays until the driver process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._codec = "zstd"
        atexit.register(self.close)

    def save(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        frame.write.mode("overwrite").option("compression", self._codec).parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001  the JVM may have gone first; the folder is then the cluster's to expire
            pass

    def _delete(self, path: str) -> None:
        delete(self.spark, path)


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of any store that Spark reads; nothing if there is none."""
    at, fs = _place(spark, path)
    fs.delete(at, True)


def complete_tables(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path`` that a writer has finished."""
    at, fs = _place(spark, path)
    if not fs.exists(at):
        return []
    found = [x.getPath() for x in fs.listStatus(at) if x.isDirectory()]
    return sorted(x.getName() for x in found if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))


def running(frame: DataFrame, work: Workspace, name: str, order: list, sums: dict[str, str]) -> DataFrame:
    """The rows with ``place``, their number from 0 in an order, and under each key of ``sums`` the sum of that column over the rows before.

    Rows are sorted over all tasks and written; sums inside a task's rows are added to those of the tasks
    before, of which there is a row each. The order must leave no ties.
    """
    rows = work.save(frame.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), name).withColumn("_part", F.shiftright("_m", 33))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_part").agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_{k}") for k, c in sums.items()))
    earlier = before(Window.orderBy("_part"))
    bases = totals.select("_part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_n", *(f"_{k}" for k in sums))))
    own = before(Window.partitionBy("_part").orderBy("_m"))
    place = (F.col("_n") + F.col("_m").bitwiseAND((1 << 33) - 1)).alias("place")
    made = [(F.col(f"_{k}") + F.coalesce(F.sum(c).over(own), F.lit(0))).alias(k) for k, c in sums.items()]
    return rows.join(F.broadcast(bases), "_part").select(*frame.columns, place, *made)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
