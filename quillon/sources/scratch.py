"""Scratch tables in the folder that all executors share: cut lineage, and results that outlive a lost executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of df by name, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def scratch_root(spark: SparkSession) -> str:
    """A folder for this application below spark.checkpoint.dir; where that is unset, a temporary one in local mode only."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="quillon-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = f"file://{own}"
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/quillon-{sc.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path for one table, which is deleted when the session ends."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if not _scratch:  # registered after Spark's own handlers, so that it runs before them
        atexit.unregister(drop_tables)
        atexit.register(drop_tables)
    _scratch.append((spark, path))
    return path


def table(df: DataFrame, name: str = "t", partition_by: str | None = None) -> DataFrame:
    """Writes df to the shared scratch folder and reads it back: no lineage, and any executor may be lost.

    A partitioned table has a folder per value of the column; filters on it leave the other folders unread.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    made = spark.read.schema(df.schema).parquet(path).select(*columns_of(df))
    made._quillon_path = path
    return made


def discard(*tables: DataFrame) -> None:
    """Deletes scratch tables that nothing reads any more."""
    for made in tables:
        path = made._quillon_path
        _scratch[:] = [x for x in _scratch if x[1] != path]
        _delete(made.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_scratch: list[tuple[SparkSession, str]] = []


def drop_tables() -> None:
    """Removes the scratch tables made so far. Results that still read them must have been consumed."""
    while _scratch:
        owner, path = _scratch.pop()
        try:
            _delete(owner, path)
        except Exception:  # noqa: BLE001  the session has ended; its folder is the cluster's to clean
            return
