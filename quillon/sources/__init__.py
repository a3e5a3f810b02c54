"""Reading and writing of document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import columns as C
from quillon.operators import shred as S


def spread(df: DataFrame) -> DataFrame:
    """A scan dealt anew where it has fewer partitions than the session has cores, so that parsing keeps all of them busy.

    For scans only: a table of many files or row groups is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def read_documents(spark: SparkSession, *paths: str, merge_schema: bool = True) -> DataFrame:
    """Parquet with document columns. Files with other lanes are read together; markers keep reads right."""
    return spark.read.option("mergeSchema", str(merge_schema).lower()).parquet(*paths)


def write_shredded(
    df: DataFrame, path: str, column: str, spec: dict | S.Spec, *, cluster_by: list[str] = (), row_group_bytes: int | None = None, mode: str = "error"
) -> None:
    """Parquet with the column shredded by spec, rows sorted by lanes within each file so that row groups can be skipped."""
    spec = S.Spec.of(spec)
    out = df.withColumn(column, C.shred(F.col(f"`{column}`"), spec))
    if cluster_by:
        out = out.sortWithinPartitions(*[F.col(f"`{column}`")["shreds"].getField(n) for n in cluster_by])
    writer = out.write.mode(mode)
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    writer.parquet(path)
