"""A corpus pipeline over documents, stage by stage.

Every stage takes the documents that the one before has kept, with all their columns, and works on all of them. Null and
empty texts, repeated rows, null ids, empty tables and further columns of any names have the results that each stage states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontamination, linededup, minhash, mixing, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a learned rule rejects go; null and empty texts have no words and are rejected.

    Rows are judged each on their own, whatever their ids. Without labels of both classes only the base rule rejects.
    """
    return quality.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in enough documents stay in the one with the largest id alone; all rows stay, null texts as they are.

    Rows that share an id, or have none, are one document and keep or lose the same lines.
    """
    return linededup.dedup_texts(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that with the least id, ids before nulls; texts without words stay."""
    return minhash.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut from texts; a document that is mostly such passages goes. Other rows stay."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; null is a source, and rows without ids are drawn by their texts."""
    return mixing.repeated(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing sources", mixing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
