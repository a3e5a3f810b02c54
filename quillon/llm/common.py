"""Shared helpers: scratch tables, batch mapping and tokenisation."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.sources.scratch import columns_of, discard, scratch_root, table

__all__ = ["columns_of", "discard", "scratch_root", "table"]

#: Arrow batches that executors hand to Python hold at most so many bytes, whatever the length of a text.
BATCH_BYTES = 4 * 1024 * 1024

#: Bytes to the word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z; all others become a space.
_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def alnum_text(text: str | bytes | None) -> bytes:
    """A text with its words as below, and spaces in place of all other characters."""
    return (text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")).translate(_ALNUM)


def alnum_words(text: str | bytes | None) -> list[bytes]:
    """Words of ASCII letters (lower-cased), digits and all other code points above 0x7F."""
    return alnum_text(text).split()


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches by bytes, for the whole session, as there is no such setting per query."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def free_prefix(columns: list[str], base: str) -> str:
    """base, longer by underscores where a column begins with it, whatever its case."""
    while any(c.lower().startswith(base.lower()) for c in columns):
        base += "_"
    return base


#: A key with more than the share of one in so many rows is hot; there are fewer hot keys than this, whatever the rows.
HOT = 1000


def skew_join(left: DataFrame, right: DataFrame, on: str, counts: DataFrame) -> DataFrame:
    """left joined with right (one row per key), where a few keys may hold most rows of left.

    counts has each key with m, its rows in left. Hot keys, fewer than HOT, are filtered apart by name: their rows of right
    are broadcast, and the rows of left that meet them are not shuffled. left is read twice, so it should be a table.
    """
    total = counts.agg(F.sum("m")).first()[0] or 0
    keys = [r[0] for r in counts.where(F.col("m") * HOT > total).select(on).collect()]
    if not keys:
        return left.join(right, on)
    hot = F.col(on).isin([F.lit(bytes(k) if isinstance(k, bytearray) else k) for k in keys])
    few = table(right.where(hot), "hot")  # fewer than HOT rows
    return left.where(hot).join(F.broadcast(few), on).unionByName(left.where(~hot).join(right.where(~hot), on))


def release() -> None:
    """Gives what a worker has freed back to the machine; idle workers stay alive and would hold on to it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        return


def map_batches(df: DataFrame, schema: T.StructType | str, fn: Callable[[Iterator], Iterator[pa.RecordBatch]]) -> DataFrame:
    """mapInArrow that releases a worker's free memory when a task ends."""

    names = df.columns
    odd = any(set(n) & set(".`") for n in names)  # mapInArrow looks columns up by name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn((b.rename_columns(names) for b in batches) if odd else batches)
        finally:
            release()

    return (df.toDF(*[f"c{k}" for k in range(len(names))]) if odd else df).mapInArrow(run, schema)


def map_arrow(df: DataFrame, schema: T.StructType | str, fn: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """Calls fn on every Arrow batch of df; fn returns the columns of schema by name."""
    out = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    names = out.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = fn(batch)
                yield pa.RecordBatch.from_arrays([got[n] for n in names], names=names)

    return map_batches(df, out, run)
