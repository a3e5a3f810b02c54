"""Documents in Structured Streaming.

Scalar functions apply to streams as they are. The keyed merge is commutative, so its winning leaves are an ordinary
streaming aggregation, and documents are built from them wherever the state is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from quillon.operators.aggregates import from_leaves, winning_leaves


def merge_stream(stream: DataFrame, by: list[str], doc: str, key: Column | str, *, largest: bool = True) -> DataFrame:
    """The winning leaves of a stream of documents, for complete or update mode."""
    return winning_leaves(stream, by, doc, key, largest=largest)


def documents(state: DataFrame, by: list[str], name: str = "merged") -> DataFrame:
    """The merged documents of a table of winning leaves that merge_stream has written."""
    return from_leaves(state, by, name)
