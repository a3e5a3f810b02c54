"""SQL names of the document functions: register(spark) makes them callable from spark.sql.

They take plain and shredded documents alike: a shredded row carries the types of its lanes in its manifest. Functions
whose result type hangs on a spec are registered under a name of the caller's choice by register_transform and the like,
and reads that should reach the lanes themselves are columns of a view (document_view).
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import algebra, canon, columns as C, path as P
from quillon.functions.canon import DocError
from quillon.operators import shred as S
from quillon.plans.reader import Reader

_PATHS: dict[object, P.Path] = {}


def _steps(path: str | int | None) -> P.Path:
    """The parsed path; paths are few, so they are kept."""
    if path not in _PATHS:
        if len(_PATHS) > 4096:
            _PATHS.clear()
        _PATHS[path] = () if path is None else P.of(path)
    return _PATHS[path]


@lru_cache(256)
def _spec(lanes: tuple[tuple[str, str], ...]) -> S.Spec:
    return S.Spec.of(dict(lanes))


def _tree(document: str | dict):
    """The tree of a plain document, or of a shredded one by the lanes that its manifest names."""
    if not isinstance(document, dict):
        return canon.parse(document)
    lanes = tuple((m["path"], m["type"]) for m in document["manifest"] or ())
    if not lanes:
        return canon.parse(document["residual"])
    return S.reconstruct_tree(document, _spec(lanes), canon.parse)


def _plain(document: str | dict | None) -> str | None:
    return canon.render(_tree(document)) if isinstance(document, dict) else document


def _read(fn):
    """A read of the value at an optional path; NULL where there is none."""

    def at(document, path=None):
        v = P.get(_tree(document), _steps(path))
        return None if v is P.MISSING else fn(v)

    return at


def _entries(document, style: str = "jsonpath", arrays: str = "indexed_elements") -> list[dict]:
    style, arrays = style.strip().lower(), arrays.strip().lower()
    if style not in ("jsonpath", "dotted") or arrays not in ("indexed_elements", "whole_json"):
        raise DocError(f"unknown key_style {style!r} or array_style {arrays!r}")
    return C.entry_list(_tree(document), style, arrays)


def _valid(document) -> bool:
    if isinstance(document, dict):
        try:
            return canon.render(canon.parse(document["residual"])) == document["residual"] and _tree(document) is not P.MISSING
        except DocError:
            return False
    return S.valid_row(document, None, canon.parse)


def _diff(a, b, arrays: str = "atomic") -> str:
    return C.diff_texts(_plain(a), _plain(b), algebra.array_mode(arrays))


def _strings(document, paths: list[str]) -> list[str | None]:
    tree = _tree(document)
    found = [P.get(tree, _steps(p)) for p in paths]
    return [None if v is P.MISSING else canon.text_of(v) for v in found]


_S, _A, _L, _B = T.StringType(), T.ArrayType(T.StringType()), T.LongType(), T.BooleanType()
_list = lambda fn: lambda v: fn(v) if isinstance(v, list) else None
#: Name: result type, function, and whether the function sees NULLs; for the others any NULL argument gives NULL.
FUNCTIONS = {
    "doc": (_S, lambda d: _plain(d) if isinstance(d, dict) else canon.canonical(d), False),
    "try_doc": (_S, C._try, False),
    "doc_to_json": (_S, _plain, False),
    "doc_quote": (_S, canon.quote, False),
    "doc_extract": (_S, _read(canon.render), False),
    "doc_extract_string": (_S, _read(canon.text_of), False),
    "doc_extract_strings": (_A, _strings, False),
    "doc_entries": (C.ENTRY, _entries, False),
    "doc_array_elements": (_A, _read(_list(lambda v: [canon.render(x) for x in v])), False),
    "doc_type": (_S, _read(canon.type_name), False),
    "doc_keys": (_A, _read(lambda v: sorted(v) if isinstance(v, dict) else None), False),
    "doc_array_length": (_L, _read(_list(len)), False),
    "doc_validate": (_B, _valid, False),
    "doc_merge_patch": (_S, lambda *d: C.patch_texts(*map(_plain, d)), True),
    "doc_overlay": (_S, lambda *d: C.overlay_texts(*map(_plain, d)), True),
    "doc_diff": (_S, _diff, True),
}


def register(spark: SparkSession) -> None:
    """Registers FUNCTIONS. Reads give NULL for NULL; merges, overlays and diffs take a NULL document as their Column forms do."""
    for name, (kind, fn, nulls) in FUNCTIONS.items():
        spark.udf.register(name, C.make_udf(kind, fn, nulls=nulls))


def register_transform(spark: SparkSession, name: str, spec: dict, on_type_mismatch: str = "convert") -> None:
    """Registers name(document) as transform with a constant spec, whose fields are the fields of the result."""
    kind, project = C.projection(spec, on_type_mismatch)
    spark.udf.register(name, C.make_udf(kind, lambda d: project(_tree(d))))


def register_shred(spark: SparkSession, name: str, spec: dict, *, roundtrip: bool = False) -> None:
    """Registers name(document) as shred with a constant spec; a shredded document is shredded anew."""
    made = S.Spec.of(spec)
    spark.udf.register(name, C.make_udf(made, lambda d: S.shred_parts(_tree(d), made, roundtrip)))


def document_view(df: DataFrame, name: str, column: str, reads: dict[str, str | tuple[str, str]], *, clean: bool = False) -> DataFrame:
    """Registers df, with further columns read from a document column, as the temporary view name.

    reads maps columns to paths (read as text) or to (path, type). Each is planned as Reader does, so that filters of SQL
    queries on lanes are filters on Parquet columns: with clean they reach the scan as they are.
    """
    r = Reader(df, column, clean=clean)
    made = {k: r.get_text(v) if isinstance(v, str) else r.get(*v) for k, v in reads.items()}
    out = df.select("*", *[c.alias(k) for k, c in made.items()])
    out.createOrReplaceTempView(name)
    return out


def suggest(spark: SparkSession, view: str, column: str, **options) -> str | None:
    """The shredding advice for a column of a view or table."""
    from quillon.operators.advisor import suggest_shredding

    return suggest_shredding(spark.table(view).select(F.col(f"`{column}`")), column, **options)
