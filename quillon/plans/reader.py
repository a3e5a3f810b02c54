"""Reads of plain and shredded documents, each by the cheapest way that is right.

A read is one of: lane (the typed column, with the residual for values left behind), residual (a path that no lane
touches), reconstruct (a container with lifted parts, or a list lane). Filters on lanes carry an implied predicate on the
bare lane and the row's marker, which Parquet can push down; the marker keeps it right on rows that hold a misfit and on
files that were written with other lanes.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import coerce, columns as C, path as P
from quillon.functions.canon import DocError
from quillon.operators import shred as S


class Reader:
    """A document column of a DataFrame. clean: every row is known to have the spec's marker (see prove_clean)."""

    def __init__(self, df: DataFrame, column: str, *, clean: bool = False):
        self.col = F.col(f"`{column}`")
        self.name = column
        self.spec = S.Spec.from_type(df.schema[column].dataType)
        self.clean = clean
        self._by_path = {x.path: x for x in self.spec.lanes} if self.spec else {}

    # classification

    def classify(self, path: str | int) -> str:
        """plain, lane, residual or reconstruct."""
        if self.spec is None:
            return "plain"
        steps = P.of(path)
        here = self._by_path.get(steps)
        for x in self.spec.lanes:
            inside = len(x.path) > len(steps) and x.path[: len(steps)] == steps
            into = x.array and steps[: len(x.path)] == x.path
            if into or (inside and here is None):
                return "reconstruct"
            if inside and here is not None:
                return "reconstruct"  # a lane above another: its misfits are containers with lifted parts
        return "lane" if here is not None else "residual"

    def lane(self, path: str | int) -> Column:
        return self.col["shreds"].getField(self._by_path[P.of(path)].name)

    @property
    def plain(self) -> Column:
        """The whole document as canonical text."""
        return self.col if self.spec is None else C.reconstruct(self.col, self.spec)

    def _source(self, how: str) -> Column:
        return self.col if how == "plain" else self.col["residual"] if how == "residual" else self.plain

    # reads

    def get_text(self, path: str | int) -> Column:
        """The text at a path."""
        how = self.classify(path)
        if how != "lane":
            return C.extract_string(self._source(how), path)
        x = self._by_path[P.of(path)]
        text = C.lane_text(self.lane(path), x.kind)
        return text if self.clean else F.coalesce(text, C.extract_string(self._missed(x), path))

    def _missed(self, x: S.Lane) -> Column:
        """The residual of rows where the lane is empty, so that Python sees no others."""
        return F.when(self.col["shreds"].getField(x.name).isNull(), self.col["residual"])

    def get(self, path: str | int, kind: str) -> Column:
        """The value at a path as a type; a lane of that type is read as it is."""
        kind = coerce.type_of(kind)
        how = self.classify(path)
        field = {"v": {"type": kind, "path": P.text(P.of(path))}}
        if how == "lane":
            x = self._by_path[P.of(path)]
            if x.kind == kind:
                bare = self.lane(path)
                return bare if self.clean else F.coalesce(bare, C.transform(self._missed(x), field)["v"])
            how = "reconstruct"
        return C.transform(self._source(how), field)["v"]

    def extract(self, path: str | int) -> Column:
        """The document at a path."""
        how = self.classify(path)
        if how == "lane":
            x = self._by_path[P.of(path)]
            lane = self.lane(path)
            text = C.quote(lane) if x.kind == "VARCHAR" else C.lane_text(lane, x.kind)
            return text if self.clean else F.coalesce(text, C.extract(self._missed(x), path))
        return C.extract(self._source(how), path)

    def get_texts(self, paths: list[str | int]) -> Column:
        """Several texts as an array: from one parse, or path by path where lanes serve all of them."""
        hows = {self.classify(p) for p in paths}
        if hows == {"lane"}:
            return F.array(*[self.get_text(p) for p in paths])
        how = "plain" if hows == {"plain"} else "residual" if hows == {"residual"} else "reconstruct"
        return C.extract_strings(self._source(how), paths)

    def read(self, reads: dict[str, C.Read]) -> Column:
        """A struct of several reads (C.text_at and the like) from at most one parse of each document.

        On shredded documents, reads that no lane touches need the residual alone; any other reconstructs once for all.
        """
        if self.spec is None:
            return C.read(self.col, reads)
        if all(r.path is not None and self.classify(r.path) == "residual" for r in reads.values()):
            return C.read(self.col["residual"], reads)
        return C.read(self.col, reads, self.spec)

    def transform(self, spec: dict, on_type_mismatch: str = "convert") -> Column:
        """A struct of typed fields. Fields of clean lanes are read from them; the rest share one parse."""
        if self.spec is None:
            return C.transform(self.col, spec, on_type_mismatch)
        fields = {n: C.Field(n, s) for n, s in spec.items()}
        if self.clean:
            bare = {n: f for n, f in fields.items() if (x := self._by_path.get(f.path)) and x.scalar and x.kind == f.kind and not f.list}
            if len(bare) == len(fields):
                return F.when(self.col.isNotNull(), F.struct(*[self.col["shreds"].getField(self._by_path[f.path].name).alias(n) for n, f in fields.items()]))
        touched = any(
            x.path[: len(f.head)] == f.head or f.head[: len(x.path)] == x.path for f in fields.values() for x in self.spec.lanes
        )
        return C.transform(self.plain if touched else self.col["residual"], spec, on_type_mismatch)

    def type_of(self, path: str | int | None = None) -> Column:
        return C.type_of(self._around(path), path)

    def keys(self, path: str | int | None = None) -> Column:
        return C.keys(self._around(path), path)

    def array_length(self, path: str | int | None = None) -> Column:
        return C.array_length(self._around(path), path)

    def array_elements(self, path: str | int | None = None) -> Column:
        return C.array_elements(self._around(path), path)

    def entries(self, **styles) -> Column:
        return C.entries(self.plain, **styles)

    def _around(self, path) -> Column:
        if self.spec is None or path is None:
            return self.plain
        how = self.classify(path)
        return self._source("reconstruct" if how == "lane" else how)

    # filters

    def where(self, path: str | int, op: str, value) -> Column:
        """A comparison (=, <, <=, >, >=, in) of the value at a path with literals of one type."""
        values = list(value) if op == "in" else [value]
        kind = _kind(values[0])
        test = _compare(op, values)
        if self.classify(path) != "lane" or self._by_path[P.of(path)].kind != kind:
            return test(self.get(path, kind))
        bare = self.lane(path)
        if self.clean:
            return test(bare)
        mark = self.col["shreds"].getField(S.SET)
        implied = test(bare) | (mark != F.lit(self.spec.clean)) | mark.isNull()
        return implied & test(self.get(path, kind))


def _kind(v) -> str:
    if isinstance(v, bool):
        return "BOOLEAN"
    if isinstance(v, int):
        return "BIGINT" if v < 2**63 else "UBIGINT"
    return "UBIGINT" if isinstance(v, Decimal) else "DOUBLE" if isinstance(v, float) else "VARCHAR"


def _compare(op: str, values: list):
    lits = [F.lit(v) for v in values]
    tests = {
        "=": lambda c: c == lits[0],
        "<": lambda c: c < lits[0],
        "<=": lambda c: c <= lits[0],
        ">": lambda c: c > lits[0],
        ">=": lambda c: c >= lits[0],
        "in": lambda c: c.isin(*values),
    }
    if op not in tests:
        raise DocError(f"unknown comparison {op!r}")
    return tests[op]


def prove_clean(df: DataFrame, column: str) -> bool:
    """Whether every document of the column has the marker of its type: one aggregation over one narrow column."""
    spec = S.Spec.from_type(df.schema[column].dataType)
    if spec is None:
        return False
    doc = F.col(f"`{column}`")
    mark = doc["shreds"].getField(S.SET)
    r = df.where(doc.isNotNull()).agg(F.min(mark).alias("a"), F.max(mark).alias("b"), F.count_if(mark.isNull()).alias("n")).first()
    return r["a"] == r["b"] == spec.clean and not r["n"]


def align(df: DataFrame, column: str, spec: dict | S.Spec | None) -> DataFrame:
    """df with the column in the form of spec (None: plain), without loss; for unions, inserts and set operations."""
    old = S.Spec.from_type(df.schema[column].dataType)
    new = None if spec is None else S.Spec.of(spec)
    c = F.col(f"`{column}`")
    if old == new:
        return df
    if new is None:
        out = C.reconstruct(c, old)
    else:
        out = C.shred(c, new) if old is None else C.reshred(c, old, new)
    return df.withColumn(column, out)


def union(one: DataFrame, two: DataFrame, column: str) -> DataFrame:
    """All rows of both, the column shredded on the lanes of either (the later type wins a name)."""
    specs = [S.Spec.from_type(d.schema[column].dataType) for d in (one, two)]
    both = [s for s in specs if s is not None]
    target = both[0].merged(both[1]) if len(both) == 2 else both[0] if both else None
    return align(one, column, target).unionByName(align(two, column, target))


def merge_patch(df: DataFrame, *columns: str, name: str = "merged") -> DataFrame:
    """df with the merge of plain or shredded columns; shredded inputs give a result on the union of their lanes."""
    readers = [Reader(df, c) for c in columns]
    merged = C.merge_patch(*[r.plain for r in readers])
    target = None
    for r in readers:
        if r.spec is not None:
            target = r.spec if target is None else target.merged(r.spec)
    return df.withColumn(name, merged if target is None else C.shred(merged, target))


def diff(df: DataFrame, prev: str, cur: str, *, arrays: str = "atomic", name: str = "diff") -> DataFrame:
    """df with the diff of two columns; where both are shredded alike, equal rows are told by comparing columns."""
    a, b = Reader(df, prev), Reader(df, cur)
    if a.spec is not None and a.spec == b.spec:
        whole = C.diff_shredded(a.col, b.col, a.spec, arrays)
    else:
        whole = C.diff(a.plain, b.plain, arrays)
    if a.spec is not None and a.spec == b.spec and a.spec.scalars == a.spec.lanes:
        same = a.col["residual"].eqNullSafe(b.col["residual"])
        for x in a.spec.lanes:
            same = same & a.col["shreds"].getField(x.name).eqNullSafe(b.col["shreds"].getField(x.name))
        # Python sees NULLs, which cost nothing, on rows without a change
        change = C.diff_shredded(F.when(~same, a.col), F.when(~same, b.col), a.spec, arrays)
        whole = F.when(same, F.lit("{}")).otherwise(change)
    return df.withColumn(name, whole)
