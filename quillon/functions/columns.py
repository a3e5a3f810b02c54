"""Column functions over documents.

A plain document is a string column of canonical text; a shredded one the struct of quillon.operators.shred, whose spec
is handed in as `spec` where it cannot be read from a DataFrame (quillon.plans.reader does that). SQL NULL in, SQL NULL out,
unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from quillon.functions import algebra, canon, coerce, path as P
from quillon.functions.canon import DocError
from quillon.operators import shred as S

TEXT, TEXTS = T.StringType(), T.ArrayType(T.StringType())


def _values(array: pa.Array) -> list:
    return S.from_arrow(array) if S.is_shredded(array.type) else array.to_pylist()


def _array(rows: list, kind: pa.DataType) -> pa.Array:
    """Python values as an array; structs are built field by field, which is several times faster than row by row."""
    if not pa.types.is_struct(kind) or not kind.num_fields:
        return pa.array(rows, kind)
    cols = [_array([None if r is None else r[f.name] for r in rows], f.type) for f in kind]
    return pa.StructArray.from_arrays(cols, fields=list(kind), mask=pa.array([r is None for r in rows], pa.bool_()))


def make_udf(kind: T.DataType | S.Spec, fn: Callable, one: bool = False, nulls: bool = False):
    """An Arrow UDF of fn over Python values, of one argument or any number. NULL in gives NULL out unless nulls is set.

    For a spec, fn gives what S.shred_parts does, and the result is a shredded document. Such results are evaluated once:
    marked as not deterministic, they are neither moved below filters nor repeated for each read of a lane.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spec = kind if isinstance(kind, S.Spec) else None
    arrow = None if spec else to_arrow_type(kind)

    def run(*arrays: pa.Array) -> pa.Array:
        rows = zip(*map(_values, arrays), strict=True)
        made = [None if not nulls and None in row else fn(*row) for row in rows]
        return S.to_arrow(made, spec) if spec else _array(made, arrow)

    if one:

        def single(a: pa.Array) -> pa.Array:
            return run(a)

        call = single
    else:

        def many(*a: pa.Array) -> pa.Array:
            return run(*a)

        call = many
    udf = arrow_udf(call, spec.spark_type() if spec else kind)
    return udf.asNondeterministic() if spec else udf


def _udf(kind: T.DataType | S.Spec, fn: Callable, *cols: Column) -> Column:
    """fn over the Python values of cols, an Arrow batch at a time; rows with a NULL first column are NULL."""
    if len(cols) == 1:
        return make_udf(kind, fn, one=True)(cols[0])
    return make_udf(kind, lambda first, *row: None if first is None else fn(first, *row), nulls=True)(*cols)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# construction and rendering


def doc(text: Column | str) -> Column:
    """Canonical document of a JSON text; malformed text fails the query."""
    return _udf(TEXT, canon.canonical, _col(text))


def _try(text: str) -> str | None:
    try:
        return canon.canonical(text)
    except DocError:
        return None


def try_doc(text: Column | str) -> Column:
    """As doc, but NULL for what does not parse."""
    return _udf(TEXT, _try, _col(text))


def to_json(document: Column | str, spec: dict | S.Spec | None = None) -> Column:
    """Canonical text of a plain or shredded document."""
    return _col(document) if spec is None else reconstruct(document, spec)


def quote(text: Column | str) -> Column:
    """A string value as a document."""
    return _udf(TEXT, canon.quote, _col(text))


def shred(document: Column | str, spec: dict | S.Spec, *, roundtrip: bool = False) -> Column:
    """A plain document, or a JSON text, with the lanes of spec. roundtrip also lifts parsed fractions into DOUBLE lanes."""
    spec = S.Spec.of(spec)
    return _udf(spec, lambda t: S.shred_parts(canon.parse(t), spec, roundtrip), _col(document))


def reshred(document: Column | str, old: dict | S.Spec, new: dict | S.Spec, *, roundtrip: bool = False) -> Column:
    """A shredded document with the lanes of another spec. Doubles of a dropped lane stay doubles."""
    old, new = S.Spec.of(old), S.Spec.of(new)
    if old == new:
        return _col(document)
    return _udf(new, lambda r: S.shred_parts(S.reconstruct_tree(r, old, canon.parse), new, roundtrip), _col(document))


def reconstruct(document: Column | str, spec: dict | S.Spec) -> Column:
    """The plain document of a shredded one; fails on a row with a lane that spec lacks."""
    spec = S.Spec.of(spec)
    return _udf(TEXT, lambda r: canon.render(S.reconstruct_tree(r, spec, canon.parse)), _col(document))


# paths


def _source(document: Column | str, steps: P.Path) -> tuple[Column, P.Path]:
    """Where a read starts: one of what extract has made goes on from its document, as one read of the longer path."""
    col = _col(document)
    base, before = col.__dict__.get("_quillon_source", (col, ()))
    return base, (*before, *steps)


def extract(document: Column | str, path: str | int) -> Column:
    """The document at a path, NULL if there is none. Reads of an extracted document are fused into one parse."""
    base, steps = _source(document, P.of(path))

    def at(text: str) -> str | None:
        v = P.get(canon.parse(text), steps)
        return None if v is P.MISSING else canon.render(v)

    out = _udf(TEXT, at, base)
    out._quillon_source = (base, steps)
    return out


def extract_string(document: Column | str, path: str | int) -> Column:
    """The text of the value at a path: strings bare, JSON null and nothing NULL, containers as JSON."""
    base, steps = _source(document, P.of(path))

    def at(text: str) -> str | None:
        v = P.get(canon.parse(text), steps)
        return None if v is P.MISSING else canon.text_of(v)

    return _udf(TEXT, at, base)


def extract_strings(document: Column | str, paths: list[str | int]) -> Column:
    """The texts at several paths as one array, from a single parse."""
    steps = [P.of(p) for p in paths]

    def at(text: str) -> list[str | None]:
        tree = canon.parse(text)
        found = [P.get(tree, s) for s in steps]
        return [None if v is P.MISSING else canon.text_of(v) for v in found]

    return _udf(TEXTS, at, _col(document))


def extract_many(document: Column | str, paths: dict[str, str | int]) -> Column:
    """The texts at several paths as one struct, from a single parse."""
    steps = {n: P.of(p) for n, p in paths.items()}
    kind = T.StructType([T.StructField(n, TEXT) for n in steps])

    def at(text: str) -> dict[str, str | None]:
        tree = canon.parse(text)
        return {n: None if (v := P.get(tree, s)) is P.MISSING else canon.text_of(v) for n, s in steps.items()}

    return _udf(kind, at, _col(document))


# several reads from one parse


class Read:
    """One read at a path: what it makes of the value there (NULL if there is none), and its type."""

    def __init__(self, path, kind: T.DataType, fn: Callable):
        self.steps = () if path is None else P.of(path)
        self.path, self.spark_type, self.fn = path, kind, fn

    def of(self, tree):
        v = P.get(tree, self.steps)
        return None if v is P.MISSING else self.fn(v)


def text_at(path) -> Read:
    return Read(path, TEXT, canon.text_of)


def doc_at(path) -> Read:
    return Read(path, TEXT, canon.render)


def type_at(path=None) -> Read:
    return Read(path, TEXT, canon.type_name)


def keys_at(path=None) -> Read:
    return Read(path, TEXTS, lambda v: sorted(v) if isinstance(v, dict) else None)


def length_at(path=None) -> Read:
    return Read(path, T.LongType(), lambda v: len(v) if isinstance(v, list) else None)


def elements_at(path=None) -> Read:
    return Read(path, TEXTS, lambda v: [canon.render(x) for x in v] if isinstance(v, list) else None)


def typed_at(path, kind: str) -> Read:
    kind = coerce.type_of(kind)
    return Read(path, S._SPARK[kind], lambda v: coerce.coerce(v, kind, "convert", str(path)))


def _reads_type(reads: dict[str, Read]) -> T.StructType:
    return T.StructType([T.StructField(n, r.spark_type) for n, r in reads.items()])


def read(document: Column | str, reads: dict[str, Read], spec: dict | S.Spec | None = None) -> Column:
    """A struct of several reads from one parse (and, with spec, one reconstruction) of each document."""
    if spec is None:

        def at(text: str) -> dict:
            tree = canon.parse(text)
            return {n: r.of(tree) for n, r in reads.items()}

        return _udf(_reads_type(reads), at, _col(document))
    made = S.Spec.of(spec)

    def whole(row: dict) -> dict:
        tree = S.reconstruct_tree(row, made, canon.parse)
        return {n: r.of(tree) for n, r in reads.items()}

    return _udf(_reads_type(reads), whole, _col(document))


# transform


class Field:
    """One field of a projection: a type name, or {type, path, join_separator}."""

    def __init__(self, name: str, spec):
        self.name, self.sep = name, None
        self.list = False
        if isinstance(spec, str | list):
            self.path: P.Path = (name,)
            kind = spec
        elif isinstance(spec, dict):
            unknown = set(spec) - {"type", "path", "join_separator"}
            if unknown or "type" not in spec:
                raise DocError(f"unknown or missing entry in field {name!r}: {sorted(unknown) or ['type']}")
            kind, self.sep = spec["type"], spec.get("join_separator")
            self.path = P.of(spec["path"], strict=True, wildcard=True) if "path" in spec else (name,)
        else:
            raise DocError(f"unsupported spec of field {name!r}")
        if isinstance(kind, list):
            if len(kind) != 1:
                raise DocError(f"unsupported type of field {name!r}")
            self.list, kind = True, kind[0]
        self.kind = coerce.type_of(kind)
        wild = any(map(P.is_wild, self.path))
        if self.sep is not None and (self.kind != "VARCHAR" or self.list):
            raise DocError(f"join_separator needs a VARCHAR field: {name!r}")
        if wild != (self.list or self.sep is not None):
            raise DocError(f"a wildcard path goes with a list or a join: {name!r}")
        cut = next((i for i, s in enumerate(self.path) if P.is_wild(s)), len(self.path))
        self.head, self.tail = self.path[:cut], self.path[cut + 1 :]
        self.where = P.text(self.path)

    @property
    def spark_type(self) -> T.DataType:
        one = S._SPARK[self.kind]
        return T.ArrayType(one) if self.list else one

    def read(self, tree, mode: str):
        at = P.get(tree, self.head)
        if self.list or self.sep is not None:
            if not isinstance(at, list):
                return None
            leaves = [P.get(e, self.tail) for e in at]
            leaves = [None if v is P.MISSING else v for v in leaves]
            if self.sep is not None:
                return self.sep.join(canon.text_of(v) for v in leaves if v is not None and not isinstance(v, dict | list))
            return [None if isinstance(v, dict | list) and mode != "fail" else coerce.coerce(v, self.kind, mode, self.where) for v in leaves]
        return None if at is P.MISSING else coerce.coerce(at, self.kind, mode, self.where)


def projection(spec: dict, on_type_mismatch: str = "convert") -> tuple[T.StructType, Callable]:
    """The type of a projection, and the function from a tree to its row."""
    if not isinstance(spec, dict) or not spec:
        raise DocError("transform needs a non-empty constant mapping")
    mode = on_type_mismatch.strip().lower()
    if mode not in ("convert", "null", "fail"):
        raise DocError("on_type_mismatch must be convert, null or fail")
    fields = [Field(n, s) for n, s in spec.items()]
    return T.StructType([T.StructField(f.name, f.spark_type) for f in fields]), lambda tree: {f.name: f.read(tree, mode) for f in fields}


def transform(document: Column | str, spec: dict, on_type_mismatch: str = "convert") -> Column:
    """A struct of typed fields. Mismatches convert, become NULL ('null') or fail ('fail')."""
    kind, project = projection(spec, on_type_mismatch)
    return _udf(kind, lambda text: project(canon.parse(text)), _col(document))


# flattening

ENTRY = T.ArrayType(T.StructType([T.StructField("key", TEXT), T.StructField("value", TEXT)]))


def entry_list(tree, style: str = "jsonpath", arrays: str = "indexed_elements") -> list[dict]:
    if arrays == "whole_json" and isinstance(tree, list):
        raise DocError("a top-level array has no key of its own under whole_json")
    out: list[dict] = []

    def walk(v, key: str) -> None:
        if isinstance(v, dict):
            for k, x in v.items():
                walk(x, f"{key}.{P.key_text(k)}" if style == "jsonpath" else f"{key}.{k}" if key else k)
        elif isinstance(v, list) and arrays == "indexed_elements":
            for i, x in enumerate(v):
                walk(x, f"{key}[{i}]" if style == "jsonpath" else f"{key}.{i}" if key else str(i))
        else:
            out.append({"key": key, "value": canon.text_of(v)})

    walk(tree, "$" if style == "jsonpath" else "")
    return out


def entries(document: Column | str, *, key_style: str = "jsonpath", array_style: str = "indexed_elements") -> Column:
    """Scalar leaves as an array of (key, value); null leaves keep their key, empty containers give nothing."""
    style, arrays = key_style.strip().lower(), array_style.strip().lower()
    if style not in ("jsonpath", "dotted") or arrays not in ("indexed_elements", "whole_json"):
        raise DocError(f"unknown key_style {key_style!r} or array_style {array_style!r}")
    return _udf(ENTRY, lambda t: entry_list(canon.parse(t), style, arrays), _col(document))


def array_elements(document: Column | str, path: str | int | None = None) -> Column:
    """An array's elements as documents; NULL where there is no array."""
    base, steps = _source(document, () if path is None else P.of(path))

    def at(text: str) -> list[str] | None:
        v = P.get(canon.parse(text), steps)
        return [canon.render(x) for x in v] if isinstance(v, list) else None

    return _udf(TEXTS, at, base)


# introspection


def _at(document: Column | str, path, kind: T.DataType, fn: Callable) -> Column:
    base, steps = _source(document, () if path is None else P.of(path, strict=isinstance(path, str) and path.startswith("$")))

    def at(text: str):
        v = P.get(canon.parse(text), steps)
        return None if v is P.MISSING else fn(v)

    return _udf(kind, at, base)


def type_of(document: Column | str, path: str | int | None = None) -> Column:
    return _at(document, path, TEXT, canon.type_name)


def keys(document: Column | str, path: str | int | None = None) -> Column:
    """Sorted keys of an object, else NULL. Canonical text has them sorted, so the root needs no Python."""
    if path is None:
        return F.when(F.substring(_col(document), 1, 1) == "{", F.json_object_keys(_col(document)))
    return _at(document, path, TEXTS, lambda v: sorted(v) if isinstance(v, dict) else None)


def array_length(document: Column | str, path: str | int | None = None) -> Column:
    """Elements of an array, else NULL."""
    if path is None:
        return F.json_array_length(_col(document)).cast("long")
    return _at(document, path, T.LongType(), lambda v: len(v) if isinstance(v, list) else None)


def validate(document: Column | str, spec: dict | S.Spec | None = None) -> Column:
    """Whether a stored document keeps all rules of its form."""
    made = None if spec is None else S.Spec.of(spec)
    return _udf(T.BooleanType(), lambda r: S.valid_row(r, made, canon.parse), _col(document))


def storage_size(document: Column | str, spec: dict | S.Spec | None = None) -> Column:
    """Bytes of the residual, the manifest, the lanes and all: strings by length, other scalars by 8, booleans by 1."""
    d = _col(document)
    if spec is None:
        n = F.octet_length(d).cast("long")
        zero = F.lit(0).cast("long")
        return F.when(d.isNotNull(), F.struct(n.alias("residual"), zero.alias("manifest"), zero.alias("shreds"), n.alias("total")))

    def width(c: Column, kind: str) -> Column:
        if kind == "VARCHAR":
            return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
        return F.when(c.isNull(), F.lit(0)).otherwise(F.lit(1 if kind == "BOOLEAN" else 8)).cast("long")

    def lane_width(x: S.Lane) -> Column:
        c = d["shreds"].getField(x.name)
        if x.scalar:
            return width(c, x.kind)
        one = lambda e: sum((width(e.getField(n), k) for n, k in x.fields), F.lit(0).cast("long")) if x.fields else width(e, x.kind)
        return F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda s, e: s + F.coalesce(one(e), F.lit(0))), F.lit(0).cast("long"))

    lanes = sum(map(lane_width, S.Spec.of(spec).lanes), F.lit(0).cast("long"))
    residual = F.octet_length(d["residual"]).cast("long")
    manifest = F.aggregate(
        d["manifest"], F.lit(0).cast("long"), lambda s, m: s + F.octet_length(m["path"]) + F.octet_length(m["type"])
    )
    return F.when(
        d.isNotNull(),
        F.struct(residual.alias("residual"), manifest.alias("manifest"), lanes.alias("shreds"), (residual + manifest + lanes).alias("total")),
    )


def shred_manifest(document: Column | str, spec: dict | S.Spec | None = None) -> Column:
    """What was taken from this row, by path; empty for a plain document."""
    if spec is None:
        return F.when(_col(document).isNotNull(), F.array().cast("array<struct<path:string,type:string>>"))
    return _col(document)["manifest"]


def version() -> Column:
    return F.lit(canon.FORMAT_VERSION)


# merge and diff


def merge_patch(target: Column | str, *patches: Column | str) -> Column:
    """RFC 7396 from left to right. A NULL target is an empty document; a NULL patch gives NULL, which later ones start anew."""
    if not patches:
        return _col(target)
    return make_udf(TEXT, patch_texts, nulls=True)(_col(target), *map(_col, patches))


def patch_texts(*texts: str | None) -> str | None:
    now = None if texts[0] is None else canon.parse(texts[0])
    gone = texts[0] is None
    for t in texts[1:]:
        if t is None:
            gone = True
            continue
        now = algebra.merge_patch({} if gone else now, canon.parse(t))
        gone = False
    return None if gone else canon.render(now)


def overlay(base: Column | str, *patches: Column | str) -> Column:
    """base, with the keys that it lacks from the patches."""
    return make_udf(TEXT, overlay_texts, nulls=True)(_col(base), *map(_col, patches))


def overlay_texts(*texts: str | None) -> str | None:
    now = None if texts[0] is None else canon.parse(texts[0])
    for t in texts[1:]:
        if t is not None:
            more = canon.parse(t)
            now = algebra._bare(more) if texts[0] is None and now is None else algebra.overlay(now, more)
    return None if now is None and texts[0] is None else canon.render(now)


def diff(prev: Column | str, cur: Column | str, arrays: str = "atomic") -> Column:
    """What changed from prev to cur; `{}` for nothing, also between NULLs. Equal texts need no parse."""
    mode = algebra.array_mode(arrays)
    return make_udf(TEXT, lambda a, b: diff_texts(a, b, mode), nulls=True)(_col(prev), _col(cur))


def diff_texts(a: str | None, b: str | None, mode: str = "atomic") -> str:
    if a == b:
        return "{}"
    x = algebra.NULL if a is None else canon.parse(a)
    y = algebra.NULL if b is None else canon.parse(b)
    return canon.render(algebra.diff(x, y, mode))


def diff_shredded(prev: Column | str, cur: Column | str, spec: dict | S.Spec, arrays: str = "atomic") -> Column:
    """As diff, for two documents shredded by spec, which are reconstructed and compared in one step."""
    mode, made = algebra.array_mode(arrays), S.Spec.of(spec)

    def change(a: dict | None, b: dict | None) -> str:
        x = algebra.NULL if a is None else S.reconstruct_tree(a, made, canon.parse)
        y = algebra.NULL if b is None else S.reconstruct_tree(b, made, canon.parse)
        return canon.render(algebra.diff(x, y, mode))

    return make_udf(TEXT, change, nulls=True)(_col(prev), _col(cur))


# lanes


def double_text(value: Column | str) -> Column:
    """Canonical text of a double."""
    return _udf(TEXT, canon.format_double, _col(value))


def lane_text(c: Column, kind: str) -> Column:
    """What a text read of a lane's value gives."""
    return c if kind == "VARCHAR" else double_text(c) if kind == "DOUBLE" else c.cast("string")
