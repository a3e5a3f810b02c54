"""Shredded documents: typed lanes beside a residual, without loss.

A shredded column is a struct of `residual` (canonical text), `manifest` (what was taken from this row, with types) and
`shreds` (`$set`, one `$spill$k` per 63 scalar lanes, and the lanes by name). Whatever does not fit its lane stays in the
residual. `$set` is a hash of the lanes, its lowest bit flipped on rows where a value stayed behind.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from decimal import Decimal
from functools import cached_property
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillon.functions import coerce, path as P
from quillon.functions.canon import DocError, Num, format_double, render

SET, SPILL = "$set", "$spill$"
BITS = 63
_STRUCT = re.compile(r"STRUCT\s*\((.*)\)\s*\[\s*\]\Z", re.I | re.S)
_SPARK = {
    "BIGINT": T.LongType(),
    "UBIGINT": T.DecimalType(20, 0),
    "DOUBLE": T.DoubleType(),
    "VARCHAR": T.StringType(),
    "BOOLEAN": T.BooleanType(),
}


@dataclass(frozen=True)
class Lane:
    """One lane: its name and steps; kind is the scalar type, or that of the elements, or the subfields of objects."""

    name: str
    path: P.Path
    kind: str | None
    array: bool = False
    fields: tuple[tuple[str, str], ...] = ()

    @property
    def scalar(self) -> bool:
        return not self.array

    @property
    def ddl(self) -> str:
        if self.fields:
            return "STRUCT(" + ", ".join(f"{identifier(n)} {k}" for n, k in self.fields) + ")[]"
        return self.kind + ("[]" if self.array else "")

    @property
    def spark_type(self) -> T.DataType:
        if self.fields:
            return T.ArrayType(T.StructType([T.StructField(n, _SPARK[k]) for n, k in self.fields]))
        return T.ArrayType(_SPARK[self.kind]) if self.array else _SPARK[self.kind]


def identifier(name: str) -> str:
    return name if re.fullmatch(r"[a-z_][a-z0-9_]*", name) else '"' + name.replace('"', '""') + '"'


def _subfields(text: str) -> tuple[tuple[str, str], ...]:
    out = []
    for m in re.finditer(r'\s*("(?:[^"]|"")*"|[^\s,"]+)\s+([A-Za-z]+)\s*(?:,|\Z)', text):
        name = m[1][1:-1].replace('""', '"') if m[1].startswith('"') else m[1]
        out.append((name, coerce.type_of(m[2])))
    if not out:
        raise DocError(f"no subfields in STRUCT({text})[]")
    return tuple(out)


def lane(name: str, kind) -> Lane:
    """A lane from a spec entry: a type name, 'T[]', 'STRUCT(a T, ...)[]', [T] or [{a: T}]."""
    if not name or name == "body" or (name.startswith("$") and not name.startswith("$.")):
        raise DocError(f"{name!r} is reserved or not a shred name: write $.key")
    steps = P.parse(name) if name.startswith("$") else (name,)
    if not all(isinstance(s, str) for s in steps):
        raise DocError(f"a shred path has no array index: {name!r}")
    if isinstance(kind, list):
        if len(kind) != 1:
            raise DocError(f"unsupported type for shred {name!r}")
        inner = kind[0]
        if isinstance(inner, dict):
            return Lane(name, steps, None, True, tuple((k, coerce.type_of(v)) for k, v in inner.items()))
        return Lane(name, steps, coerce.type_of(inner), True)
    if not isinstance(kind, str):
        raise DocError(f"unsupported type for shred {name!r}")
    if m := _STRUCT.match(kind.strip()):
        return Lane(name, steps, None, True, _subfields(m[1]))
    text = kind.strip()
    if text.endswith("[]"):
        return Lane(name, steps, coerce.type_of(text[:-2]), True)
    return Lane(name, steps, coerce.type_of(text))


@dataclass(frozen=True)
class Spec:
    """Lanes in name order."""

    lanes: tuple[Lane, ...]

    @classmethod
    def of(cls, spec: dict | Spec) -> Spec:
        if isinstance(spec, Spec):
            return spec
        if not isinstance(spec, dict) or not spec:
            raise DocError("shredding must be a non-empty constant mapping of names to types")
        made = [lane(n, k) for n, k in spec.items()]
        if len({x.path for x in made}) < len(made):
            raise DocError("two shreds name the same path")
        return cls(tuple(sorted(made, key=lambda x: x.name.encode())))

    @classmethod
    def from_type(cls, kind: T.DataType) -> Spec | None:
        """The spec of a shredded column's type, or None for any other type."""
        if not isinstance(kind, T.StructType) or kind.fieldNames() != ["residual", "manifest", "shreds"]:
            return None
        names = {str(v): k for k, v in _SPARK.items()}
        out = []
        for f in kind["shreds"].dataType.fields:
            if f.name == SET or f.name.startswith(SPILL):
                continue
            t, array = f.dataType, isinstance(f.dataType, T.ArrayType)
            t = t.elementType if array else t
            steps = P.parse(f.name) if f.name.startswith("$") else (f.name,)
            if isinstance(t, T.StructType):
                out.append(Lane(f.name, steps, None, True, tuple((x.name, names[str(x.dataType)]) for x in t.fields)))
            else:
                out.append(Lane(f.name, steps, names[str(t)], array))
        return cls(tuple(sorted(out, key=lambda x: x.name.encode())))

    @cached_property
    def scalars(self) -> tuple[Lane, ...]:
        return tuple(x for x in self.lanes if x.scalar)

    @cached_property
    def clean(self) -> int:
        """The marker of rows where every value found its lane; even, and independent of the order of lanes."""
        total = 0
        for x in self.lanes:
            total += int.from_bytes(hashlib.blake2b(f"{x.name}\x00{x.ddl}".encode(), digest_size=8).digest(), "big")
        return (total % 2**63) & ~1

    @cached_property
    def n_spill(self) -> int:
        return -(-len(self.scalars) // BITS)

    def spark_type(self) -> T.StructType:
        meta = [T.StructField(SET, T.LongType())] + [T.StructField(f"{SPILL}{k}", T.LongType()) for k in range(self.n_spill)]
        entry = T.StructType([T.StructField("path", T.StringType()), T.StructField("type", T.StringType())])
        return T.StructType(
            [
                T.StructField("residual", T.StringType()),
                T.StructField("manifest", T.ArrayType(entry)),
                T.StructField("shreds", T.StructType(meta + [T.StructField(x.name, x.spark_type) for x in self.lanes])),
            ]
        )

    def merged(self, later: Spec) -> Spec:
        """The union of two specs; the later type wins a name both have."""
        both = {x.name: x for x in self.lanes} | {x.name: x for x in later.lanes}
        return Spec(tuple(both[n] for n in sorted(both, key=str.encode)))


def storage_type(spec: dict | Spec | None = None) -> T.DataType:
    """The column type of a plain document, or of one shredded by spec."""
    return T.StringType() if spec is None else Spec.of(spec).spark_type()


def _parent(tree, steps: P.Path):
    for s in steps[:-1]:
        tree = tree.get(s) if isinstance(tree, dict) else None
    return tree if isinstance(tree, dict) else None


def shred_tree(tree, spec: Spec, roundtrip: bool = False) -> dict:
    """A row of spec's type from a tree, which is taken over and changed."""
    residual, taken, marks, values = shred_parts(tree, spec, roundtrip)
    lanes = {x.name: v for x, v in zip(spec.lanes, values, strict=True)}
    meta = {SET: marks[0]} | {f"{SPILL}{k}": m for k, m in enumerate(marks[1:])}
    manifest = [{"path": spec.lanes[k].name, "type": spec.lanes[k].ddl} for k in taken]
    return {"residual": residual, "manifest": manifest, "shreds": meta | lanes}


def shred_parts(tree, spec: Spec, roundtrip: bool = False) -> tuple[str, list[int], list, list]:
    """The residual, the numbers of the lanes that were filled, the marker with the spill bits, and the lanes' values."""
    values: list = []
    taken, spills, rank = [], [0] * spec.n_spill, 0
    for k, x in enumerate(spec.lanes):
        value = None
        bit, rank = rank, rank + x.scalar
        holder = _parent(tree, x.path)
        v = holder.get(x.path[-1], P.MISSING) if holder is not None else P.MISSING
        if v is P.MISSING or v is None:
            pass
        elif x.scalar:
            if coerce.fits(v, x.kind, roundtrip):
                value = coerce.lane_value(v, x.kind)
                del holder[x.path[-1]]
            else:
                spills[bit // BITS] |= 1 << (bit % BITS)
        elif isinstance(v, list):
            value = _lift_objects(v, x.fields, roundtrip) if x.fields else _lift_scalars(v, x.kind, roundtrip)
        values.append(value)
        if value is not None:
            taken.append(k)
    return render(tree), taken, [spec.clean ^ 1 if any(spills) else spec.clean, *[s or None for s in spills]], values


def is_shredded(kind: pa.DataType) -> bool:
    return pa.types.is_struct(kind) and [f.name for f in kind] == ["residual", "manifest", "shreds"]


def to_arrow(rows: list[tuple | None], spec: Spec) -> pa.Array:
    """What shred_parts gives per row (None for NULL) as an array of spec's type, built column by column."""
    kind = to_arrow_type(spec.spark_type())
    null = pa.array([r is None for r in rows], pa.bool_())
    blank = (None, (), [None] * (1 + spec.n_spill), [None] * len(spec.lanes))
    parts = [blank if r is None else r for r in rows]
    where = [k for _, taken, _, _ in parts for k in taken]
    at = pa.array(where, pa.int32())
    names = [pa.array([getattr(x, n) for x in spec.lanes], pa.string()).take(at) for n in ("name", "ddl")]
    ends = list(accumulate((len(taken) for _, taken, _, _ in parts), initial=0))
    starts = [None if n else e for n, e in zip(null.to_pylist(), ends, strict=False)]
    entry = kind.field("manifest").type.value_type
    manifest = pa.ListArray.from_arrays(pa.array([*starts, ends[-1]], pa.int32()), pa.StructArray.from_arrays(names, fields=list(entry)))
    shreds = kind.field("shreds").type
    fields = list(shreds)
    n_meta = 1 + spec.n_spill
    cols = [pa.array([m[k] for _, _, m, _ in parts], fields[k].type) for k in range(n_meta)]
    cols += [pa.array([v[k] for _, _, _, v in parts], fields[n_meta + k].type) for k in range(len(spec.lanes))]
    residual = pa.array([r for r, _, _, _ in parts], pa.string())
    lanes = pa.StructArray.from_arrays(cols, fields=fields, mask=null)
    return pa.StructArray.from_arrays([residual, manifest.cast(kind.field("manifest").type), lanes], fields=list(kind), mask=null)


def from_arrow(array: pa.Array) -> list[dict | None]:
    """The rows of an array of a shredded type, read column by column; rows with equal manifests share one list."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    live = array.is_valid().to_pylist()
    residual, manifest, shreds = array.flatten()
    names = [f.name for f in shreds.type]
    lanes = [c.to_pylist() for c in shreds.flatten()]
    entries = manifest.flatten()
    paths, types = (c.to_pylist() for c in entries.flatten())
    sizes = pc.list_value_length(manifest).to_pylist()
    known: dict[tuple, list[dict]] = {}
    out: list[dict | None] = []
    at = 0
    rows = zip(*lanes, strict=True) if lanes else [()] * len(array)
    for alive, text, n, row in zip(live, residual.to_pylist(), sizes, rows, strict=True):
        some = (*paths[at : at + (n or 0)], *types[at : at + (n or 0)])
        at += n or 0
        if some not in known:
            known[some] = [{"path": p, "type": t} for p, t in zip(some[: len(some) // 2], some[len(some) // 2 :], strict=True)]
        out.append({"residual": text, "manifest": known[some], "shreds": dict(zip(names, row, strict=True))} if alive else None)
    return out


def _lift_scalars(v: list, kind: str, roundtrip: bool) -> list:
    out = []
    for i, e in enumerate(v):
        if e is not None and coerce.fits(e, kind, roundtrip):
            out.append(coerce.lane_value(e, kind))
            v[i] = None
        else:
            out.append(None)
    return out


def _lift_objects(v: list, fields: tuple[tuple[str, str], ...], roundtrip: bool) -> list:
    out = []
    for e in v:
        if not isinstance(e, dict):
            out.append(None)
            continue
        row = {}
        for name, kind in fields:
            got = e.get(name)
            if got is not None and coerce.fits(got, kind, roundtrip):
                row[name] = coerce.lane_value(got, kind)
                del e[name]
            else:
                row[name] = None
        out.append(row)
    return out


def from_lane(v, kind: str):
    if kind == "UBIGINT":
        return int(v) if isinstance(v, Decimal | int) else v
    return Num(format_double(v), True) if kind == "DOUBLE" else v


def check_manifest(row: dict, spec: Spec) -> None:
    """Raises if a row was shredded with a lane that its type no longer has, or has with another type."""
    have = {x.name: x.ddl for x in spec.lanes}
    for m in row["manifest"] or ():
        if have.get(m["path"]) != m["type"]:
            raise DocError(f"row was shredded with shred '{m['path']} {m['type']}', which is missing here")


def reconstruct_tree(row: dict, spec: Spec, parse):
    """The tree of a shredded row. Lanes fill what the residual lacks; list lanes fill the residual's skeletons."""
    check_manifest(row, spec)
    tree = parse(row["residual"])
    taken = {m["path"] for m in row["manifest"] or ()}
    for x in sorted(spec.lanes, key=lambda x: len(x.path)):
        value = row["shreds"].get(x.name)
        if value is None or x.name not in taken:
            continue
        holder = _parent(tree, x.path)
        if holder is None:
            raise DocError(f"shred {x.name!r} has no place in the residual")
        if x.scalar:
            holder.setdefault(x.path[-1], from_lane(value, x.kind))
            continue
        skeleton = holder.get(x.path[-1])
        if not isinstance(skeleton, list) or len(skeleton) != len(value):
            raise DocError(f"shred {x.name!r} is not as long as its skeleton")
        for i, e in enumerate(value):
            if e is None:
                continue
            if not x.fields:
                skeleton[i] = from_lane(e, x.kind)
            elif isinstance(skeleton[i], dict):
                for name, kind in x.fields:
                    if e.get(name) is not None:
                        skeleton[i].setdefault(name, from_lane(e[name], kind))
    return tree


def valid_row(row: dict, spec: Spec | None, parse) -> bool:
    """Whether a stored row is canonical and keeps the lane, spill and skeleton rules."""
    try:
        if spec is None:
            return render(parse(row)) == row
        residual = row["residual"]
        if residual is None or render(parse(residual)) != residual:
            return False
        again = shred_tree(reconstruct_tree(row, spec, parse), spec, True)
        meta = row["shreds"]
        dirty = any(meta.get(f"{SPILL}{k}") for k in range(spec.n_spill))
        if meta.get(SET) != (spec.clean ^ 1 if dirty else spec.clean):
            return False
        bit = 0
        for x in spec.lanes:
            if x.scalar:
                spilled = ((meta.get(f"{SPILL}{bit // BITS}") or 0) >> (bit % BITS)) & 1
                bit += 1
                if spilled and meta.get(x.name) is not None:
                    return False
        # lanes of doubles may have been left in the residual as text
        kept = {m["path"] for m in row["manifest"] or ()}
        return kept <= {m["path"] for m in again["manifest"]} and all(
            (meta.get(x.name) is not None) == (x.name in kept) for x in spec.lanes
        )
    except DocError:
        return False
