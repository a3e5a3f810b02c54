"""Documents from typed columns: structs become shredded documents whose lanes are the columns themselves."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import canon, path as P
from quillon.functions.canon import DocError, Num, format_double, render
from quillon.functions.columns import _udf
from quillon.operators import shred as S

MAX_DEPTH = 16
_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def embedded(kind: T.DataType, field: T.StructField | None) -> bool:
    """Whether a string field is marked as a document (metadata {"document": true})."""
    return isinstance(kind, T.StringType) and field is not None and bool(field.metadata.get("document"))


def lane_kind(kind: T.DataType) -> str | None:
    """The lane type of a column type, or None where only the residual holds it exactly."""
    if isinstance(kind, T.BooleanType):
        return "BOOLEAN"
    if isinstance(kind, _INTS):
        return "BIGINT"
    if isinstance(kind, T.DecimalType):
        return "UBIGINT" if (kind.precision, kind.scale) == (20, 0) else None
    if isinstance(kind, T.FloatType | T.DoubleType):
        return "DOUBLE"
    if isinstance(kind, T.StringType | T.DateType | T.TimestampType | T.TimestampNTZType | T.BinaryType | T.DayTimeIntervalType):
        return "VARCHAR"
    return None


def lane_column(c: Column, kind: T.DataType) -> Column:
    """The column as its lane holds it."""
    if isinstance(kind, T.FloatType | T.DoubleType):
        wide = c.cast("double")
        finite = ~(F.isnan(wide) | (F.abs(wide) == float("inf")))
        return F.when(wide.isNull() | finite, wide).otherwise(F.raise_error(F.lit("non-finite number")).cast("double"))
    if isinstance(kind, _INTS):
        return c.cast("long")
    if isinstance(kind, T.DecimalType):
        return F.when(c.isNull() | (c >= 0), c).otherwise(F.raise_error(F.lit("negative value in an unsigned column")).cast(kind))
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, T.TimestampType):
        return F.concat(_clock(F.to_utc_timestamp(c, F.current_timezone())), F.lit("+00"))
    if isinstance(kind, T.TimestampNTZType):
        return _clock(c)
    if isinstance(kind, T.BinaryType | T.DayTimeIntervalType):
        return _udf(T.StringType(), lambda v: scalar(v), c)
    return c


def _clock(c: Column) -> Column:
    """Date and time to the second, and as many decimals as there are."""
    whole = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.regexp_replace(whole, r"\.?0+$", "")


def scalar(v):
    """A Python value of any column type as a tree."""
    if v is None or isinstance(v, bool | int | str | Num):
        return v
    if isinstance(v, float):
        if not math.isfinite(v):
            raise DocError("non-finite number")
        return Num(format_double(v), True)
    if isinstance(v, Decimal):
        return int(v) if v == v.to_integral_value() and v.as_tuple().exponent == 0 else Num(format(v, "f"))
    if isinstance(v, datetime.datetime):
        text = v.astimezone(datetime.UTC).replace(tzinfo=None) if v.tzinfo else v
        out = text.strftime("%Y-%m-%d %H:%M:%S") + (f".{text.microsecond:06d}".rstrip("0") if text.microsecond else "")
        return out + ("+00" if v.tzinfo else "")
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, bytes | bytearray):
        return "".join(f"\\x{b:02X}" if b < 32 or b > 126 or b in (34, 39, 92) else chr(b) for b in bytes(v))
    if isinstance(v, datetime.timedelta):
        sign = "-" if v < datetime.timedelta(0) else ""
        v = abs(v)
        hours, rest = divmod(v.seconds, 3600)
        clock = f"{hours:02d}:{rest // 60:02d}:{rest % 60:02d}" + (f".{v.microseconds:06d}".rstrip("0") if v.microseconds else "")
        days = f"{v.days} day{'s' if v.days != 1 else ''}" if v.days else ""
        return sign + " ".join(x for x in (days, clock if v.seconds or v.microseconds or not days else "") if x)
    raise TypeError(f"no document value for {type(v).__name__}")


def tree_of(v, kind: T.DataType, field: T.StructField | None = None):
    """The tree of a value of a column type."""
    if v is None:
        return None
    if embedded(kind, field):
        return canon.parse(v)
    if isinstance(kind, T.StructType):
        if spec := S.Spec.from_type(kind):
            return S.reconstruct_tree(v, spec, canon.parse)
        return {f.name: tree_of(v[f.name], f.dataType, f) for f in kind.fields}
    if isinstance(kind, T.MapType):
        out: dict = {}
        for k, x in v if isinstance(v, list) else v.items():
            name = canon.text_of(scalar(k))
            if name in out:
                raise DocError(f"two map keys render as {name!r}")
            out[name] = tree_of(x, kind.valueType)
        return out
    if isinstance(kind, T.ArrayType):
        return [tree_of(x, kind.elementType) for x in v]
    if isinstance(kind, T.TimestampType) and isinstance(v, datetime.datetime) and v.tzinfo is None:
        v = v.replace(tzinfo=datetime.UTC)
    return scalar(v)


def supported(kind: T.DataType) -> None:
    """Raises TypeError for a type that has no document form."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            supported(f.dataType)
    elif isinstance(kind, T.MapType):
        supported(kind.keyType)
        supported(kind.valueType)
    elif isinstance(kind, T.ArrayType):
        supported(kind.elementType)
    elif lane_kind(kind) is None and not isinstance(kind, T.DecimalType | T.NullType):
        raise TypeError(f"no document form for {kind.simpleString()}")


def _expressible(kind: T.DataType, field: T.StructField | None = None) -> bool:
    """Whether Spark's own JSON writer gives canonical text of a value, once structs have their fields sorted."""
    if isinstance(kind, T.StructType):
        names = kind.fieldNames()
        return len(set(names)) == len(names) and S.Spec.from_type(kind) is None and all(_expressible(f.dataType, f) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _expressible(kind.elementType)
    if embedded(kind, field):
        return False
    return isinstance(kind, T.BooleanType | T.StringType | T.DateType | T.TimestampType | T.TimestampNTZType) or isinstance(kind, _INTS)


def _sorted(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        made = F.struct(*[_sorted(c.getField(f.name), f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name.encode())])
        return F.when(c.isNotNull(), made)
    if isinstance(kind, T.ArrayType):
        e = kind.elementType
        return F.transform(c, lambda x: _sorted(x, e)) if isinstance(e, T.StructType | T.ArrayType) or not _same_text(e) else c
    return c if _same_text(kind) else lane_column(c, kind)


def _same_text(kind: T.DataType) -> bool:
    return isinstance(kind, T.BooleanType | T.StringType) or isinstance(kind, _INTS)


def plain(c: Column, kind: T.DataType) -> Column:
    """A struct, map or array column as a plain document.

    Structs and arrays of booleans, integers, strings, dates and times are written by Spark itself; rows whose strings
    have control characters that it spells otherwise, and all other types, go through Python.
    """
    supported(kind)
    slow = lambda v: _udf(T.StringType(), lambda x: render(tree_of(x, kind)), v)
    if not isinstance(kind, T.StructType | T.ArrayType) or not _expressible(kind) or (isinstance(kind, T.StructType) and not kind.fields):
        return slow(c)
    text = F.to_json(_sorted(c, kind), {"ignoreNullFields": "false"})
    odd = text.rlike(r"\\u00[01][A-F]")
    return F.when(odd, slow(F.when(odd, c))).otherwise(text)


class _Plan:
    """Where each part of a struct type goes: lanes by path, and the pieces of the residual."""

    def __init__(self, kind: T.StructType):
        supported(kind)
        found: list[tuple[S.Lane, tuple[str, ...], T.StructField]] = []
        self._find(kind, (), found)
        names: dict[str, int] = {}
        for x, _, _ in found:
            names[x.name.lower()] = names.get(x.name.lower(), 0) + 1
        self.lanes = {at: (x, f) for x, at, f in found if names[x.name.lower()] == 1}
        self.spec = S.Spec(tuple(sorted((x for x, _ in self.lanes.values()), key=lambda x: x.name.encode()))) if self.lanes else None

    def _find(self, kind: T.StructType, at: tuple[str, ...], out: list) -> None:
        for f in kind.fields:
            path = (*at, f.name)
            if len(path) > MAX_DEPTH or path == ("body",) or embedded(f.dataType, f):
                continue
            name = f.name if not at and f.name and not f.name.startswith("$") else P.text(path)
            if len(path) == 1 and (not f.name or f.name.startswith("$")):
                name = P.text(path)
            t = f.dataType
            if isinstance(t, T.StructType):
                if S.Spec.from_type(t) is None:
                    self._find(t, path, out)
            elif isinstance(t, T.ArrayType):
                e = t.elementType
                if isinstance(e, T.StructType):
                    fields = tuple((x.name, lane_kind(x.dataType)) for x in e.fields)
                    if fields and all(k for _, k in fields) and not any(embedded(x.dataType, x) for x in e.fields):
                        out.append((S.Lane(name, path, None, True, fields), path, f))
                elif k := lane_kind(e):
                    out.append((S.Lane(name, path, k, True), path, f))
            elif k := lane_kind(t):
                out.append((S.Lane(name, path, k), path, f))

    def residual(self, c: Column, kind: T.StructType, at: tuple[str, ...] = ()) -> Column:
        """JSON text of what the lanes leave: nulls, skeletons and the fields without a lane."""
        pieces = []
        for f in sorted(kind.fields, key=lambda f: f.name.encode()):
            path, v = (*at, f.name), c.getField(f.name)
            head = F.lit(canon.quote(f.name) + ":")
            if path in self.lanes and not isinstance(f.dataType, T.ArrayType):
                pieces.append(F.when(v.isNull(), F.concat(head, F.lit("null"))))
                continue
            if path in self.lanes:
                body = self._skeleton(v, f.dataType.elementType)
            elif isinstance(f.dataType, T.StructType) and S.Spec.from_type(f.dataType) is None:
                body = self.residual(v, f.dataType, path)
            else:
                body = _udf(T.StringType(), lambda x, f=f: render(tree_of(x, f.dataType, f)), v)
            pieces.append(F.concat(head, F.when(v.isNull(), F.lit("null")).otherwise(body)))
        if not pieces:
            return F.lit("{}")
        return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*pieces)), ","), F.lit("}"))

    @staticmethod
    def _skeleton(v: Column, kind: T.DataType) -> Column:
        if not isinstance(kind, T.StructType):
            return F.concat(F.lit("["), F.array_join(F.transform(v, lambda _: F.lit("null")), ","), F.lit("]"))
        nulls = lambda e: F.array_compact(
            F.array(*[F.when(e.getField(f.name).isNull(), F.lit(canon.quote(f.name) + ":null")) for f in sorted(kind.fields, key=lambda f: f.name.encode())])
        )
        one = lambda e: F.when(e.isNull(), F.lit("null")).otherwise(F.concat(F.lit("{"), F.array_join(nulls(e), ","), F.lit("}")))
        return F.concat(F.lit("["), F.array_join(F.transform(v, one), ","), F.lit("]"))

    def lane(self, c: Column, at: tuple[str, ...]) -> Column:
        x, f = self.lanes[at]
        for k in at:
            c = c.getField(k)
        if not isinstance(f.dataType, T.ArrayType):
            return lane_column(c, f.dataType)
        e = f.dataType.elementType
        if not isinstance(e, T.StructType):
            return F.transform(c, lambda v: lane_column(v, e))
        made = lambda v: F.struct(*[lane_column(v.getField(s.name), s.dataType).alias(s.name) for s in e.fields])
        return F.transform(c, lambda v: F.when(v.isNotNull(), made(v)))


def document(c: Column, kind: T.StructType) -> Column:
    """A struct column as a shredded document (plain if no field has a lane). Lanes are references to the fields.

    Text is assembled in generated code; only fields without a lane, such as maps, go through Python.
    """
    if not isinstance(kind, T.StructType):
        return plain(c, kind)
    plan = _Plan(kind)
    if plan.spec is None:
        return plain(c, kind)
    lanes = {x.name: plan.lane(c, at) for at, (x, _) in plan.lanes.items()}
    types = {x.name: x.spark_type for x in plan.spec.lanes}
    took = [F.when(lanes[x.name].isNotNull(), F.struct(F.lit(x.name).alias("path"), F.lit(x.ddl).alias("type"))) for x in plan.spec.lanes]
    meta = [F.lit(plan.spec.clean).alias(S.SET), *[F.lit(None).cast("long").alias(f"{S.SPILL}{k}") for k in range(plan.spec.n_spill)]]
    out = F.struct(
        plan.residual(c, kind).alias("residual"),
        F.array_compact(F.array(*took)).alias("manifest"),
        F.struct(*meta, *[lanes[x.name].cast(types[x.name]).alias(x.name) for x in plan.spec.lanes]).alias("shreds"),
    )
    return F.when(c.isNotNull(), out)


def document_spec(kind: T.StructType) -> S.Spec | None:
    """The lanes that document() gives a struct type."""
    return _Plan(kind).spec
