"""Scalar types of projections and lanes: the lossless gate and the conversion ladder."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal, InvalidOperation

from quillon.functions.canon import DocError, Num, scalar_text, type_name

TYPES = {"BIGINT": "bigint", "UBIGINT": "decimal(20,0)", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
_RANGE = {"BIGINT": (-(2**63), 2**63 - 1), "UBIGINT": (0, 2**64 - 1)}
_TRUE, _FALSE = {"true", "t", "1", "yes", "y"}, {"false", "f", "0", "no", "n"}
_INT = re.compile(r"[-+]?[0-9]+(?:_[0-9]+)*\Z")
_RADIX = re.compile(r"0[xX][0-9a-fA-F]+\Z|0[bB][01]+\Z")
_DEC = re.compile(r"[-+]?(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?\Z")


def type_of(name: str) -> str:
    out = name.strip().upper() if isinstance(name, str) else ""
    if out not in TYPES:
        raise DocError(f"unsupported type {name!r}")
    return out


def fits(v, kind: str, roundtrip: bool = False) -> bool:
    """Whether a lane of this type can hold the value without loss of its text."""
    if kind == "VARCHAR":
        return isinstance(v, str)
    if kind == "BOOLEAN":
        return isinstance(v, bool)
    if isinstance(v, bool):
        return False
    if kind == "DOUBLE":
        from quillon.functions.canon import format_double

        if not isinstance(v, Num):
            return False
        if v.binary:
            return True
        return roundtrip and abs(float(v)) != float("inf") and format_double(float(v)) == v.text
    low, high = _RANGE[kind]
    return isinstance(v, int) and low <= v <= high


def lane_value(v, kind: str):
    """A fitting value as the column type of its lane holds it."""
    if kind == "UBIGINT":
        return Decimal(v)
    return float(v) if kind == "DOUBLE" else v


def _whole(x: Decimal, kind: str, how: str):
    try:
        n = int(x.to_integral_value(rounding=how))
    except (InvalidOperation, OverflowError, ValueError):
        return None
    low, high = _RANGE[kind]
    return n if low <= n <= high else None


def _convert(v, kind: str):
    """The value as kind, or None where no conversion is defined."""
    if kind == "VARCHAR":
        return v if isinstance(v, str) else scalar_text(v)
    if kind == "BOOLEAN":
        if isinstance(v, bool):
            return v
        if isinstance(v, str):
            low = v.lower()
            return True if low in _TRUE else False if low in _FALSE else None
        return float(v) != 0
    if kind == "DOUBLE":
        if isinstance(v, str):
            s = v.strip().lower()
            if _DEC.match(s):
                return float(s.replace("_", ""))
            return float(s) if s.lstrip("+-") in ("nan", "inf", "infinity") else None
        return float(v)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return _whole(Decimal(v), kind, ROUND_HALF_EVEN)
    if isinstance(v, Num):
        return _whole(Decimal(float(v)) if v.binary else Decimal(v.text), kind, ROUND_HALF_EVEN if v.binary else ROUND_HALF_UP)
    s = v.strip()
    if _RADIX.match(s):
        return _whole(Decimal(int(s.lower(), 0)), kind, ROUND_HALF_UP)
    if not (_INT.match(s) or _DEC.match(s)):
        return None
    if kind == "UBIGINT" and s.startswith("-") and Decimal(s.replace("_", "")) != 0:
        return None
    return _whole(Decimal(s.replace("_", "")), kind, ROUND_HALF_UP)


def coerce(v, kind: str, mode: str, where: str):
    """A leaf as kind: convert, null for what is not of the type, or fail for what cannot be converted.

    Missing values and JSON null are NULL in all modes; containers are NULL, or fail.
    """
    if v is None:
        return None
    if mode == "null":
        exact = {
            "VARCHAR": isinstance(v, str),
            "BOOLEAN": isinstance(v, bool),
            "DOUBLE": isinstance(v, int | Num) and not isinstance(v, bool),
        }.get(kind)
        if exact is None:
            exact = fits(v, kind)
        if not exact:
            return None
    out = None if isinstance(v, dict | list) else _convert(v, kind)
    if out is None and mode == "fail":
        raise DocError(f"cannot convert value at {where} from {type_name(v)} to {kind}")
    return Decimal(out) if kind == "UBIGINT" and out is not None else out
