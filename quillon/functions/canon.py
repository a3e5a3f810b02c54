"""JSON text to trees and trees to canonical text.

A tree is made of dict, list, str, int, bool, None and Num. Integers are Python integers; every other number is a Num that
keeps its source text byte for byte. Canonical text has keys in code point order, the last of repeated keys, and no
insignificant white space.
"""

from __future__ import annotations

import json
import math
import re
import sys

MAX_DEPTH = 1000
FORMAT_VERSION = 1

sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))


class DocError(ValueError):
    """A document, path, spec or conversion that does not hold."""


class Num:
    """A number that is not a plain integer, identified by its text. binary: it comes from a column of doubles."""

    __slots__ = ("binary", "text")

    def __init__(self, text: str, binary: bool = False):
        self.text, self.binary = text, binary

    def __eq__(self, other):
        return isinstance(other, Num) and other.text == self.text

    def __hash__(self):
        return hash(self.text)

    def __repr__(self):
        return self.text

    def __float__(self):
        return float(self.text)


def _integer(text: str):
    return int(text) if len(text) < 600 else Num(text)


def _constant(text: str):
    raise DocError(f"invalid JSON - {text} is not a JSON value")


class _Decoder:
    """A JSON decoder that can travel to executors: it is made anew there."""

    def __init__(self):
        self.decode = json.JSONDecoder(parse_float=Num, parse_int=_integer, parse_constant=_constant).decode

    def __reduce__(self):
        return _Decoder, ()


_DECODER = _Decoder()
_OPENING = re.compile(r'"(?:[^"\\]|\\.)*"|[\[{]|[\]}]', re.S)


def _depth(text: str) -> int:
    now = most = 0
    for m in _OPENING.finditer(text):
        c = m[0]
        if c in "[{":
            now += 1
            most = max(most, now)
        elif c in "]}":
            now -= 1
    return most


def parse(text: str):
    """The tree of one JSON text. Raises DocError for what is not strict JSON or nests too deeply."""
    if not text or not text.strip(" \t\n\r"):
        raise DocError("input is empty")
    if text.count("[") + text.count("{") > MAX_DEPTH and _depth(text) > MAX_DEPTH:
        raise DocError(f"nesting depth exceeds maximum of {MAX_DEPTH}")
    try:
        tree = _DECODER.decode(text)
    except DocError:
        raise
    except RecursionError:
        raise DocError(f"nesting depth exceeds maximum of {MAX_DEPTH}") from None
    except ValueError as e:
        raise DocError(f"invalid JSON - {e}") from None
    if "\\u" in text and ("\\ud" in text or "\\uD" in text):
        try:
            render(tree).encode()
        except UnicodeEncodeError:
            raise DocError("invalid JSON - lone surrogate in a string") from None
    return tree


_NUM = re.compile(r'"\\u0000N([-+0-9.eE]+)"')
_MARK = '"\\u0000N'


def quote(text: str) -> str:
    """A string as JSON text."""
    return json.dumps(text, ensure_ascii=False)


def _slow(v) -> str:
    if isinstance(v, dict):
        return "{" + ",".join(f"{quote(k)}:{_slow(v[k])}" for k in sorted(v)) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(_slow, v)) + "]"
    return scalar_text(v) if not isinstance(v, str) else quote(v)


def scalar_text(v) -> str:
    """A number, boolean or null as JSON text."""
    if v is None:
        return "null"
    if v is True:
        return "true"
    if v is False:
        return "false"
    return v.text if isinstance(v, Num) else str(v)


_FAST = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":"), check_circular=False)


def render(tree) -> str:
    """Canonical text of a tree."""
    try:
        return _FAST.encode(tree)
    except TypeError:  # there is a number that keeps its text
        return _render_numbers(tree)


def _render_numbers(tree) -> str:
    count = 0

    def number(v):
        nonlocal count
        if not isinstance(v, Num):
            raise TypeError(f"not a document value: {type(v).__name__}")
        count += 1
        return "\x00N" + v.text

    encoder = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=number, check_circular=False)
    out = encoder.encode(tree)
    # a string may itself begin like the mark; then each value is written on its own
    return _NUM.sub(r"\1", out) if out.count(_MARK) == count else _slow(tree)


def canonical(text: str) -> str:
    return render(parse(text))


def type_name(v) -> str:
    """OBJECT, ARRAY, VARCHAR, BIGINT, UBIGINT, DOUBLE, BOOLEAN or NULL."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "BOOLEAN"
    if isinstance(v, str):
        return "VARCHAR"
    if isinstance(v, dict):
        return "OBJECT"
    if isinstance(v, list):
        return "ARRAY"
    if isinstance(v, int):
        if -(2**63) <= v < 2**63:
            return "BIGINT"
        if 0 <= v < 2**64:
            return "UBIGINT"
    return "DOUBLE"


def text_of(v) -> str | None:
    """What a text read of a value gives: strings bare, null as NULL, containers as canonical text."""
    if v is None:
        return None
    if isinstance(v, str):
        return v
    return render(v) if isinstance(v, dict | list) else scalar_text(v)


def format_double(x: float) -> str:
    """Shortest digits that read back as x: fixed notation for 1e-6 <= |x| < 1e21, and `.0` after whole numbers."""
    if not math.isfinite(x):
        raise DocError("non-finite number")
    if x == 0:
        return "-0.0" if math.copysign(1, x) < 0 else "0.0"
    mantissa, _, exponent = f"{x!r}".partition("e")
    sign = "-" if mantissa[0] == "-" else ""
    whole, _, part = mantissa.lstrip("-").partition(".")
    digits = (whole + part).lstrip("0")
    point = len(whole) + int(exponent or 0) - (len(whole + part) - len((whole + part).lstrip("0")))
    digits = digits.rstrip("0")
    if -6 < point <= 21:
        if point <= 0:
            return f"{sign}0.{'0' * -point}{digits}"
        if point >= len(digits):
            return f"{sign}{digits}{'0' * (point - len(digits))}.0"
        return f"{sign}{digits[:point]}.{digits[point:]}"
    rest = "." + digits[1:] if len(digits) > 1 else ""
    return f"{sign}{digits[0]}{rest}e{point - 1}"
