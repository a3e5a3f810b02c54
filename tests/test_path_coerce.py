"""Path grammar and the conversion ladder."""

from decimal import Decimal

import pytest

from quillon.functions import path as P
from quillon.functions.canon import DocError, Num, parse
from quillon.functions.coerce import coerce, fits


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("$", ()),
        ("$.a", ("a",)),
        ("$.a.b[2].c", ("a", "b", 2, "c")),
        ('$."a.b"."q\\"x"', ("a.b", 'q"x')),
        ('$.""', ("",)),
    ],
)
def test_parse(text, want):
    assert P.parse(text) == want
    assert P.parse(P.text(want)) == want


def test_bare_keys_and_indexes():
    assert P.of("a.b") == ("a.b",)
    assert P.of(3) == (3,)


@pytest.mark.parametrize("bad", ["$.a[-1]", "$.a[-0]", "$.a[-]"])
def test_negative_index(bad):
    with pytest.raises(DocError, match="negative array index"):
        P.parse(bad)


@pytest.mark.parametrize("bad", ["a", "$a", "$[0]", "$.a[", "$.a[x]", "$.", "$.a[99999999999999999999]", "$.a[*]"])
def test_bad_paths(bad):
    with pytest.raises(DocError):
        P.parse(bad)


def test_bad_arguments():
    with pytest.raises(DocError, match="non-negative"):
        P.of(-1)
    for bad in (None, ""):
        with pytest.raises(DocError):
            P.of(bad)
    with pytest.raises(DocError):
        P.parse("$.a[*].b[*]", wildcard=True)


@pytest.mark.parametrize(
    ("text", "kind", "want"),
    [
        ('"3.5"', "BIGINT", 4),
        ('"2.5"', "BIGINT", 3),
        ('"1e2"', "BIGINT", 100),
        ('" 12 "', "BIGINT", 12),
        ('"0x1F"', "BIGINT", 31),
        ('"1_000"', "BIGINT", 1000),
        ('"true"', "BIGINT", None),
        ('"-0.4"', "UBIGINT", None),
        ("1e30", "BIGINT", None),
        ("true", "BIGINT", 1),
        ('"t"', "BOOLEAN", True),
        ('"1"', "BOOLEAN", True),
        ('"yes"', "BOOLEAN", True),
        ('"off"', "BOOLEAN", None),
        ('"1e999"', "DOUBLE", float("inf")),
        ("true", "DOUBLE", 1.0),
        ('"x"', "DOUBLE", None),
        ("1.50", "VARCHAR", "1.50"),
        ("false", "VARCHAR", "false"),
        ("18446744073709551615", "UBIGINT", Decimal(2**64 - 1)),
        ("null", "BIGINT", None),
        ("[1]", "BIGINT", None),
    ],
)
def test_convert(text, kind, want):
    assert coerce(parse(text), kind, "convert", "$.x") == want


def test_convert_as_duckdb_does():
    import duckdb

    con = duckdb.connect()
    texts = "true|t|1|yes|y|on|TRUE|false|f|0|no|n|off| true |2|1.0||abc|-12|+12|3.5|2.5|-2.5|1e2|1.5e1|1e-1|0x1F|0b101|1_000|1__0|_1|1_|1.5_0|.5|5.|1e30".split("|")
    texts += "9223372036854775807|9223372036854775808|18446744073709551615|18446744073709551616|-0.4|-0|inf|1e999| 12 |12 3|0.49|1e|9223372036854775807.5".split("|")
    for kind in ("BIGINT", "UBIGINT", "DOUBLE", "BOOLEAN"):
        for t in texts:
            assert coerce(t, kind, "convert", "$") == con.execute(f"select try_cast(? as {kind})", [t]).fetchone()[0], (kind, t)


def test_binary_doubles_round_half_even():
    assert coerce(Num("2.5", True), "BIGINT", "convert", "$") == 2
    assert coerce(Num("3.5", True), "BIGINT", "convert", "$") == 4


def test_null_mode():
    assert coerce("7", "BIGINT", "null", "$") is None
    assert coerce(7, "BIGINT", "null", "$") == 7
    assert coerce(7, "DOUBLE", "null", "$") == 7.0
    assert coerce(7, "VARCHAR", "null", "$") is None


def test_fail_mode():
    with pytest.raises(DocError, match=r"cannot convert value at \$\.x from VARCHAR to BIGINT"):
        coerce("abc", "BIGINT", "fail", "$.x")
    with pytest.raises(DocError, match="from OBJECT to BIGINT"):
        coerce({}, "BIGINT", "fail", "$.x")
    assert coerce(None, "BIGINT", "fail", "$.x") is None


def test_gate():
    assert fits("x", "VARCHAR") and not fits(1, "VARCHAR")
    assert fits(1, "BIGINT") and not fits(parse("1.0"), "BIGINT") and not fits(2**63, "BIGINT") and not fits(True, "BIGINT")
    assert fits(2**63, "UBIGINT") and fits(0, "UBIGINT") and not fits(-1, "UBIGINT")
    assert not fits(parse("1.5"), "DOUBLE") and fits(parse("1.5"), "DOUBLE", True) and fits(Num("1.5", True), "DOUBLE")
    assert not fits(parse("1.50"), "DOUBLE", True)
    assert fits(True, "BOOLEAN") and not fits(1, "BOOLEAN")
