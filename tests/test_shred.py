"""Lanes, spills, markers, manifests and reconstruction."""

import copy
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.functions.canon import DocError, canonical, parse, render
from quillon.operators import shred as S
from tests.test_canon import docs


def row(text, spec, **kw):
    return S.shred_tree(parse(text), S.Spec.of(spec), **kw)


def back(r, spec):
    return render(S.reconstruct_tree(r, S.Spec.of(spec), parse))


FITS = {"BIGINT": "-40", "VARCHAR": '"reed"', "BOOLEAN": "true"}
MISFITS = {"BIGINT": '"forty"', "VARCHAR": "[0.5]", "BOOLEAN": '{"no":1}'}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(sorted(FITS)), st.sampled_from(["fit", "misfit", "null", "absent"]), st.booleans()), min_size=1, max_size=9))
def test_spill_bits_name_the_misfits(lanes):
    """Generated lanes at the root and one level down, each with a value that fits, does not, is null or is missing."""
    spec, whole, inner, want = {}, [], [], {}
    for n, (kind, state, deep) in enumerate(lanes):
        name = f"lane{n}"
        spec[f"$.box.{name}" if deep else name] = kind
        if state != "absent":
            value = {"fit": FITS[kind], "misfit": MISFITS[kind], "null": "null"}[state]
            (inner if deep else whole).append(f'"{name}":{value}')
        want[f"$.box.{name}" if deep else name] = state
    text = "{" + ",".join([*whole, '"box":{' + ",".join(inner) + "}"]) + "}"
    r = row(text, spec)
    made = S.Spec.of(spec)
    mask = sum(1 << k for k, x in enumerate(made.lanes) if want[x.name] == "misfit")
    assert r["shreds"]["$spill$0"] == (mask or None)
    assert r["shreds"]["$set"] == (made.clean ^ 1 if mask else made.clean)
    assert [m["path"] for m in r["manifest"]] == [x.name for x in made.lanes if want[x.name] == "fit"]
    assert all((r["shreds"][x.name] is not None) == (want[x.name] == "fit") for x in made.lanes)
    left = parse(r["residual"])
    for name, state in want.items():
        at = left["box"] if name.startswith("$") else left
        assert (name.split(".")[-1] in at) == (state in ("misfit", "null"))
    assert back(r, spec) == canonical(text)


def test_lanes_and_residual():
    r = row('{"port":{"crane":{"load":"salt","stops":[6,9]},"gate":"north"}}', {"$.port.gate": "VARCHAR", "$.port.crane.load": "VARCHAR"})
    assert r["residual"] == '{"port":{"crane":{"stops":[6,9]}}}'
    assert (r["shreds"]["$.port.gate"], r["shreds"]["$.port.crane.load"]) == ("north", "salt")
    assert [m["path"] for m in r["manifest"]] == ["$.port.crane.load", "$.port.gate"]


@pytest.mark.parametrize(
    "text",
    [
        '{"v":[1,"two",3,null,true,-5]}',
        '{"v":[]}',
        "{}",
        '{"v":7}',
        '{"v":null}',
        '{"v":[[1],{"a":1}]}',
        "5",
        "[1,2]",
    ],
)
def test_scalar_array_lane(text):
    for kind in ("UBIGINT[]", "BIGINT[]", "VARCHAR[]"):
        assert back(row(text, {"v": kind}), {"v": kind}) == text


@pytest.mark.parametrize(
    "text",
    [
        '{"items":[{"n":1,"s":"x","tail":9},{"n":"no"},{"n":null},null,5,{}]}',
        '{"items":[]}',
        "{}",
        '{"items":"x"}',
        '{"items":[[{"n":1}]]}',
    ],
)
def test_object_array_lane(text):
    spec = {"items": "STRUCT(n BIGINT, s VARCHAR)[]"}
    assert back(row(text, spec), spec) == canonical(text)
    assert back(row(text, {"items": [{"n": "BIGINT", "s": "VARCHAR"}]}), spec) == canonical(text)


def test_overlapping_lanes():
    spec = {"a": "BIGINT", "$.a.a": "BIGINT"}
    for text in ('{"a":1}', '{"a":{"a":1,"b":2}}', '{"a":{"a":"x"}}', "{}"):
        assert back(row(text, spec), spec) == text


def test_many_lanes_use_more_spill_words():
    spec = {f"k{i:03d}": "BIGINT" for i in range(70)}
    made = S.Spec.of(spec)
    assert made.n_spill == 2
    r = row('{"k000":"x","k069":"y","k001":5}', spec)
    assert r["shreds"]["$spill$0"] == 1 and r["shreds"]["$spill$1"] == 1 << 6
    assert back(r, spec) == '{"k000":"x","k001":5,"k069":"y"}'


def test_marker_does_not_depend_on_order():
    assert S.Spec.of({"a": "BIGINT", "b": "VARCHAR"}).clean == S.Spec.of({"b": "VARCHAR", "a": "BIGINT"}).clean
    assert S.Spec.of({"a": "BIGINT"}).clean != S.Spec.of({"a": "UBIGINT"}).clean


@pytest.mark.parametrize(
    "spec",
    [{}, None, {"body": "BIGINT"}, {"$x": "BIGINT"}, {"$": "BIGINT"}, {"$.a[0]": "BIGINT"}, {"$.a[*]": "BIGINT"}, {"a": "DATE"}, {"a": 5}, {"a": ["BIGINT", "VARCHAR"]}],
)
def test_bad_specs(spec):
    with pytest.raises(DocError):
        S.Spec.of(spec)


def test_body_can_be_spelled_as_a_path():
    assert back(row('{"body":1}', {"$.body": "BIGINT"}), {"$.body": "BIGINT"}) == '{"body":1}'


def test_narrowed_rows_fail():
    r = row('{"did":"x","n":1}', {"$.did": "VARCHAR", "n": "BIGINT"})
    with pytest.raises(DocError, match=r"row was shredded with shred '\$\.did VARCHAR'"):
        back(r, {"n": "BIGINT"})
    with pytest.raises(DocError):
        back(r, {"$.did": "BIGINT", "n": "BIGINT"})


def test_lane_as_long_as_its_skeleton():
    spec = {"v": "BIGINT[]"}
    r = row('{"v":[1,2]}', spec)
    r["shreds"]["v"] = [1]
    with pytest.raises(DocError, match="skeleton"):
        back(r, spec)
    assert not S.valid_row(r, S.Spec.of(spec), parse)


def test_type_round_trip():
    spec = S.Spec.of({"a": "BIGINT", "$.b.c": "UBIGINT", "v": "VARCHAR[]", "o": "STRUCT(x BOOLEAN, y DOUBLE)[]"})
    assert S.Spec.from_type(spec.spark_type()) == spec
    assert S.Spec.from_type(S.storage_type()) is None


kinds = st.sampled_from(["BIGINT", "UBIGINT", "DOUBLE", "VARCHAR", "BOOLEAN", "BIGINT[]", "VARCHAR[]", "STRUCT(a BIGINT, b VARCHAR)[]"])
names = st.sampled_from(["a", "b", "c", "$.a.b", "$.a.a", "$.c.d.e", "v"])
keyed = st.dictionaries(st.sampled_from(["a", "b", "c", "v", "d", "e"]), st.one_of(docs, st.dictionaries(st.sampled_from("abde"), docs, max_size=3)), max_size=5)


@settings(max_examples=300, deadline=None)
@given(keyed, st.dictionaries(names, kinds, min_size=1, max_size=4), st.dictionaries(names, kinds, min_size=1, max_size=4), st.booleans())
def test_shredding_loses_nothing(doc, spec, other, roundtrip):
    try:
        one, two = S.Spec.of(spec), S.Spec.of(other)
    except DocError:
        return
    want = render(doc)
    r = S.shred_tree(copy.deepcopy(doc), one, roundtrip)
    assert render(S.reconstruct_tree(r, one, parse)) == want
    assert S.valid_row(r, one, parse)
    again = S.shred_tree(S.reconstruct_tree(r, one, parse), two, roundtrip)
    assert render(S.reconstruct_tree(again, two, parse)) == want


def test_changed_lanes_do_not_validate():
    rng = random.Random(1)
    spec = S.Spec.of({"a": "BIGINT", "b": "VARCHAR"})
    for _ in range(20):
        r = S.shred_tree({"a": rng.randint(0, 9), "b": "x"}, spec)
        r["shreds"]["$set"] ^= 2
        assert not S.valid_row(r, spec, parse)
