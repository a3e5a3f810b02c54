"""Merge, fold, overlay and diff of trees."""

import pytest
from hypothesis import given, settings

from quillon.functions import algebra as A
from quillon.functions.canon import DocError, canonical, parse, render
from tests.test_canon import docs


def patch(a, *more):
    t = parse(a)
    for m in more:
        t = A.merge_patch(t, parse(m))
    return render(t)


def test_merge_patch():
    ship = '{"hull":"oak","mast":{"height":31,"flag":"red"},"log":[4,8]}'
    assert patch(ship, '{"mast":null,"oars":12}') == '{"hull":"oak","log":[4,8],"oars":12}'
    assert patch(ship, '{"mast":{"flag":null,"crow":true}}') == '{"hull":"oak","log":[4,8],"mast":{"crow":true,"height":31}}'
    assert patch('{"tide":null}', '{"moon":"full"}') == '{"moon":"full","tide":null}'
    assert patch('{"hull":"oak"}', '{"hull":{"deck":null,"keel":9}}') == '{"hull":{"keel":9}}'
    assert patch(ship, '{"log":[null,16,{"x":null}]}').startswith('{"hull":"oak","log":[null,16,{"x":null}]')
    assert patch('"sunk"', '{"raised":1}', "[false]", '{"again":2}') == '{"again":2}'
    assert patch(ship, "null") == "null"


def test_overlay():
    f = lambda a, b: render(A.overlay(parse(a), parse(b)))
    assert f('{"hue":"teal","tone":null}', '{"hue":"grey","tone":5,"grain":0.5,"gloss":null}') == '{"grain":0.5,"hue":"teal","tone":null}'
    assert f('{"frame":{"w":30}}', '{"frame":{"w":99,"h":40}}') == '{"frame":{"h":40,"w":30}}'
    assert f('"plain"', '{"hue":"grey"}') == '"plain"'


def fold(*texts):
    acc = None
    for t in texts:
        acc = A.fold(acc, parse(t))
    return render(acc)


def test_fold():
    assert fold('{"jam":["fig","plum"],"tea":3}', '{"jam":null,"rye":true}') == '{"jam":["fig","plum"],"rye":true,"tea":3}'
    assert fold('{"jam":"fig"}', "false") == "false"
    assert fold('"toast"', '{"tea":3,"rye":null}') == '{"tea":3}'
    assert fold('{"rye":null}') == "{}"
    assert fold('{"shelf":{"top":null}}', '{"tea":3}') == '{"tea":3}'
    assert fold('{"shelf":{"top":"jar"}}', '{"shelf":{"low":{"back":null}}}') == '{"shelf":{"top":"jar"}}'


def diff(a, b, mode="atomic"):
    x = A.NULL if a is None else parse(a)
    y = A.NULL if b is None else parse(b)
    return render(A.diff(x, y, mode))


@pytest.mark.parametrize(
    ("a", "b", "mode", "want"),
    [
        ('{"elm":70}', '{"elm":70}', "atomic", "{}"),
        ('{"ash":"tall","elm":70}', '{"elm":70}', "atomic", '{"ash":null}'),
        ('{"oak":{"age":80,"rings":[3]}}', '{"oak":{"age":81,"rings":[3]}}', "atomic", '{"oak":{"age":81}}'),
        ('{"fir":false}', '{"fir":{}}', "atomic", '{"fir":{}}'),
        ('{"oak":{"age":80}}', "{}", "atomic", '{"oak":null}'),
        (None, '{"yew":"old"}', "atomic", '{"yew":"old"}'),
        ('{"yew":"old"}', None, "atomic", '{"yew":null}'),
        (None, None, "atomic", "{}"),
        ('"leaf"', '"root"', "atomic", '"root"'),
        ("-2.5", "-2.5", "atomic", "{}"),
        ('{"sap":12}', '{"sap":12.0}', "atomic", '{"sap":12.0}'),
        ('{"nests":["wren","rook"]}', '{"nests":["rook","wren"]}', "atomic", '{"nests":["rook","wren"]}'),
        ('{"nests":["wren"]}', '{"nests":[]}', "atomic", '{"nests":[]}'),
        ('{"nests":["wren","rook"]}', '{"nests":["rook","wren"]}', "counts", "{}"),
        ('{"nests":["wren","wren","owl","rook"]}', '{"nests":["owl","owl","rook"]}', "counts", '{"nests":{"added":1,"removed":2}}'),
        ("{}", '{"nests":["owl","rook","owl"]}', "counts", '{"nests":{"added":3,"removed":0}}'),
        ("{}", '{"nests":[]}', "counts", "{}"),
        ("{}", '{"nests":[]}', "atomic", '{"nests":[]}'),
        ('{"nests":["owl",null,null]}', '{"nests":["owl",null]}', "elements", '{"nests":{"added":[],"removed":[null]}}'),
        ('{"nests":["wren","wren","owl"]}', '{"nests":["owl","rook","wren"]}', "elements", '{"nests":{"added":["rook"],"removed":["wren"]}}'),
        ('{"nests":[{"eggs":4}]}', '{"nests":[{"eggs":4.0}]}', "counts", '{"nests":{"added":1,"removed":1}}'),
        ('{"nests":["owl"]}', '{"nests":"gone"}', "counts", '{"nests":"gone"}'),
        ('["owl"]', '["owl","rook","rook"]', "counts", '{"added":2,"removed":0}'),
    ],
)
def test_diff(a, b, mode, want):
    assert diff(a, b, mode) == want


def test_array_mode():
    assert A.array_mode(" Counts ") == "counts"
    with pytest.raises(DocError):
        A.array_mode("other")


def bare(v):
    return {k: bare(x) for k, x in v.items() if x is not None} if isinstance(v, dict) else v


@settings(max_examples=200, deadline=None)
@given(docs, docs)
def test_patch_of_diff(a, b):
    a = a if isinstance(a, dict) else {"v": a}
    b = bare(b if isinstance(b, dict) else {"v": b})
    assert render(A.merge_patch(a, A.diff(a, b))) == render(b)


@settings(max_examples=100, deadline=None)
@given(docs)
def test_diff_with_itself_is_empty(a):
    assert render(A.diff(a, a)) == "{}"


def test_fold_is_stable_under_canonical_text():
    assert canonical(fold('{"b":1.50,"a":[{"z":1,"y":2}]}')) == '{"a":[{"y":2,"z":1}],"b":1.50}'
