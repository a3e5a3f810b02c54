"""Group merges, collections, advice and statistics against small brute-force versions."""

import json
import random

import pytest
from pyspark.errors import PythonException
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import algebra, columns as C
from quillon.functions.canon import DocError, parse, render
from quillon.operators import advisor, aggregates as A


def frame(spark, rows, schema="g string, k long, d string"):
    return spark.createDataFrame(rows, schema)


def result(df, name="merged"):
    return {r["g"]: r[name] for r in df.collect()}


def test_group_merge_golden(spark):
    rows = [
        ("kept", 10, '{"crew":["ada","bo"],"deck":4}'), ("kept", 20, '{"crew":null,"mast":true}'), ("scalar", 10, '{"oar":"left"}'), ("scalar", 20, '"anchor"'),
        ("bare", 10, '{"sail":null}'), ("none", 10, None), ("gap", 20, None), ("gap", 10, '{"rope":7.25}'), (None, 10, '{"keel":[]}'),
    ]
    want = {"kept": '{"crew":["ada","bo"],"deck":4,"mast":true}', "scalar": '"anchor"', "bare": "{}", "none": None, "gap": '{"rope":7.25}', None: '{"keel":[]}'}
    assert result(A.group_merge(frame(spark, rows), ["g"], "d", ["k"])) == want


def test_group_merge_without_groups(spark):
    df = frame(spark, [("a", 2, '{"a":2}'), ("a", 1, '{"a":1,"b":1}')])
    assert [r.merged for r in A.group_merge(df, [], "d", ["k"]).collect()] == ['{"a":2,"b":1}']
    assert A.group_merge(df.limit(0), [], "d", ["k"]).count() == 0


def random_doc(rng):
    def value(depth):
        kind = rng.randrange(6)
        if kind == 0:
            return None
        if kind == 1 and depth < 2:
            return {f"n{rng.randrange(3)}": value(depth + 1) for _ in range(rng.randrange(3))}
        return [rng.randrange(9), [rng.randrange(3)], "s", True][rng.randrange(4)]

    # object keys and leaf keys never share a path
    doc = {f"leaf{rng.randrange(5)}": [None, rng.randrange(99), [1, 2.50], "x", 1.50][rng.randrange(5)] for _ in range(4)}
    for i in range(rng.randrange(3)):
        doc[f"obj{i}"] = {f"x{rng.randrange(3)}": [None, rng.randrange(9)][rng.randrange(2)] for _ in range(2)}
    return json.dumps(doc)


def test_keyed_merges_equal_ordered_folds(spark):
    rng = random.Random(11)
    rows = [(f"g{rng.randrange(12)}", i, random_doc(rng)) for i in rng.sample(range(10_000), 400)]
    df = frame(spark, rows)

    def fold(order):
        out = {}
        for g, _, d in sorted(rows, key=order):
            out[g] = algebra.fold(out.get(g), parse(d))
        return {g: render(v) for g, v in out.items()}

    up = fold(lambda r: r[1])
    assert result(A.group_merge(df, ["g"], "d", ["k"])) == up
    assert result(A.group_merge_max(df, ["g"], "d", "k")) == up
    assert result(A.group_merge_min(df, ["g"], "d", "k")) == fold(lambda r: -r[1])


def clashing(rng):
    def value(depth):
        kind = rng.randrange(5)
        if kind == 0:
            return None
        if kind < 3 and depth < 3:
            return {k: value(depth + 1) for k in rng.sample("abc", rng.randrange(4))}
        return [rng.randrange(9), [1, {"z": None}], 1.50][rng.randrange(3)]

    return json.dumps(value(0) if rng.random() < 0.2 else {k: value(1) for k in rng.sample("abc", rng.randrange(4))})


def test_ordered_merge_equals_fold_on_clashes(spark):
    rng = random.Random(17)
    rows = [(f"g{rng.randrange(60)}", i, clashing(rng)) for i in rng.sample(range(10_000), 900)]

    def fold(sign):
        out = {}
        for g, _, d in sorted(rows, key=lambda r: sign * r[1]):
            out[g] = algebra.fold(out.get(g), parse(d)) if g in out else algebra.fold(None, parse(d))
        return {g: render(v) for g, v in out.items()}

    df = frame(spark, rows).repartition(6)
    assert result(A.group_merge(df, ["g"], "d", ["k"])) == fold(1)
    assert result(A.group_merge(df, ["g"], "d", ["k"], descending=True)) == fold(-1)


def test_keyed_edges(spark):
    rows = [("a", 1, '{"a":null}'), ("b", 1, None), ("c", None, '{"x":1,"y":1}'), ("c", 0, '{"x":2}'), ("d", 1, "5"), ("d", 2, "6"), ("e", 1, "[1]")]
    want = {"a": "{}", "b": None, "c": '{"x":2,"y":1}', "d": "6", "e": "[1]"}
    assert result(A.group_merge_max(frame(spark, rows), ["g"], "d", "k")) == want
    assert result(A.group_merge_min(frame(spark, rows), ["g"], "d", "k")) == want | {"d": "5"}
    for clash in ([("a", 1, '{"x":{"y":1}}'), ("a", 2, '{"x":5}')], [("a", 1, '{"x":1}'), ("a", 2, "5")]):
        with pytest.raises(PythonException, match="is an object in one row"):
            A.group_merge_max(frame(spark, clash), ["g"], "d", "k").collect()


def test_keyed_parts_and_key_types(spark, monkeypatch):
    monkeypatch.setattr(A, "HELD_LEAVES", 3)
    rng = random.Random(13)
    rows = [(f"g{rng.randrange(3)}", rng.randrange(40), random_doc(rng)) for _ in range(200)]
    df = frame(spark, rows).repartition(5)
    whole = F.struct(F.col("k").cast("double").alias("x"), F.col("d").alias("y"))
    for merge, leaves in ((A.group_merge_max, True), (A.group_merge_min, False)):
        for key in (whole, F.col("k"), F.array("k"), F.when(F.col("k") > 5, F.col("k"))):
            want = result(A.from_leaves(A.winning_leaves(df, ["g"], "d", key, largest=leaves), ["g"]))
            assert result(merge(df, ["g"], "d", key)) == want
    assert A.group_merge_max(df.limit(0), [], "d", "k").count() == 0
    (r,) = A.group_merge_max(df, [], "d", whole).collect()
    (w,) = A.from_leaves(A.winning_leaves(df, [], "d", whole), []).collect()
    assert r == w


def test_collect(spark):
    df = frame(spark, [("a", 1, "1"), ("a", 2, None), ("a", 3, "null"), ("a", 4, "3")])
    assert result(df.groupBy("g").agg(A.group_array("d", ["k"]).alias("merged"))) == {"a": "[1,null,null,3]"}
    assert df.limit(0).agg(A.group_array("d").alias("x")).first().x is None
    assert result(df.groupBy("g").agg(A.group_array_distinct("d").alias("merged"))) == {"a": "[1,3,null]"}
    w = Window.partitionBy("g").orderBy("k").rowsBetween(-1, 0)
    assert [r.x for r in df.select("k", A.group_array_over("d", w).alias("x")).orderBy("k").collect()] == ["[1]", "[1,null]", "[null,null]", "[null,3]"]


def test_group_object(spark):
    df = frame(spark, [("b", 1, "1"), ("a", 2, None), ("b", 3, "3"), ('q"', 4, "4")])
    assert [r.object for r in A.group_object(df, [], "g", "d", "k").collect()] == ['{"a":null,"b":3,"q\\"":4}']
    with pytest.raises(Exception, match="key cannot be NULL"):
        A.group_object(frame(spark, [(None, 1, "1")]), [], "g", "d").collect()


def test_running_fold(spark):
    df = frame(spark, [("a", 1, '{"x":1}'), ("a", 2, '{"y":2}'), ("a", 3, '{"x":3}')])
    w = Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    d = df.select("k", F.collect_list("d").over(w).alias("l")).select("k", A.fold_list("l").alias("m"))
    assert [r.m for r in d.orderBy("k").collect()] == ['{"x":1}', '{"x":1,"y":2}', '{"x":3,"y":2}']


CORPUS = [
    '{"stable_int":1,"stable_str":"a","ratio":1.5,"flag":true,"meta":{"nested_int":10},"tags":[1,2,3],"items":[{"n":1,"s":"x"}],"sparse":99,"mixed":1}',
    '{"stable_int":2,"stable_str":"b","ratio":2.5,"flag":false,"meta":{"nested_int":20},"tags":[4,5],"items":[{"n":2,"s":"y"}],"mixed":2}',
    '{"stable_int":3,"stable_str":"c","ratio":3.5,"flag":true,"meta":{"nested_int":30},"tags":[6],"items":[{"n":3,"s":"z"}],"mixed":"text"}',
    '{"stable_int":4,"stable_str":"d","ratio":4.5,"flag":false,"meta":{"nested_int":40},"tags":[],"items":[],"mixed":"text"}',
]
BASE = """{"$.meta.nested_int": 'BIGINT', flag: 'BOOLEAN', items: 'STRUCT(n BIGINT, s VARCHAR)[]', %sstable_int: 'BIGINT', stable_str: 'VARCHAR', tags: 'BIGINT[]'}"""


@pytest.mark.parametrize(("kw", "extra"), [({}, ""), ({"min_fit": 0.5}, "mixed: 'BIGINT', "), ({"min_presence": 0.25}, "sparse: 'BIGINT', ")])
def test_suggest(spark, kw, extra):
    df = spark.createDataFrame([(d,) for d in CORPUS], "d string")
    assert advisor.suggest_shredding(df, "d", **kw) == BASE % extra


@pytest.mark.parametrize(
    ("texts", "want"),
    [
        (['{"big":18446744073709551615}', '{"big":10000000000000000000}'], "{big: 'UBIGINT'}"),
        (['{"k":1}', '{"k":2}', '{"k":null}'], "{k: 'BIGINT'}"),
        (['{"tags":[1,null,2]}', '{"tags":[3,4]}'], "{tags: 'BIGINT[]'}"),
        (["5", "[1]"], None),
        ([None], None),
        (['{"body":1,"$x":2}'], """{"$.$x": 'BIGINT', "$.body": 'BIGINT'}"""),
        (['{"m":{"q\\"uote":1}}'], """{"$.m.""q\\""uote""\": 'BIGINT'}"""),
    ],
)
def test_suggest_rules(spark, texts, want):
    got = advisor.suggest_shredding(spark.createDataFrame([(t,) for t in texts], "d string"), "d")
    assert got == want
    if want:
        assert C.shred("d", advisor.parse_spec(got)) is not None


def test_suggested_spec_shreds(spark):
    df = spark.createDataFrame([(d,) for d in CORPUS], "d string")
    spec = advisor.parse_spec(advisor.suggest_shredding(df, "d"))
    made = df.select("d", C.to_json(C.shred("d", spec), spec).alias("x")).collect()
    assert all(r.x == render(parse(r.d)) for r in made)


def test_suggest_errors(spark):
    df = spark.createDataFrame([("{}",)], "d string")
    with pytest.raises(DocError):
        advisor.suggest_shredding(df, "d", min_fit=1.5)
    with pytest.raises(DocError):
        advisor.suggest_shredding(df.select(C.shred("d", {"a": "BIGINT"}).alias("d")), "d")


def test_suggest_keeps_every_lane_of_many_arrays(spark):
    items = [dict.fromkeys([f"f{k:02}" for k in range(22)], 1)]
    df = spark.createDataFrame([(json.dumps({f"a{i:04}": items for i in range(3000)}),)], "d string")
    lane = "STRUCT(" + ", ".join(f"f{k:02} BIGINT" for k in range(22)) + ")[]"
    assert advisor.parse_spec(advisor.suggest_shredding(df, "d")) == {f"a{i:04}": lane for i in range(3000)}


def test_suggest_limits(spark):
    def suggest(n_paths, n_subs):
        d = {"items": [{f"k{i}": 1} for i in range(n_subs)], **{f"p{i}": 1 for i in range(n_paths - 1)}}
        return advisor.suggest_shredding(spark.createDataFrame([(json.dumps(d),)], "d string"), "d")

    assert len(advisor.parse_spec(suggest(8192, 8192))) == 8192
    with pytest.raises(DocError, match="paths"):
        suggest(8193, 1)
    with pytest.raises(DocError, match="subfields"):
        suggest(1, 8193)


def test_shred_stats(spark):
    spec = {"a": "BIGINT"}
    df = spark.createDataFrame([('{"a":5,"b":1}',), ('{"a":"x"}',), ('{"b":2}',), ('{"a":7}',), (None,)], "d string")
    (r,) = df.select(C.shred("d", spec).alias("j")).agg(advisor.shred_stats(F.col("j"), spec).alias("s")).collect()
    assert [(x.path, x.type, x.lane_rate, x.divert_rate) for x in r.s] == [("a", "BIGINT", 0.5, 0.25)]
    assert df.limit(0).select(C.shred("d", spec).alias("j")).agg(advisor.shred_stats(F.col("j"), spec).alias("s")).first().s is None


def test_several_merges_with_filters_of_shredded_documents(spark):
    rng = random.Random(41)
    rows = []
    for i in range(300):
        d = {rng.choice("pqrs"): rng.choice([i, f"t{i}", {"u": i, "v": None}, [i, None]]) for _ in range(rng.randint(0, 3))}
        d = {k: (v if not isinstance(v, dict) else v) for k, v in d.items() if k != "s" or isinstance(v, dict)}
        d = {k: v for k, v in d.items() if k == "s" or not isinstance(v, dict)}
        rows.append((i % 7, rng.choice([None, *range(20)]), i, None if i % 11 == 0 else json.dumps(d)))
    df = spark.createDataFrame(rows, "g int, k int, i int, d string")
    spec = {"p": "BIGINT", "$.s.u": "BIGINT", "q": "VARCHAR"}
    sh = df.withColumn("j", C.shred("d", spec))
    key = F.struct("k", "i")
    out = A.merges(
        sh,
        ["g"],
        a=A.Merge("d", key),
        b=A.Merge("j", key, "min"),
        c=A.Merge("j", key, "last", where=F.col("i") % 2 == 0, spec=spec),
        e=A.Merge("d", key, where=F.lit(False)),
    )
    out = out.withColumn("c", C.reconstruct("c", spec)).collect()
    want = {
        "a": A.group_merge_max(df, ["g"], "d", key, "x"),
        "b": A.group_merge_min(df, ["g"], "d", key, "x"),
        "c": A.group_merge(df.where("i % 2 = 0"), ["g"], "d", [key], "x"),
    }
    for name, frame in want.items():
        assert {r.g: r[name] for r in out} == {r.g: r.x for r in frame.collect()}
    assert {r.e for r in out} == {None}
    assert A.merges(sh.limit(0), ["g"], a=A.Merge("j", "k")).count() == 0


def test_rows_in_any_order_give_the_winners_of_a_plain_comparison(spark, monkeypatch):
    rng = random.Random(43)
    rows = [(g, rng.choice([None, *range(6)]), json.dumps({f"x{rng.randrange(8)}": rng.randrange(5) for _ in range(rng.randint(0, 6))})) for g in range(6) for _ in range(60)]
    df = spark.createDataFrame(rows, "g int, k int, d string")
    for largest in (True, False):
        best = {}
        for g, k, d in rows:
            for path, v in json.loads(d).items():
                rank = (k is not None, (k or 0) * (1 if largest else -1), str(v) if largest else "".join(chr(255 - ord(c)) for c in str(v)))
                if (g, path) not in best or rank > best[g, path][0]:
                    best[g, path] = (rank, v)
        want = {}
        for (g, path), (_, v) in best.items():
            want.setdefault(g, {})[path] = v
        for raw in (0, 3, 1000):
            monkeypatch.setattr(A, "RAW", raw)
            merge = A.group_merge_max if largest else A.group_merge_min
            assert {r.g: json.loads(r.merged) for r in merge(df, ["g"], "d", "k").collect()} == want
