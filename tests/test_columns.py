"""Column functions, construction and SQL names on Spark."""

import datetime
from decimal import Decimal

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon import sql
from quillon.functions import columns as C
from quillon.functions.canon import DocError
from quillon.operators import construct, shred as S
from quillon.plans.reader import Reader


def one(spark, column, *values):
    """column evaluated on rows (a, b, ...) of strings."""
    width = max(map(len, values))
    schema = ", ".join(f"{chr(97 + i)} string" for i in range(width))
    return [r[0] for r in spark.createDataFrame(list(values), schema).select(column.alias("x")).collect()]


def test_parse(spark):
    assert one(spark, C.doc("a"), ('{"b":1,"a":2}',), (None,)) == ['{"a":2,"b":1}', None]
    assert one(spark, C.try_doc("a"), ("oops",), ("[" * 1001,), ("1",)) == [None, None, "1"]
    with pytest.raises(PythonException, match="invalid JSON"):
        one(spark, C.doc("a"), ("oops",))


def test_extract(spark):
    doc = ('{"a.b":"flat","a":{"b":"nested","n":null,"l":[1,{"x":"y"}]}}',)
    got = lambda f, p: one(spark, f("a", p), doc)[0]
    assert got(C.extract_string, "a.b") == "flat"
    assert got(C.extract_string, "$.a.b") == "nested"
    assert got(C.extract_string, '$."a.b"') == "flat"
    assert got(C.extract, "$.a.n") == "null"
    assert got(C.extract_string, "$.a.n") is None
    assert got(C.extract, "$.a.zz") is None
    assert got(C.extract_string, "$.a.l[1]") == '{"x":"y"}'
    assert one(spark, C.extract("a", 1), ("[1,2]",)) == ["2"]
    assert one(spark, C.extract_strings("a", ["x", "$.y"]), ('{"x":1,"y":"z"}',), (None,)) == [["1", "z"], None]


def test_transform(spark):
    text = '{"purchase":{"products":[{"category":"books"},{"x":1},{"category":null},{"category":2},{"category":"games"}]},"n":"7"}'
    spec = {
        "n": "BIGINT",
        "cats": {"type": ["VARCHAR"], "path": "$.purchase.products[*].category"},
        "joined": {"type": "VARCHAR", "path": "$.purchase.products[*].category", "join_separator": ","},
        "none": {"type": ["BIGINT"], "path": "$.nothing[*]"},
    }
    (x, y) = one(spark, C.transform("a", spec), (text,), (None,))
    assert x.n == 7 and x.cats == ["books", None, None, "2", "games"] and x.joined == "books,2,games" and x.none is None
    assert y is None
    (z,) = one(spark, C.transform("a", {"v": {"type": ["VARCHAR"], "path": "$.items[*].name"}}), ('{"items":[{"name":"obj"},["arr"],{"name":"obj2"}]}',))
    assert z.v == ["obj", None, "obj2"]
    with pytest.raises(PythonException, match="cannot convert value"):
        one(spark, C.transform("a", {"n": "BIGINT"}, "fail"), ('{"n":"x"}',))


@pytest.mark.parametrize("spec", [{}, {"a": "DATE"}, {"a": {"path": "$.a"}}, {"a": {"type": "BIGINT", "path": "$.a[*]"}}, {"a": {"type": "BIGINT", "other": 1}}, {"a": {"type": ["BIGINT"], "path": "$.a"}}])
def test_bad_transforms(spec):
    with pytest.raises(DocError):
        C.transform("a", spec)


def test_entries(spark):
    flat = lambda c, t: [(e.key, e.value) for e in one(spark, c, (t,))[0]]
    assert flat(C.entries("a"), '{"a":[1,{"x.y":null}],"e":{},"l":[]}') == [("$.a[0]", "1"), ('$.a[1]."x.y"', None)]
    assert flat(C.entries("a", key_style="dotted"), "[1,2]") == [("0", "1"), ("1", "2")]
    assert flat(C.entries("a"), "5") == [("$", "5")]
    assert flat(C.entries("a"), "{}") == []
    assert flat(C.entries("a", key_style="dotted", array_style="whole_json"), '{"a":[null,1],"b":[]}') == [("a", "[null,1]"), ("b", "[]")]
    assert one(spark, C.entries("a"), (None,)) == [None]
    with pytest.raises(PythonException):
        one(spark, C.entries("a", array_style="whole_json"), ("[1]",))
    with pytest.raises(DocError):
        C.entries("a", key_style="other")


def test_array_elements(spark):
    assert one(spark, C.array_elements("a"), ("[1,null,{}]",), ("[]",), ("{}",), (None,)) == [["1", "null", "{}"], [], None, None]
    assert one(spark, C.array_elements("a", "$.x"), ('{"x":[[1]]}',)) == [["[1]"]]


def test_introspection(spark):
    assert one(spark, C.type_of("a"), ("null",), ("[]",)) == ["NULL", "ARRAY"]
    assert one(spark, C.type_of("a", "x"), ("{}",)) == [None]
    assert one(spark, C.keys("a"), ('{"a":1,"b":2}',), ("[]",), ("5",)) == [["a", "b"], None, None]
    assert one(spark, C.keys("a", "$.x"), ('{"x":{"q":1}}',), ('{"x":5}',)) == [["q"], None]
    assert one(spark, C.array_length("a"), ("[1,2]",), ("{}",)) == [2, None]
    assert one(spark, C.validate("a"), ('{"a":1}',), ('{"b":1,"a":1}',), ("{",)) == [True, False, False]


def test_merge_null_rules(spark):
    m = C.merge_patch("a", "b", "c")
    assert one(spark, m, ('{"x":1}', None, '{"y":2}'), (None, '{"x":1}', '{"z":null}'), ('{"x":1}', '{"y":1}', None)) == ['{"y":2}', '{"x":1}', None]
    assert one(spark, C.merge_patch("a"), ('{"a":null}',)) == ['{"a":null}']
    assert one(spark, C.diff("a", "b"), (None, None), (None, '{"a":1}'), ('{"a":1}', None)) == ["{}", '{"a":1}', '{"a":null}']


def test_shred_and_reshred(spark):
    spec, new = {"a": "BIGINT", "$.b.c": "VARCHAR"}, {"$.b.c": "BIGINT", "d": "VARCHAR[]"}
    rows = [('{"a":1,"b":{"c":"x"},"d":["p",1]}',), ('{"a":"no","b":5}',), (None,)]
    df = spark.createDataFrame(rows, "t string").select("t", C.shred("t", spec).alias("j"))
    got = df.select("t", C.to_json("j", spec).alias("x"), C.reconstruct(C.reshred("j", spec, new), new).alias("y"), C.validate("j", spec).alias("v")).collect()
    assert all(r.t == r.x == r.y for r in got) and [r.v for r in got] == [True, True, None]
    size = df.select(C.storage_size("j", spec).alias("s"), C.shred_manifest("j", spec).alias("m")).collect()
    assert size[0].s.shreds == 9 and [m.path for m in size[0].m] == ["$.b.c", "a"]
    assert size[1].s.shreds == 0 and size[1].m == [] and size[2].s is None


KINDS = T.StructType(
    [
        T.StructField("i", T.IntegerType()),
        T.StructField("d", T.DoubleType()),
        T.StructField("s", T.StringType()),
        T.StructField("t", T.BooleanType()),
        T.StructField("u", T.DecimalType(20, 0)),
        T.StructField("dec", T.DecimalType(10, 2)),
        T.StructField("big", T.DecimalType(38, 0)),
        T.StructField("day", T.DateType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("ntz", T.TimestampNTZType()),
        T.StructField("bin", T.BinaryType()),
        T.StructField("m", T.MapType(T.IntegerType(), T.StringType())),
        T.StructField("l", T.ArrayType(T.LongType())),
        T.StructField("o", T.ArrayType(T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.StringType())]))),
        T.StructField("n", T.StructType([T.StructField("p", T.LongType()), T.StructField("q", T.ArrayType(T.ArrayType(T.LongType())))])),
        T.StructField("j", T.StringType(), metadata={"document": True}),
    ]
)
FULL = (
    1, 2.0, '{"not":"parsed"}', True, Decimal(2**63), Decimal("1.50"), Decimal(10**30), datetime.date(2024, 1, 2),
    datetime.datetime(2024, 1, 1, 12, 0, tzinfo=datetime.UTC), datetime.datetime(2024, 1, 1, 12, 34, 56, 789000), b"\xaa\xbb",
    {1: "x", 10: "y", 2: "z"}, [1, None, 3], [(1, None), None, (None, "b")], (5, [[1], []]), '{"k":[1,2.50]}',
)
WANT = (
    '{"big":1000000000000000000000000000000,"bin":"\\\\xAA\\\\xBB","d":2.0,"day":"2024-01-02","dec":1.50,"i":1,"j":{"k":[1,2.50]},"l":[1,null,3],'
    '"m":{"1":"x","10":"y","2":"z"},"n":{"p":5,"q":[[1],[]]},"ntz":"2024-01-01 12:34:56.789","o":[{"x":1,"y":null},null,{"x":null,"y":"b"}],'
    '"s":"{\\"not\\":\\"parsed\\"}","t":true,"ts":"2024-01-01 12:00:00+00","u":9223372036854775808}'
)


def test_construct(spark):
    kind = T.StructType([T.StructField("s", KINDS)])
    df = spark.createDataFrame([(FULL,), (tuple([None] * len(KINDS)),), (None,)], kind)
    made = df.select(construct.document(F.col("s"), KINDS).alias("j"))
    spec = S.Spec.from_type(made.schema["j"].dataType)
    assert {x.name: x.ddl for x in spec.lanes} == {
        "i": "BIGINT", "d": "DOUBLE", "s": "VARCHAR", "t": "BOOLEAN", "u": "UBIGINT", "day": "VARCHAR", "ts": "VARCHAR", "ntz": "VARCHAR",
        "bin": "VARCHAR", "l": "BIGINT[]", "o": "STRUCT(x BIGINT, y VARCHAR)[]", "$.n.p": "BIGINT",
    }
    texts = [r.x for r in made.select(Reader(made, "j").plain.alias("x")).collect()]
    assert texts[0] == WANT
    assert texts[1] == "{" + ",".join(f'"{n}":null' for n in sorted(KINDS.fieldNames())) + "}"
    assert texts[2] is None
    assert all(r.v in (True, None) for r in made.select(C.validate("j", spec).alias("v")).collect())
    plain = df.select(construct.plain(F.col("s"), KINDS).alias("x")).collect()
    assert plain[0].x == WANT


def test_construct_by_spark_equals_python(spark):
    kind = T.StructType.fromDDL("z int, a string, n struct<q: array<struct<y: string, x: bigint>>, b: boolean>, d date, t timestamp, m array<array<timestamp_ntz>>")
    rows = [
        ((1, 'q"\\\n\u0001é/\x7f', ([("v", 1), None, (None, None)], True), datetime.date(2020, 1, 2), datetime.datetime(2020, 1, 2, 3, 4, 5, 60000), [[datetime.datetime(2020, 1, 1)], None, []]),),
        ((None, "\x1f \x0b \\u001F", None, None, None, None),),
        ((2, None, (None, None), None, None, [])),
        (None,),
    ]
    rows[2] = (rows[2],)
    df = spark.createDataFrame(rows, T.StructType([T.StructField("s", kind)]))
    made = df.select("s", construct.plain(F.col("s"), kind).alias("x"), construct.document(F.col("s"), kind).alias("j"))
    got = made.select("s", "x", Reader(made, "j").plain.alias("y")).collect()
    for r in got:
        want = None if r.s is None else C.canon.render(construct.tree_of(r.s.asDict(True), kind))
        assert r.x == r.y == want


def test_construct_doubles(spark):
    kind = T.StructType([T.StructField("v", T.DoubleType())])
    df = spark.createDataFrame([((x,),) for x in (1e20, 1e-7, -0.0, 2.0)], T.StructType([T.StructField("s", kind)]))
    made = df.select(construct.document(F.col("s"), kind).alias("j"))
    got = [r.x for r in made.select(Reader(made, "j").plain.alias("x")).collect()]
    assert got == ['{"v":100000000000000000000.0}', '{"v":1e-7}', '{"v":-0.0}', '{"v":2.0}']
    assert [r.x for r in made.select(Reader(made, "j").get_text("v").alias("x")).collect()][0] == "100000000000000000000.0"
    bad = spark.createDataFrame([((float("inf"),),)], T.StructType([T.StructField("s", kind)]))
    with pytest.raises(Exception, match="non-finite"):
        bad.select(construct.document(F.col("s"), kind).alias("j")).collect()


def test_construct_roots(spark):
    df = spark.createDataFrame([([{"a": 1}, None],), (None,)], "l array<map<string,int>>")
    assert [r.x for r in df.select(construct.plain(F.col("l"), df.schema["l"].dataType).alias("x")).collect()] == ['[{"a":1},null]', None]
    with pytest.raises(TypeError):
        construct.plain(F.col("v"), T.VariantType())


def test_sql_names(spark):
    sql.register(spark)
    spark.createDataFrame([('{"a":{"b":[1,2]}}',)], "d string").createOrReplaceTempView("sql_docs")
    r = spark.sql(
        """SELECT doc_extract(d, '$.a.b') AS x, doc_extract_string(d, '$.a.b[1]') AS y, doc_keys(d) AS k, doc_array_length(doc_extract(d, '$.a.b')) AS n,
           doc_type(d) AS t, try_doc('[') AS bad, doc_merge_patch(d, '{"a":null}') AS m, doc_diff(d, d) AS same, doc_validate(d) AS v,
           size(doc_entries(d)) AS e, doc_array_elements('[1,2]') AS el, doc_overlay('{"a":1}', '{"b":2}') AS o, doc_quote('x"') AS q FROM sql_docs"""
    ).first()
    assert (r.x, r.y, r.k, r.n, r.t, r.bad, r.m, r.same, r.v, r.e, r.el, r.o, r.q) == (
        "[1,2]", "2", ["a"], 2, "OBJECT", None, "{}", "{}", True, 2, ["1", "2"], '{"a":1,"b":2}', '"x\\""',
    )


def test_sql_names_see_null(spark):
    sql.register(spark)
    one = spark.sql(
        """SELECT doc_diff(NULL, '{"p":4}') AS a, doc_diff('{"p":4}', NULL) AS b, doc_diff(NULL, NULL) AS c, doc_merge_patch(NULL, '{"p":4}') AS d,
           doc_merge_patch('{"p":4}', NULL) AS e, doc_merge_patch('{"p":4}', '{"q":5}', '{"p":null}') AS f, doc_overlay(NULL, '{"p":4,"q":null}') AS g,
           doc_overlay('{"p":4}', NULL, '{"q":5}') AS h, doc_diff('{"l":[3]}', '{"l":[3,8]}', 'counts') AS i, doc_extract(NULL, '$.p') AS j,
           doc_extract('{"p":4}', NULL) AS k, doc_type('{"p":[2]}', '$.p') AS l, doc_keys('{"p":{"z":0,"y":1}}', '$.p') AS m,
           doc_array_length('{"p":[2,2]}', '$.p') AS n, doc_extract_strings('{"p":4,"s":"t"}', array('s', 'none', '$.p')) AS o,
           doc_entries('{"p":[6]}', 'dotted') AS q, doc(NULL) AS r, doc_validate(NULL) AS s"""
    ).first()
    assert one[:9] == ('{"p":4}', '{"p":null}', "{}", '{"p":4}', None, '{"q":5}', '{"p":4}', '{"p":4,"q":5}', C_COUNTS)
    assert one[9:15] == (None, None, "ARRAY", ["y", "z"], 2, ["t", None, "4"])
    assert [tuple(e) for e in one.q] == [("p.0", "6")] and one.r is None and one.s is None


C_COUNTS = '{"l":{"added":1,"removed":0}}'


def test_sql_names_match_columns_on_null(spark):
    sql.register(spark)
    docs = [None, '{"a":{"x":1}}', '{"a":{"x":2,"y":[1]},"b":null}', "3", "[1,2]"]
    df = spark.createDataFrame([(a, b) for a in docs for b in docs], "a string, b string")
    df.createOrReplaceTempView("null_pairs")
    got = spark.sql("SELECT doc_merge_patch(a, b) AS m, doc_overlay(a, b) AS o, doc_diff(a, b) AS d, a, b FROM null_pairs")
    want = df.select(C.merge_patch("a", "b").alias("m"), C.overlay("a", "b").alias("o"), C.diff("a", "b").alias("d"), "a", "b")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_sql_reads_shredded_documents(spark):
    sql.register(spark)
    spec = {"k": "BIGINT", "$.o.s": "VARCHAR", "l": "STRUCT(p BIGINT)[]"}
    texts = ['{"k":7,"l":[{"p":1,"q":"a"},3],"o":{"s":"t","u":1.50}}', '{"k":"seven","l":4}', "[5]", None]
    df = spark.createDataFrame([(t,) for t in texts], "d string").select("d", C.shred("d", spec).alias("j"))
    df.createOrReplaceTempView("shredded_docs")
    rows = spark.sql(
        """SELECT d, doc(j) = doc(d) AS same, doc_extract_string(j, 'k') AS k, doc_extract(j, '$.l[0]') AS l, doc_type(j) AS t, doc_keys(j, 'o') AS keys,
           doc_merge_patch(j, '{"k":null}') AS m, doc_diff(j, d) AS none, doc_validate(j) AS valid FROM shredded_docs"""
    ).collect()
    assert [r.same for r in rows] == [True, True, True, None]
    assert [r.k for r in rows] == ["7", "seven", None, None]
    assert [r.l for r in rows] == ['{"p":1,"q":"a"}', None, None, None]
    assert [r["keys"] for r in rows] == [["s", "u"], None, None, None]
    assert [r.none for r in rows] == ["{}"] * 4 and [r.valid for r in rows] == [True, True, True, None]
    assert [r.m for r in rows][1] == '{"l":4}'
    sql.register_transform(spark, "my_fields", {"k": "BIGINT", "s": {"type": "VARCHAR", "path": "$.o.s"}})
    sql.register_shred(spark, "my_lanes", {"k": "BIGINT"})
    got = spark.sql("SELECT my_fields(j) AS f, my_lanes(j).shreds.k AS k FROM shredded_docs").collect()
    assert [r.f and tuple(r.f) for r in got] == [(7, "t"), (None, None), (None, None), None] and [r.k for r in got] == [7, None, None, None]
    view = sql.document_view(df, "routed_docs", "j", {"k": ("k", "BIGINT"), "s": "$.o.s"})
    assert view.columns == ["d", "j", "k", "s"]
    assert [tuple(r) for r in spark.sql("SELECT k, s FROM routed_docs WHERE k > 3").collect()] == [(7, "t")]
    assert sql.suggest(spark, "shredded_docs", "d", min_presence=0.1) is not None


def test_chained_reads_are_one_parse(spark):
    texts = ['{"a":{"b":[{"c":"x"},{"c":{"d":2.50}}]}}', '{"a":7}', '{"a":{"b":null}}', "[1]", None]
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    a, b = C.extract("d", "a"), C.extract(C.extract("d", "a"), "$.b")
    got = df.select(
        C.extract_string(C.extract(b, 0), "c").alias("c"), C.extract(C.extract(b, 1), "$.c.d").alias("e"),
        C.type_of(b).alias("t"), C.keys(a).alias("k"), C.array_length(b).alias("n"), F.size(C.array_elements(a, "b")).alias("m"),
    )
    plan = got.select("c")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(d#") == 1
    assert [tuple(r) for r in got.collect()] == [("x", "2.50", "ARRAY", ["b"], 2, 2), (None, None, None, None, None, None), (None, None, "NULL", ["b"], None, None), *[(None,) * 6] * 2]
