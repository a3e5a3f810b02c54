"""Planned reads of shredded documents: same answers as plain reads, lanes pushed down to Parquet."""

import pytest
from pyspark.sql import functions as F

from quillon import sources
from quillon.functions import columns as C
from quillon.functions.canon import DocError, canonical
from quillon.plans import reader as R
from quillon.plans.reader import Reader

TEXTS = [
    '{"a":1,"b":{"c":"x","d":[1,2]},"s":"t","v":[1,"z"],"o":[{"x":1,"y":2}]}',
    '{"a":"misfit","b":{"c":5},"s":null}',
    '{"a":{"k":1},"b":7}',
    '{"b":{"c":null}}',
    "{}",
    "5",
    None,
]
SPEC = {"a": "BIGINT", "$.b.c": "VARCHAR", "s": "VARCHAR", "v": "BIGINT[]", "o": "STRUCT(x BIGINT)[]"}
PATHS = ["a", "$.a.k", "b", "$.b.c", "$.b.d", "$.b.d[1]", "s", "v", "$.v[1]", "$.o[0].x", "$.o[0].y", "zz"]


@pytest.fixture(scope="module")
def both(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    return df.select("i", "t", C.shred("t", SPEC).alias("j"))


def test_reads_agree(both):
    p, r = Reader(both, "t"), Reader(both, "j")
    cols = []
    for k, path in enumerate(PATHS):
        for name in ("get_text", "extract", "type_of", "keys", "array_length", "array_elements"):
            cols += [getattr(p, name)(path).alias(f"p_{name}_{k}"), getattr(r, name)(path).alias(f"r_{name}_{k}")]
        for kind in ("BIGINT", "VARCHAR"):
            cols += [p.get(path, kind).alias(f"p_{kind}_{k}"), r.get(path, kind).alias(f"r_{kind}_{k}")]
    for row in both.select(*cols).collect():
        got = row.asDict()
        for name, value in got.items():
            if name.startswith("p_"):
                assert got["r_" + name[2:]] == value, (name, PATHS[int(name.rsplit("_", 1)[1])])


def test_transform_and_lists_agree(both):
    spec = {"a": "BIGINT", "c": {"type": "VARCHAR", "path": "$.b.c"}, "x": {"type": ["BIGINT"], "path": "$.o[*].x"}}
    p, r = Reader(both, "t"), Reader(both, "j")
    for row in both.select(p.transform(spec).alias("p"), r.transform(spec).alias("r"), p.get_texts(PATHS).alias("pt"), r.get_texts(PATHS).alias("rt")).collect():
        assert row.p == row.r and row.pt == row.rt


def test_fused_reads_agree(both):
    p, r = Reader(both, "t"), Reader(both, "j")
    reads = {}
    for k, path in enumerate(PATHS):
        made = (C.text_at, C.doc_at, C.type_at, C.keys_at, C.length_at, C.elements_at)
        reads |= {f"{f.__name__}_{k}": f(path) for f in made} | {f"n_{k}": C.typed_at(path, "BIGINT")}
    some = {"d": C.text_at("$.b.d"), "z": C.text_at("zz")}
    for row in both.select("t", p.read(reads).alias("p"), r.read(reads).alias("r"), p.read(some).alias("x"), r.read(some).alias("y"), r.get("a", "BIGINT").alias("a")).collect():
        assert row.p == row.r and row.x == row.y and (row.p is None or row.p.n_0 == row.a)


def test_classes(both):
    r = Reader(both, "j")
    kinds = {p: r.classify(p) for p in PATHS}
    assert kinds["a"] == kinds["$.b.c"] == "lane"
    assert kinds["b"] == kinds["v"] == kinds["$.o[0].x"] == "reconstruct"
    assert kinds["zz"] == kinds["$.b.d"] == kinds["$.a.k"] == "residual"
    assert Reader(both, "t").classify("a") == "plain"


@pytest.mark.parametrize(("op", "value"), [("=", 1), (">", 0), ("<=", 1), ("in", [1, 2])])
def test_filters_agree(both, op, value):
    p, r = Reader(both, "t"), Reader(both, "j")
    assert sorted(x.i for x in both.where(p.where("a", op, value)).collect()) == sorted(x.i for x in both.where(r.where("a", op, value)).collect())


def test_text_filter_finds_misfits(both):
    r = Reader(both, "j")
    assert [x.i for x in both.where(r.where("$.b.c", "=", "5")).collect()] == [1]
    with pytest.raises(DocError):
        r.where("a", "like", "x")


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "t")
    df = spark.range(0, 30_000, 1, 1).select(
        F.concat(F.lit('{"seq":'), "id", F.lit(',"kind":"'), F.lpad(F.col("id").cast("string"), 8, "0"), F.lit('","pad":"'), F.sha2(F.col("id").cast("string"), 256), F.lit('"}')).alias("d")
    )
    sources.write_shredded(df, path, "d", {"$.seq": "BIGINT", "kind": "VARCHAR"}, cluster_by=["$.seq"], row_group_bytes=200_000)
    return sources.read_documents(spark, path)


def scanned(df):
    """Rows that the scan has made."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_lane_filter_is_pushed_down(clustered):
    r = Reader(clustered, "d", clean=True)
    got = clustered.where(r.where("$.seq", "=", 20_000)).select(r.get("$.seq", "BIGINT").alias("seq"), r.get_text("kind").alias("kind"))
    plan = got._jdf.queryExecution().toString()
    assert "EqualTo(d.shreds.`$.seq`,20000)" in plan and "residual" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert [tuple(x) for x in got.collect()] == [(20_000, "00020000")]


def test_implied_predicate_is_pushed_down(clustered):
    r = Reader(clustered, "d")
    got = clustered.where(r.where("$.seq", "=", 20_000)).select(r.get_text("$.pad").alias("pad"))
    plan = got._jdf.queryExecution().toString()
    pushed = plan.split("PushedFilters")[1].split("\n")[0]
    assert "EqualTo(d.shreds.`$.seq`,20000)" in pushed and "$set" in pushed
    assert len(got.collect()) == 1


def test_prove_clean(clustered, both):
    assert R.prove_clean(clustered, "d")
    assert not R.prove_clean(both, "j") and not R.prove_clean(both, "t")


def test_files_with_other_lanes(spark, tmp_path):
    one = spark.createDataFrame([(1, '{"a":1,"b":"x"}'), (2, '{"a":"no"}')], "i int, d string")
    two = spark.createDataFrame([(3, '{"a":3,"b":"y"}'), (4, '{"a":1}')], "i int, d string")
    sources.write_shredded(one, str(tmp_path / "p=1"), "d", {"a": "BIGINT"})
    sources.write_shredded(two, str(tmp_path / "p=2"), "d", {"b": "VARCHAR"})
    df = sources.read_documents(spark, str(tmp_path / "p=1"), str(tmp_path / "p=2"))
    r = Reader(df, "d")
    assert {x.name for x in r.spec.lanes} == {"a", "b"}
    got = {x.i: (x.t, x.w) for x in df.select("i", r.get_text("a").alias("t"), r.plain.alias("w")).collect()}
    assert got == {1: ("1", '{"a":1,"b":"x"}'), 2: ("no", '{"a":"no"}'), 3: ("3", '{"a":3,"b":"y"}'), 4: ("1", '{"a":1}')}
    assert sorted(x.i for x in df.where(r.where("a", "=", 1)).collect()) == [1, 4]
    assert sorted(x.i for x in df.where(r.where("b", "in", ["x", "y"])).collect()) == [1, 3]
    assert not R.prove_clean(df, "d")


def test_set_operations_compare_by_value(spark):
    text = '{"a":1,"b":"x"}'
    one = spark.createDataFrame([(text,)], "d string").select(C.shred("d", {"a": "BIGINT"}).alias("d"))
    two = spark.createDataFrame([(text,)], "d string").select(C.shred("d", {"b": "VARCHAR"}).alias("d"))
    x, y = R.align(one, "d", None), R.align(two, "d", None)
    assert x.union(y).distinct().count() == 1 and x.intersect(y).count() == 1 and x.exceptAll(y).count() == 0
    u = R.union(one, two, "d")
    assert [r.t for r in u.select(Reader(u, "d").plain.alias("t")).collect()] == [text, text]
    assert {x.name for x in Reader(u, "d").spec.lanes} == {"a", "b"}


def test_merge_and_diff_of_shredded(spark):
    df = spark.createDataFrame([('{"a":1,"b":"x"}', '{"b":null,"c":2}'), ('{"a":1}', '{"a":1}'), (None, '{"a":2}'), (None, None)], "p string, q string")
    s = df.select("p", "q", C.shred("p", {"a": "BIGINT"}).alias("x"), C.shred("q", {"a": "BIGINT"}).alias("y"))
    m = R.merge_patch(s, "x", "y")
    want = [r.w for r in df.select(C.merge_patch("p", "q").alias("w")).collect()]
    assert [r.w for r in m.select(Reader(m, "merged").plain.alias("w")).collect()] == want
    d = R.diff(s, "x", "y").select("diff").collect()
    assert [r.diff for r in d] == [r.w for r in df.select(C.diff("p", "q").alias("w")).collect()]


def test_entries_of_shredded(both):
    p, r = Reader(both, "t"), Reader(both, "j")
    for row in both.select(p.entries().alias("p"), r.entries().alias("r")).collect():
        assert (None if row.p is None else sorted(map(str, row.p))) == (None if row.r is None else sorted(map(str, row.r)))


def test_plain_column_is_its_own_text(both):
    rows = both.select("t", Reader(both, "j").plain.alias("w")).collect()
    assert all(r.w == (None if r.t is None else canonical(r.t)) for r in rows)


def test_stored_tables_are_read_by_lanes_with_pushed_filters(spark, tmp_path):
    from quillon import sources

    rows = [(i, '{"k":%d,"name":"n%d","rest":{"x":%d}}' % (i, i % 5, i)) for i in range(4000)] + [(4000, '{"k":"odd","name":null}'), (4001, None)]
    df = spark.createDataFrame(rows, "i int, d string").coalesce(1)
    one, two = f"{tmp_path}/one", f"{tmp_path}/two"
    sources.write_shredded(df, one, "d", {"k": "BIGINT", "name": "VARCHAR"}, cluster_by=["k"], row_group_bytes=1 << 14)
    sources.write_shredded(df, two, "d", {"name": "VARCHAR"})
    docs = sources.read_documents(spark, one)
    r = R.Reader(docs, "d", clean=False)
    got = docs.where(r.where("k", "<", 7)).select("i", r.get_text("name").alias("n"))
    assert sorted(map(tuple, got.collect())) == [(i, f"n{i % 5}") for i in range(7)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "shreds.k" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert "rest" not in plan and plan.count("ArrowEvalPython") <= 2
    clean = docs.where("i < 4000")
    assert R.prove_clean(clean, "d") and not R.prove_clean(docs, "d")
    r = R.Reader(docs, "d", clean=True)
    plan = docs.where(r.where("k", "<", 7)).groupBy(r.get_text("name")).count()._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "LessThan(d.shreds.k,7)" in plan.replace("`", "")
    both = sources.read_documents(spark, one, two)
    r = R.Reader(both, "d")
    assert both.where(r.where("k", "<", 7)).count() == 14
    assert both.select(r.plain.alias("p")).where('p = \'{"k":"odd","name":null}\'').count() == 2


def test_shredding_is_evaluated_once(spark):
    df = spark.createDataFrame([('{"k":1,"s":"x"}',)], "d string")
    made = df.select(C.shred("d", {"k": "BIGINT"}).alias("j"))
    r = R.Reader(made, "j")
    got = made.where(r.where("k", ">", 0)).select(r.get("k", "BIGINT").alias("k"), r.get_text("s").alias("s"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("single(d#") == 1
    assert [tuple(x) for x in got.collect()] == [(1, "x")]


def test_scans_with_few_partitions_are_dealt_anew(spark, tmp_path):
    from quillon import sources

    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert sources.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = df.repartition(9)
    assert sources.spread(many) is many
