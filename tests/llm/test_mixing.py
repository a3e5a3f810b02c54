"""Targets against an iterative filling, and the samples against their targets."""

import random
from collections import defaultdict

import pytest

from quillon.llm import mixing as M


def fill(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total = sum(sizes.values())
    full = set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        level = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else weight[s] * level for s in names}
        full |= over


def corpus(seed, sources=7, docs=400):
    rng = random.Random(seed)
    rows = []
    for d in range(docs):
        s = rng.choice([None, "", *[f"src{k}" for k in range(sources)], *["src0"] * 6])
        rows.append((d, " ".join(["w"] * rng.choice([0, 1, 5, 20, 60])), s, 1, 9))
    return rows


SCHEMA = "doc_id long, text string, source string, size int, target int"


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_targets_and_taken(spark, seed):
    rows = corpus(seed)
    out = M.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.doc_id for r in out) == [r[0] for r in rows]
    source = {r[0]: r[2] for r in rows}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        assert r.size == len(rows[r.doc_id][1].split()) and r.taken == r.copies * r.size <= 3 * r.size
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(r.source_size == sizes[source[r.doc_id]] for r in out)
    want = fill(dict(sizes))
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 60
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))


def test_reruns_and_layout_agree(spark):
    df = spark.createDataFrame(corpus(5), SCHEMA)
    once = sorted(map(tuple, M.mix(df).collect()))
    assert once == sorted(map(tuple, M.mix(df.repartition(7)).collect()))
    assert once == sorted(map(tuple, M.mix(df, cells=3).collect()))
    assert once != sorted(map(tuple, M.mix(df, seed="other").collect()))


def test_inclusion_follows_probability(spark):
    rows = [(d, "w w", "a" if d % 4 else "b", 0, 0) for d in range(2000)]
    out = M.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    by = defaultdict(list)
    for r in out:
        by["a" if r.doc_id % 4 else "b"].append(r.copies)
    # weights 5 and 2 of 4000 words in sources of 3000 and 1000
    assert sum(by["a"]) * 2 == pytest.approx(4000 * 5 / 7, abs=2) and sum(by["b"]) * 2 == pytest.approx(4000 * 2 / 7, abs=2)
    assert set(by["a"]) == {0, 1} and set(by["b"]) == {1, 2}


def test_edges(spark):
    rows = [(1, None, "a", 0, 0), (None, "x y", None, 0, 0), (None, "x y", None, 0, 0), (2, "", "b", 0, 0), (3, "x", "c", 0, 0), (3, "x", "c", 0, 0)]
    out = M.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 6 and {r.taken for r in out if r.size == 0} == {0}
    assert all(r.target == 0.0 for r in out if r.source_size == 0)
    assert M.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    (r,) = M.mix(spark.createDataFrame([(1, None, None, 0, 0)], SCHEMA)).collect()
    assert (r.target, r.taken) == (0.0, 0)


def test_repeated_rows(spark):
    df = spark.createDataFrame(corpus(6), SCHEMA)
    copies = {r.doc_id: r.copies for r in M.mix(df).collect()}
    out = M.repeated(df)
    assert out.columns == df.columns
    seen = defaultdict(int)
    for r in out.collect():
        seen[r.doc_id] += 1
    assert seen == {d: n for d, n in copies.items() if n}


def test_plain_operators_only(spark):
    plan = M.mix(spark.createDataFrame(corpus(1), SCHEMA))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "Cartesian"))


@pytest.mark.parametrize("text", ["w w w w w w w w w w", None])
def test_rows_without_ids_are_not_taken_all_or_none(spark, monkeypatch, text):
    """Null ids, with texts of their own (None) or all alike, and one id for all: each source comes near its target."""
    for d in (None, 7):
        rows = [(d, text or f"{k} w w w w w w w w w", s, 0, 0) for s, n in (("a", 100), ("b", 60), ("c", 200)) for k in range(n)]
        for ties in (M.TIES, 10):
            monkeypatch.setattr(M, "TIES", ties)
            out = M.mix(spark.createDataFrame(rows, SCHEMA)).collect()
            taken, target = defaultdict(int), {}
            for r in out:
                taken[r.source_size] += r.taken
                target[r.source_size] = r.target
            assert len(out) == 360
            for k, t in target.items():
                assert abs(taken[k] - t) <= (10 if ties > 10 or not text else 0.2 * t)


def test_a_crowded_cell_is_divided(spark, monkeypatch):
    df = spark.createDataFrame(corpus(5), SCHEMA)
    once = sorted(map(tuple, M.mix(df).collect()))
    monkeypatch.setattr(M, "EDGE_ROWS", 1)
    assert once == sorted(map(tuple, M.mix(df, cells=4).collect()))


def test_many_sources_are_ordered_by_ranges(spark, monkeypatch):
    df = spark.createDataFrame(corpus(5, sources=40), SCHEMA)
    once = sorted(map(tuple, M.mix(df).collect()))
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 3)
    assert once == sorted(map(tuple, M.mix(df).collect()))
    assert sorted(r.doc_id for r in M.repeated(df).collect()) == sorted(r[0] for r in once for _ in range(r[4]))


def test_stage_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "s", 1, 2), (None, None, None, None, None)], "doc_id long, text string, source string, __s int, `i.t` int")
    out = M.repeated(df)
    assert out.columns == df.columns and out.count() >= 1
    assert M.repeated(df.limit(0)).count() == 0
