"""Line dedup against brute force, both ways of applying it, and its reversibility."""

import hashlib
import random

import numpy as np

from quillon.llm import linededup as L

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    line = line.strip(SPACE)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line) if len(line) >= 40 else None


def brute(rows):
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if k := key(line):
                holders.setdefault(k, set()).add(d)
    top = {k: max((d for d in v if d is not None), default=None) for k, v in holders.items() if len(v) >= 5}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in top or top[key(x)] == d]
        out.append((str(d), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def documents():
    rng = random.Random(9)
    pool = [f"{'Common line number'} {k} with enough characters in it to count É" for k in range(12)] + ["short"] * 2
    rows = []
    for d in range(80):
        lines = []
        for _ in range(rng.randint(0, 7)):
            x = rng.choice(pool) if rng.random() < 0.6 else f"a line of its own {rng.random()} {rng.random()} {d}"
            lines.append(rng.choice(["", " ", "\t"]) + rng.choice([x, x.upper().replace("É", "É")]) + rng.choice(["", "\r"]))
        rows.append((d, "\n".join(lines)))
    return rows + [(90, None), (91, ""), (None, pool[0]), (None, pool[1]), (5, pool[2]), (5, pool[2]), (92, "\n\n")]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "k", 0) for d, t in rows], "doc_id long, text string, k string, n long")


def digests(df):
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect())


def test_against_brute_force(spark):
    rows = documents()
    for bound in (L.BROADCAST_KEYS, 0):  # filters on the executors, and a join
        assert digests(L.line_dedup(frame(spark, rows), broadcast_keys=bound)) == brute(rows)
    assert L.line_dedup(frame(spark, [])).count() == 0


def test_insertions_and_deletions(spark):
    rows = [r for r in documents() if r[0] is not None]
    first, second = rows[: len(rows) // 2], rows[len(rows) // 2 :]
    refs = lambda ix: sorted((bytes(r.k), r.doc_id, r.n) for r in ix.refs.collect())
    whole = L.LineIndex.build(frame(spark, rows))
    grown = L.LineIndex.build(frame(spark, first)).insert(frame(spark, second))
    assert refs(whole) == refs(grown)
    assert refs(grown.delete(frame(spark, second))) == refs(L.LineIndex.build(frame(spark, first)))
    assert refs(grown.delete(frame(spark, rows))) == []
    empty = L.LineIndex.empty(spark)
    assert refs(empty.insert(frame(spark, first))) == refs(L.LineIndex.build(frame(spark, first)))


def test_stage(spark):
    rows = documents()
    docs = frame(spark, rows)
    out = L.dedup_texts(docs)
    assert out.columns == docs.columns and out.count() == len(rows)


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    high, low = rng.integers(0, 2**64, (2, 5000), dtype=np.uint64)
    f = L.CuckooFilter.of(high, low)
    assert f.contains(high, low).all()
    other = rng.integers(0, 2**64, (2, 20000), dtype=np.uint64)
    assert f.contains(*other).mean() < 0.01
    f.delete(high[:2000], low[:2000])
    assert f.contains(high[2000:], low[2000:]).all() and f.contains(high[:2000], low[:2000]).mean() < 0.01
    assert f.insert(high[:2000], low[:2000]) and f.contains(high, low).all()
    small = L.CuckooFilter(np.zeros((4, 4), np.uint16))
    assert not small.insert(high[:40], low[:40])


def filters(ix):
    return {r.shard: (r.n_keys, L.CuckooFilter.read(bytes(r.data), bytes(r.stash))) for r in ix.filters().collect()}


def test_filters_follow_insertions_and_deletions(spark):
    rows = [r for r in documents() if r[0] is not None]
    first, second = rows[: len(rows) // 2], rows[len(rows) // 2 :]
    whole, grown = L.LineIndex.build(frame(spark, rows)), L.LineIndex.build(frame(spark, first)).insert(frame(spark, second))
    for ix in (whole, grown, grown.delete(frame(spark, second)), grown.delete(frame(spark, rows))):
        held = filters(ix)
        per = {}
        for r in ix.repeated().collect():
            per.setdefault(r.shard, []).append(bytes(r.k))
        assert sorted(held) == list(range(L.SHARDS))
        assert {s: n for s, (n, _) in held.items() if n} == {s: len(k) for s, k in per.items()}
        assert all(held[s][1].contains(*L._halves(k)).all() for s, k in per.items())


def test_a_change_reads_and_replaces_its_own_shards_alone(spark):
    rows = [r for r in documents() if r[0] is not None]
    index = L.LineIndex.build(frame(spark, rows))
    one = frame(spark, [(1000, rows[3][1].split("\n")[0]), (1001, "one new line that is quite long enough to be counted")])
    touched = {r.shard for r in L.references(one.select("doc_id", "text")).collect()}
    assert 1 <= len(touched) <= 2
    grown = index.insert(one)
    old, new = grown.parts
    assert new.live == touched and old.live == set(range(L.SHARDS)) - touched and old.refs is index.parts[0].refs
    plan = index._live("refs", "shard int, k binary, doc_id bigint, n long", frozenset(touched))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "shard" in plan.split("PartitionFilters")[1][:120]
    assert {r.shard for r in index._live("refs", "shard int, k binary, doc_id bigint, n long", frozenset(touched)).select("shard").distinct().collect()} <= touched
    again = lambda ix: sorted((bytes(r.k), r.doc_id, r.n) for r in ix.refs.collect())
    assert again(grown) == again(L.LineIndex.build(frame(spark, rows + [(r.doc_id, r.text) for r in one.collect()])))


def test_filter_groups_and_hot_lines(spark, monkeypatch):
    rows = documents() + [(200 + d, "one line that every one of these documents holds, word by word\nshort") for d in range(300)]
    monkeypatch.setattr(L, "FILTER_BYTES", 100)  # a filter has 32 bytes at least
    assert digests(L.line_dedup(frame(spark, rows), broadcast_keys=0)) == brute(rows)
    monkeypatch.setattr(L, "HOT", 1)  # no line is hot
    assert digests(L.line_dedup(frame(spark, rows), broadcast_keys=0)) == brute(rows)


def test_filters_prune_before_the_shuffle(spark):
    docs = frame(spark, documents())
    index = L.LineIndex.build(docs.select("doc_id", "text"))
    lines = L.references(docs.select("doc_id", "text")).drop("n")
    known = {bytes(r.k) for r in index.repeated().collect()}
    left = L._passing(lines, index._broadcast(list(range(L.SHARDS)))).collect()
    assert known and {bytes(r.k) for r in left} >= known & {bytes(r.k) for r in lines.collect()}
    assert len(left) < 0.8 * lines.count()


def test_stage_with_clashing_names_and_nulls(spark):
    rows = documents()
    df = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], "doc_id long, text string, `__l_text` string, __l_ long, `a.b` string")
    for bound in (L.BROADCAST_KEYS, 0):
        out = L.dedup_texts(df, broadcast_keys=bound)
        assert out.columns == df.columns
        got = sorted((str(r.doc_id), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out.collect())
        assert got == sorted((d, h) for d, _, _, h in brute(rows))
    assert L.dedup_texts(df.limit(0)).count() == 0


def test_a_full_filter_misses_nothing():
    rng = np.random.default_rng(3)
    high, low = rng.integers(0, 2**64, (2, 60), dtype=np.uint64)
    full = L.CuckooFilter(np.zeros((4, 4), np.uint16))
    assert not full.insert(high, low) and len(full.stash) == 44
    again = L.CuckooFilter.read(*full.written())
    assert again.contains(high, low).all()
    again.delete(high, low)
    assert not again.stash and not again.buckets.any()
