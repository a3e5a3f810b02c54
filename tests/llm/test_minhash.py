"""Near-dedup against all pairs, and its parts."""

import random
import re

import numpy as np
import pytest

from quillon.llm import minhash as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    all_sets = [sets(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(all_sets):
        for j in range(i):
            both = len(a & all_sets[j])
            if both and 100 * both >= 75 * (len(a) + len(all_sets[j]) - both):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted((str(d), len(all_sets[i]), str(d if not all_sets[i] else least.get(top(i)))) for i, (d, _) in enumerate(rows))


def corpus(seed=1, bases=25):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    rows = []
    shared = " ".join(rng.choice(vocab) for _ in range(30))
    for b in range(bases):
        words = [rng.choice(vocab) for _ in range(rng.choice([3, 6, 40, 120]))]
        for c in range(rng.choice([1, 2, 6])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(copy).upper() if c % 2 else f"{shared} {' '.join(copy)}" if b % 7 == 0 else " ".join(copy)))
    chain = [rng.choice(vocab) for _ in range(100)]
    for _ in range(12):  # neighbours are similar, ends are not
        chain = [*chain[4:], *[rng.choice(vocab) for _ in range(4)]]
        rows.append((len(rows), " ".join(chain)))
    rng.shuffle(rows)
    return [*rows, (700, None), (701, ""), (702, " \n\t"), (703, "one two"), (704, "ONE  two"), (None, rows[0][1]), (3, rows[5][1]), (rows[1][0], rows[1][1])]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, b"x", 0) for d, t in rows], "doc_id long, text string, cls binary, n_shingles int")


def test_against_all_pairs(spark):
    rows = corpus()
    out = M.near_dedup(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_large_group_and_bounds(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"v{rng.randrange(500)}" for _ in range(60)]
    rows = []
    for d in range(150):
        copy = list(base)
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(60)] = f"x{rng.randrange(9)}"
        rows.append((d, " ".join(copy)))
    rows += corpus(3, 6)[:-8]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    monkeypatch.setattr(M, "BLOCK", 16)
    monkeypatch.setattr(M, "SETS", 8)
    monkeypatch.setattr(M, "GUESTS", 8)
    monkeypatch.setattr(M, "SALT", 10)
    monkeypatch.setattr(M, "BROADCAST_ROLES", 0)
    monkeypatch.setattr(M, "BROADCAST_KEYS", 0)
    out = M.near_dedup(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == brute(rows)


def test_empty(spark):
    assert M.near_dedup(frame(spark, [])).count() == 0
    assert [r.kept for r in M.near_dedup(frame(spark, [(1, None), (2, "")])).collect()] == [True, True]


@pytest.mark.parametrize("bound", [10**6, 0])
def test_components(spark, bound):
    rng = random.Random(7)
    nodes = [bytes([k]) for k in range(60)]
    links = [(nodes[k], nodes[k + 1]) for k in range(20)] + [tuple(rng.sample(nodes[25:], 2)) for _ in range(25)]
    up = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    got = {bytes(r.cls): bytes(r.comp) for r in M.components(spark.createDataFrame(links, "a binary, b binary"), bound).collect()}
    assert got == {n: up[n] for n in {x for ab in links for x in ab}}


def test_signature_is_unbiased():
    rng = random.Random(4)
    off = []
    for _ in range(60):
        a = [f"w{rng.randrange(2000)}" for _ in range(300)]
        b = [w if rng.random() > 0.04 else "z" + w for w in a]
        x, y = M.shingles(" ".join(a)), M.shingles(" ".join(b))
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        off.append((M.signature(x) == M.signature(y)).mean() - true)
    assert abs(np.mean(off)) < 0.015 and np.std(off) < 0.04


def test_hashes():
    assert len(set(M.word_hashes(b"foo bar baz " * 30_000).tolist())) == 3  # beyond a chunk of powers
    for text in (None, "", "a", "a b c d e f", "É x" * 40, "A b\tc\nD e  f g"):
        assert len(M.shingles(text)) == len(sets(text))


def test_stage_keeps_one_of_each_group(spark):
    rows = corpus()[:-3]
    docs = frame(spark, rows)
    out = M.keep_one(docs)
    assert out.columns == docs.columns
    want = {d for d, _, c in brute(rows) if d == c}
    assert {str(r.doc_id) for r in out.collect()} == want


def test_stage_judges_rows_with_a_shared_id_apart(spark):
    one, two, three = (" ".join(f"{w}{k}" for k in range(40)) for w in "abc")
    docs = frame(spark, [(3, one), (7, one), (7, two), (1, three), (3, three)])
    assert sorted((r.doc_id, r.text) for r in M.keep_one(docs).collect()) == sorted([(3, one), (7, two), (1, three)])


def test_stage_without_ids_and_with_repeated_rows(spark):
    one, two, three = (" ".join(f"{w}{k}" for k in range(40)) for w in "abc")
    near = one.replace("a39", "other")
    rows = [(None, one), (None, one), (None, near), (5, two), (5, two), (5, two), (None, two), (8, None), (8, None), (None, ""), (9, three)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, __n_id string, comp int")
    out = M.keep_one(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    kept_null = [t for d, t in got if d is None and t]
    assert len(kept_null) == 1 and kept_null[0] in (one, near)
    assert sorted([x for x in got if x != (None, kept_null[0])], key=str) == sorted([(5, two), (8, None), (8, None), (None, ""), (9, three)], key=str)
    assert M.keep_one(df.limit(0)).count() == 0


def test_rows_without_ids_cost_no_pairs(spark):
    """Texts are found again by id and hash: as many rows with texts as there are roles, whatever the ids."""
    rows = []
    for k in range(120):
        words = [f"p{k}w{i}" for i in range(30)]
        rows += [(None, " ".join(words)), (None, " ".join([*words[:-1], "z"]))]
    docs = frame(spark, rows).select("doc_id", "text")
    assert M.near_dedup(docs).where("component_id is null").count() == len(rows)
    hashed = docs.withColumn("h", M.F.xxhash64("text"))
    sketches = M.sketch(hashed)
    classes = sketches.groupBy("cls").agg(M.F.min(M.F.struct("doc_id", "h")).alias("rep"))
    got = M._Texts(hashed, classes, False).of(classes.select("cls", M.F.lit(1).alias("role")))
    assert got.count() == len(rows)


def test_many_unlike_classes_in_one_bucket(spark, monkeypatch):
    """All share a bucket, none is similar but two pairs: blocks and groups are bounded, and the pairs are found."""
    monkeypatch.setattr(M, "BLOCK", 64)
    monkeypatch.setattr(M, "GUESTS", 32)
    rng = np.random.default_rng(11)
    n = 600
    sigs, made = rng.integers(0, 2**32, (n, M.BANDS * M.ROWS), dtype=np.uint64).astype(np.uint32), []
    sigs[401], sigs[17] = sigs[400], sigs[599]
    sigs[:, M._ORDER[: M.ROWS]] = 7  # the first band of all is one
    for k in range(n):
        keys = M.bands(sigs[k])
        made.append((f"c{k:04}".encode(), keys.tolist(), M._print(keys).tobytes(), (sigs[k] & np.uint32(255)).astype(np.uint8).tobytes(), 50))
    classes = spark.createDataFrame(made, "cls binary, bands array<long>, prints binary, sig binary, n long")
    buckets = classes.select("cls", M.F.explode("bands").alias("key"))
    comps = spark.createDataFrame([], "cls binary, comp binary")
    got = M._across(buckets, comps, classes.select("cls", "sig", "prints", "n")).collect()
    assert sorted((bytes(r.a), bytes(r.b)) for r in got) == [(b"c0017", b"c0599"), (b"c0400", b"c0401")]


def test_a_star_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(M, "BROADCAST_ROLES", 0)
    monkeypatch.setattr(M, "SALT", 16)
    base = [f"s{k}" for k in range(120)]
    rows = [(k, " ".join([*base, f"own{k}", f"end{k}"])) for k in range(300)] + [(1000, " ".join(base))] * 40 + [(None, " ".join(base))] * 40
    out = M.near_dedup(frame(spark, rows)).collect()
    assert len(out) == len(rows) and {r.component_id for r in out} == {0}


@pytest.mark.parametrize("bound", [10**6, 0])
def test_components_of_a_star_and_a_chain(spark, bound):
    name = lambda k: f"{k:06}".encode()
    links = [(name(0), name(k)) for k in range(1, 3000)] + [(name(5000 + k), name(5001 + k)) for k in range(60)]
    got = {bytes(r.cls): bytes(r.comp) for r in M.components(spark.createDataFrame(links, "a binary, b binary"), bound).collect()}
    assert {got[name(k)] for k in range(3000)} == {name(0)} and {got[name(5000 + k)] for k in range(61)} == {name(5000)}


def test_recall_at_the_threshold():
    """Pairs with a similarity of 0.75 to 0.8 share a band."""
    rng = np.random.default_rng(23)
    missed = 0
    pairs = 3000
    for _ in range(pairs):
        size = int(rng.integers(30, 200))
        union = rng.integers(0, 2**64, size, dtype=np.uint64)
        both = int(np.ceil(rng.uniform(0.75, 0.8) * size))
        side = rng.random(size - both) < 0.5
        a, b = (np.concatenate([union[:both], union[both:][x]]) for x in (side, ~side))
        missed += not (M.bands(M.signature(a)) == M.bands(M.signature(b))).any()
    assert missed == 0
