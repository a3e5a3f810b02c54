"""The suffix automaton against brute force, blocks, and removal of spans."""

import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import decontamination as D
from quillon.llm.common import alnum_words

word = st.sampled_from([b"a", b"b", b"c", b"zz"])


def brute(items, doc, width):
    hit, found = [0] * len(doc), set()
    for name, w in items:
        windows = [w[i : i + width] for i in range(len(w) - width + 1)] if len(w) >= width else [w] if w else []
        for x in windows:
            for i in range(len(doc) - len(x) + 1):
                if doc[i : i + len(x)] == x:
                    found.add(name)
                    hit[i : i + len(x)] = [1] * len(x)
    return hit, found


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(word, max_size=9), max_size=5), st.lists(word, max_size=30), st.integers(1, 6))
def test_automaton(items, doc, width):
    named = [(str(i), w) for i, w in enumerate(items)]
    auto = D.SuffixAutomaton(named, width)
    spans, found = auto.match(doc)
    hit = [0] * len(doc)
    for a, b in spans:
        hit[a:b] = [1] * (b - a)
    assert (hit, {auto.names[k] for k in found}) == brute(named, doc, width)
    assert all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))


def tables(spark):
    rng = random.Random(4)
    w = lambda n: [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n)]
    items = [(i, " ".join(w(rng.choice([3, 9, 10, 25])))) for i in range(20)] + [(50, None), (51, "  ,"), (None, "only Here once"), (3, "q r s")]
    docs = []
    for d in range(60):
        words = w(40)
        if d % 3 == 0:
            piece = items[d % 20][1].upper().split(" ")
            words[5:5] = piece[:12]
        docs.append((d, "- ".join(words), "x", 1))
    docs += [(100, None, None, None), (101, "", None, None), (102, "ONLY here, once!", None, None), (None, "q R\ns", None, None), (102, "ONLY here, once!", None, None)]
    return (
        docs,
        items,
        spark.createDataFrame(docs, "doc_id long, text string, item_id string, n_hit int"),
        spark.createDataFrame(items, "item_id long, text string"),
    )


def test_against_brute_force(spark):
    docs, items, d, i = tables(spark)
    named = [("" if k is None else str(k), alnum_words(t)) for k, t in items]
    want = sorted(
        (str(k), len(alnum_words(t)), sum(h), len(f), hashlib.sha256(",".join(sorted(f)).encode()).hexdigest(), any(h))
        for k, t, *_ in docs
        for h, f in [brute(named, alnum_words(t), 10)]
    )
    for size in (D.BLOCK_WORDS, 20):  # one block, and many
        got = D.contamination(d, i, block_words=size).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want


def test_no_items(spark):
    _, _, d, i = tables(spark)
    assert D.contamination(d, i.limit(0)).where("contaminated or n_hit > 0").count() == 0
    assert D.contamination(d.limit(0), i).count() == 0


def test_removal(spark):
    long = " ".join(f"w{k}" for k in range(12))
    rows = [(1, f"Before this. {long.upper()}, after that and some more words so that it stays here."), (2, long), (3, "clean text"), (4, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in D.decontaminate(d, spark.createDataFrame([(1, long)], "item_id long, text string")).collect()}
    assert out == {1: "Before this. , after that and some more words so that it stays here.", 3: "clean text", 4: None}


def test_many_blocks_move_hit_texts_alone(spark, monkeypatch):
    """Items of over 20 blocks, one of them longer than a block: the same hits, and only texts with hits are written."""
    monkeypatch.setattr(D, "TASK_TEXTS", 3)
    monkeypatch.setattr(D, "PASS_BLOCKS", 4)
    rng = random.Random(8)
    w = lambda n: " ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(40)) for _ in range(n))
    items = [(k, w(rng.choice([4, 11, 30]))) for k in range(60)] + [(100, w(400))]
    docs = [(d, w(60)) for d in range(200)]
    docs += [(300 + k, f"{w(5)} {t} {w(5)}") for k, (_, t) in enumerate(items)] * 2 + [(400 + a, " ".join(items[-1][1].split()[a : a + 25])) for a in range(0, 370, 7)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda size: sorted(map(tuple, D.contamination(d, i, block_words=size).collect()))
    whole = rows(D.BLOCK_WORDS)
    made = []
    table = D.table
    monkeypatch.setattr(D, "table", lambda df, name="t": made.append((name, table(df, name))) or made[-1][1])
    assert rows(40) == whole
    texts = {r.text for r in dict(made)["wanted"].collect()}
    hit = {r[0] for r in whole if r[5]}
    assert texts == {t for k, t in docs if k in hit}
    assert len(hit) < len({k for k, _ in docs}) / 2 + 60


def test_stage_with_clashing_names(spark):
    long = " ".join(f"w{k}" for k in range(12))
    rows = [(1, f"x, {long} y z a b c d e f g h i j k l m n", 5, "a"), (1, f"x, {long} y z a b c d e f g h i j k l m n", 5, "a"), (None, None, None, None), (2, "", 0, "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, __d_from int, `item.id` string")
    for size in (D.BLOCK_WORDS, 11):
        items = spark.createDataFrame([(1, long), (None, None), (2, long[4:])], "item_id long, text string")
        out = D.decontaminate(d, items, block_words=size)
        assert out.columns == d.columns
        assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "x,  y z a b c d e f g h i j k l m n", 5, "a")] * 2 + [(None, None, None, None), (2, "", 0, "b")], key=str)
    assert D.decontaminate(d.limit(0), items).count() == 0
    assert D.decontaminate(d, items.limit(0)).count() == 4
