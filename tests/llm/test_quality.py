"""Quality rules against a brute-force count and on learnable labels."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import decision_list, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é\n\t #|.\x0b  ", max_size=60))
def test_stats(text):
    assert quality.text_stats(text)[:5] == brute(text)


def test_stats_of_many_words():
    rng = random.Random(3)
    words = [str(rng.randrange(6)) for _ in range(400)]
    assert quality.text_stats(" ".join(words))[:5] == brute(" ".join(words))
    many = [str(i) for i in range(9000)] * 2  # codes of five words need ranks
    assert quality.text_stats(" ".join(many))[4] == 18000
    assert quality.text_stats(None)[:5] == (0, 0, 0, 0, 0)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, kept string")


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(300):
        words = [word() for _ in range(rng.randint(20, 80))]
        bad = i % 4 == 0
        text = " ".join(w + rng.choice(["&&&", "###", "***"]) if bad else w for w in words)
        rows.append((i, text, "x", "y"))
        labels.append((i, 0 if bad else 1))
    return rows, labels


def test_learned_list_separates(spark):
    rows, labels = corpus()
    more = [(900, None, None, None), (901, "", "", ""), (None, rows[1][1], None, None), (1, rows[1][1], None, None)]
    train = spark.createDataFrame([x for x in labels if x[0] % 2] + [x for x in labels if x[0] % 8 == 0] + [(None, 1), (5, None)], "doc_id long, quality int")
    out = quality.quality(documents(spark, rows + more), train).collect()
    assert len(out) == len(rows) + len(more)
    kept = {}
    for r in out:
        kept.setdefault(r.doc_id, []).append(r.kept)
    assert all(kept[i][0] == (q == 1) for i, q in labels)
    assert kept[900] == kept[901] == [False] and kept[None] == [True] and kept[1] == [True, True]
    r = next(r for r in out if r.doc_id == 900)
    assert (r.n_words, r.base_failed) == (0, True)


def test_base_rule_alone(spark):
    rows, labels = corpus()
    for some in ([], [(i, 1) for i, _ in labels]):
        out = quality.quality(documents(spark, rows), spark.createDataFrame(some, "doc_id long, quality int"))
        assert out.where("kept <> (not base_failed)").count() == 0
    assert quality.quality(documents(spark, []), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


def test_stage_keeps_columns(spark):
    rows, labels = corpus()
    docs = documents(spark, rows)
    out = quality.keep_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {i for i, q in labels if q}


def test_list_is_ordered_and_interpretable(spark):
    rng = np.random.default_rng(0)
    x = {"a": rng.random(600), "b": rng.random(600)}
    y = (x["a"] > 0.8) | ((x["b"] < 0.2) & (x["a"] < 0.3))
    rules = decision_list.learn(x, y)
    assert rules and all(len(r) <= 4 for r in rules)
    df = spark.createDataFrame([(float(a), float(b), bool(v)) for a, b, v in zip(x["a"], x["b"], y, strict=True)], "a double, b double, y boolean")
    got = df.select("y", decision_list.expression(rules, F.lit(True), F.lit(False)).alias("p"))
    assert got.where("y = p").count() >= 0.95 * 600


@pytest.mark.parametrize("y", [np.zeros(0, bool), np.zeros(9, bool), np.ones(9, bool)])
def test_nothing_to_learn(y):
    assert decision_list.learn({"a": np.arange(len(y), dtype=float)}, y) == []


def test_repeated_ids_teach_once_and_left_out_rows_are_judged(spark):
    rows, labels = corpus()
    docs = documents(spark, rows)
    half = [x for x in labels if x[0] % 3]
    lab = spark.createDataFrame(half, "doc_id long, quality int")
    again = docs.unionByName(docs.where("doc_id = 4").crossJoin(spark.range(300)).drop("id"))
    assert quality.learn_rules(docs, lab) == quality.learn_rules(again, lab) != []
    left = {r.doc_id: r.kept for r in quality.quality(docs, lab).where("doc_id % 3 = 0").collect()}
    right = sum(left[i] == (q == 1) for i, q in labels if not i % 3)
    assert right >= 0.98 * len(left)


def test_stage_with_clashing_names(spark):
    rows, labels = corpus()
    df = spark.createDataFrame([(i, t, 1, "z") for i, t, *_ in rows] + [(None, None, None, None), (None, "", 2, "")], "doc_id long, text string, __q_kept int, `a.b` string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    out = quality.keep_quality(df, lab)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == {i for i, q in labels if q}
    assert quality.keep_quality(df.limit(0), lab).count() == 0 and quality.keep_quality(df, lab.limit(0)).count() > 0
