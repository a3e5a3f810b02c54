"""License scans against brute force."""

import random
import re

from quillon.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text):
    w = words(text)
    places = [(i, label) for phrase, label in L.PHRASES for p in [phrase.split()] for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def texts():
    rng = random.Random(12)
    bits = ["cc", "by", "CC BY", "cc-by", "all rights reserved.", "General Public License", "general", "public", "license", "rights", "é", "K", "x1", "all"]
    out = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(150)]
    return [*out, None, "", "...", "cc by cc by", "all rights reserved", "Kcc by"]


def test_base(spark):
    rows = list(enumerate(texts()))
    rows += [(None, "cc by"), (0, rows[0][1]), (0, rows[0][1])]
    df = spark.createDataFrame([(d, t, "l", 1.0) for d, t in rows], "doc_id long, text string, labels string, score double")
    out = L.scan(df).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels) for r in out)
    want = sorted((str(d), n, b, str(f), str(x), s) for d, t in rows for n, b, f, x, s in [brute(t)])
    assert got == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in out)


def test_method_labels(spark):
    rows = [
        (1, "Text before.\nLicensed under the Apache License, Version 2.0.\nText after."),
        (2, "Released under the MIT License."),
        (3, "licensed under CC BY-NC 4.0"),
        (4, "Licensed under the terms of Apache, a version"),
        (5, "Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following conditions are met"),
        (6, "apache license " * 50),
        (7, "nothing of the kind"),
    ]
    out = {r.doc_id: r for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    labels = {k: r.labels for k, r in out.items()}
    assert labels == {1: "apache-2.0", 2: "mit", 3: "cc-by,cc-by-nc", 4: "", 5: "bsd", 6: "", 7: ""}
    assert out[1].score == 1.0 and 0.75 <= out[5].score <= 1 and out[7].score == 0


def test_many_places_and_spans(spark):
    line = "Released under the MIT License. "
    docs = spark.createDataFrame([(1, line * 400 + "all rights reserved " * 3)], "doc_id long, text string")
    (r,) = L.scan(docs).collect()
    assert (r.n_base, r.labels, r.base_labels) == (3, "mit,reserved", "reserved")
    plan = L.scan(docs)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "Cartesian"))
    assert L.scan(docs.limit(0)).count() == 0


def test_whole_licenses_as_a_table(spark, monkeypatch):
    rng = random.Random(3)
    license_ = " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(60)}" for _ in range(300))
    words_ = license_.split()
    changed = [*words_[:100], "other", *words_[101:200], *words_[202:]]  # no more lost than GAP
    rows = [(1, "Before. " + license_.upper() + " after"), (2, " ".join(changed)), (3, " ".join(words_[:150])), (4, " ".join(sorted(words_)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame([("own", license_), ("none", None), ("short", "a b"), ("own", license_)], "label string, text string")
    for bound in (L.BROADCAST_GRAMS, 0):
        monkeypatch.setattr(L, "BROADCAST_GRAMS", bound)
        out = {r.doc_id: r for r in L.scan(docs, table).collect()}
        assert {k: r.labels for k, r in out.items()} == {1: "own", 2: "own", 3: "", 4: ""}
        assert out[1].score == 1 and 0.9 < out[2].score < 1 and out[3].score == 0.5


def test_a_hash_alone_proves_nothing(spark, monkeypatch):
    monkeypatch.setattr(L, "gram", lambda w, i, k=L.K: L.F.lit(1).cast("long"))  # all grams collide
    docs = spark.createDataFrame([(1, "released under the mit license"), (2, "quite other words than those of it")], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in L.scan(docs).collect()} == {1: "mit", 2: ""}
