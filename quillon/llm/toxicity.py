"""Toxicity by a weighted lexicon: folding, Aho-Corasick matching, exception phrases and length normalisation."""

from __future__ import annotations

import math
import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import map_arrow, map_batches, prepare, table
from quillon.llm.minhash import shingles

#: At most so many labelled rows, those with the smallest hash of their id, teach the lexicon and the scale.
SAMPLE_ROWS = 12_000
#: Sampled rows that share the least shingle under one of so many permutations count as copies of the first of them.
COPY_KEYS = 4
#: Terms are whole words or beginnings of words with so many letters.
STEM_MIN, STEM_MAX = 3, 8
#: Share of a term's documents that must be toxic, and the risk of a chance finding among all candidates.
PRECISION, RISK = 0.8, 0.01

# Letters that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h",
    "ӏ": "l", "ո": "n", "ս": "u", "в": "b", "к": "k", "м": "m", "н": "h", "т": "t", "α": "a", "ε": "e", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "i"}

_FOLD = str.maketrans(HOMOGLYPHS | DIGITS | {c: "" for c in "​‌‍⁠﻿­"})
_FULLWIDTH = str.maketrans({chr(0xFEE0 + c): chr(c).lower() for c in range(0x21, 0x7F)})
#: Signs within a word or before its first letter; those that end a word are punctuation.
_SIGN = re.compile(r"(?:(?<=[^\W_])|(?<!\S))[@$!](?=[^\W\d_])")
_GAP = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """Words in lower case between single spaces, each look-alike in place of what it looks like. Null is empty."""
    text = (text or "").lower()
    if any(s in text for s in SIGNS):
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    if not text.isascii():
        text = text.translate(_FULLWIDTH)
    return f" {_GAP.sub(' ', text.translate(_FOLD)).strip()} "


class Lexicon:
    """Terms with weights, exception phrases, and the scale of the score. Terms begin with a space; whole words end with one."""

    def __init__(self, terms: dict[str, float], exceptions: set[str] = frozenset(), scale: tuple[float, float, float] = (-2.0, 0.0, 0.0)):
        self.terms, self.exceptions, self.scale = terms, set(exceptions), scale
        self.auto = None

    def __getstate__(self):
        return self.terms, self.exceptions, self.scale

    def __setstate__(self, state):
        self.terms, self.exceptions, self.scale = state
        self.auto = None

    def _automaton(self):
        if self.auto is None and self.terms:
            self.auto = ahocorasick.Automaton()
            for term, weight in self.terms.items():
                self.auto.add_word(term, (len(term), weight))
            for phrase in self.exceptions:
                self.auto.add_word(phrase, (len(phrase), 0.0))
            self.auto.make_automaton()
        return self.auto

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """Start, end and weight of each term, of several at one start the heaviest, outside exception phrases."""
        auto = self._automaton()
        if auto is None:
            return []
        best: dict[int, tuple[int, float]] = {}
        safe: list[tuple[int, int]] = []
        for end, (n, weight) in auto.iter(folded):
            start = end + 1 - n
            if not weight:
                safe.append((start, end + 1))
            elif start not in best or weight > best[start][1]:
                best[start] = (end + 1, weight)
        out = [(a, b, w) for a, (b, w) in best.items()]
        return [h for h in out if not any(s <= h[0] and h[1] <= e for s, e in safe)] if safe else out

    def features(self, folded: str) -> tuple[float, float]:
        """The sum of weights with diminishing returns, and its share of the length."""
        total = sum(w for _, _, w in self.hits(folded))
        return math.log1p(total), math.log1p(1000 * total / (len(folded) + 50))

    def score(self, text: str | None) -> float:
        a, b = self.features(fold(text))
        z = self.scale[0] + self.scale[1] * a + self.scale[2] * b
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def candidates(folded: str) -> set[str]:
    out = set()
    for w in set(folded.split()):
        if len(w) >= STEM_MIN:
            out.update(" " + w[:k] for k in range(STEM_MIN, min(len(w), STEM_MAX + 1)))
            out.add(f" {w} ")
    return out


def _surprise(a: int, n: int, p: float) -> float:
    """A bound on minus the log of the chance of a or more of n at rate p."""
    q = a / n
    if q <= p:
        return 0.0
    return n * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0))


def choose(counts: list[tuple[str, int, int]], toxic: int, clean: int, tried: int) -> dict[str, float]:
    """Terms from (candidate, toxic documents, clean documents): shortest first, none that begins with a chosen one."""
    rate = toxic / max(1, toxic + clean)
    need = math.log(max(1, tried) / RISK)
    out: dict[str, float] = {}
    for term, a, b in sorted(counts, key=lambda x: (len(x[0]), x[0])):
        if a < PRECISION * (a + b) or _surprise(a, a + b, rate) < need:
            continue
        if any(term[:k] in out for k in range(2, len(term))):
            continue
        out[term] = max(0.1, math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1)))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    reg = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + reg, x.T @ (y - p) - reg @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> Lexicon:
    """A lexicon from at most sample_rows labelled rows, none of them held out.

    Labels of one id count as their greatest, and of its texts the least teaches; null ids, labels and texts are ignored.
    Without labels of both classes the lexicon is empty and every score is the base rate's. The corpus is read once: the
    sampled texts, one per id, become a table that all steps of learning read.
    """
    prepare(docs.sparkSession)
    named = (
        labels.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{label_col}`").cast("int").alias("y"))
        .where("i is not null and y is not null")
        .where(~held_out(F.col("i")))
        .groupBy("i")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("i"), "i")
        .limit(sample_rows)
    )
    texts = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"))
    # bounded by sample_rows ids, so the build side may be broadcast; repeated ids are settled before their shuffle
    some = texts.where("t is not null").join(F.broadcast(named), "i").groupBy("i", "y").agg(F.min("t").alias("t"))
    some = table(some.repartition(max(8, docs.sparkSession.sparkContext.defaultParallelism)), "sample")
    kind = some.schema["i"].dataType.simpleString()

    def keys(batch: pa.RecordBatch) -> dict:
        found = pa.array(map(_copy_keys, batch.column("t").to_pylist()), pa.list_(pa.int64()))
        return {"i": batch.column("i"), "y": batch.column("y"), "keys": found}

    once = _without_copies(map_arrow(some.select("i", "y", "t"), f"i {kind}, y int, keys array<long>", keys).collect())
    named = docs.sparkSession.createDataFrame(once, f"i {kind}, y int")
    some = some.drop("y").join(F.broadcast(named), "i").select("t", "y")

    def count(batches):
        both = (Counter(), Counter())
        n = [0, 0]
        for batch in batches:
            for text, y in zip(batch.column("t").to_pylist(), batch.column("y").to_pylist(), strict=True):
                both[y > 0].update(candidates(fold(text)))
                n[y > 0] += 1
        names = ["", *(both[0].keys() | both[1].keys())]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.string()),
                pa.array([n[1], *[both[1][k] for k in names[1:]]], pa.int64()),
                pa.array([n[0], *[both[0][k] for k in names[1:]]], pa.int64()),
            ],
            names=["c", "a", "b"],
        )

    per = map_batches(some, "c string, a long, b long", count).groupBy("c").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    total = F.col("a") + F.col("b")
    tried = per.agg(
        F.count("*").alias("n"),
        F.max(F.when(F.col("c") == "", F.col("a"))).alias("toxic"),
        F.max(F.when(F.col("c") == "", F.col("b"))).alias("clean"),
        # what cannot be a chance finding; no more than the sample's words
        F.collect_list(F.when((F.col("c") != "") & (F.col("a") >= 4) & (F.col("a") >= PRECISION * total), F.struct("c", "a", "b"))).alias("terms"),
    ).first()
    toxic, clean = tried["toxic"] or 0, tried["clean"] or 0
    if not toxic or not clean:
        return Lexicon({}, scale=(math.log((toxic + 0.5) / (clean + 0.5)) if toxic + clean else -2.0, 0.0, 0.0))
    lexicon = Lexicon(choose([(r["c"], r["a"], r["b"]) for r in tried["terms"]], toxic, clean, tried["n"]))

    def measure(batch: pa.RecordBatch) -> dict:
        around, clean_hits = [], []
        for text, y in zip(batch.column("t").to_pylist(), batch.column("y").to_pylist(), strict=True):
            folded = fold(text)
            clean_hits.append(_contexts(folded, lexicon) if y is not None else [])
            around.append(lexicon.features(folded))
        return {
            "y": batch.column("y"),
            "a": pa.array([a for a, _ in around], pa.float64()),
            "b": pa.array([b for _, b in around], pa.float64()),
            "near": pa.array(clean_hits, pa.list_(pa.string())),
        }

    rows = map_arrow(some, "y int, a double, b double, near array<string>", measure).collect()
    seen = (Counter(), Counter())
    for r in rows:
        seen[r["y"] > 0].update(set(r["near"]))
    # a phrase that clean documents hold and toxic ones do not excuses its term
    lexicon.exceptions = {p for p, n in seen[0].items() if n >= 3 and not seen[1][p]}
    rows = sorted((r["a"], r["b"], r["y"]) for r in rows)
    x = np.array([r[:2] for r in rows])
    y = np.array([r[2] > 0 for r in rows], float)
    w = _logistic(x, y)
    if min(w[1:]) < 0:  # more hits or a denser text never lower a score
        k = int(np.argmax(w[1:]))
        one = _logistic(x[:, [k]], y)
        w = np.array([one[0], *[max(0.0, one[1]) if j == k else 0.0 for j in range(2)]])
    lexicon.scale = tuple(float(v) for v in w)
    return lexicon


def _contexts(folded: str, lexicon: Lexicon) -> list[str]:
    """Each hit's word with the word before and with the word after it, in the bounds of the text."""
    out = []
    for start, end, _ in lexicon.hits(folded):
        stop = folded.index(" ", start + 1)
        before = folded.rfind(" ", 0, start)
        after = folded.find(" ", stop + 1)
        if before >= 0:
            out.append(folded[before : stop + 1])
        if after >= 0:
            out.append(folded[start : after + 1])
    return out


def _copy_keys(text: str | None) -> list[int]:
    """Least hashes of the five-word shingles under COPY_KEYS permutations; one key for texts without words."""
    found = shingles(text)
    if not len(found):
        return [0]
    odd = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64) for k in range(1, COPY_KEYS + 1)]
    return [int((found * m).min() >> np.uint64(1)) for m in odd]


def _without_copies(rows: list) -> list[tuple[object, int]]:
    """(id, label) of the sampled rows that share no key with an earlier one, so that a copied text teaches once."""
    seen: set[tuple[int, int]] = set()
    out = []
    for r in sorted(rows, key=lambda r: str(r["i"])):
        keys = set(enumerate(r["keys"]))
        if not keys & seen:
            out.append((r["i"], r["y"]))
        seen |= keys
    return out


def held_out(key: F.Column) -> F.Column:
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted per row of docs, from the whole texts alone.

    Null and empty texts have no hits and the lowest score. A null id is not held out. Repeated rows have a row each;
    other columns, labels among them, are not read for a score.
    """
    lexicon = learn(docs, labels)

    def scores(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "score": pa.array(map(lexicon.score, batch.column("text").to_pylist()), pa.float64())}

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = map_arrow(docs.select("doc_id", "text"), f"doc_id {kind}, score double", scores)
    return got.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
