"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items that fit one block are an automaton that is broadcast, and texts pass it once without a shuffle. More items are dealt
into blocks: hashes of their windows are broadcast first, and only texts with a window of some block, each such text once,
go to the tasks that hold that block's automaton. Texts are never written for each block.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import alnum_words, alnum_text, free_prefix, map_arrow, map_batches, prepare, table
from quillon.llm.minhash import _mix, word_hashes

#: Consecutive item words that make a match.
WINDOW = 10
#: About so many item words go into one automaton, of 1.25 states per word; a process that holds it takes 200 MB.
BLOCK_WORDS = 200_000
#: Blocks whose windows (12 bytes each) are looked for in one pass over the texts.
PASS_BLOCKS = 20
#: Texts that one task matches with one automaton.
TASK_TEXTS = 20_000
#: A document with a larger share of hit words is removed whole.
COVERAGE = 0.5

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BITS = 20


class SuffixAutomaton:
    """All substrings of all items, as states with suffix links; each knows the items in which its strings occur."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.names: list[str] = []
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for name, words in items:
            if words:
                coded.append([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words])
                self.names.append(name)
        for code in coded:
            last = 0
            for c in code:
                last = self._extend(last, c)
        self._mark(coded)

    def _clone(self, p: int, q: int, c: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        known = self.next[last].get(c)
        if known is not None:  # another item has brought this string
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, known, c)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return new

    def _mark(self, coded: list[list[int]]) -> None:
        n = len(self.next)
        self.items: dict[int, list[int]] = {}
        self.whole: dict[int, list[tuple[int, int]]] = {}
        seen = [-1] * n
        for k, code in enumerate(coded):
            v = 0
            for c in code:
                v = self.next[v][c]
                u = v
                while u > 0 and self.length[u] >= self.window and seen[u] != k:
                    seen[u] = k
                    self.items.setdefault(u, []).append(k)
                    u = self.link[u]
            if len(code) < self.window:
                self.whole.setdefault(v, []).append((len(code), k))
        order = sorted(range(1, n), key=self.length.__getitem__)
        self.at_window, self.short_up = [0] * n, [0] * n
        for v in order:
            up = self.link[v]
            if self.length[v] >= self.window:
                self.at_window[v] = self.at_window[up] or v
            self.short_up[v] = v if v in self.whole else self.short_up[up]
        self.least = min([self.window, *[m for some in self.whole.values() for m, _ in some]]) if coded else self.window
        self.pairs = np.zeros(1 << _BITS, bool)
        for code in coded:
            a = np.asarray(code, np.uint64)
            self.pairs[self._pair(a[:-1], a[1:])] = True

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - _BITS)).astype(np.int64)

    def _runs(self, code: np.ndarray) -> list[tuple[int, int]]:
        """Stretches outside which the automaton cannot reach a match: all their word pairs may occur in items."""
        if self.least < 2:
            good = code > 0
            size, more = 1, 0
        else:
            good = (code[:-1] > 0) & (code[1:] > 0)
            good &= self.pairs[self._pair(code[:-1], code[1:])]
            size, more = self.least - 1, 1
        edge = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(np.int8)))
        a, b = edge[::2], edge[1::2]
        long = b - a >= size
        return list(zip((a[long]).tolist(), (b[long] + more).tolist(), strict=True))

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged spans of hit words (from, to) and the items that occur."""
        if not self.names or len(words) < self.least:
            return [], set()
        get = self.vocab.get
        code = np.fromiter([get(w, 0) for w in words], np.uint64, len(words))
        spans: list[list[int]] = []
        found: set[int] = set()
        nxt, link, length = self.next, self.link, self.length

        def add(a: int, b: int) -> None:
            while spans and a <= spans[-1][1]:
                x, y = spans.pop()
                a, b = min(a, x), max(b, y)
            spans.append([a, b])

        for start, end in self._runs(code):
            v = run = 0
            for i, c in enumerate(code[start:end].tolist(), start):
                while v and c not in nxt[v]:
                    v = link[v]
                    run = length[v]
                to = nxt[v].get(c)
                if to is None:
                    v = run = 0
                    continue
                v, run = to, run + 1
                if run >= self.window:
                    add(i + 1 - self.window, i + 1)
                    found.update(self.items[self.at_window[v]])
                u = self.short_up[v]
                while u:
                    for m, k in self.whole[u]:
                        if m <= run:
                            add(i + 1 - m, i + 1)
                            found.add(k)
                    u = self.short_up[link[u]]
        return [(a, b) for a, b in spans], found


def _pieces(items: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> DataFrame:
    """i and words of each item; one longer than a block comes in pieces, which overlap by all but one word of a window."""
    some = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("i"), F.coalesce(f"`{text_col}`", F.lit("")).alias("t"))

    def cut(batch: pa.RecordBatch) -> dict:
        names, parts = [], []
        for i, text in zip(batch.column("i").to_pylist(), batch.column("t").to_pylist(), strict=True):
            words = alnum_words(text)
            step = max(1, block_words - window + 1)
            for a in range(0, max(1, len(words) - window + 1) if len(words) > block_words else 1, step):
                piece = words[a : a + block_words] if len(words) > block_words else words
                if piece:
                    names.append(i)
                    parts.append(b" ".join(piece))
        return {"i": pa.array(names, pa.string()), "w": pa.array(parts, pa.binary()), "n": pa.array([p.count(b" ") + 1 for p in parts], pa.int64())}

    return map_arrow(some, "i string, w binary, n long", cut)


def _fields(p: str) -> list[T.StructField]:
    long, text = T.ArrayType(T.LongType()), T.ArrayType(T.StringType())
    return [T.StructField(p + "words", T.LongType(), False), T.StructField(p + "from", long), T.StructField(p + "to", long), T.StructField(p + "items", text)]


def _found(rows: list[tuple[int, list, list]]) -> list[pa.Array]:
    """Columns of (words, spans, items) rows."""
    long = pa.list_(pa.int64())
    return [
        pa.array([n for n, _, _ in rows], pa.int64()),
        pa.array([[a for a, _ in s] for _, s, _ in rows], long),
        pa.array([[b for _, b in s] for _, s, _ in rows], long),
        pa.array([sorted(set(i)) for _, _, i in rows], pa.list_(pa.string())),
    ]


def find(
    docs: DataFrame,
    items: DataFrame,
    *,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    prefix: str = "__d_",
) -> DataFrame:
    """docs and prefix + words, from and to (merged spans of hit words) and items (sorted distinct ids).

    Null and empty texts have no words; null items and items without words match nothing, null item ids are empty strings.
    Repeated items count once, repeated rows of docs get a row each. Columns may have any names that do not begin with prefix.
    """
    spark = prepare(docs.sparkSession)
    pieces = table(_pieces(items, item_id_col, item_text_col, window, block_words), "items")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    names = [f.name for f in _fields(prefix)]
    if total > block_words:
        return _find_in_blocks(docs, pieces, -(-total // block_words), text_col, window, prefix)
    rows = sorted((r["i"], bytes(r["w"])) for r in pieces.collect())
    # its size is bounded by block_words
    held = spark.sparkContext.broadcast(SuffixAutomaton([(i, w.split()) for i, w in rows], window))

    def matched(batch: pa.RecordBatch) -> dict:
        auto, out = held.value, []
        for text in batch.column(text_col).to_pylist():
            words = alnum_words(text)
            spans, got = auto.match(words)
            out.append((len(words), spans, [auto.names[k] for k in got]))
        return {n: batch.column(n) for n in batch.schema.names} | dict(zip(names, _found(out), strict=True))

    return map_arrow(docs, T.StructType([*docs.schema.fields, *_fields(prefix)]), matched)


def _codes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash per run of so many words."""
    n = len(words) - size + 1
    code = np.full(max(0, n), size, np.uint64)
    for k in range(size if n > 0 else 0):
        code = code * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n]
    return _mix(code)


def _find_in_blocks(docs: DataFrame, pieces: DataFrame, n: int, text_col: str, window: int, prefix: str) -> DataFrame:
    """find for items of n blocks. What it finds for a text hangs on the text alone, so texts are known by a digest."""
    spark = docs.sparkSession
    pieces = table(pieces.withColumn("block", F.pmod(F.xxhash64("i", "w"), F.lit(n)).cast("int")), "blocks")

    def windows(batch: pa.RecordBatch) -> dict:
        blocks, sizes, codes = [], [], []
        for block, raw in zip(batch.column("block").to_pylist(), batch.column("w").to_pylist(), strict=True):
            hashes = word_hashes(raw)
            size = min(window, len(hashes))
            some = np.unique(_codes(hashes, size))
            blocks.append(np.full(len(some), block, np.int32))
            sizes.append(np.full(len(some), size, np.int32))
            codes.append(some.view(np.int64))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return {"block": pa.array(join(blocks, np.int32)), "size": pa.array(join(sizes, np.int32)), "code": pa.array(join(codes, np.int64))}

    codes = table(map_arrow(pieces.select("block", "w"), "block int, size int, code long", windows).distinct(), "windows")
    sizes = sorted(r["size"] for r in codes.select("size").distinct().collect())  # the window and shorter
    texts = docs.select(F.md5(F.col(f"`{text_col}`")).alias("key"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    wanted = None
    for first in range(0, n, PASS_BLOCKS):
        rows = codes.where((F.col("block") >= first) & (F.col("block") < first + PASS_BLOCKS)).select("code", "block").toPandas().sort_values("code")
        held = spark.sparkContext.broadcast((rows["code"].to_numpy(), rows["block"].to_numpy()))  # PASS_BLOCKS * BLOCK_WORDS windows at most
        some = _wanted(texts, held, sizes)
        wanted = some if wanted is None else wanted.unionByName(some)
    wanted = table(wanted, "wanted")
    tasks = {r["block"]: -(-r["n"] // TASK_TEXTS) for r in wanted.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per block
    share = spark.createDataFrame(sorted(tasks.items()), "block int, tasks int")
    home = F.pmod(F.xxhash64("key"), F.col("tasks")).cast("int").alias("task")
    guests = wanted.join(F.broadcast(share), "block").select("block", home, F.lit(1).alias("role"), "key", F.encode("text", "utf-8").alias("body"))
    owners = pieces.join(F.broadcast(share), "block").select(
        "block", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(0).alias("role"), F.col("i").alias("key"), F.col("w").alias("body")
    )
    dealt = owners.unionByName(guests).repartition("block", "task").sortWithinPartitions("block", "task", "role", "key", "body")

    def match(batches):
        at, items, auto = None, [], None
        for batch in batches:
            keys, out = [], []
            for block, task, role, key, body in zip(*(batch.column(c).to_pylist() for c in ("block", "task", "role", "key", "body")), strict=True):
                if (block, task) != at:
                    at, items, auto = (block, task), [], None
                if not role:
                    items.append((key, body.split()))
                    continue
                if auto is None:
                    auto, items = SuffixAutomaton(items, window), []
                words = alnum_words(body)
                spans, got = auto.match(words)
                if spans:
                    keys.append(key)
                    out.append((len(words), spans, [auto.names[k] for k in got]))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *_found(out)], names=["key", "words", "from", "to", "items"])

    schema = T.StructType([T.StructField("key", T.StringType()), *_fields("")])
    per = map_batches(dealt, schema, match).groupBy("key").agg(F.collect_set(F.struct("from", "to", "items")).alias("found"))
    hits = table(per.select(F.col("key").alias(prefix + "key"), F.col("found").alias(prefix + "found")), "hits")
    # null texts match nothing, each under a key of its own
    key = F.coalesce(F.md5(F.col(f"`{text_col}`")), F.concat(F.lit("-"), F.monotonically_increasing_id()))
    both = docs.withColumn(prefix + "key", key).join(hits, prefix + "key", "left").drop(prefix + "key")
    names, own = [f.name for f in _fields(prefix)], docs.columns

    def united(batch: pa.RecordBatch) -> dict:
        out = []
        for text, found in zip(batch.column(text_col).to_pylist(), batch.column(prefix + "found").to_pylist(), strict=True):
            spans = _union([p for x in found or () for p in zip(x["from"], x["to"], strict=True)])
            out.append((len(alnum_words(text)), spans, [i for x in found or () for i in x["items"]]))
        return {n: batch.column(n) for n in own} | dict(zip(names, _found(out), strict=True))

    return map_arrow(both, T.StructType([*docs.schema.fields, *_fields(prefix)]), united)


def _wanted(texts: DataFrame, held, sizes: list[int]) -> DataFrame:
    """block, key and text of the texts with a window of a block, each at most once per task."""

    def wanted(batches):
        codes, blocks = held.value
        seen: set[tuple[int, str]] = set()
        for batch in batches:
            out = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                hashes = word_hashes(alnum_text(text))
                mine = np.unique(np.concatenate([_codes(hashes, size) for size in sizes])).view(np.int64)
                low, high = np.searchsorted(codes, mine, "left"), np.searchsorted(codes, mine, "right")
                for b in {int(x) for a, z in zip(low[high > low].tolist(), high[high > low].tolist(), strict=True) for x in blocks[a:z]}:
                    if (b, key) not in seen:
                        seen.add((b, key))
                        out.append((b, key, text))
            if out:
                b, k, t = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.string()), pa.array(t, pa.string())], names=["block", "key", "text"])

    return map_batches(texts, "block int, key string, text string", wanted)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _hit(p: str) -> F.Column:
    pairs = F.arrays_zip(F.col(p + "from").alias("a"), F.col(p + "to").alias("b"))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row per row of docs: n_words, n_hit, n_items, items_sha256 and contaminated.

    Null and empty texts have no words and no hits, null items and items without words no windows. Null item ids are
    empty strings. Repeated documents get a row each, repeated items count once. Other columns are not read.
    """
    some = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    got = find(some, items, **options)
    return got.select(
        "doc_id",
        F.col("__d_words").alias("n_words"),
        _hit("__d_").alias("n_hit"),
        F.size("__d_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__d_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("__d_from") > 0).alias("contaminated"),
    )


def without_words(text: str, starts: list[int], ends: list[int]) -> str:
    """text without the stretches from the first to the last character of each span of words."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for a, b in zip(starts, ends, strict=True):
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join([*out, text[last:]])


def decontaminate(
    docs: DataFrame, items: DataFrame, *, text_col: str = "text", coverage: float = COVERAGE, **options
) -> DataFrame:
    """The rows of docs with hit spans cut from their texts; rows with a larger share of hit words than coverage go.

    Clean rows stay as they are, null and empty texts and repeated rows included; an empty table of items changes nothing.
    The columns are those of docs and may have any names; null items and items without words match nothing.
    """
    p = free_prefix(docs.columns, "__d_")
    cols = docs.columns
    got = find(docs, items, text_col=text_col, prefix=p, **options).where(_hit(p) <= coverage * F.col(p + "words"))

    def cut(batch: pa.RecordBatch) -> dict:
        texts, a, b = (batch.column(n).to_pylist() for n in (text_col, p + "from", p + "to"))
        new = [without_words(t, x, y) if x else t for t, x, y in zip(texts, a, b, strict=True)]
        return {n: batch.column(n) for n in cols} | {text_col: pa.array(new, pa.string())}

    return map_arrow(got, T.StructType(docs.schema.fields), cut)
