"""Incremental, reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

The reference counts (line, document, times) and the repeated lines that follow from them are tables with a folder per
shard of the line keys. Each shard has a cuckoo filter of its repeated lines, a row of a table that executors build and
change: an insertion or deletion of documents reads and rewrites the shards of its own lines alone. When documents are
judged, the filters tell on the spot which lines cannot be repeated; the exact table decides on the rest.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import columns_of, free_prefix, map_arrow, map_batches, prepare, table

#: Lines shorter than this, and lines in fewer documents, are left alone.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: Repeated lines up to this many are broadcast (32 bytes each) behind their filters; beyond that, only filters are.
BROADCAST_KEYS = 1_000_000
#: Filters are broadcast in groups of at most so many bytes; each group meets the lines of its own shards.
FILTER_BYTES = 128 * 1024 * 1024
#: A filter has about 3 bytes per repeated line of its shard, and one filter at a time is in a task's memory.
SHARDS = 16
#: A line that has more than the total's share of one in so many references is met without a shuffle; there are fewer of them.
HOT = 1000

_SPACES = " \t\n\x0b\x0c\r"


def line_key(line: str, least_chars: int = LEAST_CHARS) -> bytes | None:
    """128 bits of the line without ASCII white space at its ends and with A-Z lower-cased; null for short lines."""
    line = line.strip(_SPACES)
    if len(line) < least_chars:
        return None
    # bytes.lower() touches A-Z alone
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass").lower())


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; insertions and deletions of keys of 16 bytes.

    What finds no place after KICKS moves goes to a short list beside the buckets, so that no key is ever missed.
    """

    SLOTS, KICKS, LOAD = 4, 500, 0.85

    def __init__(self, buckets: np.ndarray, stash: list[tuple[int, int]] | None = None):
        self.buckets, self.stash = buckets, list(stash or ())

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        size = 1 << max(2, int(np.ceil(np.log2(max(1, n) / (cls.SLOTS * cls.LOAD)))))
        return cls(np.zeros((size, cls.SLOTS), np.uint16))

    @classmethod
    def read(cls, data: bytes, stash: bytes) -> CuckooFilter:
        pairs = np.frombuffer(stash, np.int64).reshape(-1, 2)
        return cls(np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy(), [tuple(map(int, p)) for p in pairs])

    def written(self) -> tuple[bytes, bytes]:
        return self.buckets.tobytes(), np.array(self.stash, np.int64).tobytes()

    def _places(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.buckets) - 1)
        print_ = (low >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
        one = high & mask
        return print_, one.astype(np.int64), (one ^ self._step(print_, mask)).astype(np.int64)

    @staticmethod
    def _step(print_: np.ndarray, mask: np.uint64) -> np.ndarray:
        return (print_.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & mask

    def contains(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        f, a, b = self._places(high, low)
        wide = f[:, None]
        out = (self.buckets[a] == wide).any(1) | (self.buckets[b] == wide).any(1)
        for print_, at in self.stash:
            out |= (f == print_) & ((a == at) | (b == at))
        return out

    def _put(self, f: int, a: int, b: int, rng: np.random.Generator) -> bool:
        mask = np.uint64(len(self.buckets) - 1)
        for at in (a, b):
            free = np.flatnonzero(self.buckets[at] == 0)
            if len(free):
                self.buckets[at, free[0]] = f
                return True
        at = a
        for _ in range(self.KICKS):
            slot = int(rng.integers(self.SLOTS))
            f, self.buckets[at, slot] = int(self.buckets[at, slot]), f
            at = int(np.uint64(at) ^ self._step(np.array([f], np.uint16), mask)[0])
            free = np.flatnonzero(self.buckets[at] == 0)
            if len(free):
                self.buckets[at, free[0]] = f
                return True
        self.stash.append((f, at))
        return False

    def _fill(self, f: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Puts fingerprints into the free slots of their buckets, all at once; tells which found none."""
        order = np.argsort(at, kind="stable")
        sorted_ = at[order]
        first = np.searchsorted(sorted_, sorted_)
        rank = np.arange(len(sorted_)) - first
        # the rank-th free slot of each bucket: free slots come last in the order of emptiness, taken from its end
        empty = np.argsort(self.buckets[sorted_] != 0, axis=1, kind="stable")
        room = (self.buckets[sorted_] == 0).sum(1)
        good = rank < room
        self.buckets[sorted_[good], empty[good, rank[good]]] = f[order][good]
        left = np.zeros(len(f), bool)
        left[order[~good]] = True
        return left

    def insert(self, high: np.ndarray, low: np.ndarray) -> bool:
        """False if some fingerprints found no place in the buckets; then the table should be built anew with more of them."""
        f, a, b = self._places(high, low)
        left = self._fill(f, a)
        f, a, b = f[left], a[left], b[left]
        left = self._fill(f, b)
        f, a, b = f[left], a[left], b[left]
        rng = np.random.default_rng(0)
        return all([self._put(int(x), int(y), int(z), rng) for x, y, z in zip(f, a, b, strict=True)])

    def delete(self, high: np.ndarray, low: np.ndarray) -> None:
        """Removes one fingerprint of each key. Only keys that were inserted may be deleted."""
        for f, a, b in zip(*self._places(high, low), strict=True):
            for at in (a, b):
                slot = np.flatnonzero(self.buckets[at] == f)
                if len(slot):
                    self.buckets[at, slot[0]] = 0
                    break
            else:
                gone = next(i for i, (x, at) in enumerate(self.stash) if x == f and at in (a, b))
                del self.stash[gone]

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray) -> CuckooFilter:
        n = len(high)
        while True:
            made = cls.sized(n)
            if made.insert(high, low):
                return made
            n = 2 * max(4, n)


def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), ">u8").reshape(-1, 2).astype(np.uint64)
    return both[:, 0].copy(), both[:, 1].copy()


def _shard(low: np.ndarray, shards: int) -> np.ndarray:
    return ((low & np.uint64(0xFFFF)) % np.uint64(shards)).astype(np.int64)


class Filters:
    """The filters of some shards, for executors."""

    def __init__(self, rows: list[tuple[int, bytes, bytes]], shards: int):
        self.shards = shards
        self.by_shard = {s: CuckooFilter.read(data, stash) for s, data, stash in rows}

    def maybe(self, keys: list[bytes]) -> np.ndarray:
        """Which keys may be repeated lines; keys of other shards are not."""
        out = np.zeros(len(keys), bool)
        if keys:
            high, low = _halves(keys)
            shard = _shard(low, self.shards)
            for s, f in self.by_shard.items():
                here = np.flatnonzero(shard == s)
                if len(here):
                    out[here] = f.contains(high[here], low[here])
        return out


def _lines(text: str | None, least_chars: int) -> list[tuple[int, bytes]]:
    """The places and keys of the lines that are long enough."""
    found = ((i, line_key(x, least_chars)) for i, x in enumerate((text or "").split("\n")) if len(x) >= least_chars)
    return [(i, k) for i, k in found if k]


def references(docs: DataFrame, least_chars: int = LEAST_CHARS, shards: int = SHARDS) -> DataFrame:
    """shard, k, the columns of docs but text, and n: how often the row holds the line. A row per line and row of docs."""
    own = [f for f in docs.schema.fields if f.name != "text"]

    def keys(batch: pa.RecordBatch) -> dict:
        where, found, counts = [], [], []
        for r, text in enumerate(batch.column("text").to_pylist()):
            seen: dict[bytes, int] = {}
            for _, k in _lines(text, least_chars):
                seen[k] = seen.get(k, 0) + 1
            where += [r] * len(seen)
            found += seen.keys()
            counts += seen.values()
        at = pa.array(where, pa.int64())
        return {f.name: batch.column(f.name).take(at) for f in own} | {
            "shard": pa.array(_shard(_halves(found)[1], shards) if found else [], pa.int32()),
            "k": pa.array(found, pa.binary()),
            "n": pa.array(counts, pa.int64()),
        }

    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("k", T.BinaryType()), *own, T.StructField("n", T.LongType())])
    return map_arrow(docs, schema, keys)


class _Part(NamedTuple):
    """Tables that hold the shards of one build or change; later changes have replaced the shards that are not live."""

    refs: DataFrame  # shard, k, doc_id, n
    repeated: DataFrame  # shard, k, n_docs, holder
    filters: DataFrame  # shard, n_keys, size, data, stash
    live: frozenset[int]


class LineIndex:
    """Exact reference counts of the documents inserted so far, the repeated lines among them, and a filter per shard.

    Insertions add to the counts and deletions take from them, so that whatever a document has caused to be dropped
    comes back once it is deleted. Both give a new index, which shares the tables of the shards that they do not touch.
    """

    def __init__(self, spark: SparkSession, id_type: T.DataType, parts: tuple[_Part, ...] = (), *, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, shards: int = SHARDS):
        self.spark, self.id_type, self.parts = spark, id_type, parts
        self.least_chars, self.least_docs, self.shards = least_chars, least_docs, shards

    @classmethod
    def empty(cls, spark: SparkSession, id_type: str = "bigint", **options) -> LineIndex:
        return cls(spark, T.StructType.fromDDL(f"x {id_type}")["x"].dataType, **options)

    @classmethod
    def build(cls, docs: DataFrame, **options) -> LineIndex:
        return cls(docs.sparkSession, docs.schema["doc_id"].dataType, **options).insert(docs)

    def _live(self, name: str, schema: str, only: frozenset[int] | None = None) -> DataFrame:
        """The rows of a table of the parts in their live shards, or in some of these; other shards' folders stay unread."""
        out = self.spark.createDataFrame([], schema)
        for part in self.parts:
            some = part.live if only is None else part.live & only
            if some:
                rows = getattr(part, name)
                whole = len(some) == self.shards
                out = out.unionByName(rows if whole else rows.where(F.col("shard").isin(sorted(some))))
        return out

    @property
    def _kind(self) -> str:
        return self.id_type.simpleString()

    @property
    def refs(self) -> DataFrame:
        return self._live("refs", f"shard int, k binary, doc_id {self._kind}, n long")

    def repeated(self, only: frozenset[int] | None = None) -> DataFrame:
        """shard, k, n_docs and holder; a null id is one document and holds a line only if no other does."""
        return self._live("repeated", f"shard int, k binary, n_docs long, holder {self._kind}", only)

    def filters(self, only: frozenset[int] | None = None) -> DataFrame:
        return self._live("filters", "shard int, n_keys long, size long, data binary, stash binary", only)

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._changed(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        return self._changed(docs, -1)

    def _changed(self, docs: DataFrame, sign: int) -> LineIndex:
        """One aggregation by line and document within the shards of the documents' lines; what sums to nothing is forgotten."""
        prepare(self.spark)
        new = references(docs.select(F.col("doc_id").cast(self.id_type).alias("doc_id"), "text"), self.least_chars, self.shards)
        if self.parts:
            new = table(new.withColumn("n", sign * F.col("n")), "changes", "shard")
            touched = frozenset(r["shard"] for r in new.select("shard").distinct().collect())  # at most `shards` rows
            if not touched:
                return self
            new = new.unionByName(self._live("refs", f"shard int, k binary, doc_id {self._kind}, n long", touched))
        else:  # nothing to take from
            touched = frozenset(range(self.shards))
            new = new if sign > 0 else new.where(F.lit(False))
        summed = new.groupBy("shard", "k", "doc_id").agg(F.sum("n").alias("n")).where("n > 0")
        refs = table(summed, "lines", "shard")
        per = refs.groupBy("shard", "k").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("holder"))
        repeated = table(per.where(F.col("n_docs") >= self.least_docs), "repeated")
        part = _Part(refs, repeated, self._filtered(repeated, touched), touched)
        old = [p._replace(live=p.live - touched) for p in self.parts]
        return LineIndex(
            self.spark, self.id_type, (*[p for p in old if p.live], part), least_chars=self.least_chars, least_docs=self.least_docs, shards=self.shards
        )

    def _filtered(self, repeated: DataFrame, touched: frozenset[int]) -> DataFrame:
        """The filters of the touched shards: changed by the lines that have come and gone, or new where they have outgrown their size."""
        # at most `shards` rows each
        sizes = {r["shard"]: r["n"] for r in repeated.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        had = {r["shard"]: r["size"] for r in self.filters(touched).select("shard", "size").collect()}
        fresh = [s for s in touched if s not in had or sizes.get(s, 0) > CuckooFilter.LOAD * CuckooFilter.SLOTS * had[s]]
        steady = frozenset(touched) - frozenset(fresh)
        now = repeated.select("shard", "k")
        rows = now.where(F.col("shard").isin(fresh)).select("shard", "k", F.lit(1).alias("op")) if steady else now.withColumn("op", F.lit(1))
        if steady:
            now, before = now.where(F.col("shard").isin(sorted(steady))), self.repeated(steady).select("shard", "k")
            come, gone = now.join(before, ["shard", "k"], "left_anti"), before.join(now, ["shard", "k"], "left_anti")
            rows = rows.unionByName(come.withColumn("op", F.lit(1))).unionByName(gone.withColumn("op", F.lit(2)))
        rows = rows.select("shard", "op", "k", F.lit(None).cast("binary").alias("data"), F.lit(None).cast("binary").alias("stash"))
        starts = self.spark.createDataFrame([(s,) for s in fresh], "shard int").selectExpr("shard", "0 AS op", "CAST(NULL AS binary) AS k", "CAST(NULL AS binary) AS data", "CAST(NULL AS binary) AS stash")
        old = self.filters(steady).select("shard", F.lit(0).alias("op"), F.lit(None).cast("binary").alias("k"), "data", "stash")
        dealt = rows.unionByName(starts).unionByName(old).repartition(self.shards, "shard").sortWithinPartitions("shard", "op")

        def build(batches):
            at, held = None, None

            def row():
                data, stash = held.written()
                n = int((held.buckets != 0).sum()) + len(held.stash)
                cols = [pa.array([at], pa.int32()), pa.array([n], pa.int64()), pa.array([len(held.buckets)], pa.int64()), pa.array([data]), pa.array([stash])]
                return pa.RecordBatch.from_arrays(cols, names=["shard", "n_keys", "size", "data", "stash"])

            for batch in batches:
                shard, op = (np.asarray(batch.column(c)) for c in ("shard", "op"))
                keys = batch.column("k").to_pylist()
                edges = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(op) != 0)) + 1).tolist(), len(shard)]
                for a, b in zip(edges, edges[1:], strict=False):
                    if a == b:
                        continue
                    if not op[a]:  # the filter as it was, one row per shard
                        if held is not None:
                            yield row()
                        at, data = int(shard[a]), batch.column("data")[a].as_py()
                        held = CuckooFilter.sized(sizes.get(at, 0)) if data is None else CuckooFilter.read(data, batch.column("stash")[a].as_py())
                    elif op[a] == 1:
                        held.insert(*_halves(keys[a:b]))
                    else:
                        held.delete(*_halves(keys[a:b]))
            if held is not None:
                yield row()

        return table(map_batches(dealt, "shard int, n_keys long, size long, data binary, stash binary", build), "filters")

    def _groups(self) -> list[list[int]]:
        """The shards in groups whose filters have FILTER_BYTES together, or a single filter each."""
        out: list[list[int]] = [[]]
        total = 0
        for r in self.filters().select("shard", "size").orderBy("shard").collect():
            n = 2 * CuckooFilter.SLOTS * r["size"]
            if total + n > FILTER_BYTES and out[-1]:
                out.append([])
                total = 0
            out[-1].append(r["shard"])
            total += n
        return out

    def _broadcast(self, shards: list[int]):
        rows = self.filters(frozenset(shards)).select("shard", "data", "stash").collect()  # FILTER_BYTES, or one filter
        return self.spark.sparkContext.broadcast(Filters([(r["shard"], bytes(r["data"]), bytes(r["stash"])) for r in rows], self.shards))

    def apply(self, docs: DataFrame, *, broadcast_keys: int = BROADCAST_KEYS, prefix: str = "__l_") -> DataFrame:
        """docs (doc_id, text and more) and prefix + text, lines and dropped.

        Lines that the filters of their shards do not know stay, without a look at the exact table. Up to broadcast_keys
        repeated lines are broadcast behind the filters. Beyond that, filters are broadcast alone, group by group; only
        lines that pass them are shuffled to meet the exact table, and each row's lost lines come to it in a join on its id
        and a hash of its text. Lines that hold more than a thousandth of all references are met without a shuffle.
        """
        prepare(self.spark)
        found = self.repeated()
        if not self.parts or found.count() <= broadcast_keys:
            held = self._broadcast(list(range(self.shards)))
            exact = self.spark.sparkContext.broadcast({bytes(r["k"]): r["holder"] for r in found.select("k", "holder").collect()})
            return _drop(docs, self.least_chars, prefix, held, exact, None)
        row = [F.col("doc_id"), F.xxhash64("text").alias("h")]
        groups = self._groups()
        lines = references(docs.select(*row, "text"), self.least_chars, self.shards).drop("n")
        if len(groups) > 1:
            lines = table(lines, "lines", "shard")
        passed = None
        for shards in groups:
            some = lines if len(groups) == 1 else lines.where(F.col("shard").isin(shards))
            some = _passing(some, self._broadcast(shards))
            passed = some if passed is None else passed.unionByName(some)
        passed = table(passed, "passed")
        total = found.agg(F.sum("n_docs")).first()[0]
        hot = F.col("n_docs") * HOT > total
        often = table(found.where(hot).select("k", "holder"), "hot")  # fewer than HOT rows
        one = passed.join(F.broadcast(often), "k")
        two = passed.join(F.broadcast(often), "k", "left_anti").join(found.where(~hot).select("k", "holder"), "k")
        lost = (
            one.unionByName(two)
            .where(~F.col("doc_id").eqNullSafe(F.col("holder")))
            .groupBy(F.col("doc_id").alias(prefix + "id"), F.col("h").alias(prefix + "h"))
            .agg(F.collect_set("k").alias(prefix + "lost"))
        )
        same = docs["doc_id"].eqNullSafe(lost[prefix + "id"]) & (F.xxhash64(docs["text"]) == lost[prefix + "h"])
        return _drop(docs.join(lost, same, "left").drop(prefix + "id", prefix + "h"), self.least_chars, prefix, None, None, prefix + "lost")


def _passing(lines: DataFrame, held) -> DataFrame:
    """The lines that the broadcast filters may know."""

    def keep(batch: pa.RecordBatch) -> dict:
        some = batch.filter(pa.array(held.value.maybe(batch.column("k").to_pylist())))
        return {n: some.column(n) for n in some.schema.names}

    return map_arrow(lines, lines.schema, keep)


def _drop(docs: DataFrame, least_chars: int, prefix: str, held, exact, lost_col: str | None) -> DataFrame:
    cols = [f for f in docs.schema.fields if f.name != lost_col]
    text, n_lines, n_dropped = (prefix + n for n in ("text", "lines", "dropped"))
    schema = T.StructType([*cols, T.StructField(text, T.StringType()), T.StructField(n_lines, T.LongType(), False), T.StructField(n_dropped, T.LongType(), False)])

    def drop(batch: pa.RecordBatch) -> dict:
        texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
        gone: list[set[int]] = [set() for _ in texts]
        known = [(r, i, k) for r, t in enumerate(texts) for i, k in _lines(t, least_chars)]
        if held is not None:
            for at in np.flatnonzero(held.value.maybe([k for _, _, k in known])).tolist():
                r, i, k = known[at]
                if k in exact.value and exact.value[k] != ids[r]:
                    gone[r].add(i)
        else:
            lost = [set(x or ()) for x in batch.column(lost_col).to_pylist()]
            for r, i, k in known:
                if k in lost[r]:
                    gone[r].add(i)
        left = [t if not g else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in g) for t, g in zip(texts, gone, strict=True)]
        return {f.name: batch.column(f.name) for f in cols} | {
            text: pa.array(left, pa.string()),
            n_lines: pa.array([(t or "").count("\n") + 1 for t in texts], pa.int64()),
            n_dropped: pa.array(map(len, gone), pa.int64()),
        }

    return map_arrow(docs, schema, drop)


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 per row of docs, after inserting all of docs into an empty index.

    Null and empty texts are one empty line. A document that repeats a line counts once for it; rows that share an id
    are one document, and so are rows without one. Other columns are not read. Empty tables give no rows.
    """
    some = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    got = LineIndex.build(some).apply(some, **options)
    return got.select(
        "doc_id",
        F.col("__l_lines").alias("n_lines"),
        F.col("__l_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("__l_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def dedup_texts(docs: DataFrame, **options) -> DataFrame:
    """docs (doc_id, text and any others) with the lost lines gone from text, all rows and columns kept.

    Null and empty texts stay as they are, as do texts without lost lines; a text that loses all its lines is empty. Rows
    that share an id, or have none, are one document; equal rows lose the same lines. Columns may have any names.
    """
    prefix = free_prefix(docs.columns, "__l_")
    got = LineIndex.build(docs.select("doc_id", "text")).apply(docs, prefix=prefix, **options)
    return got.select(*[F.col(prefix + "text").alias("text") if c == "text" else own for c, own in zip(docs.columns, columns_of(docs), strict=True)])
