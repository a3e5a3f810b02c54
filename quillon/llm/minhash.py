"""Near-dedup by min-max hashing: the least and the greatest value under each permutation fill the bands.

Documents with equal shingle sets form a class, which takes part once. Classes that share a band meet at the bucket's
first class; links are confirmed on full sets. Where a bucket still holds several components, its classes are compared
across components block by block, so that a large group costs rows for its members and not for its pairs.

A text is found again by its row's id and a hash of it, so that null and repeated ids cost nothing. Joins on buckets,
first classes, hubs and components take their few hot keys apart (skew_join); all others have a bounded number of rows
per key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import discard, free_prefix, map_arrow, map_batches, prepare, skew_join, table

WIDTH, PERCENT = 5, 75
#: Permutations of each kind of band; a permutation gives two values, so 120 of them fill 48 bands of 5 rows.
PERMUTATIONS, ROWS = 120, 5
BANDS = 2 * PERMUTATIONS // ROWS
#: Pairs whose signatures agree on a smaller share are not worth a look at the sets (5 deviations below the threshold).
AGREE = 0.6
#: Classes of a bucket whose sketches (about 700 bytes each) a task holds to compare others with.
BLOCK = 2048
#: Classes of a bucket that are compared with one block by one task, one after the other.
GUESTS = 2048
#: Classes whose whole sets a task holds to compare others with, and classes that it compares with them.
SETS = 256
#: Members of one first class that are confirmed together.
SALT = 256
#: Classes in pairs up to this many (about 60 bytes each) are broadcast to fetch their texts; more meet them in a join.
BROADCAST_ROLES = 400_000
#: Band keys that classes share, up to this many (about 50 bytes each), are broadcast; more meet the classes in a join.
BROADCAST_KEYS = 1_000_000
#: Links up to this many (32 bytes each) are united in one task; more by rounds of joins.
ONE_TASK = 250_000

_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_CHUNK = 1 << 16
_UP, _DOWN = _powers(_P, _CHUNK), _powers(_INV, _CHUNK)


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash per word between ASCII white space, from running sums over the bytes."""
    at = np.frombuffer(raw, np.uint8)
    if not len(at):
        return np.zeros(0, np.uint64)
    inside = ~_SPACE[at]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if len(at) <= _CHUNK:
        up, down = _UP[: len(at)], _DOWN
    else:
        up, down = _powers(_P, len(at)), _powers(_INV, len(at))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((at.astype(np.uint64) + np.uint64(1)) * up)])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; of its whole word sequence where that is shorter."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    n = len(words)
    if not n:
        return words
    if n < width:
        return np.array([_mix(np.array([_fold(words) + np.uint64(n)], np.uint64))[0]], np.uint64)
    code = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        code = code * np.uint64(0xD6E8FEB86659FD93) + words[k : n - width + 1 + k]
    return np.unique(_mix(code))


def _fold(words: np.ndarray) -> np.uint64:
    out = np.zeros(1, np.uint64)
    for w in words:
        out = _mix(out * np.uint64(0xD6E8FEB86659FD93) + w)
    return out[0]


_RNG = np.random.default_rng(20240229)
_MUL = _RNG.integers(0, 2**32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 2**32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Least and greatest value under each permutation, 2 * PERMUTATIONS numbers of 32 bits."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    high = np.zeros(PERMUTATIONS, np.uint32)
    for k in range(0, len(x), 2048):
        y = x[k : k + 2048][None, :] * _MUL[:, None] + _ADD[:, None]
        # a second multiplication keeps close inputs from staying close
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        low, high = np.minimum(low, y.min(1)), np.maximum(high, y.max(1))
    return np.concatenate([low, high])


_ORDER = np.random.default_rng(5).permutation(2 * PERMUTATIONS)


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of ROWS values, minima and maxima mixed."""
    rows = sig[_ORDER].astype(np.uint64).reshape(BANDS, ROWS)
    code = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        code = _mix(code * np.uint64(0xD6E8FEB86659FD93) + rows[:, k])
    return code.view(np.int64)


def _print(keys: np.ndarray) -> np.ndarray:
    """The upper half of band keys."""
    return (np.asarray(keys, np.int64).view(np.uint64) >> np.uint64(32)).astype(np.uint32)


_SKETCH = "doc_id {id}, n_shingles long, cls binary, bands array<long>, prints binary, sig binary"


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, cls (a digest of the set; null if empty), bands, half of each band, 8 bits of each signature value.

    Then the columns of docs besides doc_id and text.
    """
    more = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    names = [f.name for f in more]

    def sketches(batch: pa.RecordBatch) -> dict:
        n, cls, keys, prints, sigs = [], [], [], [], []
        for text in batch.column("text").to_pylist():
            found = shingles(text)
            n.append(len(found))
            if len(found):
                sig = signature(found)
                cls.append(xxhash.xxh3_128_digest(found.tobytes()))
                keys.append(bands(sig))
                prints.append(_print(keys[-1]).tobytes())
                sigs.append((sig & np.uint32(255)).astype(np.uint8).tobytes())
            else:
                cls.append(None)
                keys.append(None)
                prints.append(None)
                sigs.append(None)
        return {
            "doc_id": batch.column("doc_id"),
            "n_shingles": pa.array(n, pa.int64()),
            "cls": pa.array(cls, pa.binary()),
            "bands": pa.array(keys, pa.list_(pa.int64())),
            "prints": pa.array(prints, pa.binary()),
            "sig": pa.array(sigs, pa.binary()),
        } | {n: batch.column(n) for n in names}

    made = _SKETCH.format(id=docs.schema["doc_id"].dataType.simpleString())
    return map_arrow(docs, ", ".join([made, *(f"{f.name} {f.dataType.simpleString()}" for f in more)]), sketches)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _agreement(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs (a, b) of a table whose signatures agree enough, with the share that does; sets of too unlike sizes go."""
    one = sigs.select(F.col("cls").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na"))
    two = sigs.select(F.col("cls").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb"))
    first = skew_join(pairs, one, "a", pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m")))
    both = first.join(two, "b").where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")

    def agree(batch: pa.RecordBatch) -> dict:
        x = np.frombuffer(b"".join(batch.column("sa").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        y = np.frombuffer(b"".join(batch.column("sb").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        share = (x == y).mean(1)
        good = pa.array(share >= AGREE)
        return {n: batch.column(n).filter(good) for n in ("a", "b")} | {"agree": pa.array(share).filter(good)}

    return map_arrow(both, "a binary, b binary, agree double", agree)


class _Texts:
    """Where the texts of classes are: in the row of docs (doc_id, text, h) with the id and hash of each class's first row."""

    def __init__(self, docs: DataFrame, classes: DataFrame, repeats: bool):
        self.docs, self.classes, self.repeats = docs, classes, repeats

    def of(self, roles: DataFrame) -> DataFrame:
        """roles (cls and more) with the text of each class; repeated rows may bring a role once per task."""
        names = roles.columns
        roles = table(roles.join(self.classes.select("cls", F.col("rep.doc_id").alias("__id"), F.col("rep.h").alias("__h")), "cls"), "roles")
        wanted = F.broadcast(roles) if roles.count() <= BROADCAST_ROLES else roles
        same = self.docs["doc_id"].eqNullSafe(wanted["__id"]) & (self.docs["h"] == wanted["__h"])
        got = self.docs.join(wanted, same).select(*names, "text")
        return map_batches(got, got.schema, lambda batches: _once(batches, names)) if self.repeats else got


def _once(batches, names: list[str]):
    """Each role once; as many are held as a task's rows have."""
    seen: set[tuple] = set()
    for batch in batches:
        new = []
        for role in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            new.append(role not in seen)
            seen.add(role)
        yield batch.filter(pa.array(new))


def _own(text: str | None, cls: bytes) -> np.ndarray | None:
    """The set of a text if it is the class's; another text may have the same id and hash."""
    found = shingles(text)
    return found if len(found) and xxhash.xxh3_128_digest(found.tobytes()) == cls else None


def _confirm(pairs: DataFrame, texts: _Texts) -> DataFrame:
    """The pairs (a, b) of a table whose full sets are similar.

    The texts of the classes in pairs are read once more. The members of one a are dealt into groups of about SALT, each
    of which gets the text of a once, so that no text is repeated for each of its pairs.
    """
    heads = table(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT).cast("int").alias("salts"), F.count(F.lit(1)).alias("m")), "heads")
    members = skew_join(pairs, heads.select("a", "salts"), "a", heads)
    members = members.select(F.col("b").alias("cls"), "a", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), F.lit(1).alias("member"))
    starts = heads.select(F.col("a").alias("cls"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"))
    near = texts.of(members.unionByName(starts))
    dealt = near.repartition("a", "salt").sortWithinPartitions("a", "salt", "member", "cls")

    def check(batches):
        at, head, last = None, None, None
        for batch in batches:
            x, y = [], []
            for a, salt, member, cls, text in zip(*(batch.column(n).to_pylist() for n in ("a", "salt", "member", "cls", "text")), strict=True):
                if (a, salt, cls) == last:
                    continue
                found = _own(text, cls)
                if found is None:
                    continue
                last = (a, salt, cls)
                if not member:
                    at, head = (a, salt), found
                elif at == (a, salt) and similar(head, found):
                    x.append(a)
                    y.append(cls)
            if x:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["a", "b"])

    return table(map_batches(dealt, "a binary, b binary", check), "links")


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """cls and comp, the least class reachable over links (a, b), for classes with a link.

    Up to one_task links are united in a single task. Beyond that, each round gives every class the least label among
    its own and its neighbours', hands that on to the class that its old label names, and then follows labels once;
    only aggregations with partial sums meet a class's neighbours.
    """
    links = table(links.select("a", "b").where("a <> b").distinct(), "links")
    if links.count() <= one_task:
        return table(map_batches(links.coalesce(1), "cls binary, comp binary", _unite), "labels")
    both = table(links.union(links.select("b", "a")), "links")
    degrees = table(both.groupBy("b").agg(F.count(F.lit(1)).alias("m")), "degrees")
    labels = table(both.groupBy(F.col("a").alias("cls")).agg(F.min("b").alias("m")).select("cls", F.least("cls", "m").alias("comp")), "labels")
    while True:
        now = labels.select("cls", "comp")
        near = skew_join(both, now.select(F.col("cls").alias("b"), "comp"), "b", degrees).groupBy(F.col("a").alias("cls")).agg(F.min("comp").alias("near"))
        least = now.join(near, "cls").select("cls", "comp", F.least("comp", "near").alias("low"))
        hooked = table(least.select("cls", "low").union(least.select(F.col("comp").alias("cls"), "low")).groupBy("cls").agg(F.min("low").alias("low")), "hooked")
        # as many classes may have one label as the component has
        jump = hooked.select(F.col("cls").alias("low"), F.col("low").alias("further"))
        new = skew_join(hooked, jump, "low", hooked.groupBy("low").agg(F.count(F.lit(1)).alias("m")))
        new = new.select("cls", F.least("low", "further").alias("comp"))
        new = table(new.join(now.withColumnRenamed("comp", "was"), "cls"), "labels")
        changed = new.where("comp <> was").limit(1).count()
        discard(labels, hooked)
        labels = new
        if not changed:
            discard(both, degrees, links)
            return labels.select("cls", "comp")


def _unite(batches):
    up: dict[bytes, bytes] = {}

    def top(x: bytes) -> bytes:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            x, y = sorted((top(a), top(b)))
            up[y] = x
    if up:
        names = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(map(top, names), pa.binary())], names=["cls", "comp"])


def _star(buckets: DataFrame, sigs: DataFrame) -> DataFrame:
    """Each class with the one among its buckets' least classes with which its signature agrees best."""
    pairs = table(buckets.where("cls <> head").select(F.col("head").alias("a"), F.col("cls").alias("b")).distinct(), "pairs")
    return _agreement(pairs, sigs).groupBy("b").agg(F.max_by("a", F.struct("agree", "a")).alias("a"))


def _across(buckets: DataFrame, comps: DataFrame, sigs: DataFrame) -> DataFrame:
    """Components (ca, cb) with classes in one bucket whose signatures agree enough, and the pair (a, b) that does best.

    A bucket's classes are owned by blocks of about BLOCK. Those outside the component of its least class are guests of
    every block, in groups of about GUESTS, each of which meets what the block owns in a task of its own; a task holds
    what the block owns, and guests come one by one. Two classes are compared in the bucket of the first band that they share.
    Signatures are fetched for the classes of buckets with several components alone.
    """
    named = buckets.select("key", "cls").join(comps, "cls", "left").select("key", "cls", F.coalesce("comp", "cls").alias("comp"))
    named = table(named, "named")
    per = named.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.min("cls").alias("least"))
    mixed = (
        per.groupBy("key")
        .agg(F.sum("c").alias("m"), F.min_by(F.struct("comp", "c"), "least").alias("h"), F.count(F.lit(1)).alias("comps"))
        .where("comps > 1")
        .select(
            "key",
            "m",
            F.col("h.comp").alias("main"),
            F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"),
            F.ceil((F.col("m") - F.col("h.c")) / GUESTS).cast("int").alias("groups"),
        )
    )
    mixed = table(mixed, "mixed")
    narrow = table(skew_join(named, mixed.drop("m"), "key", mixed), "mixed")
    rows = narrow.join(sigs.select("cls", "sig", "prints", "n"), "cls")
    mine = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    group = F.pmod(F.xxhash64("cls", F.lit(1)), F.col("groups")).cast("int")
    as_ = lambda i, j, guest: F.struct(i.alias("i"), j.alias("j"), F.lit(guest).alias("guest"))
    owned = F.transform(F.sequence(F.lit(0), F.col("groups") - 1), lambda j: as_(mine, j, 0))
    guest = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: as_(i, group, 1))
    places = F.when(F.col("comp") == F.col("main"), owned).otherwise(F.concat(owned, guest))
    dealt = (
        rows.select("key", "cls", "comp", "sig", "prints", "n", F.explode(places).alias("p"))
        .select("key", "cls", "comp", "sig", "prints", "n", "p.*")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j", "guest", "cls")
    )

    def made(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        kinds = [pa.binary()] * 4 + [pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["ca", "cb", "a", "b", "agree"])

    def compare(batches):
        at, block, held = None, [], None
        out: dict[tuple, tuple] = {}
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("key", "i", "j", "guest", "cls", "comp", "sig", "prints", "n")]
            for key, i, j, guest, cls, comp, sig, bits, size in zip(*cols, strict=True):
                if (key, i, j) != at:
                    at, block, held = (key, i, j), [], None
                if not guest:
                    block.append((cls, comp, sig, bits, size))
                    continue
                if not block:
                    continue
                if held is None:
                    here = _print(np.array([key]))[0]
                    held = (
                        np.frombuffer(b"".join(h[2] for h in block), np.uint8).reshape(len(block), -1),
                        np.frombuffer(b"".join(h[3] for h in block), np.uint32).reshape(len(block), -1),
                        np.array([h[4] for h in block]),
                    )
                sigs_, prints, n = held
                its_prints = np.frombuffer(bits, np.uint32)
                fits = np.flatnonzero(100 * np.minimum(n, size) >= PERCENT * np.maximum(n, size))
                near = fits[its_prints[(prints[fits] == its_prints).argmax(1)] == here]
                share = (sigs_[near] == np.frombuffer(sig, np.uint8)).mean(1)
                for k in np.flatnonzero(share >= AGREE).tolist():
                    other, its = block[near[k]][:2]
                    if its == comp:
                        continue
                    a, b = sorted((cls, other))
                    ca, cb = sorted((comp, its))
                    row = (ca, cb, a, b, float(share[k]))
                    if (ca, cb) not in out or row[4] > out[ca, cb][4]:
                        out[ca, cb] = row
                if len(out) >= BLOCK:  # the best of each two components is chosen again after the shuffle
                    yield made(list(out.values()))
                    out = {}
        if out:
            yield made(list(out.values()))

    found = map_batches(dealt, "ca binary, cb binary, a binary, b binary, agree double", compare)
    top = found.groupBy("ca", "cb").agg(F.max_by(F.struct("a", "b"), F.struct("agree", "a", "b")).alias("p"))
    best = table(top.select("ca", "cb", "p.a", "p.b"), "pairs")
    discard(named, mixed, narrow)
    return best


def _all_of(pairs: DataFrame, comps: DataFrame, texts: _Texts) -> DataFrame:
    """Links (a, b) between all classes of two components (ca, cb), for pairs of components of three classes or more.

    The larger component is dealt into blocks of about SETS classes, and the classes of those that it may be linked with
    into groups of as many; each block meets each group in a task of its own, which holds the sets of the block. Pairs of
    single classes have been confirmed as they were.
    """
    sizes = table(comps.groupBy("comp").agg(F.count(F.lit(1)).alias("m")), "sizes")
    size = lambda side: sizes.select(F.col("comp").alias(side), F.col("m").alias(side + "n"))
    both = pairs.select("ca", "cb").join(size("ca"), "ca", "left").join(size("cb"), "cb", "left")
    both = both.withColumns({"can": F.coalesce("can", F.lit(1)), "cbn": F.coalesce("cbn", F.lit(1))}).where("can * cbn > 1")
    first = F.struct("can", "ca") > F.struct("cbn", "cb")
    both = table(
        both.select(
            F.when(first, F.col("ca")).otherwise(F.col("cb")).alias("owner"),
            F.when(first, F.col("cb")).otherwise(F.col("ca")).alias("guest"),
            F.greatest("can", "cbn").alias("n"),
            F.least("can", "cbn").alias("guests"),
        ),
        "pairs",
    )
    owners = table(
        both.groupBy("owner").agg(
            F.ceil(F.max("n") / SETS).cast("int").alias("blocks"), F.ceil(F.sum("guests") / SETS).cast("int").alias("groups"), F.count(F.lit(1)).alias("m")
        ),
        "owners",
    )
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    names = comps.select(F.col("comp").alias("owner"), "cls")
    mine = skew_join(names, owners.drop("m"), "owner", sizes.select(F.col("comp").alias("owner"), "m"))
    mine = mine.select("cls", "owner", F.pmod(F.xxhash64("cls"), "blocks").cast("int").alias("i"), upto("groups").alias("j"), F.lit(0).alias("guest"))
    dealt = skew_join(both, owners.drop("m"), "owner", owners)
    others = dealt.select("owner", "blocks", "groups", F.col("guest").alias("comp")).join(comps, "comp", "left").withColumn("cls", F.coalesce("cls", "comp"))
    others = others.select("cls", "owner", upto("blocks").alias("i"), F.pmod(F.xxhash64("cls", F.lit(1)), "groups").cast("int").alias("j"), F.lit(1).alias("guest"))
    near = texts.of(mine.unionByName(others)).repartition("owner", "i", "j").sortWithinPartitions("owner", "i", "j", "guest", "cls")

    def check(batches):
        at, sets, names, marks, last = None, [], [], None, None
        for batch in batches:
            x, y = [], []
            for owner, i, j, guest, cls, text in zip(*(batch.column(n).to_pylist() for n in ("owner", "i", "j", "guest", "cls", "text")), strict=True):
                if (owner, i, j) != at:
                    at, sets, names, marks, last = (owner, i, j), [], [], None, None
                if cls == last:
                    continue
                found = _own(text, cls)
                if found is None:
                    continue
                last = cls
                mark = (signature(found) & np.uint32(255)).astype(np.uint8)
                if not guest:
                    sets.append((found, mark))
                    names.append(cls)
                    continue
                if marks is None:
                    marks = np.array([m for _, m in sets]).reshape(len(sets), -1)
                for k in np.flatnonzero((marks == mark).mean(1) >= AGREE).tolist() if sets else ():
                    if similar(sets[k][0], found):  # one link joins the components
                        x.append(names[k])
                        y.append(cls)
                        break
            if x:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["a", "b"])

    return table(map_batches(near, "a binary, b binary", check), "links")


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept per row of docs.

    Null and empty texts, and texts of white space alone, have no shingles and are linked with nothing. Rows with equal
    sets are in one component; null ids take part and never name it, and a component without any id is named null.
    Repeated rows keep a row each. Other columns are not read.

    Links are sought in three steps: each class with the best of its buckets' first classes; of each two components
    that still share a bucket the best pair; and then all classes of components that still share one.
    """
    some = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return _verdicts(some)[0].drop("h", "cls", "comp")


def _verdicts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of near_dedup for docs (doc_id, text), with h, cls and comp, and the (doc_id, h) of repeated rows.

    h is a hash of the text, cls and comp name class and component and are null where a text has no words.
    """
    prepare(docs.sparkSession)
    docs = docs.withColumn("h", F.xxhash64("text"))
    sketches = table(sketch(docs), "sketch")
    classes = table(
        sketches.where("cls is not null")
        .groupBy("cls")
        .agg(
            F.min("doc_id").alias("id"),
            F.min(F.struct("doc_id", "h")).alias("rep"),
            *[F.first(c).alias(c) for c in ("bands", "prints", "sig")],
            F.first("n_shingles").alias("n"),
        ),
        "classes",
    )
    rows = table(sketches.select("doc_id", "n_shingles", "cls", "h"), "rows")
    discard(sketches)
    repeats = table(rows.where("cls is not null").groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "repeats")
    texts = _Texts(docs, classes, bool(repeats.limit(1).count()))
    spread = classes.select("cls", F.explode("bands").alias("key"))
    shared = table(spread.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "shared")
    few = shared.count() <= BROADCAST_KEYS
    buckets = table(spread.join(F.broadcast(shared.drop("m")), "key") if few else skew_join(spread, shared.drop("m"), "key", shared), "buckets")
    heads = table(buckets.groupBy("key").agg(F.min("cls").alias("head"), F.count(F.lit(1)).alias("m")), "heads")
    buckets, single = table(skew_join(buckets, heads.drop("m"), "key", heads), "buckets"), buckets
    discard(shared, heads, single)
    sigs = classes.select("cls", "sig", "prints", "n")
    comps = components(_confirm(table(_star(buckets, sigs), "pairs"), texts))
    comps = _joined(comps, _confirm(_across(buckets, comps, sigs), texts))
    comps = _joined(comps, _all_of(_across(buckets, comps, sigs), comps, texts))
    discard(buckets)
    named = classes.select("cls", "id").join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = named.groupBy("comp").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("m"))
    named, least = table(named, "named"), table(least, "least")
    per = table(skew_join(named, least.drop("m"), "comp", least).select("cls", "comp", "component_id"), "components")
    counts = rows.where("cls is not null").groupBy("cls").agg(F.count(F.lit(1)).alias("m"))
    out = skew_join(rows.where("cls is not null"), per, "cls", counts).unionByName(rows.where("cls is null"), allowMissingColumns=True)
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "h", "cls", "comp"), repeats


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """The components of comps and links together, from a graph with a node per component."""
    if not links.limit(1).count():
        return comps
    top = lambda side: F.coalesce(F.col(side + "c"), F.col(side))
    ends = links.join(comps.select(F.col("cls").alias("a"), F.col("comp").alias("ac")), "a", "left").join(
        comps.select(F.col("cls").alias("b"), F.col("comp").alias("bc")), "b", "left"
    )
    merged = components(ends.select(top("a").alias("a"), top("b").alias("b")))
    kept = comps.join(merged.select(F.col("cls").alias("comp"), F.col("comp").alias("new")), "comp", "left")
    both = kept.select("cls", F.coalesce("new", "comp").alias("comp")).unionByName(merged)
    return table(both.groupBy("cls").agg(F.min("comp").alias("comp")), "labels")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text and any others) that stay, one of each group, with the columns of docs.

    Of a group that has the least id stays, ids before nulls; of rows that share an id the text with the least hash, and of
    rows that share id and text one. Null texts and texts without words are in no group and stay. Columns may have any names.
    """
    p = free_prefix(docs.columns, "__n_")
    rows, repeats = _verdicts(docs.select("doc_id", "text"))
    rows = table(rows.where("comp is not null").select("doc_id", "h", "comp"), "verdicts")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    best = table(rows.groupBy("comp").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("m")), "best")
    judged = skew_join(rows, best.drop("m"), "comp", best)
    gone = judged.where(rank != F.col("best")).select(F.col("doc_id").alias(p + "id"), F.col("h").alias(p + "h")).distinct()
    same = lambda some: docs["doc_id"].eqNullSafe(some[p + "id"]) & (F.xxhash64(docs["text"]) == some[p + "h"])
    if not repeats.limit(1).count():
        return docs.join(gone, same(gone), "left_anti")
    often = repeats.select(F.col("doc_id").alias(p + "id"), F.col("h").alias(p + "h"))
    either = gone.unionByName(often)
    lone = often.join(gone, often[p + "id"].eqNullSafe(gone[p + "id"]) & (often[p + "h"] == gone[p + "h"]), "left_anti")
    single, several = docs.join(either, same(either), "left_anti"), docs.join(lone, same(lone), "left_semi")
    return single.unionByName(several.dropDuplicates(["doc_id", "text"]))
