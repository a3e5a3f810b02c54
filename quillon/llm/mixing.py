"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import columns_of, skew_join, table

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: A source's target stops at so many times its size.
MOST = 3
#: Ranks are counted in so many cells per source; the cell with the threshold is divided again until it has few rows.
CELLS = 4096
#: A cell with so many rows or fewer is sorted in one task.
EDGE_ROWS = 1_000_000
#: Of so many equal rows at the threshold, or fewer, as many as fit are taken; of more, that share of each partition's.
TIES = 100_000
#: Sources up to this many are ordered in one task and broadcast with their targets; more are ordered by ranges and met in a join.
BROADCAST_SOURCES = 50_000
#: A rank has 52 bits of the random odds and 11 of the text, which parts rows that share an id.
_BITS, _TEXT_BITS = 52, 11
_GAP = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    # splitting takes one pass, whereas each match of regexp_count copies the text
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), _GAP, -1), "")).cast("long")


def _running(df: DataFrame, order: list[Column], sums: dict[str, str], one_task: bool) -> DataFrame:
    """df with running sums in an order of all rows, each up to and with its row, by the names of sums.

    In one task, or by ranges of the order: then only sums per range come to the driver, one row for each.
    """
    by = {k: F.sum(c).over(Window.orderBy(*order)) for k, c in sums.items()}
    if one_task:
        return df.withColumns(by)
    keys = {f"__o{k}": c for k, c in enumerate(order)}
    ranged = df.withColumns(keys).repartitionByRange(*[F.col(k) for k in keys]).withColumn("__range", F.spark_partition_id())
    ranged = table(ranged, "ranges")
    per = sorted(ranged.groupBy("__range").agg(*[F.sum(c).alias(k) for k, c in sums.items()]).collect(), key=lambda r: r["__range"])
    offsets, past = [], [0] * len(sums)
    for r in per:
        offsets.append((r["__range"], *past))
        past = [a + r[k] for a, k in zip(past, sums, strict=True)]
    starts = df.sparkSession.createDataFrame(offsets, ", ".join(["__range int", *[f"__past_{k} long" for k in sums]]))
    w = Window.partitionBy("__range").orderBy(*[F.col(k) for k in keys])
    out = ranged.join(F.broadcast(starts), "__range")  # a row per range
    out = out.withColumns({k: F.sum(c).over(w) + F.col(f"__past_{k}") for k, c in sums.items()})
    return out.drop("__range", *keys, *[f"__past_{k}" for k in sums])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, *, one_task: bool = True) -> DataFrame:
    """Source sizes (source, source_size) with their targets, which add up to all sizes.

    Sources by code point, null last, have the weights in turn. A source with size * MOST / weight below the common
    level is full; the level is what the others' weights share of the rest. One row per source is ordered, no more.
    """
    pick = F.array(*[F.lit(w) for w in weights])
    by_name = [F.col("source").isNull(), F.col("source")]
    named = _running(sizes.withColumn("__one", F.lit(1).cast("long")), by_name, {"__k": "__one"}, one_task)
    named = named.withColumn("__w", F.get(pick, ((F.col("__k") - 1) % len(weights)).cast("int")).cast("long"))
    named = named.withColumn("__cap", MOST * F.col("source_size"))
    filled = _running(named, [F.col("__cap") / F.col("__w"), *by_name], {"__used": "__cap", "__gone": "__w"}, one_task)
    if not one_task:
        filled = table(filled, "filled")
    whole = filled.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("__total"), F.sum("__w").alias("__weights"))
    # before a source's turn: what the full ones have used, and the weights that are left, its own with them
    used, left = F.col("__used") - F.col("__cap"), F.col("__weights") - F.col("__gone") + F.col("__w")
    level = (F.col("__total") - used) / left
    named = filled.crossJoin(F.broadcast(whole)).withColumn("__level", F.when(F.col("__cap") > F.col("__w") * level, level))  # one row
    common = named.agg(F.max("__level").alias("__common"))
    return named.crossJoin(F.broadcast(common)).select(
        "source",
        "source_size",
        F.when(F.col("__level").isNotNull(), F.col("__w") * F.col("__common")).otherwise(F.col("__cap").cast("double")).alias("target"),
    )


def uniform(key: Column, seed: str) -> Column:
    """A number within (0, 1) that depends on key and seed alone."""
    head = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    return (F.conv(head, 16, 10).cast("double") + 0.5) / float(2**52)


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    seed: str = "mix",
    cells: int = CELLS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (copies * size) per row of docs, and the columns in keep.

    Each document has floor(target / source_size) certain copies; the fraction is its inclusion probability for one
    more. Documents of a source are ranked by random odds divided by inclusion odds and taken in that order while the
    sum of sizes stays nearest to what the certain copies leave. The odds hang on the id, those of a null id on the text;
    rows that share an id are parted by their texts, and of equal rows as many are taken as fit. Null and empty texts have
    size 0 and copies of no words; sources of size 0 have target 0. Null is a source. Other columns are not read. No
    source is gathered in one task: the cell with its threshold is divided until it has few rows.
    """
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))))
    read = [
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").cast("string").alias("__source"),
        word_count(F.col(f"`{text_col}`")).alias("size"),
        uniform(key, seed).alias("__u"),
        F.xxhash64(F.col(f"`{text_col}`")).bitwiseAND(F.lit(2**_TEXT_BITS - 1)).alias("__t"),
    ]
    # texts are counted once; ids, sources and sizes serve all that follows
    base = table(docs.select(*read), "mix")
    sizes = table(base.groupBy(F.col("__source").alias("source")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("m")), "sources")
    few = sizes.count() <= BROADCAST_SOURCES
    small = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    name = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("")).alias("__s")  # noqa: E731  null is a source
    share = targets(sizes.drop("m"), weights, one_task=few)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    share = share.select(name(F.col("source")), "source_size", "target", F.floor(ratio).cast("long").alias("__sure"), (ratio - F.floor(ratio)).alias("__p"))
    share = table(share.withColumn("__need", F.col("target") - F.col("__sure") * F.col("source_size")), "share")
    counts = sizes.select(name(F.col("source")), "m")

    def ranked(df: DataFrame, more: DataFrame) -> DataFrame:
        """df with its source's columns and the rank; a source may hold most rows."""
        df = df.withColumn("__s", name(F.col("__source"))).drop("__source")
        out = df.join(F.broadcast(more), "__s") if few else skew_join(df, more, "__s", counts)
        u, p = F.col("__u"), F.col("__p")
        # odds / (1 + odds) has the order of the odds u / (1 - u) over p / (1 - p)
        x = u * (1 - p) / (u * (1 - p) + p * (1 - u))
        bits = F.least(F.floor(x * float(2**_BITS)).cast("long"), F.lit(2**_BITS - 1))
        return out.withColumn("__r", F.when(p > 0, F.shiftleft(bits, _TEXT_BITS) + F.col("__t"))).drop("__u", "__t")

    ranks = ranked(base.drop("doc_id"), share.select("__s", "__p", "__need")).where("__r is not null")
    step, shift = max(1, cells.bit_length() - 1), _BITS + _TEXT_BITS
    span = share.where("__p > 0").select("__s", F.lit(0).cast("long").alias("__cell"), F.lit(0).cast("long").alias("__past"))
    inside = ranks.withColumn("__past", F.lit(0).cast("long"))
    by = Window.partitionBy("__s").orderBy("__cell")
    while True:
        # sizes per cell, then the cell in which the sum reaches the need
        shift = max(0, shift - step)
        per = inside.withColumn("__cell", F.shiftright("__r", shift)).groupBy("__s", "__cell")
        per = per.agg(F.sum("size").alias("__sum"), F.count(F.lit(1)).alias("__rows"), F.first("__past").alias("__from"), F.first("__need").alias("__need"))
        per = per.withColumn("__past", F.col("__from") + F.sum("__sum").over(by) - F.col("__sum"))
        edge = per.where("__past <= __need and __need < __past + __sum")
        span = table(edge.select("__s", "__cell", "__past", "__rows"), "edges")  # a row per source at most
        inside = ranks.join(small(span.drop("__rows").withColumnRenamed("__cell", "__edge")), "__s").where(F.shiftright("__r", shift) == F.col("__edge"))
        if not shift or (span.agg(F.max("__rows")).first()[0] or 0) <= EDGE_ROWS:
            break
    ties = inside.groupBy("__s", "__r").agg(F.sum("size").alias("__sum"), F.count(F.lit(1)).alias("__n"), F.first("__past").alias("__past"), F.first("__need").alias("__need"))
    run = F.col("__past") + F.sum("__sum").over(Window.partitionBy("__s").orderBy("__r"))
    ties = ties.withColumn("__run", run)
    whole = F.col("__run") <= F.col("__need")
    some = ~whole & (F.col("__run") - F.col("__sum") <= F.col("__need"))
    of_tie = F.floor((F.col("__need") - (F.col("__run") - F.col("__sum"))) / (F.col("__sum") / F.col("__n")) + 0.5).cast("long")
    cut = ties.groupBy("__s").agg(
        F.max(F.when(whole, F.col("__r"))).alias("__top"),
        F.max(F.when(some, F.struct(F.col("__r").alias("r"), of_tie.alias("take"), F.col("__n").alias("of")))).alias("__tie"),
    )
    ends = share.join(span.select("__s", "__cell"), "__s", "left").join(cut, "__s", "left")
    ends = table(ends.select("__s", "source_size", "target", "__sure", "__p", "__cell", "__top", "__tie"), "ends")
    kept = [F.col(f"`{c}`").alias(f"__keep_{k}") for k, c in enumerate(keep)]
    done = ranked(docs.select(*read, *kept) if keep else base, ends)
    cell = F.shiftright("__r", shift)
    at_tie = F.coalesce((F.col("__r") == F.col("__tie.r")) & (cell == F.col("__cell")), F.lit(False))
    before = F.col("__r").isNotNull() & ((cell < F.coalesce("__cell", F.lit(2**62))) | ((cell == F.col("__cell")) & (F.col("__r") <= F.col("__top"))))
    done = done.withColumn("__one", F.when(at_tie, F.col("__tie.take") >= F.col("__tie.of")).otherwise(F.coalesce(before, F.lit(False))))
    if ends.where("__tie.take > 0 and __tie.take < __tie.of").limit(1).count():
        # equal rows at a threshold: a bounded number is counted out, of more that share of each partition's
        torn = at_tie & F.coalesce(F.col("__tie.take").between(F.lit(1), F.col("__tie.of") - 1), F.lit(False))
        bounded = F.col("__tie.of") <= TIES
        # multiples of the golden ratio by the row's place in its partition spread evenly
        golden = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)) * F.lit(0.6180339887498949)
        chance = golden - F.floor(golden)
        done = done.withColumn("__torn", torn).withColumn("__one", F.when(torn & ~bounded, chance * F.col("__tie.of") < F.col("__tie.take")).otherwise(F.col("__one")))
        counted = done.where(torn & bounded)
        place = F.row_number().over(Window.partitionBy("__s").orderBy("doc_id", "size"))
        done = done.where(~(torn & bounded)).unionByName(counted.withColumn("__one", place <= F.col("__tie.take"))).drop("__torn")
    copies = F.col("__sure") + F.col("__one").cast("long")
    return done.withColumn("copies", copies.cast("long")).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
        *[F.col(f"__keep_{k}").alias(c) for k, c in enumerate(keep)],
    )


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, with the columns of docs, whatever their names.

    Rows without words stay as often as their source's certain copies and their rank say; empty tables give no rows.
    """
    body = F.struct(*columns_of(docs)).alias("__body")
    inner = docs.select(
        F.col(f"`{options.pop('id_col', 'doc_id')}`").alias("i"),
        F.col(f"`{options.pop('text_col', 'text')}`").alias("t"),
        F.col(f"`{options.pop('source_col', 'source')}`").alias("s"),
        body,
    )
    out = mix(inner, id_col="i", text_col="t", source_col="s", keep=("__body",), **options)
    return out.where("copies > 0").withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__body.*")
