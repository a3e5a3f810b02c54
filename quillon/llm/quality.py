"""Quality rules: text statistics judged by a learned, interpretable decision list."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import decision_list
from quillon.llm.common import columns_of, free_prefix, map_arrow, prepare

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE = ("n_lines", "n_upper", "n_marks", "n_distinct", "n_digits", "n_stops")
#: At most so many labelled rows, those with the smallest hash of their id, are gathered to learn the rules.
SAMPLE_ROWS = 20_000

#: The learner sees ratios, so that rules hold for short and long texts alike.
RATIOS = {
    "r_symbols": ("n_symbols", "word_chars"),
    "r_dup_lines": ("n_dup_lines", "n_lines"),
    "r_repeats": ("n_repeat_words", "n_words"),
    "r_upper": ("n_upper", "word_chars"),
    "r_marks": ("n_marks", "n_words"),
    "r_distinct": ("n_distinct", "n_words"),
    "r_digits": ("n_digits", "word_chars"),
    "r_stops": ("n_stops", "n_words"),
    "r_length": ("word_chars", "n_words"),
}


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of `width` words found twice or more, its first place included."""
    n = len(words)
    if n <= width:
        return 0
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(ids) == n:
        return 0
    at = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    code, high = at, len(ids)
    for k in range(1, width):
        if high > 2**62 // len(ids):  # ranks instead of codes, before they overflow
            uniq, code = np.unique(code, return_inverse=True)
            high = len(uniq)
        code = code[:-1] * len(ids) + at[k:]
        high *= len(ids)
    _, where, counts = np.unique(code, return_inverse=True, return_counts=True)
    twice = counts[where] > 1
    if not twice.any():
        return 0
    step = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return int((step.cumsum()[:n] > 0).sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The counts of one whole text; null counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = text.split("\n")
    dup, seen = 0, set()
    for line in lines:
        if line.strip(_SPACES):
            if line in seen:
                dup += 1
            seen.add(line)
    chars = len(text) - sum(map(text.count, _SPACES))
    return (
        len(words),
        chars,
        sum(map(text.count, _SYMBOLS)),
        dup,
        repeated_words(words),
        len(lines),
        int((np.frombuffer(raw, np.uint8) != np.frombuffer(raw.lower(), np.uint8)).sum()),
        sum(map(text.count, "!?")),
        len(set(words)),
        sum(map(text.count, "0123456789")),
        sum(map(text.count, ".,")),
    )


def with_stats(df: DataFrame, *, text_col: str = "text", prefix: str = "") -> DataFrame:
    """df and its counts, each a long named prefix + name. No shuffle."""
    names = (*_COUNTS, *_MORE)
    fields = [T.StructField(prefix + n, T.LongType(), False) for n in names]

    def stats(batch: pa.RecordBatch) -> dict:
        rows = np.array([text_stats(t) for t in batch.column(text_col).to_pylist()], np.int64)
        return {n: batch.column(n) for n in batch.schema.names} | {
            f.name: pa.array(rows[:, k]) for k, f in enumerate(fields)
        }

    return map_arrow(df, T.StructType([*df.schema.fields, *fields]), stats)


def _with_ratios(df: DataFrame, prefix: str) -> DataFrame:
    """Adds the ratios as prefix + name; a ratio to nothing is 0."""
    div = lambda a, b: F.when(F.col(prefix + b) > 0, F.col(prefix + a) / F.col(prefix + b)).otherwise(F.lit(0.0))
    return df.withColumns({prefix + k: div(a, b) for k, (a, b) in RATIOS.items()})


def base_failed(prefix: str = "") -> F.Column:
    """The fixed rule: fewer than 10 words, or more than a fifth of the words repeated."""
    return (F.col(prefix + "n_words") < 10) | (100 * F.col(prefix + "n_repeat_words") > 20 * F.col(prefix + "n_words"))


def learn_rules(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
    prefix: str = "__q_",
) -> list[decision_list.Rule]:
    """Rules that reject, learned from at most `sample_rows` labelled documents.

    Several labels of one id count as their least, and of several documents the one with the least ratios teaches; null ids
    and null labels are ignored. Documents that the base rule rejects teach nothing, as the list never decides on them.
    """
    prepare(docs.sparkSession)
    named = (
        labels.select(F.col(f"`{id_col}`").alias("__q_id"), F.col(f"`{label_col}`").cast("int").alias("__q_y"))
        .where("__q_id is not null and __q_y is not null")
        .groupBy("__q_id")
        .agg(F.min("__q_y").alias("__q_y"))
        .orderBy(F.xxhash64("__q_id"), "__q_id")
        .limit(sample_rows)
    )
    texts = docs.select(F.col(f"`{id_col}`").alias("__q_id"), F.col(f"`{text_col}`").alias("__q_text"))
    # bounded by sample_rows ids, so the build side may be broadcast
    some = with_stats(texts.join(F.broadcast(named), "__q_id"), text_col="__q_text", prefix=prefix)
    some = _with_ratios(some, prefix).where(~base_failed(prefix))
    cols = [prefix + k for k in (*RATIOS, "n_words")]
    # one row per id, hence sample_rows rows at most, the same ones in every run
    one = some.groupBy("__q_id", "__q_y").agg(F.min(F.struct(*cols)).alias("__q_row")).select("__q_id", "__q_y", "__q_row.*")
    rows = one.toPandas()
    rows = rows.sort_values(["__q_id", *cols], kind="stable")
    rows = rows.iloc[np.random.default_rng(7).permutation(len(rows))]
    x = {c.removeprefix(prefix): rows[c].to_numpy(float) for c in cols}
    return decision_list.learn(x, rows["__q_y"].to_numpy() == 0)


def judge(df: DataFrame, rules: list[decision_list.Rule], *, text_col: str = "text", prefix: str = "__q_") -> DataFrame:
    """df with its counts, prefix + base_failed and prefix + kept; one narrow pass over the whole texts."""
    out = _with_ratios(with_stats(df, text_col=text_col, prefix=prefix), prefix)
    verdict = decision_list.expression(rules, F.lit(False), F.lit(True), prefix)
    out = out.withColumn(prefix + "base_failed", base_failed(prefix))
    return out.withColumn(prefix + "kept", ~F.col(prefix + "base_failed") & verdict)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per row of docs (doc_id, text): counts, base_failed and kept.

    Null and empty texts have no words and fail the base rule. Repeated rows are judged each on their own, and null
    ids are kept as they are. Other columns, whatever their names, are not read. Without labels of both classes the
    list is empty and only the base rule rejects.
    """
    prepare(docs.sparkSession)
    rules = learn_rules(docs, labels)
    out = judge(docs.select("doc_id", "text"), rules)
    return out.select("doc_id", *[F.col(f"__q_{n}").alias(n) for n in (*_COUNTS, "base_failed", "kept")])


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text and any others) that pass, with the columns of docs, whatever their names.

    Null and empty texts have no words and go, by the base rule; repeated rows and null ids are judged each on their own.
    Empty tables of documents or labels are allowed: without labels of both classes only the base rule rejects.
    """
    prepare(docs.sparkSession)
    rules = learn_rules(docs, labels)
    prefix = free_prefix(docs.columns, "__q_")
    return judge(docs, rules, prefix=prefix).where(F.col(prefix + "kept")).select(*columns_of(docs))
