"""Chat formatting with a grammar round trip, in DataFrame operations only.

conversation := turn*
turn         := "<s>[INST]" role "[/INST]" text "</s>"

Roles and texts hold none of the four control strings. A control string within them is escaped by one more backslash
after its first character, which one backslash less undoes; a turn is escaped only if its plain rendering does not
parse back to its source. One escape undoes every conflict, which a last parse proves; a turn that still differed would
fail the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, BETWEEN, CLOSE = "<s>[INST]", "[/INST]", "</s>"
#: A control string with any number of backslashes after its first character.
_CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
_ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, _CONTROL, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPED, "$1$2$3")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(BETWEEN), text, F.lit(CLOSE))


def parse_segment(segment: Column) -> Column:
    """Role and text of what stands before one closing mark; null where it is not of the grammar."""
    halves = F.split(F.substring(segment, len(OPEN) + 1, 2**31 - 1), r"\[/INST\]", -1)
    fits = (
        segment.startswith(OPEN)
        & (F.size(halves) == 2)
        & ~F.substring(segment, len(OPEN) + 1, 2**31 - 1).rlike(r"</?s>|\[INST\]")
    )
    return F.when(fits, F.struct(unescape(halves[0]).alias("role"), unescape(halves[1]).alias("text")))


def split_turns(formatted: Column) -> Column:
    """The renderings of the turns without their closing marks, in order."""
    segments = F.split(formatted, CLOSE, -1)
    return F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0)))


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation, in order; an element is null where it does not parse."""
    return F.transform(split_turns(formatted), parse_segment)


def _round_trip(turns: DataFrame) -> DataFrame:
    """__role and __text as they go into the rendering: escaped where the plain turn does not come back."""
    out = turns.withColumns({"__er": F.col("__role"), "__et": F.col("__text")})
    same = lambda back: (
        (F.size(back) == 1) & back[0].isNotNull() & (back[0]["role"] == F.col("__role")) & (back[0]["text"] == F.col("__text"))
    )
    # a text without any first character of a control string is plain; only others need a parse
    risky = F.col("__role").rlike(_CONTROL) | F.col("__text").rlike(_CONTROL)
    good = F.coalesce(same(parse(render(F.col("__er"), F.col("__et")))), F.lit(False))
    out = out.withColumn("__good", ~risky | good)
    out = out.withColumns({c: F.when(F.col("__good"), F.col(c)).otherwise(escape(F.col(c))) for c in ("__er", "__et")})
    again = F.coalesce(same(parse(render(F.col("__er"), F.col("__et")))), F.lit(False))
    lost = F.raise_error(F.lit("a turn does not come back from its rendering")).cast("string")
    return out.withColumn("__et", F.when(F.col("__good") | again, F.col("__et")).otherwise(lost))


def format_conversations(
    turns: DataFrame,
    *,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    train_role: str = "assistant",
) -> DataFrame:
    """conv_id, n_turns, formatted and loss_spans (start and length in code points of `formatted`, by turn; the turn's
    number from 0, and where in its rendering the text begins).

    Turns are ordered by turn, then role, then text; null turns come first. Null roles and texts are empty, null ids
    form one conversation, repeated rows are turns of their own. Empty tables give no rows; other columns are not read.
    Rendering and round trip work a turn at a time before the one shuffle by conversation, which only joins strings.
    """
    some = turns.select(
        F.col(f"`{id_col}`").alias("conv_id"),
        F.col(f"`{turn_col}`").alias("__turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("__role"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"),
    )
    ready = _round_trip(some).select(
        "conv_id",
        "__turn",
        "__role",
        "__text",
        render(F.col("__er"), F.col("__et")).alias("__piece"),
        (len(OPEN) + F.length("__er") + len(BETWEEN)).cast("long").alias("__skip"),
        F.length("__et").cast("long").alias("__len"),
    )
    by = Window.partitionBy("conv_id").orderBy("__turn", "__role", "__text")
    before = F.sum(F.length("__piece").cast("long")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    placed = ready.select(
        "conv_id",
        F.row_number().over(by).alias("__k"),
        "__piece",
        F.when(
            F.col("__role") == train_role,
            F.struct(
                (F.coalesce(before, F.lit(0)) + F.col("__skip")).alias("start"),
                F.col("__len").alias("length"),
                (F.row_number().over(by) - 1).alias("turn"),
                F.col("__skip").alias("skip"),
            ),
        ).alias("__span"),
    )
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("__k", "__piece", "__span"))).alias("__all"))
    return whole.select(
        "conv_id",
        F.size("__all").cast("long").alias("n_turns"),
        F.array_join(F.transform("__all", lambda x: x["__piece"]), "").alias("formatted"),
        F.filter(F.transform("__all", lambda x: x["__span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The digests of what format_conversations has made, all from `formatted` and `loss_spans`."""
    # spans are cut from their turns, not from the start of the whole, so that long conversations take linear time
    parsed = formatted.withColumn("__parts", split_turns(F.col("formatted")))
    parsed = parsed.withColumn("__turns", F.transform("__parts", parse_segment))
    said = F.array_join(
        F.transform("__turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    cut = lambda s: F.substr(F.get("__parts", s["turn"]), (s["skip"] + 1).cast("int"), s["length"].cast("int"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(cut(s))), "")
    return parsed.withColumn("__loss", loss).select(
        "conv_id",
        F.size("__turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("__loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
