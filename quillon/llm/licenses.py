"""License scans by diagonal voting, in DataFrame operations only.

Texts are split into words once. The same pass counts the fixed phrases and lets all word grams meet the grams of the
templates; what it leaves, a row per text and one per equal gram, is a small table that all later steps read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import table

# Phrases whose places are counted, and their labels.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

#: Template texts of the method, already in word form, and their labels.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("reserved", "all rights reserved no part of this publication may be reproduced"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

#: Words in a gram.
K = 3
#: Templates with so many grams or fewer are broadcast (about 100 bytes each); more are met in a join.
BROADCAST_GRAMS = 500_000
#: Share of a template's words that matched grams must cover.
COVER = 0.75
#: Diagonals this close belong to one place: so many words inserted or lost.
GAP = 2

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of letters with A-Z lower-cased, digits and all above 0x7F; none of null.

    lower() also changes other letters, which is of no matter to phrases of ASCII letters, but for the Kelvin sign,
    the one letter that it would turn into ASCII alone; another letter stands in for it.
    """
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138"))
    # splitting takes one pass, whereas each match of regexp_extract_all copies the text
    return F.array_remove(F.split(F.lower(plain), _GAP, -1), "")


def gram(w: Column, i: Column, k: int = K) -> Column:
    """Hash of the k words from i on; what lies beyond the last word is null and matches no template."""
    return F.xxhash64(*[F.get(w, i + j) for j in range(k)])


def phrase_places(joined: Column, phrase: str) -> tuple[Column, Column, Column]:
    """How many places, first and last word index, in words that each stand between spaces of their own."""
    parts = F.split(joined, " " + "  ".join(phrase.split()) + " ", -1)
    in_words = lambda s: ((F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))) / 2).cast("long")
    n = (F.size(parts) - 1).cast("long")
    first = F.when(n > 0, in_words(parts[0]))
    last = F.when(n > 0, F.col("n_words") - in_words(F.element_at(parts, -1)) - len(phrase.split()))
    return n, first, last


BASE = ("n_words", "n_base", "first_word", "last_word", "__base")


def base_scan(docs: DataFrame) -> DataFrame:
    """Adds n_words and the columns of the fixed phrases to a frame with a word array __w. No shuffle."""
    out = docs.withColumn("n_words", F.size("__w").cast("long"))
    out = out.withColumn("__joined", F.concat(F.lit(" "), F.array_join("__w", "  "), F.lit(" ")))
    hit = F.lit(False)
    for phrase, _ in PHRASES:
        hit = hit | F.col("__joined").contains("  ".join(phrase.split()))
    places = [phrase_places(F.col("__joined"), p) for p, _ in PHRASES]
    found = F.struct(
        *[F.when(hit, n).otherwise(F.lit(0)).cast("long").alias(f"n{k}") for k, (n, _, _) in enumerate(places)],
        *[F.when(hit, a).alias(f"a{k}") for k, (_, a, _) in enumerate(places)],
        *[F.when(hit, b).alias(f"b{k}") for k, (_, _, b) in enumerate(places)],
    )
    out = out.withColumn("__f", found)
    every = range(len(PHRASES))
    total = F.col("__f.n0")
    for k in every[1:]:
        total = total + F.col(f"__f.n{k}")
    labels = F.array(*[F.when(F.col(f"__f.n{k}") > 0, F.lit(PHRASES[k][1])) for k in every])
    return out.withColumns(
        {
            "n_base": total,
            "first_word": F.least(*[F.col(f"__f.a{k}") for k in every]),
            "last_word": F.greatest(*[F.col(f"__f.b{k}") for k in every]),
            "__base": F.array_sort(F.array_distinct(F.array_compact(labels))),
        }
    ).drop("__f", "__joined")


def template_grams(spark: SparkSession, templates) -> DataFrame:
    """A row per gram of each template (label, text): its hash, words, template, place and the template's length in words.

    templates are a list or a table; whole license texts are templates as well as single sentences.
    """
    made = spark.createDataFrame(templates, "label string, text string") if isinstance(templates, list | tuple) else templates.select("label", "text")
    made = made.select(F.col("label").alias("__label"), words(F.col("text")).alias("__tw")).where(F.size("__tw") >= K)
    made = table(made.select(F.xxhash64("__label", "__tw").alias("__t"), "__label", "__tw").dropDuplicates(["__t"]), "templates")
    at = F.explode(F.sequence(F.lit(0), F.size("__tw") - K))
    return made.select("__t", "__label", F.size("__tw").alias("__tn"), "__tw", at.alias("__at")).select(
        gram(F.col("__tw"), F.col("__at")).alias("__g"), "__t", "__label", "__tn", "__at", F.slice("__tw", F.col("__at") + 1, K).alias("__gw")
    )


def scanned(docs: DataFrame, templates) -> DataFrame:
    """For a frame with keys __key and word arrays __w: a row per row with its base columns, at place -1, and one per gram
    that is equal, word by word, to a template's."""
    grams = template_grams(docs.sparkSession, templates)
    small = F.broadcast if grams.count() <= BROADCAST_GRAMS else (lambda df: df)
    # places are generated and hashed within generated code; an outer explode keeps Spark from also evaluating the words
    # in a filter of its own
    places = F.sequence(F.lit(-1), F.greatest(F.size("__w") - K, F.lit(-1)))
    rolled = base_scan(docs).select(*BASE, "__key", "__w", F.explode_outer(places).alias("__pos"))
    rolled = rolled.withColumn("__h", F.when(F.col("__pos") >= 0, gram(F.col("__w"), F.col("__pos"))))
    same = F.col("__h") == F.col("__g")
    for k in range(K):  # a hash alone proves nothing
        same = same & (F.get("__w", F.col("__pos") + k) == F.get("__gw", F.lit(k)))
    met = rolled.join(small(grams), same, "left").where("__pos = -1 or __t is not null")
    first = F.col("__pos") == -1
    return table(met.select("__key", "__pos", *[F.when(first, F.col(c)).alias(c) for c in BASE], "__t", "__label", "__tn", "__at"), "scan")


def match_templates(votes: DataFrame) -> DataFrame:
    """Spans of templates from equal grams: __key, label, cover, first and last word.

    Votes gather by diagonal, that is by place in the text less place in the template; diagonals within GAP words form one
    span, whose covered template words, all equal to the text's, are counted.
    """
    diagonals = votes.groupBy("__key", "__t", "__label", "__tn", (F.col("__pos") - F.col("__at")).alias("__d")).agg(
        F.collect_set("__at").alias("__ats"), F.min("__pos").alias("__first"), F.max("__pos").alias("__last")
    )
    by = Window.partitionBy("__key", "__t").orderBy("__d")
    apart = F.coalesce((F.col("__d") - F.lag("__d").over(by) > GAP).cast("int"), F.lit(0))
    spans = (
        diagonals.withColumn("__new", apart)
        .withColumn("__span", F.sum("__new").over(by))
        .groupBy("__key", "__t", "__label", "__tn", "__span")
        .agg(
            F.array_distinct(F.flatten(F.collect_list("__ats"))).alias("__ats"),
            F.min("__first").alias("first"),
            (F.max("__last") + K - 1).alias("last"),
        )
    )
    covered = F.size(
        F.array_distinct(F.flatten(F.transform("__ats", lambda a: F.sequence(a, a + F.lit(K - 1)))))
    )
    return spans.select(
        "__key",
        F.col("__label").alias("label"),
        (covered / F.col("__tn")).alias("cover"),
        "first",
        "last",
        ((F.col("last") - F.col("first") + 1) <= F.col("__tn") + 2 * GAP).alias("tight"),
    )


def scan(docs: DataFrame, templates=TEMPLATES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: n_words, the places of the fixed phrases, and labels with a score.

    templates are (label, text) pairs or a table of them, sentences and whole licenses alike; null texts, and those of fewer
    than K words, match nothing. score is the largest share of a template that a span covers, and 1 where a fixed phrase
    stands. Null and empty texts have no words, no labels and score 0. Null ids and repeated rows stay, each with its own
    row. Only the id and the text are read.
    """
    some = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("__text"))
    keyed = some.withColumn("__key", F.struct("doc_id", F.xxhash64("__text").alias("h")))
    marks = scanned(keyed.select("__key", words(F.col("__text")).alias("__w")), templates)
    spans = match_templates(marks.where("__t is not null"))
    sure = (F.col("cover") >= COVER) & F.col("tight")
    found = spans.groupBy("__key").agg(
        F.collect_set(F.when(sure, F.col("label"))).alias("__more"), F.max("cover").alias("__cover")
    )
    base = marks.where("__pos = -1").select("__key", *BASE)
    both = base.join(found, base["__key"].eqNullSafe(found["__key"]), "left").select(base["__key"]["doc_id"].alias("doc_id"), *BASE, "__more", "__cover")
    labels = F.array_sort(F.array_union("__base", F.coalesce("__more", F.array().cast("array<string>"))))
    return both.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("__base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0))
        .otherwise(F.least(F.coalesce("__cover", F.lit(0.0)), F.lit(1.0)))
        .alias("score"),
    )
