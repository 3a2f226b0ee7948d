"""License scans: an exact set-similarity join of text blocks with templates.

A template is a set of words. Its words are put in the order of their
frequency in the whole corpus, rarest first; a block that holds the required
share of a template must hold one of its first words (the prefix), so blocks
are found by an equality join of the corpus' words with the templates'
prefixes. Positional and length filters drop candidates that cannot reach the
threshold, and the exact overlap decides. All of it is column expressions.

A phrase is a template that must stand word for word: its blocks are all runs
of its own length. A notice's blocks are all runs of twice its length,
wherever they begin: a block that meets the threshold also does from its first
template word on, so blocks that begin at template words find it.

Texts are cut into words once. Only words that some template has are kept,
with their places; they are what frequencies, candidates and overlaps are
taken from.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import step_table

#: Words before lower-casing: runs of 0-9, letters and non-ASCII characters.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False
    share: float = 1.0

    def row(self, number: int) -> tuple:
        words = self.text.split()
        need = len(set(words)) if self.phrase else math.ceil(self.share * len(set(words)) - 1e-9)
        return number, self.label, self.phrase, words, list(dict.fromkeys(words)), need


# The phrases that are counted.
PHRASES = [
    Template("cc-by", "cc by", phrase=True),
    Template("gpl", "general public license", phrase=True),
    Template("reserved", "all rights reserved", phrase=True),
]
NOTICES = [
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template(
        "apache-2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license "
        "is distributed on an as is basis",
        share=0.8,
    ),
    Template("mit", "released under the mit license"),
    Template("mit", "licensed under the mit license"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files",
        share=0.8,
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met",
        share=0.8,
    ),
    Template("gpl-3.0", "licensed under the gnu general public license version 3"),
    Template(
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu "
        "general public license as published by the free software foundation",
        share=0.8,
    ),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", share=0.9),
    Template("spdx", "spdx license identifier"),
]


def words_of(text: Column) -> Column:
    """The words of a text, not lower-cased yet; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def template_table(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    """One row per template: the stated list, whose size does not depend on the data."""
    kind = "t int, label string, phrase boolean, t_words array<string>, t_set array<string>, need int"
    return spark.createDataFrame([x.row(i) for i, x in enumerate(templates)], kind)


def placed(split: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """``key``, ``text_hash``, ``n_words``, and ``found``: the template words of a text with their places, in order."""

    def known(raw: Column, place: Column) -> Column:
        # some letters beyond ASCII have a lower case inside it; no template word holds them
        plain = F.octet_length(raw) == F.char_length(raw)
        return F.when(plain & F.lower(raw).isin(*vocabulary), F.struct(place.alias("place"), F.lower(raw).alias("word")))

    found = F.array_compact(F.transform("words", known)).alias("found")
    return split.select("key", "text_hash", F.size("words").cast("long").alias("n_words"), found)


def prefixes(templates: DataFrame, frequency: DataFrame) -> DataFrame:
    """Templates by the words of their prefix: the first size - need + 1 in order of frequency."""
    listed = templates.select("*", F.explode("t_set").alias("word"))
    rarest = Window.partitionBy("t").orderBy(F.coalesce("n", F.lit(0)), "word")
    ranked = listed.join(frequency, "word", "left").withColumn("rank", F.row_number().over(rarest))
    return ranked.filter(F.col("rank") <= F.size("t_set") - F.col("need") + 1).drop("n")


def matches(texts: DataFrame, templates: DataFrame) -> DataFrame:
    """(key, text_hash, label, phrase, start, share) of every block that meets its template's threshold.

    ``texts`` are `placed` ones. A phrase's blocks are counted by place; a
    notice is listed once for each prefix word in such a block, with the
    largest share among the blocks around it.
    """
    frequency = texts.select(F.explode("found.word").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    listed = prefixes(templates, frequency).collect()  # no more rows than the templates have words
    starters = sorted({r["word"] for r in listed})
    reach = 2 * max(len(r["t_words"]) for r in listed)
    # candidates: a prefix word and the template words near it, which cannot lie further away than their number
    def candidate(x: Column, i: Column) -> Column:
        near = F.slice("found", F.greatest(i + 1 - reach, F.lit(1)), F.lit(2 * reach + 1))
        return F.when(x["word"].isin(*starters), F.struct(x.alias("hit"), near.alias("near")))

    hits = F.array_compact(F.transform("found", candidate))
    some = texts.filter(F.size("found") > 0).select("key", "text_hash", F.explode(hits).alias("h"))
    some = some.select("key", "text_hash", "h.near", F.col("h.hit.place").alias("place"), F.col("h.hit.word").alias("word"))
    fixed = templates.sparkSession.createDataFrame(listed, prefixes(templates, frequency).schema)
    joined = some.join(F.broadcast(fixed), "word")
    length = F.size("t_words")

    # a phrase's only prefix word gives the place where it would begin
    first = F.col("place") - F.array_position("t_words", F.col("word")).cast("int") + 1
    run = F.filter("near", lambda x: x["place"].between(first, first + length - 1))
    stands = (first >= 0) & (F.transform(run, lambda x: x["word"]) == F.col("t_words"))
    phrases = joined.filter("phrase").filter(stands)
    phrases = phrases.select("key", "text_hash", "label", "phrase", first.alias("start"), F.lit(1.0).alias("share"))

    inside = F.filter(
        "near", lambda x: (F.abs(x["place"] - F.col("place")) < 2 * length) & F.array_contains(F.col("t_set"), x["word"])
    )
    # length filter: enough of the template lies around; position filter: not all of it after its first words
    enough = (F.size(F.array_distinct("inside.word")) >= F.col("need")) & (F.size("t_set") - F.col("rank") + 1 >= F.col("need"))
    notices = joined.filter("not phrase").withColumn("inside", inside).filter(enough)

    def overlap(begin: Column) -> Column:
        block = F.filter("inside", lambda x: x["place"].between(begin, begin + 2 * length - 1))
        return F.size(F.array_distinct(F.transform(block, lambda x: x["word"])))

    begins = F.filter(F.transform("inside", lambda x: x["place"]), lambda p: p <= F.col("place"))
    notices = notices.withColumn("overlap", F.array_max(F.transform(begins, overlap))).filter("overlap >= need")
    share = (F.col("overlap") / F.size("t_set")).alias("share")
    return phrases.union(notices.select("key", "text_hash", "label", "phrase", F.lit(None).cast("int").alias("start"), share))


def scan(docs: DataFrame, templates: Sequence[Template] = (), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Words, phrase places, labels and score of every document.

    Returns (key, n_words, n_base, first_word, last_word, base_labels, labels,
    score): places of phrases and the first and last of them (null without
    one), the distinct labels of phrases, of all templates, and the largest
    share of a template found (0 without a match). Null and empty texts have
    no words. Rows that agree in key and text are one document; rows that
    share only the key are several. Other columns are not used.
    """
    templates = [*PHRASES, *NOTICES] if not templates else list(templates)
    own = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    split = own.select("key", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    texts = step_table(placed(split, vocabulary))
    found = matches(texts, template_table(docs.sparkSession, templates))
    plain = texts.select("key", "text_hash", "n_words")
    rows = plain.unionByName(found, allowMissingColumns=True)
    base = F.col("phrase")
    return (
        rows.groupBy("key", "text_hash")
        .agg(
            F.max("n_words").alias("n_words"),
            # a row repeated in key and text repeats its matches as well
            (F.count_if(base) / F.count("n_words")).cast("long").alias("n_base"),
            F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
            F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        )
        .drop("text_hash")
    )
