"""License scans by diagonal voting, in DataFrame functions only.

All rolling word k-grams of every text are hashed and joined to the positions of the same k-grams in license
templates. A join row votes for the diagonal (document position minus template position) on which the template would
lie; votes on neighbouring diagonals, which insertions and deletions leave behind, are merged into one span, and a
span counts as a license if enough of the template's k-grams voted. A template no longer than k must match whole.

Scale: the template table is fixed by the caller (a few hundred rows) and broadcast; the k-gram rows are streamed
through that join and only matches are shuffled, by document and template. No array or group is larger than a
document's own matches.

Edge cases: a null text has no words; rows equal in id and text share their (equal) result, rows with one id and
different texts are told apart by the text's hash; a null id is an id; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from counterlens.llm.common import ALNUM_WORD, keyed_rows

K, DRIFT, ENOUGH = 3, 2, 0.7

# The phrases searched for as such, and wordings of public licenses (label, words).
PHRASES = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("cc-by-sa", "creative commons attribution share alike 4 0 international license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
)


def words_of(text: str = "text") -> Column:
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(ALNUM_WORD), F.lit(0))


def gram_keys(w0: Column, w1: Column, w2: Column, short: list[tuple[str, str]]) -> Column:
    """Hash of the k-gram at a position; of its first two words where these are a phrase of their own. Documents and
    templates follow the same rule, so a phrase of two words is found inside longer templates too."""
    pair = F.xxhash64(F.lit(2), w0, w1)
    two = None
    for a, b in short:
        own = (w0 == a) & (w1 == b)
        two = own if two is None else two | own
    triple = F.when(w2.isNotNull(), F.xxhash64(F.lit(3), w0, w1, w2))
    return triple if two is None else F.when(two, pair).otherwise(triple)


def _grams(words: DataFrame, keys: list[str], short: list[tuple[str, str]]) -> DataFrame:
    """keys, pos, key: one row per position of the column ``words``."""
    shifted = F.arrays_zip(F.col("words").alias("w0"), F.slice("words", 2, 1 << 30).alias("w1"), F.slice("words", 3, 1 << 30).alias("w2"))
    rows = words.select(*keys, F.posexplode(shifted).alias("pos", "g"))
    return rows.select(*keys, F.col("pos"), gram_keys(F.col("g.w0"), F.col("g.w1"), F.col("g.w2"), short).alias("gram"))


def template_grams(spark: SparkSession, templates: tuple, phrases: tuple) -> tuple[DataFrame, list[tuple[str, str]]]:
    """template, label, base, gram, tpos, n_grams, n_words; the two-word phrases."""
    rows = [(i, label, i < len(phrases), text.split()) for i, (label, text) in enumerate((*phrases, *templates))]
    if any(not 2 <= len(r[3]) for r in rows) or any(r[2] and len(r[3]) > K for r in rows):
        raise ValueError("templates have at least two words, phrases at most three")
    short = [tuple(r[3]) for r in rows if len(r[3]) == 2]
    table = spark.createDataFrame(rows, "template int, label string, base boolean, words array<string>")
    grams = _grams(table.withColumn("n_words", F.size("words")), ["template", "label", "base", "n_words"], short)
    grams = grams.filter("gram is not null").withColumnRenamed("pos", "tpos")
    per = Window.partitionBy("template")
    return grams.withColumn("n_grams", F.count(F.lit(1)).over(per)), short


def license_spans(rows: DataFrame, templates: tuple = TEMPLATES, phrases: tuple = PHRASES) -> DataFrame:
    """``rows``: as ``keyed_rows``. doc_id, key, label, base, first_word, last_word (starts of the span's first and last k-gram), score."""
    spark = rows.sparkSession
    known, short = template_grams(spark, templates, phrases)
    words = rows.select("doc_id", "key", words_of().alias("words"))
    votes = (_grams(words, ["doc_id", "key"], short).join(F.broadcast(known), "gram")
             .select("doc_id", "key", "template", "label", "base", "n_grams", "pos", "tpos", (F.col("pos") - F.col("tpos")).alias("diagonal")))
    exact = ["doc_id", "key", "template", "label", "base", "n_grams", "diagonal"]
    lines = votes.groupBy(*exact).agg(F.collect_set("tpos").alias("seen"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    along = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(along)
    fresh = F.col("base") | gap.isNull() | (gap > DRIFT)                  # a phrase has no drift
    lines = lines.withColumn("span", F.sum(fresh.cast("long")).over(along))
    spans = lines.groupBy("doc_id", "key", "template", "label", "base", "n_grams", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("voted"), F.min("first").alias("first_word"),
        F.max("last").alias("last_word"))
    score = F.col("voted") / F.col("n_grams")
    return spans.filter(F.when(F.col("base"), F.col("voted") == F.col("n_grams")).otherwise(score >= ENOUGH)).select(
        "doc_id", "key", "label", "base", "first_word", "last_word", score.alias("score"))


def license_scan(docs: DataFrame, templates: tuple = TEMPLATES, phrases: tuple = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row per input row."""
    rows = keyed_rows(docs)
    spans = license_spans(rows, templates, phrases)
    base = F.col("base")
    found = spans.groupBy("doc_id", "key").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("score").alias("score"))
    found = found.select(F.col("doc_id").alias("i"), F.col("key").alias("k"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    any_case = ALNUM_WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    docs = rows.select("doc_id", "key",
                       F.coalesce(F.regexp_count("text", F.lit(any_case)), F.lit(0)).cast("long").alias("n_words"))
    return docs.join(found, docs["doc_id"].eqNullSafe(found["i"]) & (docs["key"] == found["k"]), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
