"""License scans by diagonal voting.

A word k-gram at position p of a text that stands at position t of a template votes
for the diagonal p - t. Votes of one diagonal, and of neighbouring ones where words
were added or left out, make a span; a span's score is the share of the template's
k-grams that voted for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Phrases whose every place counts, and their labels. Fixed values.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Longer passages in which licenses are given, and their labels. Fixed values.
PASSAGES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

#: Everything between words of ASCII letters, digits and non-ASCII characters, after lower-casing.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text as an array, A-Z in lower case; of a null text, an empty array."""
    # Only the letters A-Z change case: other letters are no part of any template,
    # and their case neither makes nor parts words.
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), GAPS)
    return F.filter(parts, lambda w: w != "")


def template_grams(spark: SparkSession, k: int = 2) -> DataFrame:
    """(template, label, exact, grams, t, gram, h): each k-gram of each template with its position.

    The table is made of the fixed texts above, so its size is bounded by them.
    """
    rows = []
    kinds = [(label, phrase, True) for phrase, label in PHRASES.items()] + [(label, text, False) for label, text in PASSAGES]
    for template, (label, text, exact) in enumerate(kinds):
        tokens = text.split()
        grams = [" ".join(tokens[i : i + k]) for i in range(len(tokens) - k + 1)]
        rows += [(template, label, exact, len(tokens), len(grams), t, gram) for t, gram in enumerate(grams)]
    # The empty gram stands for a text's length, once a text.
    rows.append((-1, "", False, 0, 1, 0, ""))
    schema = "template int, label string, exact boolean, length int, grams int, t int, gram string"
    return spark.createDataFrame(rows, schema).withColumn("h", F.xxhash64("gram"))


def votes(frame: DataFrame, id_col: str, text_col: str, k: int = 2) -> DataFrame:
    """(id, p, n_words, template columns): every k-gram of a text that stands in a template.

    A row with template -1 tells each row's number of words. The text's grams are
    exploded to (position, gram) only, and meet the templates' by hash; the grams
    themselves confirm each meeting.
    """
    split = frame.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words(F.col(text_col)).alias("words"))

    def gram(i: Column) -> Column:
        return F.concat_ws(" ", *(F.get("words", i - 1 + j) for j in range(k)))

    n = F.size("words")
    places = F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), gram)).otherwise(F.array().cast("array<string>"))
    grams = split.select("row", "id", n.alias("n_words"), F.posexplode(F.concat(places, F.array(F.lit("")))).alias("p", "text_gram"))
    grams = grams.withColumn("h", F.xxhash64("text_gram"))
    templates = F.broadcast(template_grams(frame.sparkSession, k))
    return grams.join(templates, "h").where("text_gram = gram").drop("text_gram", "gram", "h")


def scan(
    frame: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 2,
    slack: int = 3,
    least: float = 0.6,
) -> DataFrame:
    """One row per row of `frame`: (id, n_words, spans, score).

    `spans` is an array of (label, exact, start, end, score), in order of start:
    words [start, end). An exact span is a place where a phrase's words stand
    consecutively. Others join diagonals of a passage at most `slack` apart whose
    votes together cover the share `least` of its k-grams. `score` is the highest
    score of a span, 0 where there is none.

    A null or empty text has no words and no spans; texts are scanned whole, however
    long. Rows with a null id keep it; repeated rows are scanned each for itself. Spans of
    equal start stand in order of their end and label. An empty table gives no rows. Only
    the named columns are read, whatever else there is.
    """
    found = votes(frame, id_col, text_col, k)
    # Which of a template's positions voted for a diagonal of a document, as bits.
    diagonals = found.groupBy("row", "template", (F.col("p") - F.col("t")).cast("long").alias("diagonal")).agg(
        *(F.first(c).alias(c) for c in ("id", "n_words", "label", "exact", "grams")),
        F.bit_or(F.expr("shiftleft(1L, t)")).alias("bits"),
        F.min("t").alias("low"),
        F.max("t").alias("high"),
    )
    # A phrase needs all of its grams on one diagonal; a passage's neighbouring diagonals vote together.
    by_template = W.partitionBy("row", "template").orderBy("diagonal")
    near = by_template.rangeBetween(0, slack)

    def together(own: Column, over_near: Column) -> Column:
        return F.when(F.col("exact"), own).otherwise(over_near)

    first, last = F.col("diagonal") + F.col("low"), F.col("diagonal") + F.col("high") + k
    voted = (
        diagonals.withColumn("votes", F.bit_count(together(F.col("bits"), F.bit_or("bits").over(near))))
        .withColumn("start", together(first, F.min(first).over(near)))
        .withColumn("end", together(last, F.max(last).over(near)))
        .withColumn("score", F.col("votes") / F.col("grams"))
        .withColumn("good", (F.col("template") >= 0) & (F.col("score") >= F.when(F.col("exact"), 1.0).otherwise(least)))
        .where(F.col("good") | (F.col("template") < 0))
    )
    # Windows of a passage that overlap in diagonals are one span.
    away = F.col("diagonal") - F.lag("diagonal").over(by_template)
    opens = F.when(away.isNull() | F.col("exact") | (away > slack), 1).otherwise(0)
    merged = (
        voted.withColumn("group", F.sum(opens).over(by_template))
        .groupBy("row", "template", "group")
        .agg(
            *(F.first(c).alias(c) for c in ("id", "n_words", "label", "exact", "good")),
            F.max("score").alias("score"),
            F.min("start").alias("start"),
            F.max("end").alias("end"),
        )
    )
    good = F.col("good")
    span = F.struct("start", "end", "label", "exact", "score")
    return (
        merged.groupBy("row")
        .agg(
            F.first("id").alias("id"),
            F.first("n_words").cast("long").alias("n_words"),
            F.sort_array(F.collect_list(F.when(good, span))).alias("spans"),
        )
        .withColumn("score", F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)))
        .drop("row")
    )
