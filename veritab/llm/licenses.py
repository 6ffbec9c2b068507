"""License scans by diagonal voting.

Every k-gram of words of every text is joined with the positions it has in the license templates. A hit votes for the
diagonal (text position - template position): the words of a quoted template share one. Neighbouring diagonals, apart by a
few inserted or missing words, are merged, and a merged span counts by the share of the template's words it covers. The
join compares the words themselves, so hits are exact. Texts never travel: only hits do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from .common import content_key, lower_ascii, materialise, quoted, words

# Fixed: ASCII letters and digits and everything beyond ASCII form words; in texts that are not lower-cased yet.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Fixed phrases: label and words.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

# Notices as they are usually written in files and on pages.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "mit": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ],
    "gpl-3.0": [
        "licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-4.0": ["licensed under a Creative Commons Attribution 4.0 International License"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}

FEW_POSITIONS = 200_000  # k-gram positions up to which the template table is broadcast (some 20 MB)


def positions(spark: SparkSession, templates=None, k: int = 3) -> DataFrame:
    """(template, label, base, n, k, at, w1, w2, w3): every k-gram of every template; k is the template's length if less.

    Templates of one word cannot be found by k-grams and are left out.
    """
    rows = [(label, True, text) for label, text in PHRASES.items()]
    rows += [(label, False, t) for label, texts in (TEMPLATES if templates is None else templates).items() for t in texts]
    cells = [(F.lit(i).alias("template"), *[F.lit(v).alias(n) for v, n in zip(r, ("label", "base", "text"))]) for i, r in enumerate(rows)]
    df = spark.range(1).select(F.inline(F.array(*[F.struct(*c) for c in cells])))
    df = df.withColumn("w", words(lower_ascii(F.col("text")), WORD)).withColumn("n", F.size("w"))
    df = df.filter("n >= 2").withColumn("k", F.least(F.lit(k), F.col("n")))
    df = df.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("k"))).alias("at"))
    return df.select(
        "template", "label", "base", "n", "k", "at",
        F.get("w", F.col("at")).alias("w1"),
        F.get("w", F.col("at") + 1).alias("w2"),
        F.when(F.col("k") > 2, F.get("w", F.col("at") + 2)).alias("w3"),
    )


def hits(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """(key, template, label, base, n, k, diagonal, pos): where k-grams of templates stand in the texts, each place once."""
    rows = docs.select(content_key("doc_id", "text").alias("key"), words(F.col("text"), WORD).alias("w"))
    # a plain posexplode would have the optimizer compute the words once more, to filter texts without any
    rows = rows.select("key", "w", F.posexplode_outer("w").alias("pos", "a"))
    b, c = F.get("w", F.col("pos") + 1), F.get("w", F.col("pos") + 2)
    # lower() is quick and never parts words that are equal in ASCII lower case; those it joins beyond that fail below
    rows = rows.select("key", "pos", "a", b.alias("b"), c.alias("c"), F.xxhash64(F.lower("a"), F.lower(b)).alias("h"))
    grams = grams.withColumn("h2", F.xxhash64(F.lower("w1"), F.lower("w2")))
    grams = F.broadcast(grams) if grams.count() <= FEW_POSITIONS else grams
    a, b, c = (lower_ascii(F.col(x)) for x in "abc")
    exact = (a == F.col("w1")) & (b == F.col("w2")) & (F.col("w3").isNull() | (c == F.col("w3")))
    found = rows.join(grams, (F.col("h") == F.col("h2")) & exact)
    return found.select("key", "template", "label", "base", "n", "k", (F.col("pos") - F.col("at")).alias("diagonal"), "pos").distinct()


def spans(found: DataFrame, gap: int = 3, least: float = 0.8) -> DataFrame:
    """(key, label, base, start, end, cover): merged diagonals that cover at least ``least`` of their template.

    Diagonals of a template at most ``gap`` apart whose stretches follow on each other within ``gap`` words are one span.
    The fixed phrases are not merged: each of their places is one.
    """
    one = found.groupBy("key", "template", "label", "base", "n", "k", "diagonal")
    one = one.agg(F.min("pos").alias("lo"), (F.max("pos") + F.max("k")).alias("hi"), F.collect_set("pos").alias("at"))
    # words covered by the k-grams of the diagonal: each adds as many as its distance to the one before, k at most
    at = F.array_sort("at")
    steps = F.zip_with(F.slice(at, 2, F.size(at)), at, lambda x, y: F.when(y.isNull() | x.isNull(), F.lit(0)).otherwise(F.least(x - y, F.col("k"))))
    one = one.withColumn("voted", F.aggregate(steps, F.col("k"), lambda s, x: s + x)).drop("at")
    w = W.partitionBy("key", "template").orderBy("lo", "diagonal")
    far = (F.abs(F.col("diagonal") - F.lag("diagonal").over(w)) > gap) | (F.col("lo") - F.lag("hi").over(w) > gap)
    one = one.withColumn("new", F.when(F.lag("lo").over(w).isNull() | F.col("base") | far, 1).otherwise(0))
    one = one.withColumn("run", F.sum("new").over(w))
    merged = one.groupBy("key", "template", "label", "base", "n", "run")
    merged = merged.agg(F.min("lo").alias("start"), F.max("hi").alias("end"), F.sum("voted").alias("voted"))
    cover = F.least(F.lit(1.0), F.col("voted") / F.col("n"))
    return merged.withColumn("cover", cover).filter(F.col("cover") >= least).drop("template", "run", "voted", "n")


ADDED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scan(docs: DataFrame, templates=None, keep: tuple[str, ...] = ("doc_id",), k: int = 3, gap: int = 3, least: float = 0.8) -> DataFrame:
    """``keep`` with n_words, n_base, first_word, last_word, base_labels, labels and score of every whole text.

    A null text is empty: no words, no labels, score 0. Repeated rows each get the full result. ``score`` is the best
    cover of any span. Further columns are dropped unless kept.
    """
    found = hits(docs, positions(docs.sparkSession, templates, k))
    s = materialise(spans(found, gap, least), "licenses")
    base = F.col("base")
    by_doc = s.groupBy("key").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("cover").alias("score"),
    )
    n_words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*[quoted(x) for x in keep]).alias("kept"), content_key("doc_id", "text").alias("of"), n_words.alias("n_words"))
    rows = rows.join(by_doc, F.col("of") == F.col("key"), "left").fillna({"n_base": 0, "base_labels": "", "labels": "", "score": 0.0})
    return rows.select("kept.*", *ADDED)
