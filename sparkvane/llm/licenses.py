"""Licence scans by diagonal voting, in DataFrame functions only.

Every run of GRAM words of a document is hashed and joined with the positions of the same run in the licence templates.
A hit votes for its diagonal, document position less template position. Neighbouring diagonals are merged, so that a
word put in or left out moves a match by one diagonal and no more; a span counts when the runs it matched cover enough
of the template and the span is no longer than a copy with some words put in would be.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: ASCII but for digits and small letters, once A-Z are small.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3
NEAR = 2
COVER = 0.8
STRETCH = 1.5

# Phrases and their labels as the contract has them.
PHRASES = [
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
]

# Opening sentences of public licences and usual notices, with labels.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def words(text: Column) -> Column:
    """A text's words, with A-Z made small."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN), "")


def grams(w: Column, k: int) -> Column:
    """64-bit hashes of each k words in a row; empty with fewer words."""
    last = F.size(w) - k
    return F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + F.lit(j)) for j in range(k)])),
    ).otherwise(F.array().cast("array<bigint>"))


def _places(w: Column, joined: Column, phrase: str) -> Column:
    """Starts of a phrase; texts without it skip the search."""
    parts = phrase.split(" ")
    here = lambda i: F.array([F.get(w, i + F.lit(j)) for j in range(len(parts))]) == F.array(*map(F.lit, parts))
    return F.when(
        F.contains(joined, F.lit(f" {phrase} ")), F.filter(F.sequence(F.lit(0), F.size(w) - len(parts)), here)
    ).otherwise(F.array().cast("array<int>"))


def template_grams(spark, templates: list[tuple[str, str]], k: int) -> DataFrame:
    """(gram, tid, tpos, label, size) of every template; its size is fixed by the templates given."""
    rows = [
        {"tid": i, "label": label, "w": [x for x in re.split(BETWEEN, text.translate(str.maketrans(UPPER, LOWER))) if x]}
        for i, (label, text) in enumerate(templates)
    ]
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<tid:int,label:string,w:array<string>>>")))
    return table.select("tid", "label", F.size("w").alias("size"), F.posexplode(grams(F.col("w"), k)).alias("tpos", "gram"))


def spans(docs: DataFrame, templates: list[tuple[str, str]] | None = None, k: int = GRAM, cover: float = COVER) -> DataFrame:
    """(doc_id, text_key, label, first, last, covered): verified spans in words, last inclusive."""
    spark = docs.sparkSession
    index = template_grams(spark, templates or TEMPLATES, k)
    rolled = docs.select("doc_id", "text_key", F.posexplode_outer(grams(F.col("words"), k)).alias("pos", "gram"))
    hits = rolled.join(F.broadcast(index), "gram").withColumn("diagonal", F.col("pos") - F.col("tpos"))
    key = ["doc_id", "text_key", "tid", "label", "size"]
    lines = hits.groupBy(*key, "diagonal").agg(F.collect_set("tpos").alias("votes"))
    order = W.partitionBy(*key).orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal", 1).over(order) > NEAR).cast("int")
    islands = lines.withColumn("island", F.sum(F.coalesce(apart, F.lit(0))).over(order))
    merged = islands.groupBy(*key, "island").agg(
        F.array_distinct(F.flatten(F.collect_list("votes"))).alias("votes"),
        F.min(F.col("diagonal") + F.array_min("votes")).alias("first"),
        F.max(F.col("diagonal") + F.array_max("votes") + k - 1).alias("last"),
    )
    told = F.size(F.array_distinct(F.flatten(F.transform("votes", lambda p: F.sequence(p, p + (k - 1))))))
    return merged.withColumn("covered", told / F.col("size")).filter(
        (F.col("covered") >= cover) & (F.col("last") - F.col("first") + 1 <= F.col("size") * STRETCH)
    ).select("doc_id", "text_key", "label", "first", "last", "covered")


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per document: n_words, places of the fixed phrases, labels and a score.

    A null or empty text has no words and no labels. Repeated rows each get their row. Rows without doc_id are left
    out. The score is 1 with a phrase, else the largest part of a template that a span covers, else 0.
    """
    worded = docs.filter(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("words"))
    joined = worded.withColumn("joined", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    placed = joined.select(
        "doc_id", "text_key", F.size("words").cast("long").alias("n_words"),
        *[_places(F.col("words"), F.col("joined"), p).alias(f"p{i}") for i, (p, _) in enumerate(PHRASES)],
    )
    every = F.concat(*[F.col(f"p{i}") for i in range(len(PHRASES))])
    base = placed.select(
        "doc_id", "text_key", "n_words", F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(x)) for i, (_, x) in enumerate(PHRASES)])).alias("base"),
    )
    found = spans(worded, templates).groupBy("doc_id", "text_key").agg(
        F.collect_set("label").alias("more"), F.max("covered").alias("covered"), F.count("*").alias("n_spans")
    )
    none = F.array().cast("array<string>")
    return base.join(found, ["doc_id", "text_key"], "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.sort_array(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.coalesce("covered", F.lit(0.0)))).alias("score"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
    )
