"""License scans with SQL functions only: rolling word n-grams vote for diagonals of templates.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. Every rolling n-gram of GRAM words (fewer
for templates that are shorter) is joined by its hash, and by its words, with the places of the templates' n-grams. A
meeting of text place a and template place t is a vote for the diagonal a - t, which is where the template would begin.
Votes are put together by (text, template, diagonal) before anything is shuffled, so a group is never longer than its
template. Neighbouring diagonals are merged in overlapping bands, so that words put in or left out do not break a match:
two diagonals at most `drift` apart share a band. Diagonals and bands are verified on the words that the votes cover:

* a phrase is found where all its n-grams are on one diagonal (consecutive words, nothing between);
* a template is found in a span when its votes cover COVERAGE of its words, and DENSITY of the span's words. The score is
  the covered share of the template. A span of which half or more lies in a better one (higher score, then more words,
  then the earlier template, then the earlier start, then the shorter) of the same text is not given.

Templates come as a list: their n-grams are broadcast only while they have at most BROADCAST_WORDS words.

Defined cases: null text is an empty text, with no words, labels "" and score 0. Rows that repeat a key and a text are
rows of the result, each with the same findings; ties are put in order as above. Other columns are kept, those with a
result's name are replaced. An empty table gives none. A text is cut into words in one task, whatever its length.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: all below 128 that is no digit and no letter.
BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
#: Words of an n-gram; shares that a span must reach; a band spans twice the drift of a template: its words / DRIFT_PART.
GRAM, COVERAGE, DENSITY, DRIFT_PART = 3, 0.7, 0.7, 8
BROADCAST_WORDS = 200_000

# The phrases of the contract and their labels.
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
# Notices by which well-known public licenses are applied, and sentences they open with.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-notice", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

RESULTS = ("n_words", "places", "base_labels", "spans", "labels", "score")


def _once(value: Column, use) -> Column:
    """use(value), with value worked out once, however often use() reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """The words in order: one translation and a split at single spaces cost a fifth of matching WORD."""
    return F.array_remove(F.split(F.translate(text, UPPER + BETWEEN, LOWER + " " * len(BETWEEN)), " "), "")


def grams(listed: Column, n: int = GRAM) -> Column:
    """The n words from each place on, joined by a space; fewer at the end."""
    return _once(listed, lambda w: F.transform(w, lambda x, i: F.concat_ws(" ", x, *(F.get(w, i + j) for j in range(1, n)))))


def template_grams(spark: SparkSession, phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]]) -> DataFrame:
    """t_id, label, exact (a phrase), size (words), n (words of its n-grams), t (place), gram and hash."""
    given = [(label, text, True) for label, text in phrases] + [(label, text, False) for label, text in templates]
    if not given:
        given = [("", "", True)]
    rows = F.array(*(F.struct(F.lit(i).alias("t_id"), F.lit(a).alias("label"), F.lit(b).alias("line"), F.lit(c).alias("exact")) for i, (a, b, c) in enumerate(given)))
    listed = spark.range(0, 1, 1, 1).select(F.inline(rows)).withColumn("_w", words(F.col("line"))).withColumn("size", F.size("_w")).filter("size > 0")
    listed = listed.withColumn("n", F.least("size", F.lit(GRAM)))
    placed = listed.select("t_id", "label", "exact", "size", "n", F.posexplode(grams(F.col("_w"))).alias("t", "gram")).filter(F.col("t") <= F.col("size") - F.col("n"))
    return placed.withColumn("hash", F.xxhash64("gram"))


def votes(docs: DataFrame, known: DataFrame, sizes: Sequence[int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text_hash, template columns, diagonal and places (the template's places that agree on it, distinct).

    sizes: words of each template.
    """
    small = sum(sizes) <= BROADCAST_WORDS
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # hashed before the words are laid out, or each word would carry its text along
    hashed = docs.select(F.col(key).alias("key"), F.xxhash64(body).alias("text_hash"), body.alias("_body"))
    rolled = hashed.select("key", "text_hash", F.posexplode(grams(words(F.col("_body")))).alias("_at", "_gram"))
    shorter = [F.substring_index("_gram", " ", n) for n in sorted({n for n in sizes if 0 < n < GRAM})]
    if shorter:
        rolled = rolled.select("key", "text_hash", "_at", F.explode(F.array(F.col("_gram"), *shorter)).alias("_gram"))
    on = (F.xxhash64("_gram") == F.col("hash")) & (F.col("_gram") == F.col("gram"))
    met = rolled.join(F.broadcast(known) if small else known, on)  # at most BROADCAST_WORDS n-grams
    return met.groupBy("key", "text_hash", "t_id", "label", "exact", "size", "n", (F.col("_at") - F.col("t")).alias("diagonal")).agg(F.collect_set("t").alias("places"))


def _covered(at: Column, n: Column) -> Column:
    """How many words the n-grams at these places cover."""
    return F.size(F.array_distinct(F.flatten(F.transform(at, lambda t: F.sequence(t, t + n - 1)))))


def spans_of(found: DataFrame) -> DataFrame:
    """key, text_hash, label, exact, t_id, start, end (words, exclusive), hit (covered template words), score: verified."""
    drift = F.greatest(F.floor(F.col("size") / DRIFT_PART), F.lit(1)).cast("int")
    band = [F.struct(F.lit(0).alias("level"), F.col("diagonal").alias("band"))]
    # two sets of bands of width 2 * drift, half a width apart
    band += [F.struct(F.lit(i).alias("level"), F.floor((F.col("diagonal") + (i - 1) * drift) / (2 * drift)).cast("int").alias("band")) for i in (1, 2)]
    merged = found.select("*", F.inline(F.when(F.col("exact"), F.array(band[0])).otherwise(F.array(*band))))
    merged = merged.groupBy("key", "text_hash", "t_id", "label", "exact", "size", "n", "level", "band").agg(F.collect_list(F.struct("diagonal", "places")).alias("_d"))
    at = F.array_distinct(F.flatten(F.transform("_d", lambda d: F.transform(d["places"], lambda t: t + d["diagonal"]))))
    merged = merged.withColumn("_t", F.array_distinct(F.flatten("_d.places"))).withColumn("_a", at)
    merged = merged.withColumns({"hit": _covered(F.col("_t"), F.col("n")), "start": F.array_min("_a"), "end": F.array_max("_a") + F.col("n"), "_in": _covered(F.col("_a"), F.col("n"))})
    whole = F.col("exact") & (F.size("_t") == F.col("size") - F.col("n") + 1)
    like = ~F.col("exact") & (F.col("hit") >= COVERAGE * F.col("size")) & (F.col("_in") >= DENSITY * (F.col("end") - F.col("start")))
    return merged.filter(whole | like).select("key", "text_hash", "t_id", "label", "exact", "size", "start", "end", "hit", (F.col("hit") / F.col("size")).alias("score")).distinct()


def best_spans(spans: DataFrame, longest: int) -> DataFrame:
    """Without those that lie by half or more in a better one. A span is at most longest / DENSITY words long."""
    reach = int(longest / DENSITY) + 1
    near = Window.partitionBy("key", "text_hash", "exact").orderBy("start").rangeBetween(-reach, reach)
    own = F.struct("score", "hit", (-F.col("t_id")).alias("t"), (-F.col("start")).alias("s"), (-F.col("end")).alias("e"))
    all_ = F.collect_list(F.struct(own.alias("own"), "start", "end")).over(near)
    better = F.exists("_near", lambda o: (o["own"] > F.col("_own")) & (2 * (F.least(o["end"], F.col("end")) - F.greatest(o["start"], F.col("start"))) >= F.col("end") - F.col("start")))
    templates = spans.filter("not exact").withColumn("_own", own).withColumn("_near", all_).filter(~better).drop("_own", "_near")
    return spans.filter("exact").unionByName(templates)


def scan(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_words, places (start of each phrase, in order), base_labels, spans (start, end, label, score, in order),
    labels (of phrases and spans) and score (1 with a phrase, else that of the best span, else 0)."""
    spark = docs.sparkSession
    sizes = [len(re.findall(WORD, line)) for _, line in (*phrases, *templates)]
    found = written(votes(docs, template_grams(spark, phrases, templates), sizes, key, text), "license-votes")
    spans = best_spans(spans_of(found), max(sizes, default=1))
    exact = F.col("exact")
    found = spans.groupBy("key", "text_hash").agg(
        F.array_sort(F.collect_list(F.when(exact, F.col("start").cast("long")))).alias("places"),
        F.array_sort(F.collect_set(F.when(exact, F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_list(F.when(~exact, F.struct("start", "end", "label", "score")))).alias("spans"),
        F.array_sort(F.collect_set("label")).alias("labels"),
        F.max(F.when(exact, 1.0).otherwise(F.col("score"))).alias("score"),
    )
    k, h = f"_{uuid.uuid4().hex}", f"_{uuid.uuid4().hex}"
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.withColumn(h, F.xxhash64(body)).withColumn("n_words", F.size(words(body)).cast("long"))
    found = found.select(F.col("key").alias(k), F.col("text_hash").alias(f"{h}r"), *(F.col(c).alias(f"{h}{c}") for c in RESULTS[1:]))
    out = rows.join(found, F.col(key).eqNullSafe(F.col(k)) & (F.col(h) == F.col(f"{h}r")), "left")
    none = {"places": "array<long>", "base_labels": "array<string>", "spans": "array<struct<start:int,end:int,label:string,score:double>>", "labels": "array<string>"}
    filled = [F.coalesce(F.col(f"{h}{c}"), F.array().cast(t)).alias(c) for c, t in none.items()]
    return out.select(*(c for c in docs.columns if c not in RESULTS), "n_words", *filled, F.coalesce(F.col(f"{h}score"), F.lit(0.0)).alias("score"))
