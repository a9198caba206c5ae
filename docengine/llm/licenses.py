"""License scans: an exact set-similarity join of text blocks with license templates.

DataFrame functions only. A block is a stretch of a text, whatever its lines: WINDOW words, the next block beginning
WINDOW / 2 words later, so any passage of up to WINDOW / 2 words lies within one block, wrapped over lines or not. A block meets a template if it holds at least
CONTAINMENT of the template's distinct words. All such pairs are found: words are ordered by how many documents have
them, rarest first; a pair that meets must share a word of the template's prefix and of the block's (prefix filter), the
block must be long enough (length filter), and the words that can still be shared behind a shared one must suffice
(positional filter); what remains is compared in full. Words outside all templates cannot be shared, so blocks keep
template words only, and texts that lack the words for any template, as a whole, are left out before: both lose nothing.
The frequencies come from all documents.

The base phrases are searched for word by word in every text. Null and empty texts have no words and no labels. Repeated
rows give repeated rows; other columns aren't read; empty tables give empty results. Equal scores change nothing, as all
labels that meet are kept.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.staging import staged

WINDOW = 64
CONTAINMENT = 0.85
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Base phrases and their labels.
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
# Customary wordings of public licenses, and their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced, distributed or transmitted in any form without prior written permission"),
]


def template_words(text: str) -> list[str]:
    """The distinct words of a template, sorted."""
    return sorted(set("".join(c if c.isalnum() else " " for c in text.lower()).split()))


def needed(n: int) -> int:
    """Words of a template of n distinct ones that a block must hold."""
    return ceil(CONTAINMENT * n - 1e-9)


def words_of(text: Column) -> Column:
    """Words of a text without upper-case letters."""
    bare = F.regexp_replace(F.regexp_replace(text, "^" + SEPARATORS, ""), SEPARATORS + "\\z", "")
    return F.when(bare != "", F.split(bare, SEPARATORS)).otherwise(F.array().cast("array<string>"))


def base_places(words: str) -> Column:
    """Array of (start, label): all places where a base phrase's words stand consecutively; `words` is a column's name."""
    at = lambda i: F.get(words, i)
    label = lambda i: F.coalesce(*(F.when(_all(at(i + k) == w for k, w in enumerate(p)), F.lit(v)) for p, v in PHRASES.items()))
    last = F.greatest(F.size(words) - 1, F.lit(0))
    hit = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.cast("long").alias("start"), label(i).alias("label")))
    return F.filter(hit, lambda x: x["label"].isNotNull())


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def scan(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n_words, places (array of (start, label) of base phrases) and matches (array of (label, containment, template))."""
    spark = docs.sparkSession
    sets = [template_words(t) for _, t in templates]
    vocabulary = sorted({w for s in sets for w in s} | {w for p in PHRASES for w in p})
    literal = lambda words: F.array(*map(F.lit, words))
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    df = docs.select(*keep, lowered.alias("__t")).withColumn("__w", words_of(F.col("__t"))).withColumn("__v", F.array_intersect("__w", literal(vocabulary)))
    possible = F.array_contains("__v", "license")
    for s in sets:
        possible = possible | (F.size(F.array_intersect("__v", literal(s))) >= needed(len(s)))
    possible = (F.size("__v") >= 2) & possible
    first = df.select(*keep, F.monotonically_increasing_id().alias("__row"), F.size("__w").cast("long").alias("n_words"), "__v", F.when(possible, F.col("__t")).alias("__t"))
    first = staged(first)
    frequency = first.select(F.explode("__v").alias("word")).groupBy("word").count()  # a row for each word of the templates
    by_words = spark.createDataFrame([(i, label, w) for i, ((label, _), s) in enumerate(zip(templates, sets)) for w in s], "template int, label string, word string")
    ranked = by_words.join(F.broadcast(frequency), "word", "left").select("template", "label", F.struct(F.coalesce("count", F.lit(0)).alias("n"), "word").alias("key"))
    sized = ranked.groupBy("template", "label").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    sized = sized.withColumn("need", F.ceil(F.size("keys") * F.lit(CONTAINMENT) - 1e-9).cast("int"))
    prefixes = sized.select("template", "label", "keys", "need", F.posexplode(F.slice("keys", F.lit(1), F.size("keys") - F.col("need") + 1)).alias("t_at", "key"))

    least = min(needed(len(s)) for s in sets)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - WINDOW // 2 - 1, F.lit(0)), F.lit(WINDOW // 2))
    block = lambda at: F.struct(at.alias("at"), F.array_intersect(F.slice("w", at + 1, F.lit(WINDOW)), literal(vocabulary)).alias("v"))
    texts = first.where("__t is not null").select("__row", words_of(F.col("__t")).alias("w"))
    blocks = texts.select("__row", F.explode(F.filter(F.transform(starts, block), lambda x: F.size(x["v"]) >= least)).alias("x"))
    words = blocks.select("__row", "x.at", F.explode("x.v").alias("word"))
    keyed = words.join(F.broadcast(frequency), "word").select("__row", "at", F.struct(F.col("count").alias("n"), "word").alias("key"))
    ordered = keyed.groupBy("__row", "at").agg(F.sort_array(F.collect_list("key")).alias("b_keys"))  # WINDOW entries at most
    probes = ordered.select("__row", "b_keys", F.posexplode(F.slice("b_keys", F.lit(1), F.greatest(F.size("b_keys") - least + 1, F.lit(0)))).alias("b_at", "key"))
    rest = F.least(F.size("b_keys") - F.col("b_at"), F.size("keys") - F.col("t_at")) + F.least("b_at", "t_at")
    near = probes.join(F.broadcast(prefixes), "key").where((F.size("b_keys") >= F.col("need")) & (F.col("b_at") <= F.size("b_keys") - F.col("need")) & (rest >= F.col("need")))
    shared = F.size(F.array_intersect("b_keys", "keys"))
    met = near.where(shared >= F.col("need")).select("__row", F.struct("label", F.round(shared / F.size("keys"), 6).alias("containment"), "template").alias("m"))
    matches = met.groupBy("__row").agg(F.sort_array(F.collect_set("m")).alias("matches"))  # one entry for each template and containment
    own = first.where("__t is not null").select("__row", words_of(F.col("__t")).alias("__w")).select("__row", base_places("__w").alias("places"))
    found = own.join(matches, "__row", "left")
    return first.select(*keep, "__row", "n_words").join(found, "__row", "left").select(
        *keep, "n_words", F.coalesce("places", F.array().cast("array<struct<start:bigint,label:string>>")).alias("places"),
        F.coalesce("matches", F.array().cast("array<struct<label:string,containment:double,template:int>>")).alias("matches"),
    )


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score: 1 with a base phrase, else the largest containment."""
    df = scan(docs.select("doc_id", "text"))
    starts = F.transform("places", lambda x: x["start"])
    base = F.array_distinct(F.transform("places", lambda x: x["label"]))
    every = F.array_distinct(F.concat(base, F.transform("matches", lambda x: x["label"])))
    best = F.coalesce(F.array_max(F.transform("matches", lambda x: x["containment"])), F.lit(0.0))
    return df.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(every), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
    )


def _oracle() -> str:
    rows = ", ".join(f"({i}, '{label}', [{', '.join(repr(w) for w in template_words(t))}])" for i, (label, t) in enumerate(TEMPLATES))
    split = lambda t: f"list_filter(string_split_regex({t}, '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    phrase = " ".join(f"WHEN {' AND '.join(f'''ws[i + {k}] = '{w}' ''' for k, w in enumerate(p))} THEN '{v}'" for p, v in PHRASES.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT r, doc_id, t, {split('t')} AS ws FROM d),
tpl(id, label, words) AS (VALUES {rows}),
b AS (SELECT r, CASE {phrase} END AS label, i - 1 AS start FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE list_contains(ws, 'license'))),
bb AS (SELECT r, count(*) AS n, min(start) AS f, max(start) AS l, list_sort(list(DISTINCT label)) AS ls FROM b WHERE label IS NOT NULL GROUP BY r),
bl AS (SELECT r, ws[i + 1:i + {WINDOW}] AS lw FROM (SELECT r, ws, unnest(range(0, greatest(len(ws) - {WINDOW // 2 + 1}, 0) + 1, {WINDOW // 2})) AS i FROM w WHERE len(ws) > 0)),
m AS (SELECT r, label, round(len(list_intersect(list_distinct(lw), words)) / len(words), 6) AS c FROM bl, tpl WHERE len(list_intersect(list_distinct(lw), words)) >= ceil({CONTAINMENT} * len(words) - 1e-9)),
mm AS (SELECT r, list(DISTINCT label) AS ls, max(c) AS c FROM m GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word, coalesce(array_to_string(bb.ls, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bb.ls, []), coalesce(mm.ls, [])))), ','), '') AS labels,
  CASE WHEN n > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN bb USING (r) LEFT JOIN mm USING (r)"""


ORACLE_SQL = _oracle()
