"""License scan: phrase places, and an exact set-similarity join with templates.

A block is a run of consecutive words, wherever lines break, as long as the
template it is compared with: blocks start at every word. A block matches a
template when it holds, counted with repeats, at least ``need = ceil(threshold *
|template|)`` of the template's words and, side by side, the template's core:
the words that tell one license from another. The join finds every such block:

* Document frequencies of the template words, over all documents, order the
  words, rarest first. A matching block must hold one of the first
  ``|template| - need + 1`` words of the template: only those are join keys
  (prefix filter).
* A document that lacks too many of the template's distinct words, and a block
  that would run over the document's ends, are dropped (length filter).
* At the place of a key, the block's rarest template word, only the words that
  follow it in the order can still be common (positional filter).
* The rest is verified by counting, and the core by comparison.

Everything runs as DataFrame expressions; only the templates and their word
counts, which do not grow with the documents, are broadcast or collected.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import ascii_lower, materialise, table

# The base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Short public license notices, as words, with their cores.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "mit license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("proprietary", "all rights reserved", "all rights reserved"),
)
THRESHOLD = 0.9

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # ASCII that is no digit or lower-case letter


def needed(text: str, threshold: float) -> int:
    return math.ceil(threshold * len(text.split()) - 1e-9)


def _strings(words):
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def _held(text: Column, phrase: str | Column) -> Column:
    return text.contains(F.concat(F.lit(" "), F.lit(phrase) if isinstance(phrase, str) else phrase, F.lit(" ")))


def read_rows(docs: DataFrame, templates, threshold: float) -> DataFrame:
    """One pass over the texts: phrase places, word counts, the template words of each row, and
    the words of the rows that hold enough template words for some template."""
    vocabulary = sorted({w for _, t, _ in templates for w in t.split()})
    low = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select("doc_id", F.concat(F.lit(" "), F.trim(F.regexp_replace(low, GAP, " ")), F.lit(" ")).alias("flat"))
    held = [_held(F.col("flat"), p) for p, _ in PHRASES]
    any_held = held[0]
    for h in held[1:]:
        any_held = any_held | h
    rows = rows.withColumn("words", F.when(F.trim("flat") == "", _strings([])).otherwise(F.split(F.trim("flat"), " ")))
    rows = rows.withColumn("vocabulary", F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary))))

    def places(phrase):
        parts = phrase.split()
        at = lambda i: (F.slice("words", i + 1, len(parts)) == _strings(parts))
        return F.filter(F.transform(F.col("words"), lambda w, i: F.when((w == parts[0]) & at(i), i)), lambda i: i.isNotNull())

    for k, (phrase, _) in enumerate(PHRASES):
        rows = rows.withColumn(f"p{k}", F.when(held[k], places(phrase)).otherwise(F.array().cast("array<int>")))
    every = F.concat(*[F.col(f"p{k}") for k in range(len(PHRASES))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]))
    enough = F.lit(False)
    for _, t, _ in templates:
        distinct = sorted(set(t.split()))
        lacking = len(t.split()) - needed(t, threshold)
        enough = enough | (F.size(F.array_intersect("vocabulary", _strings(distinct))) >= len(distinct) - lacking)
    return rows.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        labels.alias("base_labels"), "vocabulary",
        F.when(enough, F.col("words")).alias("words"),
    )


def matching_blocks(rows: DataFrame, templates, threshold: float) -> DataFrame:
    """(rid, label, containment) of every block and template that match; ``rows`` as ``read_rows`` gives them."""
    session = rows.sparkSession
    counts = {r.w: r["count"] for r in rows.select(F.explode("vocabulary").alias("w")).groupBy("w").count().collect()}  # one row a template word
    keys = []
    for label, text, core in templates:
        own = Counter(text.split())
        order = [w for w in sorted(own, key=lambda w: (counts.get(w, 0), w)) for _ in range(own[w])]  # rarest first, with repeats
        need = needed(text, threshold)
        entry = (label, core, [(w, n) for w, n in sorted(own.items())], len(order), need)
        leading = list(dict.fromkeys(order[: len(order) - need + 1]))
        keys += [(w, order.index(w), leading[:k], *entry) for k, w in enumerate(leading)]
    prefix = session.createDataFrame(keys, "w string, i int, earlier array<string>, label string, core string, template array<struct<w: string, n: int>>, length int, need int")
    long_enough = rows.where("words is not null")
    placed = long_enough.select("rid", "words", F.posexplode("words").alias("at", "w")).where(F.col("w").isin(sorted({k[0] for k in keys})))
    met = placed.join(F.broadcast(prefix), "w")  # at most all words of all templates
    last = F.size("words") - F.col("length")
    starts = F.sequence(F.greatest(F.col("at") - F.col("length") + 1, F.lit(0)), F.least(F.col("at"), last))
    blocks = met.where((F.col("length") - F.col("i") >= F.col("need")) & (F.greatest(F.col("at") - F.col("length") + 1, F.lit(0)) <= last))
    blocks = blocks.select("*", F.explode(starts).alias("start")).withColumn("block", F.slice("words", F.col("start") + 1, F.col("length"))).drop("words")
    first = (F.array_position("block", F.col("w")) == F.col("at") - F.col("start") + 1) & ~F.arrays_overlap("block", "earlier")
    blocks = blocks.where(first)  # each block once, at its rarest word
    held = F.aggregate("template", F.lit(0), lambda n, t: n + F.least(t["n"], F.size(F.filter("block", lambda w: w == t["w"]))))
    fine = blocks.where(_held(F.concat(F.lit(" "), F.array_join("block", " "), F.lit(" ")), F.col("core"))).withColumn("common", held).where("common >= need")
    return fine.select("rid", "label", (F.col("common") / F.col("length")).alias("containment"))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, word and place counts, labels and score.

    ``score`` is 1 where a base phrase stands, else the largest containment of
    a matching block, else 0. Null text counts as empty: no words, no labels
    (empty strings), null places. Repeated rows repeat; whole texts of any
    length are read; an empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    rows = materialise(read_rows(docs.select("doc_id", "text"), templates, threshold), "licenses")
    found = matching_blocks(rows, templates, threshold).groupBy("rid").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    out = rows.drop("vocabulary", "words").join(found, "rid", "left")
    none = F.array().cast("array<string>")
    every = F.array_sort(F.array_distinct(F.concat("base_labels", F.coalesce("more", none))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base_labels"), ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op9_licenses(spark, sf_dir):
    """Per row of ``documents``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; see ``scan_licenses``."""
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def oracle(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The scan from its definition: every block of every text that holds a core, counted word by word."""
    places = []
    for phrase, label in PHRASES:
        parts = phrase.split()
        same = " AND ".join(f"w[i + {k + 1}] = '{p}'" for k, p in enumerate(parts))
        places.append(f"list_transform(list_filter(range(len(w)), lambda i: {same}), lambda i: {{'i': i, 'label': '{label}'}})")
    every = places[0]
    for p in places[1:]:
        every = f"list_concat({every}, {p})"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    blocks = []
    for label, text, core in templates:
        size, need = len(text.split()), needed(text, threshold)
        common = " + ".join(f"least({n}, len(list_filter(b, lambda x: x = '{w}')))" for w, n in sorted(Counter(text.split()).items()))
        blocks.append(f"""SELECT doc_id, '{label}' AS label, ({common}) / {size} AS part FROM (
          SELECT doc_id, w[i + 1 : i + {size}] AS b FROM (SELECT doc_id, w, unnest(range(len(w) - {size - 1})) AS i FROM w WHERE len(w) >= {size} AND contains(flat, ' {core} ')))
          WHERE ({common}) >= {need} AND contains(' ' || array_to_string(b, ' ') || ' ', ' {core} ')""")
    return f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
v AS (SELECT doc_id, regexp_extract_all(low, '{word}') AS w FROM d),
w AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS flat FROM v),
p AS (SELECT doc_id, len(w) AS n, {every} AS p FROM w),
b AS ({" UNION ALL ".join(blocks)}),
m AS (SELECT doc_id, list(DISTINCT label) AS more, max(part) AS best FROM b GROUP BY doc_id)
SELECT p.doc_id, n AS n_words, len(p) AS n_base, list_min(list_transform(p, lambda x: x.i)) AS first_word, list_max(list_transform(p, lambda x: x.i)) AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(p, lambda x: x.label), coalesce(more, [])))), ',') AS labels,
  CASE WHEN len(p) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM p LEFT JOIN m ON p.doc_id = m.doc_id
"""


ORACLE = oracle()
