"""License scan by an exact set-similarity join with license templates (operator 10), in DataFrame operations only.

A block is a line of a text, a template a short license statement; both are sets of words. A block meets a template when
it holds at least ``containment`` of the template's words. No such pair is missed:

1. Template words are ordered by the number of documents that hold them, counted over the whole table, rarest first.
2. Prefix filter: of a template of ``n`` words of which ``need`` must be found, one of the first ``n - need + 1`` is in
   every block that meets it. Only documents with such a word are cut into blocks, and only these words are joined.
3. Length filter: a block has at least ``need`` words. Positional filter: if the first shared word is the template's
   ``p``-th, at most ``n - p`` words are shared.
4. What is left is compared in full.

Besides, the places of fixed phrases in the word sequence are counted. Templates are configuration: their number does not
grow with the data, so their table is broadcast.

Edge cases: null text counts as empty and has no words; repeated rows get the same result each; null ids keep their row;
rows that repeat an id with other text are told apart by a digest of the text.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetbump.llm.exact_dedup import ascii_lower

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
IN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"

# Phrases and their labels.
PHRASES = (
    (("cc", "by"), "cc-by"),
    (("general", "public", "license"), "gpl"),
    (("all", "rights", "reserved"), "reserved"),
)

# License statements in common use.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by-4.0", "Licensed under the Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("gpl-3.0", "Licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee"),
    ("lgpl-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
CONTAINMENT = 0.9


def template_words(templates=TEMPLATES) -> list[tuple[str, list[str]]]:
    return [(label, sorted(set(re.findall(WORD, text.lower())))) for label, text in templates]


def words_in(norm: Column) -> Column:
    return F.regexp_extract_all(norm, F.lit(WORD), F.lit(0))


def phrase_starts(words: Column, phrase: tuple[str, ...]) -> Column:
    def start(word: Column, i: Column) -> Column:
        match = word == phrase[0]
        for j, other in enumerate(phrase[1:], 1):
            match = match & (F.get(words, i + j) == other)
        return F.when(match, i)

    return F.filter(F.transform(words, start), lambda i: i.isNotNull())


def with_phrases(docs: DataFrame, phrases=PHRASES) -> DataFrame:
    """``docs`` (with ``norm``) with n_words, n_base, first_word, last_word and base_set."""
    pattern = "|".join(GAP.join(map(re.escape, phrase)) for phrase, _ in phrases)
    # Only texts that hold a phrase's words in sequence are cut into an array of words.
    places = F.when(
        F.col("norm").rlike(pattern),
        F.transform(
            F.array(words_in(F.col("norm"))),
            lambda words: F.struct(*[phrase_starts(words, p).alias(f"p{i}") for i, (p, _) in enumerate(phrases)]),
        )[0],
    )
    lists = [F.coalesce(F.col(f"places.p{i}"), F.array().cast("array<int>")) for i in range(len(phrases))]
    starts = F.concat(*lists)
    named = F.array(*[F.when(F.size(x) > 0, F.lit(label)) for x, (_, label) in zip(lists, phrases, strict=True)])
    return (
        docs.withColumn("places", places)
        .withColumn("n_words", F.regexp_count("norm", F.lit(WORD)).cast("long"))
        .withColumn("n_base", F.size(starts).cast("long"))
        .withColumn("first_word", F.array_min(starts).cast("long"))
        .withColumn("last_word", F.array_max(starts).cast("long"))
        .withColumn("base_set", F.array_compact(named))
        .drop("places")
    )


def word_order(norm: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Number of documents that hold each template word."""
    found = norm.select(
        F.explode(F.array_intersect(words_in(F.col("norm")), F.array(*map(F.lit, vocabulary)))).alias("word")
    )
    # At most one row for each template word.
    return {r.word: r.docs for r in found.groupBy("word").agg(F.count("*").alias("docs")).collect()}


def block_matches(docs: DataFrame, containment: float = CONTAINMENT, templates=TEMPLATES) -> DataFrame:
    """Every block that meets a template: doc_id, digest, block (line from 0), text, label, containment.

    ``docs`` has doc_id, digest and norm.
    """
    spark = docs.sparkSession
    listed = template_words(templates)
    counts = word_order(docs, sorted({w for _, words in listed for w in words}))
    prefix = []
    for label, words in listed:
        ordered = sorted(words, key=lambda w: (counts.get(w, 0), w))
        need = math.ceil(containment * len(ordered) - 1e-9)
        for p, word in enumerate(ordered[: len(ordered) - need + 1]):
            prefix.append((word, label, ordered, ordered[:p], p, need))
    table = spark.createDataFrame(
        prefix, "word string, label string, words array<string>, before array<string>, p int, need int"
    )
    rare = sorted({row[0] for row in prefix})
    pattern = f"(?<!{IN_WORD})(?:{'|'.join(map(re.escape, rare))})(?!{IN_WORD})"
    blocks = (
        docs.where(F.col("norm").rlike(pattern))
        .select("doc_id", "digest", F.posexplode(F.split("norm", "\n")).alias("block", "text"))
        .where(F.col("text").rlike(pattern))
        .withColumn("held", F.array_distinct(words_in(F.col("text"))))
    )
    shared = blocks.withColumn("word", F.explode(F.array_intersect("held", F.array(*map(F.lit, rare)))))
    pairs = shared.join(F.broadcast(table), "word")
    pairs = pairs.where(
        (F.size("held") >= F.col("need"))
        & (F.size("words") - F.col("p") >= F.col("need"))
        # The pair is taken at the first shared word, so once.
        & ~F.arrays_overlap("before", "held")
    )
    pairs = pairs.withColumn("shared", F.size(F.array_intersect("words", "held"))).where("shared >= need")
    return pairs.select(
        "doc_id", "digest", "block", "text", "label", (F.col("shared") / F.size("words")).alias("containment")
    )


def scan(docs: DataFrame, containment: float = CONTAINMENT, templates=TEMPLATES) -> DataFrame:
    """One row per row of ``docs``: doc_id, word and phrase counts, base_labels, labels and score.

    The score is the best containment of a template among the blocks that meet one, and 1 where a phrase stands.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    normal = docs.select("doc_id", F.unhex(F.md5(text)).alias("digest"), ascii_lower(text).alias("norm"))
    found = (
        block_matches(normal, containment, templates)
        .groupBy("doc_id", "digest")
        .agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    )
    base = with_phrases(normal).drop("norm")
    joined = base.alias("b").join(
        found.alias("f"),
        F.col("b.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("b.digest") == F.col("f.digest")),
        "left",
    )
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("base_set", F.coalesce("found", none)))
    return joined.select(
        F.col("b.doc_id").alias("doc_id"),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base_set"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("base_set") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def scan_sql(containment: float = CONTAINMENT, templates=TEMPLATES) -> str:
    """DuckDB SQL for ``scan``: every line against every template."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rows = ", ".join(
        f"('{label}', [{', '.join(repr(w) for w in words)}])" for label, words in template_words(templates)
    )

    def starts(phrase):
        match = " AND ".join(f"words[i + {j + 1}] = '{w}'" for j, w in enumerate(phrase))
        return f"list_filter(range(len(words)), lambda i: {match})"

    lists = ", ".join(f"{starts(p)} AS p{i}" for i, (p, _) in enumerate(PHRASES))
    every = "list_concat(" + ", ".join(f"p{i}" for i in range(2)) + ")"
    for i in range(2, len(PHRASES)):
        every = f"list_concat({every}, p{i})"
    base = "list_filter([" + ", ".join(
        f"CASE WHEN len(p{i}) > 0 THEN '{label}' END" for i, (_, label) in enumerate(PHRASES)
    ) + "], lambda x: x IS NOT NULL)"
    return f"""
WITH normal AS (
  SELECT doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') AS norm FROM documents),
worded AS (SELECT doc_id, norm, regexp_extract_all(norm, '{WORD}') AS words FROM normal),
placed AS (SELECT doc_id, norm, words, {lists} FROM worded),
template(label, words) AS (VALUES {rows}),
lines AS (SELECT doc_id, unnest(string_split(norm, chr(10))) AS line FROM normal),
held AS (SELECT doc_id, list_distinct(regexp_extract_all(line, '{WORD}')) AS held FROM lines),
met AS (
  SELECT doc_id, label, len(list_intersect(t.words, h.held)) / len(t.words)::DOUBLE AS containment
  FROM held h, template t
  WHERE len(list_intersect(t.words, h.held)) >= ceil({containment} * len(t.words) - 1e-9)),
found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(containment) AS best FROM met GROUP BY doc_id)
SELECT p.doc_id, len(words)::BIGINT AS n_words, len({every})::BIGINT AS n_base,
  list_min({every})::BIGINT AS first_word, list_max({every})::BIGINT AS last_word,
  array_to_string(list_sort({base}), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat({base}, coalesce(f.labels, [])))), ',') AS labels,
  CASE WHEN len({base}) > 0 THEN 1.0::DOUBLE ELSE coalesce(f.best, 0.0)::DOUBLE END AS score
FROM placed p LEFT JOIN found f ON p.doc_id = f.doc_id"""
