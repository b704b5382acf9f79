"""License scanning: phrase places, and an exact set-similarity join with templates.

A text block (line or sentence) meets a template when it holds at least THRESHOLD of
the template's distinct words. So does a run of words as long as the template (see
``spans``), whatever line wraps and abbreviations it crosses. The join is exact. Words are ordered by their frequency
over the whole corpus, rarest first; a block can only qualify if it shares one of the
template's first ``size - need + 1`` words (prefix filter), has at least ``need`` known
words (length filter), and has enough words left on both sides of the shared word
(positional filter). Survivors are verified on the whole sets. The templates are a
parameter, so the index has a fixed size and is sent to every executor.

One pass over the texts keeps the words of all phrases and templates that each holds, counts
them, and keeps the few texts that can qualify at all; the join reads those.

Defined results: a null text counts as empty (no words, no labels, score 0); very long
texts are read whole; rows without doc_id are kept like others; repeated rows give repeated
results, so ties cannot arise; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Phrase words and their label.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Public license sentences and the label a block near them gets.
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
)
#: 0.9 tells CC BY-SA from CC BY-NC, which share six of seven words.
THRESHOLD = 0.9
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
BLOCKS = r"\n+|[.!?;]\s+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(common.lower_ascii(text), F.lit(WORD), F.lit(0))


def any_word(words) -> str:
    """Pattern: one of the words, whole, in any ASCII case."""
    return rf"(?i)(?<!{WORD[:-1]})(?:{'|'.join(sorted(words))})(?!{WORD[:-1]})"


def places(words: Column, phrases=PHRASES) -> Column:
    """(label, start) of every place where a phrase's words stand one after another."""

    def of(phrase: str, label: str) -> Column:
        parts = phrase.split()

        def here(i):
            fits = F.get(words, i) == parts[0]
            for k, part in enumerate(parts[1:], 1):
                fits = fits & (F.get(words, i + k) == part)
            return fits

        starts = F.filter(F.sequence(F.lit(0), F.size(words)), here)
        return F.transform(starts, lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("start")))

    return F.concat(*[of(*p) for p in phrases])


def vocabulary_of(templates, phrases=()) -> list[str]:
    return sorted({w for t, *_ in (*templates, *phrases) for w in t.split()})


def needed(words: set[str], threshold: float) -> int:
    return math.ceil(threshold * len(words) - 1e-9)


def marked(texts: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_hash, n_words, held, phrased, chosen: all that one pass over the texts says.

    held: known words of the whole text. Neither a block nor a run can have words that its
    text lacks, so ``chosen`` is the text where some template's need is met, and ``phrased``
    its words where all of some phrase's words are there; else both are null. Lower case is
    Unicode's here, which can only add known words; what follows decides by ASCII.
    """
    literal = lambda words: F.array(*[F.lit(w) for w in sorted(words)])
    some_of = lambda parts: F.greatest(*parts, F.lit(False))
    whole = lambda words, n: F.size(F.array_intersect("held", literal(words))) >= n
    able = some_of([whole(set(t.split()), needed(set(t.split()), threshold)) for t, _ in templates])
    says = some_of([whole(set(p.split()), len(set(p.split()))) for p, _ in PHRASES])
    blank = lambda at: (F.element_at("parts", at) == "").cast("long")
    split = texts.select("doc_id", "text", F.split(F.lower("text"), GAP + "+").alias("parts"))
    known = split.select(
        "doc_id", "text", (F.size("parts") - blank(1) - F.when(F.size("parts") > 1, blank(-1)).otherwise(0)).cast("long").alias("n_words"),
        F.array_intersect("parts", literal(vocabulary_of(templates, PHRASES))).alias("held"),
    )
    return known.select("doc_id", F.xxhash64("text").alias("text_hash"), "n_words", "held", F.when(says, words_of(F.col("text"))).alias("phrased"), F.when(able, F.col("text")).alias("chosen"))


def frequencies(docs: DataFrame) -> dict[str, int]:
    """Documents that hold each known word, over the whole corpus. The result has the vocabulary's size."""
    counted = docs.select(F.explode("held").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return {r["word"]: r["n"] for r in counted.collect()}


def template_index(spark: SparkSession, seen: dict[str, int], templates, threshold: float):
    """Rows (word, template, place, size, need, words, label), the rank of each word, and all prefix words."""
    rank = {w: i for i, w in enumerate(sorted({w for t, _ in templates for w in t.split()}, key=lambda w: (seen.get(w, 0), w)))}
    rows, prefixes = [], set()
    for k, (text, label) in enumerate(templates):
        words = sorted(set(text.split()), key=rank.__getitem__)
        need = needed(set(words), threshold)
        for place, word in enumerate(words[: len(words) - need + 1], 1):
            prefixes.add(word)
            rows.append((word, k, place, len(words), need, words, label))
    kind = "word string, template int, place int, size int, need int, words array<string>, label string"
    return spark.createDataFrame(rows, kind), rank, prefixes


def spans(docs: DataFrame, index: DataFrame, vocabulary: list[str], lengths: dict[int, int]) -> DataFrame:
    """doc_id, text_hash, template, label, size, shared: runs of words that meet a template across block cuts.

    A run has the template's length and the words it may lack. It can only qualify if it
    holds a prefix word, so the runs around prefix words are all there are.
    """
    length = F.create_map(*[F.lit(x) for k, n in lengths.items() for x in (k, n)])[F.col("template")]
    held = docs.select("doc_id", "text_hash", words_of(F.col("chosen")).alias("all")).withColumn("held", F.array_intersect("all", F.array(*[F.lit(w) for w in vocabulary])))
    met = (
        held.select("doc_id", "text_hash", "all", "held", F.explode("held").alias("word"))
        .join(F.broadcast(index), "word")
        .filter(F.size(F.array_intersect("held", "words")) >= F.col("need"))
        .withColumn("run", length + F.col("size") - F.col("need"))
        .withColumn("at", F.filter(F.sequence(F.lit(0), F.size("all") - 1), lambda i: F.get("all", i) == F.col("word")))
    )
    starts = F.array_distinct(F.flatten(F.transform("at", lambda i: F.sequence(F.greatest(F.lit(0), i - F.col("run") + 1), i))))
    shared = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(F.slice("all", i + 1, F.col("run")), F.col("words")))))
    return met.select("doc_id", "text_hash", "template", "label", "size", "need", shared.alias("shared")).filter("shared >= need").drop("need")


def near_templates(texts: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_hash, block_no (null: a run of words), template, label, containment: all pairs at or above the threshold."""
    return joined(marked(texts, templates, threshold), templates, threshold)


def joined(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``near_templates`` of what ``marked`` found with the same templates and threshold."""
    vocabulary = vocabulary_of(templates)
    index, rank, prefixes = template_index(docs.sparkSession, frequencies(docs), templates, threshold)
    ranks = F.create_map(*[F.lit(x) for w, r in rank.items() for x in (w, r)])
    docs = docs.filter("chosen is not null").select("doc_id", "text_hash", "chosen")
    blocks = (
        docs.select("doc_id", "text_hash", F.posexplode(F.split("chosen", BLOCKS)).alias("block_no", "block"))
        .filter(F.col("block").rlike(any_word(prefixes)))
        .select("doc_id", "text_hash", "block_no", F.array_intersect(words_of(F.col("block")), F.array(*[F.lit(w) for w in vocabulary])).alias("held"))
        .withColumn("held", F.transform(F.array_sort(F.transform("held", lambda w: F.struct(ranks[w].alias("r"), w.alias("w")))), lambda x: x["w"]))
    )
    pairs = (
        blocks.select("*", F.posexplode("held").alias("at", "word"))
        .join(F.broadcast(index), "word")
        .filter((F.size("held") >= F.col("need")) & (1 + F.least(F.col("size") - F.col("place"), F.size("held") - 1 - F.col("at")) >= F.col("need")))
        .withColumn("shared", F.size(F.array_intersect("held", "words")))
        .filter("shared >= need")
    )
    runs = spans(docs, index, vocabulary, {k: len(t.split()) for k, (t, _) in enumerate(templates)})
    pairs = pairs.select("doc_id", "text_hash", "block_no", "template", "label", "size", "shared").unionByName(runs, allowMissingColumns=True)
    return pairs.select("doc_id", "text_hash", "block_no", "template", "label", (F.col("shared") / F.col("size")).alias("containment")).distinct()


def scan(df: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of ``df``."""
    texts = df.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    docs = common.settle(marked(texts, templates, threshold), "license-words")
    own = docs.select("doc_id", "text_hash", "n_words", places(F.coalesce("phrased", F.array().cast("array<string>"))).alias("found"))
    near = common.settle(
        joined(docs, templates, threshold).groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("near"), F.max("containment").alias("best")), "license-near"
    )
    base_labels = F.array_distinct(F.col("found.label"))
    none = F.array().cast("array<string>")
    listed = lambda a: F.array_join(F.array_sort(a), ",")
    starts = F.col("found.start")
    own = own.join(near, own["doc_id"].eqNullSafe(near["doc_id"]) & (own["text_hash"] == near["text_hash"]), "left").drop(near["doc_id"])
    return own.select(
        "doc_id", "n_words", F.size("found").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(base_labels).alias("base_labels"), listed(F.array_union(base_labels, F.coalesce("near", none))).alias("labels"),
        F.when(F.size("found") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same by plain SQL: every block against every template, without filters."""
    rows = ", ".join(f"('{t}', '{label}')" for t, label in TEMPLATES)
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
w AS (SELECT doc_id, regexp_extract_all(low, '{WORD}') AS words FROM d),
p(phrase, label, k) AS (VALUES {phrases}),
base AS (
  SELECT doc_id, label, i - 1 AS start FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w), p
  WHERE words[i] IN ('gnu', 'apache', 'cc', 'mit') AND array_to_string(words[i:i + k - 1], ' ') = phrase
),
b AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS names FROM base GROUP BY doc_id),
t AS (SELECT list_distinct(string_split(phrase, ' ')) AS words, label FROM (VALUES {rows}) AS v(phrase, label)),
blocks AS (SELECT doc_id, list_distinct(regexp_extract_all(block, '{WORD}')) AS held FROM (SELECT doc_id, unnest(regexp_split_to_array(low, '{BLOCKS}')) AS block FROM d)),
near AS (
  SELECT doc_id, max(len(list_intersect(held, t.words))::DOUBLE / len(t.words)) AS best, list(DISTINCT label) AS names FROM blocks, t
  WHERE len(held) > 3 AND len(list_intersect(held, t.words)) >= ceil({THRESHOLD} * len(t.words) - 1e-9) GROUP BY doc_id
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(b.names), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.names, []), coalesce(near.names, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN near USING (doc_id)
"""
