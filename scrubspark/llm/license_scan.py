"""Licence scan over a positional rare-token index, in DataFrame functions only.

Base labels: places where the words of a phrase stand one after another. The method:
each file's licence words (template words that are no function words) are ranked by
inverse document frequency over all files. For every template whose mandatory key phrase
the file has, the file's rarest words of that template are looked up in its postings
(word, template, place) and give the relative positions to look at, file place minus
template place; there postings are intersected over all of its licence words. A template
holds if at one relative position ``LEAST_SHARE`` of them agree. Of n words of which m must
agree, n - m + 1 are looked up: at most n - m of them can disagree, so no position is
lost, however many templates a file holds. Labels of templates are added to the base ones.

One pass over the texts gives narrow rows (counts, base places, places of licence words)
that are written to the shared folder; document frequencies, ranks and intersections work
on those. What reaches the driver is one number per template word.

Null texts are empty; a file without words has zero counts, null places and empty labels.
Repeated rows each come out, with the same result; null ids are ids like others. An empty
table gives an empty frame, and columns other than doc_id and text are ignored. Ties in
document frequency go by the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubspark.llm.common import checkpointed

LEAST_SHARE = 0.6  # of a template's licence words that must agree

# Base phrases, then templates as (label, words, mandatory key phrase).
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0", "apache license version 2"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
)
FUNCTION_WORDS = "a and any are by for in into is met of or that the this to under with without".split()
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def postings() -> list[tuple[str, int, int]]:
    """(word, template, place) of every licence word of the templates."""
    return [(w, t, i) for t, (_, words, _) in enumerate(TEMPLATES) for i, w in enumerate(words.split()) if w not in FUNCTION_WORDS]


def _sizes() -> list[int]:
    sizes = [0] * len(TEMPLATES)
    for _, t, _ in postings():
        sizes[t] += 1
    return sizes


def lookups() -> list[int]:
    """Words of each template that are looked up: one more than may disagree."""
    return [n - min(k for k in range(n + 1) if k / n >= LEAST_SHARE) + 1 for n in _sizes()]


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def word_line(text: Column) -> Column:
    """The words, A-Z lower-cased, with one blank before, between and after them.

    ``lower`` maps two letters outside ASCII to ASCII ones; they are set aside first."""
    shown = F.regexp_replace(F.coalesce(text, F.lit("")), SEPARATORS, " ")
    kept = F.replace(F.replace(shown, F.lit("K"), F.lit("κ")), F.lit("İ"), F.lit("ı"))
    return F.concat(F.lit(" "), F.lower(F.trim(kept)), F.lit(" "))


def _narrow(docs: DataFrame) -> DataFrame:
    """One row per file: key of its content, counts, base places, places of licence words."""
    phrases = "(?:" + "|".join(p for p, _ in BASE) + ")"
    line, words = F.col("line"), F.split("line", " ")  # the first and last word are empty
    vocabulary = sorted({w for w, _, _ in postings()})
    hits = F.filter(F.transform(words, lambda w, i: F.when(w.isin(vocabulary), F.named_struct(F.lit("w"), w, F.lit("i"), (i - 1).cast("long")))), lambda x: x.isNotNull())
    count = lambda p: F.size(F.regexp_extract_all("line", F.lit(f"(?<= ){p}(?= )"), F.lit(0))).cast("long")
    has = F.contains(line, F.lit("license"))
    each = F.when(has, F.array(*[count(p) for p, _ in BASE])).otherwise(F.array(*[F.lit(0).cast("long")] * len(BASE)))
    place = lambda head: F.when(F.col("n_base") > 0, (_spaces(F.regexp_extract("line", f"(?s)^({head} ){phrases} ", 1)) - 1).cast("long"))
    return (
        docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("key"), word_line(F.col("text")).alias("line"))
        .withColumns({"hits": hits, "each": each})
        .withColumn("n_base", F.aggregate("each", F.lit(0).cast("long"), lambda a, x: a + x))
        .select(
            "doc_id",
            "key",
            F.when(line == "  ", 0).otherwise(_spaces(line) - 1).cast("long").alias("n_words"),
            "n_base",
            place(".*?").alias("first_word"),
            place(".*").alias("last_word"),
            F.array_compact(F.array(*[F.when(F.col("each")[i] > 0, label) for i, (_, label) in enumerate(BASE)])).alias("base"),
            "hits",
            F.when(F.size("hits") > 0, F.array_compact(F.array(*[F.when(F.contains(line, F.lit(f" {p} ")), i) for i, (_, _, p) in enumerate(TEMPLATES)]))).alias("phrases"),
        )
    )


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per
    input row. ``score`` is the largest share of a template's licence words that agree, of
    templates that hold; else 0.5 for a base label and 0 without."""
    spark = docs.sparkSession
    rows = checkpointed(_narrow(docs))
    files = rows.filter("size(hits) > 0")
    seen = files.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("w"))
    # document frequencies of the template words, at most one row per word
    frequency = {r.w: r.n for r in seen.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    entries = [(w, t, i, frequency.get(w, 0)) for w, t, i in postings()]
    index = F.broadcast(spark.createDataFrame(entries, "w string, template int, place long, df long"))
    ranks = F.create_map(*[F.lit(x) for w, n in sorted(frequency.items()) for x in (w, n)]) if frequency else F.lit(None).cast("map<string,long>")
    present = F.array_distinct(F.transform("hits", lambda h: h["w"]))
    ranked = F.array_sort(F.transform(present, lambda w: F.named_struct(F.lit("n"), F.element_at(ranks, w), F.lit("w"), w)))
    own_words: list[list[str]] = [sorted({w for w, k, _ in postings() if k == t}) for t in range(len(TEMPLATES))]
    rare = F.transform("ranked", lambda x: x["w"])
    among = lambda own: lambda w: w.isin(own)
    rarest = F.array(*[F.when(F.array_contains("phrases", t), F.slice(F.filter(rare, among(own)), 1, n)) for t, (own, n) in enumerate(zip(own_words, lookups()))])
    looked = files.filter("size(phrases) > 0").withColumn("ranked", ranked).select("doc_id", "key", "phrases", rarest.alias("rarest"), F.explode("hits").alias("h"))
    sizes = F.array(*[F.lit(n) for n in _sizes()])
    agreed = (
        looked.select("doc_id", "key", "phrases", "rarest", F.col("h.w").alias("w"), F.col("h.i").alias("i"))
        .join(index, "w")
        .filter(F.array_contains(F.col("phrases"), F.col("template")))
        .withColumn("looked", F.array_contains(F.element_at("rarest", F.col("template") + 1), F.col("w")))
        .groupBy("doc_id", "key", "template", (F.col("i") - F.col("place")).alias("offset"))
        .agg(F.countDistinct("place").alias("n"), F.max("looked").alias("looked"))
        .filter("looked")
        .withColumn("share", F.col("n") / F.element_at(sizes, F.col("template") + 1))
        .filter(F.col("share") >= LEAST_SHARE)
        .groupBy("doc_id", "key")
        .agg(F.max("share").alias("share"), F.collect_set("template").alias("templates"))
    )
    labels = F.array(*[F.lit(label) for label, _, _ in TEMPLATES])
    found = agreed.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "share", F.transform("templates", lambda t: F.element_at(labels, t + 1)).alias("own"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("own", F.array().cast("array<string>")))))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.coalesce("share", F.when(F.size("base") > 0, 0.5), F.lit(0.0)).alias("score"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


OP3_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM d),
n AS (SELECT r, w, i, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
b AS (
  SELECT r, i, CASE WHEN w = 'mit' AND w2 = 'license' THEN 'mit' WHEN w = 'apache' AND w2 = 'license' THEN 'apache'
                    WHEN w = 'general' AND w2 = 'public' AND w3 = 'license' THEN 'gpl' END AS label FROM n),
base AS (
  SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list_distinct(list(label))) AS labels
  FROM b WHERE label IS NOT NULL GROUP BY r),
template(template, label, phrase, size) AS (VALUES {_values((i, label, phrase, _sizes()[i]) for i, (label, _, phrase) in enumerate(TEMPLATES))}),
posting(w, template, place) AS (VALUES {_values(postings())}),
hit AS (
  SELECT w.r, template, i - place AS at, count(DISTINCT place) AS n FROM w JOIN posting ON posting.w = w.w GROUP BY ALL),
own AS (
  SELECT hit.r, max(n / size) AS share, list_distinct(list(label)) AS labels
  FROM hit JOIN template USING (template) JOIN d ON d.r = hit.r
  WHERE n / size >= {LEAST_SHARE} AND contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || phrase || ' ') GROUP BY hit.r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(base.labels, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ',') AS labels,
       coalesce(share, CASE WHEN n_base > 0 THEN 0.5 ELSE 0 END) AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN own USING (r)
"""
