"""Licence scan against plain Python, and its plan against Python nodes."""

import re

import pytest

from scrubspark.llm import license_scan as ls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(rows):
    """Results of all rows by plain loops."""
    words = [WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for _, t in rows]
    out = []
    for (doc_id, _), w in zip(rows, words):
        places, base = [], set()
        for phrase, label in ls.BASE:
            p = phrase.split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += at
            base |= {label} if at else set()
        best, own = None, set()
        for t, (label, words_t, phrase) in enumerate(ls.TEMPLATES):
            post = [(x, i) for x, k, i in ls.postings() if k == t]
            offsets = {i - j for x, j in post for i in range(len(w)) if w[i] == x}
            shares = [sum(0 <= o + j < len(w) and w[o + j] == x for x, j in post) / len(post) for o in offsets]
            if shares and max(shares) >= ls.LEAST_SHARE and f" {phrase} " in f" {' '.join(w)} ":
                best, own = max(best or 0, max(shares)), own | {label}
        score = best if best is not None else 0.5 if base else 0.0
        out.append((doc_id, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), score))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
TEXTS = [
    None, "", " .,- ", "MIT License", "the mit license, MIT LICENSE mit license", "mit  licenses", "summit license", "Mit_License/2",
    "Released under the MIT License.\nword", "x Licensed under the Apache License, Version 2.0. y", "Licensed under CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 3.", "general public license general public license",
    "li̇cense mit lİcense apache Kicense mit license", "Kelvin MİT license", "émit license mit licenseé mit license",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: MIT license",
    "licensed cc under by nc", "license " * 3000 + "mit license", "version 2 0 apache license apache license version 2",
]


def test_against_plain_python(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4]), (None, TEXTS[8]), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, hits int").repartition(3)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in ls.scan(docs).collect()), key=str)
    assert got == plain(rows)


def test_several_licences_in_one_file(spark):
    text = {label: t for label, t, _ in ls.TEMPLATES}
    mit_body = [t for label, t, _ in ls.TEMPLATES if label == "mit"][1] + " the software to deal without restriction to use copy modify merge publish distribute sublicense and or sell copies subject to the following conditions"
    both = text["bsd"] + ".\n" + text["cc-by-sa"]
    every = " x ".join(t for _, t, _ in ls.TEMPLATES)
    noise = [text[label] for label in ("bsd", "cc-by-sa", "mpl")] * 5
    rows = [(1, both), (2, both[::-1]), (3, mit_body), (4, every), (5, text["mpl"] + " " + text["bsd"]), *((10 + i, t) for i, t in enumerate(noise))]
    got = {r.doc_id: r for r in ls.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].labels, got[3].labels, got[5].labels) == ("bsd,cc-by-sa", "mit", "bsd,mpl")
    assert set(got[4].labels.split(",")) == set(text)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.values()), key=str) == plain(rows)


def test_lookups_lose_no_position():
    for n, k in zip(ls._sizes(), ls.lookups()):
        need = n - k + 1
        assert need / n >= ls.LEAST_SHARE > (need - 1) / n


def test_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, TEXTS[8], 1, 2, "x", "y")], "doc_id long, text string, phrases int, base int, line string, ranked string")
    assert [r.labels for r in ls.scan(docs).collect()] == ["mit"]


def test_query_is_native_and_whole(spark):
    sf = "/root/testdata/sf0.001"
    df = ls.op3_license_scan(spark, sf)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str) == plain(rows)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)


@pytest.mark.parametrize("columns", ["doc_id long, text string"])
def test_empty_table(spark, columns):
    assert ls.scan(spark.createDataFrame([], columns)).collect() == []
