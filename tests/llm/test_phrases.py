"""Phrase mining: index intervals and collocations against plain counting."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scrubspark.llm import phrases


def plain_counts(rows, max_words=3):
    """Counter per language of the phrases, and the number of words."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        own = counts.setdefault("und" if lang is None else lang, Counter())
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals["und" if lang is None else lang] += len(words)
            for k in range(1, max_words + 1):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return counts, totals


def plain_collocations(rows, max_words=3, min_count=10, inside=50, top=2000):
    counts, totals = plain_counts(rows, max_words)
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < min_count:
                continue
            within = (q for q, b in f.items() if len(q) > len(p) and b >= min_count and 100 * b >= inside * a)
            if any(p == q[i : i + len(p)] for q in within for i in range(len(q) - len(p) + 1)):
                continue
            cuts = [(1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def rows_of(frame):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect())


def corpus(seed, n=120):
    rng = np.random.default_rng(seed)
    words = ["Mit", "de", "é", "x-1", "la", "Ünder", "big", "data", "\xa0", "\x00"]
    ends = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "; "]
    draw = lambda k: "".join(words[min(len(words) - 1, int(rng.exponential(2)))] + ends[rng.integers(len(ends))] for _ in range(k))
    return [([None, "en", "fr", "und"][rng.integers(4)], draw(int(rng.integers(0, 60)))) for _ in range(n)]


@given(st.lists(st.integers(0, 4), max_size=60), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_intervals_count_phrases(symbols, depth):
    t = np.asarray([0, *symbols, 0], np.int32)
    index = phrases.BiIndex(t, depth)
    level = index.empty()
    for n in range(1, depth + 1):
        both = [index.extend(level, side) for side in (True, False)]
        grams = [tuple(t[i : i + n]) for i in range(len(t) - n + 1)]
        want = Counter(g for g in grams if 0 not in g)
        for out in both:
            assert {tuple(w): c for w, c in zip(out.words.tolist(), out.count.tolist())} == want
        level = both[n % 2]


@pytest.mark.parametrize("max_words, bits", [(3, 1 << 27), (3, 1 << 12), (2, 1 << 27), (4, 1 << 27)])
def test_against_plain_counting(spark, monkeypatch, max_words, bits):
    monkeypatch.setattr(phrases, "FILTER_BITS", bits)
    rows = corpus(max_words)
    docs = spark.createDataFrame([(a, b, "key") for a, b in rows], "lang string, text string, key string").repartition(5)
    want = plain_collocations(rows, max_words)
    assert want and rows_of(phrases.collocations(docs, max_words=max_words)) == want


def test_full_filter_loses_nothing(spark, monkeypatch):
    rows = corpus(9)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    monkeypatch.setattr(phrases, "frequent_filter", lambda *a: np.full(64, ~np.uint64(0)))
    assert rows_of(phrases.collocations(docs)) == plain_collocations(rows)


def test_shards_and_partitions_do_not_matter(spark, monkeypatch):
    rows = corpus(4)
    docs = spark.createDataFrame(rows, "lang string, text string")
    want = plain_collocations(rows)
    assert [rows_of(phrases.collocations(docs.repartition(p))) for p in (1, 16)] == [want, want]
    monkeypatch.setattr(phrases, "HOT_SHARE", 3)  # every part by shuffle or by broadcast
    assert rows_of(phrases.collocations(docs)) == want
    assert rows_of(phrases.collocations(docs, top=3)) == [r for r in want if r[1] <= 3]


def test_small_shards():
    texts = {"en": ["a b c", "b c d", "a b"], "fr": ["a b"]}
    shard = phrases.Shard.build(texts)
    level, _ = list(phrases._levels(shard, 2, None))[1]
    names = shard.names.to_pylist()
    got = {(shard.langs[shard.lang[w[0]]], names[w[0]], names[w[1]]): c for w, c in zip(level.words.tolist(), level.count.tolist())}
    assert got == {("en", b"a", b"b"): 2, ("en", b"b", b"c"): 2, ("en", b"c", b"d"): 1, ("fr", b"a", b"b"): 1}


def test_large_counts_stay_exact(spark):
    # 3 * 10^9 occurrences: the products pass 64 bits
    big = 3_000_000_007
    counts = [("x", "a b", 2, big - 5), ("x", "a", 1, big), ("x", "b", 1, big + 11), ("x", "", 0, 9 * big)]
    frame = spark.createDataFrame(counts, "lang string, phrase string, n_words int, f long")
    import unittest.mock as m

    with m.patch.object(phrases, "phrase_counts", lambda *a: frame):
        (row,) = phrases.collocations(frame).collect()
    assert row.score == 1000000 * (big - 5) ** 2 // (big * (big + 11))


def test_edges_of_input(spark):
    long_text = "one two " * 40000
    rows = [(None, None), ("en", ""), ("en", " \t\n"), ("en", "Hot dog. " * 6), ("en", "hot DOG"), ("en", "hot dog\thot dog hot dog"), ("und", long_text), (None, "one two")]
    docs = spark.createDataFrame([(a, b, 1, "z") for a, b in rows], "lang string, text string, f int, phrase string")
    assert rows_of(phrases.collocations(docs)) == plain_collocations(rows)
    empty = phrases.collocations(docs.limit(0))
    assert empty.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and empty.collect() == []
