"""Quality: base rules against plain counting, the forest on planted outliers, calibration."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scrubspark.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


@given(st.text(alphabet="ab #$é\n\t\x0b\x1c ", max_size=60))
@settings(max_examples=400, deadline=None)
def test_base_statistics(text):
    assert q.statistics(text)[:5] == plain(text)


def test_many_words_use_pairs(monkeypatch):
    ids = np.random.default_rng(0).integers(0, 40, 3000)
    want = q.repeated_words(ids)
    _, pair = np.unique(ids[:-1] * len(ids) + ids[1:], return_inverse=True)
    code = Counter((pair[:-1] * len(ids) + ids[2:]).tolist())
    covered = {i + k for i, c in enumerate((pair[:-1] * len(ids) + ids[2:]).tolist()) if code[c] > 1 for k in range(3)}
    assert want == len(covered)


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = q.op9_quality(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        n, chars, symbols, dup, repeat = plain(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and not (r.kept and r.base_failed)
    good = [r.kept or r.base_failed for r in got if labels.get(r.doc_id) == 1]
    assert sum(good) >= 0.98 * len(good)


def test_forest_sets_outliers_apart():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (3000, 4))
    x[:30] += rng.choice([-9, 9], (30, 4))
    score = q.Forest.fit(x).score(x)
    assert score[:30].min() > np.quantile(score[30:], 0.99)
    assert ((score > 0) & (score < 1)).all()
    same = q.Forest.fit(np.ones((5, 3))).score(np.ones((2, 3)))
    assert np.isfinite(same).all()


def test_calibration():
    score = np.asarray([0.9, 0.8, 0.8, 0.7, 0.4, 0.3])
    good = np.asarray([False, False, False, True, True, True])
    t = q.calibrate(score, good)
    assert t == 0.8 and q.calibrate(score, np.ones(6, bool)) == 2.0 and q.calibrate(score, ~good) == 2.0
    assert q.calibrate(score, np.asarray([False, True, False, True, True, True]), 0.0) == 0.9


def test_edges_of_input(spark):
    rows = [(1, None, 1.0), (2, "", 1.0), (None, "word " * 60, 1.0), (3, " ".join(f"w{i}" for i in range(80)), 1.0), (3, " ".join(f"w{i}" for i in range(80)), 1.0), (4, "x" * 300000, 1.0), (5, "a b c " * 50000, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept double")
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 1), (3, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in q.judge(docs, *q.fit(docs, labels)).collect()}
    assert got[1].n_words == 0 and got[1].base_failed and got[None].n_repeat_words == 60 and got[None].base_failed
    assert got[3].kept and got[4].word_chars == 300000 and got[5].base_failed
    assert q.judge(docs, *q.fit(docs, labels)).count() == len(rows)
    assert q.judge(docs.limit(0), *q.fit(docs.limit(0), labels)).collect() == []
    assert q.fit(docs, labels.limit(0))[1] == pytest.approx(2.0)


def test_samples_hold_for_null_and_repeated_ids(spark, monkeypatch):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"w{i} " * (i % 9 + 1)) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(7, 1), (8, 0), (11, 1)], "doc_id long, quality int")
    sizes, stats_of = [], q._stats_of
    monkeypatch.setattr(q, "_stats_of", lambda df, extra: (sizes.append(df.select("doc_id").toPandas().doc_id.tolist()), stats_of(df, extra))[1])
    q.fit(docs, labels, forest_rows=300, labelled_rows=200)
    forest, labelled = sizes
    assert 200 < len(forest) < 400 and 100 < len(labelled) < 300
    assert all(60 < n < 140 for n in (sum(d != d or d is None for d in forest), sum(d == 7 for d in forest)))


def test_verdicts_do_not_depend_on_the_partitioning(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.filter("doc_id % 3 = 0"))  # repeated rows
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    results = []
    for parts in (1, 3, 16):
        some = docs.repartition(parts)
        forest, threshold = q.fit(some, labels, forest_rows=90, labelled_rows=60)
        results.append((threshold, sorted((r.doc_id, r.kept, r.anomaly) for r in q.judge(some, forest, threshold).collect())))
    assert results[0] == results[1] == results[2] and len(results[0][1]) == docs.count()


def test_fit_takes_all_rows(spark, monkeypatch):
    # more rows than any bound of a sample; a class that only a few labelled rows show
    n = 25_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat(repeat(concat('w', id % 97, ' x', id, ' '), 30), if(id % 5000 = 7, repeat('# ', 900), '')) AS text").repartition(7)
    stats = lambda t: [60 + 900 * ("#" in t), len(t), 900 * ("#" in t), 0, 0, 1, 60, 0, len(t) % 7, 0]
    monkeypatch.setattr(q, "statistics", stats)
    labels = spark.range(n).selectExpr("id AS doc_id", "CAST(id % 5000 <> 7 AS INT) AS quality")
    seen, grow = [], q.Forest.recount
    monkeypatch.setattr(q.Forest, "recount", lambda self, sizes, total: (seen.append((sizes, total)), grow(self, sizes, total))[1])
    counted = []
    best = q.best_threshold
    monkeypatch.setattr(q, "best_threshold", lambda scored: (counted.append(sorted((r.score, r.good) for r in scored.collect())), best(scored))[1])
    forest, threshold = q.fit(docs, labels)
    [(sizes, total)], [rows] = seen, counted
    assert total == n and (sizes.sum(1) == n).all()  # every row is in a leaf of every tree
    assert len(rows) == n and sum(not good for _, good in rows) == 5  # and every labelled one is judged
    assert threshold == q.calibrate(*(np.asarray(c) for c in zip(*rows)))


def test_threshold_over_ranges_is_that_of_one_list(spark):
    rng = np.random.default_rng(5)
    for loss in (0.0, 0.01, 0.2):
        score, good = rng.integers(0, 400, 3000) / 400, rng.random(3000) < 0.8
        score[~good] += rng.random((~good).sum()) // 0.5 * 0.25
        rows = spark.createDataFrame([*zip(score.tolist(), good.tolist())], "score double, good boolean")
        assert q.best_threshold(rows, loss) == q.calibrate(score, good, loss)
    for some in (rows.filter("good"), rows.filter("not good"), rows.limit(0)):
        assert q.best_threshold(some) == 2.0


def test_whole_fit_does_not_depend_on_partitions_or_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    results = []
    for some in (docs.repartition(1), docs.repartition(9), docs.unionAll(docs)):
        forest, threshold = q.fit(some, labels)
        results.append((threshold, sorted((r.doc_id, r.kept, r.anomaly) for r in q.judge(docs, forest, threshold).collect())))
    assert results[0] == results[1] == results[2]
