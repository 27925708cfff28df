"""Language identification: held-out accuracy, the EM against a plain one, edges of input."""

import zlib

import numpy as np
import pytest

from scrubspark.llm import language_id as li


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    want = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = li.op1_language_id(spark, sf).collect()
    assert len(got) == len(want)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and want[r.doc_id].lang]
    assert sum(r.lang_pred == want[r.doc_id].lang for r in held) > 0.95 * len(held)


def plain_em(likelihood, kept):
    share = np.asarray(kept, float)
    share /= share.sum()
    rel = np.exp(likelihood - likelihood.max(1, keepdims=True))
    for _ in range(400):
        r = rel * share
        r /= r.sum(1, keepdims=True)
        share = r.mean(0)
    return share, np.log((rel * share).sum(1)).sum() + likelihood.max(1).sum()


def test_mixture_and_set_choice():
    rng = np.random.default_rng(0)
    first, rows = [], []
    for langs in ([0], [0, 2], [1, 2], [3]):
        first.append(len(rows))
        for i in range(120):
            row = rng.normal(-20, 1, 4)
            row[langs[i % len(langs)]] += 6
            rows.append(row)
    likelihood = np.asarray(rows, np.float32)
    best, share, chosen = li.mixtures(likelihood, np.ones(len(rows), np.float32), np.asarray(first))
    assert [set(np.flatnonzero(c)) for c in chosen] == [{0}, {0, 2}, {1, 2}, {3}]
    assert best[0] == 0 and best[3] == 3 and share[0] > 0.95 and 0.45 < share[1] < 0.55
    one = likelihood[120:240]
    want, _ = plain_em(one.astype(float), [1, 0, 1, 0])
    assert share[1] == pytest.approx(want.max(), abs=0.01)
    # a word counted twice is two words
    twice = li.mixtures(likelihood, np.full(len(rows), 2, np.float32), np.asarray(first))
    assert (twice[0] == best).all()


def test_a_document_in_six_languages():
    rng = np.random.default_rng(1)
    rows = [[-20 + 6 * (k == i % 6) + rng.normal(0, 0.5) for k in range(8)] for i in range(600)]
    best, share, chosen = li.mixtures(np.asarray(rows, np.float32), np.ones(600, np.float32), np.asarray([0, 600 - 60]))
    assert set(np.flatnonzero(chosen[0])) == set(range(6)) and share[0] == pytest.approx(1 / 6, abs=0.02)


def test_letters_and_ties(spark):
    assert [li.has_letter(t) for t in ("½ ²", "Ⅳ ③", "12 _", "", "½ a", "é", "中")] == [False] * 4 + [True] * 3
    same = np.full((3, 4), -5.0, np.float32)  # all languages alike: the first one
    assert li.mixtures(same, np.ones(3, np.float32), np.asarray([0]))[0].tolist() == [0]
    docs = spark.createDataFrame([(1, "½ ²", "en"), *((i, "the house", "en") for i in range(2, 9))], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in li.predict(docs, *li.learn(docs)).collect()} == {1: "und"} | {i: "en" for i in range(2, 9)}


def test_long_texts_are_scored_alike(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names, table = li.learn(docs)
    key = lambda df: {r.doc_id: (r.lang_pred, round(r.score, 3), r.languages) for r in df.collect()}
    whole = key(li.predict(docs, names, table))
    monkeypatch.setattr(li, "LONG", 10)
    monkeypatch.setattr(li, "CHUNK", 8)
    assert key(li.predict(docs, names, table)) == whole


def test_edges_of_input(spark, monkeypatch):
    en = "the house and the garden with the people that were there"
    de = "das haus und der garten mit den leuten die dort waren und nicht"
    rows = [(i, en if i % 2 else de, "en" if i % 2 else "de") for i in range(40)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "12 34 -- ++", "en"), (103, en, None), (None, de, "de"), (104, (en + " ") * 4000, "en"), (104, en, "en")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    names, table = li.learn(docs)
    assert names == ["de", "en"] and np.allclose(np.exp(table.astype(float)).sum(1), 1, atol=1e-3)
    for chunk in (1 << 21, 50):
        monkeypatch.setattr(li, "CHUNK", chunk)
        got = li.predict(docs, names, table).collect()
        assert len(got) == len(rows)
        by = {r.doc_id: r for r in got}
        assert [by[k].lang_pred for k in (100, 101, 102, 103, None, 104)] == ["und", "und", "und", "en", "de", "en"]
        assert by[100].score == 0 and by[104].score > 0.5
        assert all(by[i].lang_pred == ("en" if i % 2 else "de") for i in range(40))
    empty = docs.filter("lang = 'xx'")
    assert li.predict(docs, *li.learn(empty)).filter("lang_pred <> 'und'").count() == 0
    assert li.predict(empty, names, table).collect() == []


def test_counts_are_the_same_from_any_tasks(spark, monkeypatch):
    rows = [(i, f"mot {i % 41} wort{i} parola {'é' * (i % 5)}", f"l{i % 41:02d}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, whole = li.learn(docs.coalesce(1))
    monkeypatch.setattr(li, "TASKS_PER_SALT", 2)
    again, parts = li.learn(docs.repartition(9))
    assert len(names) == 41 and names == again and (whole == parts).all()
