"""Decontamination against edit distance at every place of every text."""

import random

import numpy as np
import pyarrow as pa
import pytest

from scrubspark.llm import decontam as dc

SF = "/root/testdata/sf0.001"


def least_edits(item, text):
    """Fewest edits of item to any part of text (row by row)."""
    a, b = np.frombuffer(dc.fold(item.encode()), np.uint8), np.frombuffer(dc.fold((text or "").encode()), np.uint8)
    col = np.arange(len(a) + 1)
    best = len(a)
    for c in b:
        new = np.empty_like(col)
        new[0] = 0
        diag = np.minimum(col[:-1] + (a != c), col[1:] + 1)
        # deletions run down the column: a running minimum of value minus place
        new[1:] = np.minimum.accumulate(np.concatenate([[0], diag]) - np.arange(len(a) + 1))[1:] + np.arange(1, len(a) + 1)
        col = new
        best = min(best, int(col[-1]))
    return best


def edited(rng, s, edits):
    s = list(s)
    for _ in range(edits):
        at = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[at] = rng.choice("abcdefgh ")
        elif kind == 1:
            del s[at]
        else:
            s.insert(at, rng.choice("abcdefgh "))
    return "".join(s)


def test_best_match_is_exact():
    rng = random.Random(1)
    for _ in range(150):
        item = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 30)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 60)))
        want = least_edits(item, text)
        got = dc.best_match(dc.fold(item.encode()), dc.fold(text.encode()), len(item))
        assert got[0] == want
        assert least_edits(item, text[got[1] : got[2]]) == want
        assert want == 0 or dc.best_match(dc.fold(item.encode()), dc.fold(text.encode()), want - 1) is None


def test_recall_and_precision_on_edited_passages(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rng.randrange(14, 60))) for i in range(25)]
    docs, share = [], dc.MAX_EDITS
    for d in range(300):
        k, (i, t) = rng.randrange(0, 5), items[d % 25]
        n = len(t)
        middle = edited(rng, t, int(n * share * k / 4)) if d % 3 else prose(20)
        docs.append((d, prose(rng.randrange(0, 30)) + " " + middle + " " + prose(rng.randrange(0, 30))))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.item_id): r for r in dc.contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    by = dict(items)
    want = {}
    for d, text in docs:
        i = d % 25
        e = least_edits(by[i], text)
        if e <= int(share * len(by[i])):
            want[d, i] = e
    found = set(want) & set(got)
    assert len(found) >= 0.95 * len(want) and len(want) > 150
    assert all(got[p].edits == want[p] for p in found)
    for (d, i), r in got.items():
        assert least_edits(by[i], docs[d][1]) <= int(share * len(by[i]))


def at_limit(rng, item, kind):
    """``item`` with as many random edits of one kind as the limit allows."""
    s = list(item)
    for _ in range(int(dc.MAX_EDITS * len(item))):
        at = rng.randrange(len(s))
        if kind == "insert":
            s.insert(at, rng.choice("abcdefgh "))
        elif kind == "delete":
            del s[at]
        else:
            s[at] = rng.choice("abcdefgh ")
    return "".join(s)


def found_share(items, middles, rng):
    """Share of (item, middle) whose item is found, the middle set in other text; edits must be the fewest."""
    index = dc.ItemIndex.build(list(enumerate(items)), dc.MAX_EDITS)
    noise = lambda: "".join(rng.choice("etaoinshrdlu ") for _ in range(300))
    texts = [noise() + " " + m + " " + noise() for m in middles]
    got = {(r, k): e for r, k, e, _, _ in dc.find_in(index, pa.array(texts))}
    for r, k in got:
        assert got[r, k] == least_edits(items[k], texts[r]) <= int(dc.MAX_EDITS * len(items[k]))
    return sum((r, r) in got for r in range(len(items))) / len(items)


@pytest.mark.parametrize("kind", ["insert", "delete", "substitute"])
@pytest.mark.parametrize("size", [240, 390, 1200, 3000])
def test_recall_at_the_limit(kind, size):
    rng = random.Random(size)
    items = ["".join(rng.choice("etaoinshrdlu  ") for _ in range(size)) for _ in range(max(2, 6000 // size))]
    assert found_share(items, [at_limit(rng, t, kind) for t in items], rng) == 1


@pytest.mark.parametrize("size", [5, 7, 10, 14, 19, 20, 34, 60, 200, 399, 401, 1500])
def test_no_place_within_the_limit_is_lost(size):
    rng = random.Random(size)
    items = ["".join(rng.choice("etaoinshrdlu  ") for _ in range(size - 1)) + "." for _ in range(20)]
    k = int(dc.MAX_EDITS * size)
    apart = [{(i + 1) * size // (k + 1) for i in range(k)} for _ in items]  # edits as far from each other as can be
    spread = ["".join("#" if i in at else c for i, c in enumerate(t)) for t, at in zip(items, apart)]
    assert found_share(items, spread, rng) == 1
    for kind in ("insert", "delete", "substitute"):
        assert found_share(items, [at_limit(rng, t, kind) for t in items], rng) == 1


@pytest.mark.parametrize("kind", ["insert", "delete", "substitute"])
@pytest.mark.parametrize("size", [14, 20, 34, 60, 120, 240, 390, 1200, 3000])
def test_recall_of_the_sampled_search(kind, size):
    """Against the exact search, with as many edits as the limit allows."""
    rng = random.Random(size)
    items = ["".join(rng.choice("etaoinshrdlu  ") for _ in range(size - 1)) + "." for _ in range(max(6, min(60, 9000 // size)))]
    index = dc.ItemIndex.build(list(enumerate(items)), dc.MAX_EDITS).tune()
    noise = lambda: "".join(rng.choice("etaoinshrdlu ") for _ in range(300))
    texts = pa.array([noise() + " " + at_limit(rng, t, kind) + " " + noise() for t in items])
    exact, sampled = ({x[:2]: x for x in dc.find_in(index, texts, every)} for every in (True, False))
    assert len(exact) >= len(items) and all(exact[k] == v for k, v in sampled.items())
    assert len(sampled) >= 0.9 * len(exact)


def test_samplings_follow_from_the_target(monkeypatch):
    letters = np.frombuffer(b"etaoinshrdlu  ", np.uint8)
    strict, loose = (dc.tuned(60, k, letters) for k in (9, 1))
    assert strict.samples.shape[2] <= loose.samples.shape[2] and strict.samples[0].size >= loose.samples[0].size
    monkeypatch.setattr(dc, "TARGET_RECALL", 1.1)
    assert dc.tuned(60, 9, letters) is None  # then every place is verified
    index = dc.ItemIndex.build([(1, "a short item to look for")], dc.MAX_EDITS).tune()
    assert set(index.sampling.values()) == {None} and dc.find_in(index, pa.array(["x a short itm to lok for y"]), False)


def test_embedding_is_the_walk():
    rng = np.random.default_rng(2)
    bits = np.concatenate([rng.integers(0, 2, (20, 256)), np.ones((20, 1), np.int64)], axis=1)
    text = np.frombuffer(b"abcabcde", np.uint8)
    got = dc.embed(text, np.asarray([0, 3, 8]), np.asarray([3, 8, 8]), bits)
    for k, (a, b) in enumerate([(0, 3), (3, 8), (8, 8)]):
        want = []
        for t in range(20):
            c = int(text[a]) if a < b else dc.END
            want.append(c)
            a += int(bits[t, c])
        assert got[:, k].tolist() == want
    assert dc.embed(text[:0], np.asarray([0]), np.asarray([0]), bits)[:, 0].tolist() == [dc.END] * 20


def test_a_substitution_in_every_tenth_byte():
    rng = random.Random(5)
    items = ["".join(rng.choice("etaoinshrdlu  ") for _ in range(200)) for _ in range(10)]
    assert found_share(items, ["".join("#" if i % 10 == 9 else c for i, c in enumerate(t)) for t in items], rng) == 1


def test_all_pairs_against_edit_distance(monkeypatch):
    monkeypatch.setattr(dc, "HITS_AT_ONCE", 50)
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    items = [t for n in (1, 3, 6, 7, 9, 13, 14, 20, 27, 40) for t in (text(n) for _ in range(4))]
    docs = [text(rng.randrange(0, 120)) for _ in range(60)] + ["", None, "a" * 300]
    index = dc.ItemIndex.build(list(enumerate(items)), dc.MAX_EDITS)
    got = {(r, index.ids[k]): e for r, k, e, _, _ in dc.find_in(index, pa.array(docs))}
    want = {(r, i): e for r, d in enumerate(docs) for i, t in enumerate(items) if t.strip() and (e := least_edits(t, d)) <= int(dc.MAX_EDITS * len(t))}
    assert want and got == want


def test_query_on_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    exact = {(d, i) for d, t in docs.items() for i, x in items.items() if dc.fold(x.encode()) in dc.fold((t or "").encode())}
    got = {(r.doc_id, r.item_id): r for r in dc.op4_decontaminate(spark, SF).collect()}
    assert exact and exact <= set(got)
    for (d, i), r in got.items():
        assert r.edits == least_edits(items[i], docs[d]) <= dc.MAX_EDITS * len(items[i].encode())


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_edges_of_input(spark, monkeypatch, block):
    monkeypatch.setattr(dc, "ITEM_BLOCK_BYTES", block)
    passage = "The Quick brown fox\njumps over the lazy dog and runs away again"
    items = spark.createDataFrame([(1, passage, "a"), (2, None, "b"), (3, "  ", "c"), (4, "tiny one", "d"), (None, "a null id item, long enough to have grams", "e"), (1, passage, "a")], "item_id long, text string, doc_id string")
    rows = [(1, passage.upper().replace("\n", " "), 1), (1, passage.upper().replace("\n", " "), 1), (None, "x" + passage, 2), (3, None, 3), (4, "", 4), (5, "aaaa" * 3000, 5), (6, "has tiny onE in it", 6), (7, "a null id item, long enough to have grams", 7), (8, "the quick brown", 8), (9, "long " * 30000 + passage, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int").repartition(3)
    got = {(r.doc_id, r.item_id, r.edits) for r in dc.contaminated(docs, items).collect()}
    assert got == {(1, 1, 0), (None, 1, 0), (6, 4, 0), (7, None, 0), (9, 1, 0)}
    kept = dc.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 8]
    assert dc.contaminated(docs.limit(0), items).collect() == [] and dc.contaminated(docs, items.limit(0)).collect() == []
    assert dc.drop_contaminated(docs, items.limit(0)).count() == len(rows)
