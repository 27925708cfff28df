"""Toxicity: held-out accuracy, the composed automaton against its machines, edges of input."""

import math
import random
import zlib

import pytest

from scrubspark.llm import toxicity as tx


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = tx.op6_toxicity(spark, sf).collect()
    assert len(got) == 10000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.score, labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    assert auc([h[:2] for h in held]) > 0.95
    caught = [p for _, y, p in held if y]
    clean = [p for _, y, p in held if not y]
    assert sum(caught) > 0.85 * len(caught) and sum(clean) < 0.01 * len(clean)


def test_composed_automaton_is_the_product():
    table, pattern = tx.compose()
    rng = random.Random(0)
    for _ in range(500):
        word = [rng.randrange(tx.CLASSES) for _ in range(rng.randrange(12))]
        state, each = 0, [m.start for m in tx.MACHINES]
        for c in word:
            state = table[state][c]
            each = [m.step(s, c) for m, s in zip(tx.MACHINES, each)]
        assert pattern[state] == tx.PATTERNS[tuple(m.meaning[s] for m, s in zip(tx.MACHINES, each))]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("You are an idiot.", [(1, 0, 1, 0, 0)]),
        ("You are not an IDIOT! They said: fine", [(1, 0, 1, 1, 0)]),
        ("He wrote that you are a moronic idiot", [(2, 0, 1, 0, 1)]),
        ("I will kill you; nothing. idiot", [(0, 1, 1, 0, 0), (1, 0, 0, 0, 0)]),
        ("videotidiot skilled", []),
        ("", []),
    ],
)
def test_clause_patterns(text, want):
    g = tx.Grammar({"idiot": 1.0, "moron*": 1.0})
    name = {i: p for p, i in tx.PATTERNS.items()}
    got = sorted(name[p] for p in g.patterns(text))
    assert got == sorted(want)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("He said: you are not an idiot. You are an idiot.", {(1, 0, 1, 1, 0): 2.0, (1, 0, 1, 0, 0): 2.0}),
        ("She wrote you are an idiot. You are an idiot. You are an idiot.", {(1, 0, 1, 0, 1): 2.0, (1, 0, 1, 0, 0): 2.0}),
        ("To kill time. I will kill you.", {(0, 1, 0, 0, 0): 3.0, (0, 1, 1, 0, 0): 3.0}),
        ("I kill. Idiot! Kill the idiot", {(0, 1, 0, 0, 0): 3.0, (1, 0, 0, 0, 0): 2.0, (1, 1, 0, 0, 0): 2.0}),
        ("Idiot. Fool. Idiot fool. Fool idiot.", {(1, 0, 0, 0, 0): 3.0, (2, 0, 0, 0, 0): 3.0}),
    ],
)
def test_every_different_clause_counts(text, want):
    got = tx.Grammar({"idiot": 2.0, "fool": 1.0}).patterns(text)
    assert got == {tx.PATTERNS[p]: w for p, w in want.items()}


def test_edges_of_input(spark):
    docs = spark.createDataFrame([(1, None, 0.0), (1, None, 0.0), (None, "you idiot", 1.0), (2, "", 2.0), (3, "a " * 40000 + "idiot", 3.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int, text string")
    model = tx.fit(docs, none)
    got = tx.score(docs, model).collect()
    assert len(got) == 5 and all(r.score == 0 and r.predicted == 0 for r in got)
    one_class = spark.createDataFrame([(1, 1, "x"), (2, None, "x"), (1, 0, "x"), (None, 1, "x")], "doc_id long, toxic int, text string")
    assert all(r.score == 1 for r in tx.score(docs, tx.fit(docs, one_class)).collect())
    assert tx.drop_toxic(docs, none).count() == 5 and tx.drop_toxic(docs, none).columns == docs.columns
    assert tx.score(docs.limit(0), tx.fit(docs.limit(0), none)).collect() == []
    strong = tx.Model({"idiot": 1.0}, [3.0] * len(tx.PATTERNS) + [0.0, 0.0], -1.0)
    by = {r.doc_id: r.score for r in tx.score(docs, strong).collect()}
    shouted = tx.Grammar({"idiot": 2.0, "fool": 1.0}).patterns("idiot! Idiot! idiot, fool idiot")
    assert shouted == {tx.PATTERNS[1, 0, 0, 0, 0]: 2.0, tx.PATTERNS[2, 0, 0, 0, 0]: 1.0}
    assert by[3] == pytest.approx(1 / (1 + math.exp(1 - 3 * math.log(2)))) and by[2] == pytest.approx(1 / (1 + math.e))


def test_learns_words_and_beginnings(spark):
    rng = random.Random(1)
    stems = ["wug", "blick", "dax", "toma", "fep", "zorin"]
    word = lambda: rng.choice(stems) + rng.choice(["a", "ing", "en", "ous", "ity"])
    rows = []
    for i in range(800):
        y = i % 4 == 0
        words = [word() for _ in range(30)]
        if y:
            words[rng.randrange(30)] = rng.choice(["gronk", "snarfl" + rng.choice("abcdefghijklmnop") + rng.choice("xyz")])
        rows.append((i, " ".join(words), int(y)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = tx.fit(docs.drop("toxic"), docs.drop("text"))
    assert any(e.startswith("gron") for e in model.entries) and any(e.startswith("snar") and e.endswith("*") for e in model.entries)
    assert not any(e.rstrip("*") in w for e in model.entries for w in stems)
    got = {r.doc_id: r.predicted for r in tx.score(docs, model).collect()}
    assert sum(got[i] != y for i, _, y in rows) < 8
