"""Repeated passages against a table of all 50-byte strings."""

import hashlib
import random

import numpy as np
import pytest

from scrubspark.llm import suffix_dedup as sd

SF = "/root/testdata/sf0.001"


def brute_force(rows: list[tuple[int | None, str | None]], length: int = sd.LENGTH) -> list[tuple]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each row, by a table of all strings."""
    least: dict[bytes, int] = {}
    raws = [(sd.NO_ID if i is None else i, (t or "").encode()) for i, t in rows]
    for i, raw in raws:
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            least[s] = min(i, least.get(s, i))
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if least[raw[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out.append((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def result(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept_bytes)).hexdigest()) for r in df.collect()), key=str)


def wanted(rows):
    return sorted(((i, *x) for (i, _), x in zip(rows, brute_force(rows))), key=str)


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = wanted(rows)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.op8_suffix_dedup(spark, SF).collect()), key=str)
    assert got == want and sum(w[2] for w in want) > 0


def passages(seed, n=160):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefé ") for _ in range(rng.randrange(2, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    common = [text(14), text(9), text(40), "ab" * 60, "x" * 130]
    rows = []
    for i in range(n):
        parts = [text(rng.randrange(0, 25))]
        for _ in range(rng.randrange(0, 3)):
            c = rng.choice(common)
            a = rng.randrange(0, len(c) // 2)
            parts += [c[a:], text(rng.randrange(0, 6))]
        rows.append((i * 3 % 211, "".join(parts)))
    rows += [(500, rows[5][1]), (500, rows[5][1]), (501, rows[5][1] + " "), (None, rows[7][1]), (None, rows[7][1] + "!"), (502, None), (503, ""), (504, "short"), (505, "y" * 49), (506, "y" * 50), (507, "y" * 51)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("hot", "block"), [(1000, 1 << 20), (2, 700), (0, 3000)])
def test_shared_passages(spark, monkeypatch, hot, block):
    monkeypatch.setattr(sd, "ROUTE_BYTES", 4000)
    monkeypatch.setattr(sd, "SORT_BYTES", 300)
    rows = passages(hot + 1)
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, _text string").repartition(4)
    assert result(sd.remove_repeats(docs, ["doc_id"], hot_documents=hot, block_bytes=block)) == wanted(rows)


def test_slices(monkeypatch, spark):
    monkeypatch.setattr(sd, "SLICE", 97)
    rows = passages(9, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(sd.remove_repeats(docs, ["doc_id"])) == wanted(rows)


def test_refinement_equals_string_classes():
    rng = np.random.default_rng(2)
    for alphabet in (1, 2, 4):
        text = rng.integers(97, 97 + alphabet, 3000).astype(np.uint8)
        text[1000:1300] = text[200:500]
        starts = np.arange(0, 2950)
        pointer = sd.refine_buckets(text, starts)
        seen = {}
        for s, p in zip(starts.tolist(), pointer.tolist()):
            assert seen.setdefault(text[s : s + 50].tobytes(), p) == p
        assert len(set(seen.values())) == len(seen)


def test_stage_and_empty_table(spark):
    passage = "é" * 60
    docs = spark.createDataFrame([(1, "a" + passage, "en", 5), (2, passage + "b", "fr", None), (3, None, None, None), (4, "same", "x", 1)], "doc_id long, text string, n_bytes string, kept_bytes int")
    got = {r.doc_id: r for r in sd.drop_repeats(docs).collect()}
    assert sd.drop_repeats(docs).columns == docs.columns
    assert got[1].text == "a" + passage and got[2].text == "b" and got[3].text is None and got[4].text == "same"
    assert got[2].n_bytes == "fr" and got[4].kept_bytes == 1
    assert sd.drop_repeats(docs.limit(0)).collect() == []
    assert sd.remove_repeats(docs.limit(0), ["doc_id"]).collect() == []
