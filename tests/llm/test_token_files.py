"""Token files: ids against the library, layout of the files, selective reads."""

import glob
import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scrubspark.llm import token_files

SF = "/root/testdata/sf0.001"
PATH = token_files.word_tokenizer_path()
TOKENIZER = Tokenizer.from_file(PATH)
MODEL = open(PATH, "rb").read()
WORDWISE = token_files.Encoder(MODEL)


def library_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def plain_rows(rows):
    """rows in order of (doc_id, text hash): (doc_id, start, n_tokens, crc32)."""
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*library_ids(text), token_files.END_ID]
        out.append((doc_id, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@given(st.lists(st.text(alphabet="aBé 'sll\t\n\x0b\x85\xa0́ Σς<|endoftext>1²½中😀\x1c\x00", max_size=40), max_size=5))
@settings(max_examples=400, deadline=None)
def test_ids_are_the_library_s(texts):
    flat, counts = WORDWISE.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    assert [flat[a - n : a].tolist() for a, n in zip(ends, counts)] == [library_ids(t) for t in texts]


def test_words_only_where_blanks_part_them(monkeypatch):
    import public_tokenizers

    assert WORDWISE.by_word
    byte_level = open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read()
    whole = token_files.Encoder(byte_level)
    assert not whole.by_word
    texts = ["Two  blanks here", "", "a <|endoftext|> b"]
    want = [Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(t, add_special_tokens=False).ids for t in texts]
    flat, counts = whole.encode(pa.array(texts, pa.string()))
    assert flat.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]
    for change in ({"lstrip": True}, {"content": "two words"}):
        spec = json.loads(MODEL)
        spec["added_tokens"][0].update(change)
        assert not token_files.splits_at_blanks(spec)
    monkeypatch.setattr(token_files, "MEMO_WORDS", 2)
    monkeypatch.setattr(token_files, "ENCODE_BYTES", 10)
    small = token_files.Encoder(MODEL)
    odd = ["one two three four", "One, five", "six one's two.'s", "w\u030a W\u030a W. w", "<|ENDOFTEXT|> <|endoftext|>. A", "it's. IT'S"]
    for texts in (odd, odd[::-1], [" ".join(odd)]):
        flat, _ = small.encode(pa.array(texts, pa.string()))
        assert flat.tolist() == [i for t in texts for i in library_ids(t)]


def test_query_against_the_library(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.op13_token_files(spark, SF).collect())
    assert got == plain_rows(docs)


def _files(path):
    return [pq.ParquetFile(f).metadata for f in sorted(glob.glob(f"{path}/*.parquet"))]


@pytest.mark.parametrize("encoding, name", [("delta", "DELTA_BINARY_PACKED"), ("dictionary", "RLE_DICTIONARY")])
def test_layout_of_the_files(spark, tmp_path, encoding, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    path = token_files.write_tokens(docs, str(tmp_path / "t"), PATH, ["lang", "source"], encoding=encoding, row_group_bytes=64 << 10, page_rows=20)
    groups = [m.row_group(g) for m in _files(path) for g in range(m.num_row_groups)]
    assert len(groups) > len(_files(path))  # the set size cuts them
    for g in groups:
        columns = {c.path_in_schema: c for c in (g.column(k) for k in range(g.num_columns))}
        assert set(columns) == {"doc_id", "part", "start_in_part", "n_tokens", "ids.list.element", "lang", "source"}
        assert name in columns["ids.list.element"].encodings
        assert all(c.has_offset_index and c.has_column_index for c in columns.values())
    spans = [(g.column(0).statistics.min, g.column(0).statistics.max) for g in groups]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))  # ascending over all files


def test_selective_reads(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = token_files.write_tokens(docs, str(tmp_path / "t"), PATH, ["lang"], end_id=None)
    few = token_files.read_tokens(spark, path, ["doc_id", "lang"], 10, 12)
    plan = few._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,10)" in plan and "ReadSchema: struct<doc_id:bigint,lang:string>" in plan
    want = {r.doc_id: (r.lang, library_ids(r.text)) for r in docs.filter("doc_id between 10 and 12").collect()}
    assert {r.doc_id: r.lang for r in few.collect()} == {k: v[0] for k, v in want.items()}
    ids = token_files.read_tokens(spark, path, ["doc_id", "ids"], 10, 12).collect()
    assert {r.doc_id: r.ids for r in ids} == {k: v[1] for k, v in want.items()}


def test_many_rows_of_one_id_are_spread(spark, tmp_path):
    rows = [(7, f"text number {k}") for k in range(300)] + [(k, "other") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = token_files.write_tokens(docs, str(tmp_path / "t"), PATH)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(m.num_rows for m in _files(path)) < 200
    got = token_files.with_starts(spark, path, token_files.read_tokens(spark, path)).collect()
    places = sorted((r.start, r.start + r.n_tokens, r.doc_id) for r in got)
    assert all(a[1] == b[0] and a[2] <= b[2] for a, b in zip(places, places[1:])) and len(places) == 320


def test_edges_of_input(spark, tmp_path):
    rows = [(5, None, "a"), (None, "Null id", "b"), (2, "", "c"), (9, "word " * 30000, "d"), (5, None, "a"), (3, " \n\t", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("start", F.lit(3))
    path = token_files.write_tokens(docs, str(tmp_path / "t"), PATH)
    got = token_files.with_starts(spark, path, token_files.read_tokens(spark, path)).select("doc_id", "start", "n_tokens", "ids").collect()
    order = [(None, "Null id"), (2, ""), (3, ""), (5, ""), (5, ""), (9, "word " * 30000)]
    want = [(d, s, n) for d, s, n, _ in plain_rows(order)]
    assert sorted(((r.doc_id, r.start, r.n_tokens) for r in got), key=str) == sorted(want, key=str)
    assert all(r.ids[-1] == token_files.END_ID and len(r.ids) == r.n_tokens for r in got)
    with pytest.raises(ValueError):
        token_files.write_tokens(docs, str(tmp_path / "u"), PATH, ["ids"])
    with pytest.raises(ValueError):
        token_files.write_tokens(docs, str(tmp_path / "u"), PATH, ["start", "start"])
    none = token_files.write_tokens(docs.limit(0), str(tmp_path / "v"), PATH, ["start"])
    assert token_files.with_starts(spark, none, token_files.read_tokens(spark, none)).collect() == []
