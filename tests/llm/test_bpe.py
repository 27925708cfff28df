"""BPE: every id and decoded text against the tokenizers library."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from scrubspark.llm import bpe

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "\n\n  a", "a" * 5000, "don't we'll I'M 'SE  it's", "<|endoftext|>x <|endoftext|>", "x  <|endoftext|>  y",
    "naïve ÀÉÎ ß½² Ⅷ ٣٤ 你好 世界 🙂🤦🏼\u200d♂️", "\x00\x1c\x1f\x85\xa0\u2003\u3000 a\xadb\ufeff", "tab\tnew\r\nline \u2028 end ",
    "1234567 abc123 _under_ ---===", "ʼn ǅ ʰ ̀á", "“quoted” – dash… 'tis", "a\xa0 \xa0b", "e\u0085\u0085 f",
]


@pytest.fixture(scope="module")
def path():
    return bpe.tokenizer_path()


@pytest.fixture(scope="module")
def theirs(path):
    return Tokenizer.from_file(path)


def expected(t, text):
    ids = t.encode(text or "", add_special_tokens=False).ids
    back = t.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_odd_texts_and_table(spark, path, theirs):
    rng = random.Random(3)
    marks = "aB é'sñ1²½ \n\t.,!?-_<|>\u2003\xa0中文🙂́ǅ\u1680\u200b\x1d\x85"
    texts = ODD + ["".join(rng.choice(marks) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x"), (None, "null id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string").repartition(3)
    got = {}
    for r in bpe.encode_digests(docs, path).collect():
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_sha256, r.decoded_sha256))
    assert len(got[3]) == 2 and got[3][0] == got[3][1]
    assert got[None] == [expected(theirs, "null id")]
    wrong = [t for i, t in enumerate(texts) if got[i][0] != expected(theirs, t)]
    assert not wrong, wrong[:3]


def test_query_on_whole_table(spark, theirs):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = bpe.op10_bpe(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(theirs, docs[r.doc_id])


def test_empty_table(spark, path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_digests(docs, path).collect() == []


def test_lexicon_is_minimal_and_exact(path):
    model = bpe.BpeModel(path)
    words = ["station", "nation", "nations", " ration", "n", "na", "é"]
    entries = {w.encode(): model.merge(w) for w in words}
    lex = bpe.Lexicon(bpe.compile_lexicon(entries))
    assert all(lex.get(w) == ids for w, ids in entries.items())
    assert lex.get(b"nat") is None and lex.get(b"nationss") is None and lex.get(b"") is None
    # 'ation' is shared by station, ration and nation up to its branch, so states are fewer than letters
    assert len(lex.final) < sum(map(len, entries))
    assert bpe.Lexicon(bpe.compile_lexicon({})).get(b"a") is None


def test_words_merged_together(path):
    model, rng = bpe.BpeModel(path), random.Random(4)
    words = ["".join(rng.choice("theaion rsé世") for _ in range(rng.randrange(1, 40))) for _ in range(500)] + ["a"]
    raw = [w.encode() for w in words]
    ids, counts = model.merge_many(b"".join(raw), bpe.np.asarray([*map(len, raw)]))
    cut = bpe.np.cumsum([0, *counts]).tolist()
    assert [ids[a:b].tolist() for a, b in zip(cut, cut[1:])] == [model.merge(w) for w in words]
    assert [len(x) for x in model.merge_many(b"", bpe.np.zeros(0, int))] == [0, 0]


def test_small_memory_changes_nothing(path, theirs, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 20)
    monkeypatch.setattr(bpe, "PART_CHARS", 64)
    model = bpe.BpeModel(path)
    coder = bpe.Encoder(model, bpe.Lexicon(bpe.compile_lexicon({b" the": model.merge(" the")})))
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "station", "x", "naïve", "<|endoftext|>"]) + str(rng.randrange(40)) for _ in range(rng.randrange(30))) for _ in range(60)]
    got = coder.encode_array(bpe.pa.array(texts)).to_pylist()
    assert got == [theirs.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_words_merge_alike(path):
    model, rng = bpe.BpeModel(path), random.Random(1)
    for n in (49, 80, 300):
        w = "".join(rng.choice("theaion rs") for _ in range(n))
        ids = [model.first[b] for b in w.encode()]
        long = model._merge_long(list(ids))
        while True:
            best = min(((f, i) for i in range(len(ids) - 1) if (f := model.merges.get(ids[i] << 32 | ids[i + 1]))), default=None)
            if best is None:
                break
            ids[best[1] : best[1] + 2] = [best[0][1]]
        assert long == ids
