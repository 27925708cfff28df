"""The pipeline, stage by stage, against plain versions of its operators."""

import hashlib

import corpus_pipeline
from tests.llm.test_bpe import expected
from tests.llm.test_decontam import least_edits
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_suffix_dedup import brute_force
from tokenizers import Tokenizer

from scrubspark.llm import bpe, decontam, toxicity

SF = "/root/testdata/sf0.001"


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "bpe_encoding"]


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, frames = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        frames.append({r.doc_id: r for r in docs.collect()})
        assert stage is corpus_pipeline.tokenize or docs.columns == columns
    source = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    mild, single, cut, clean, tokens = frames

    scores = toxicity.op6_toxicity(spark, SF).collect()
    assert set(mild) == {r.doc_id for r in scores if not r.predicted} and all(mild[d] == source[d] for d in mild)

    items = [(d, plain_fingerprint(r.text)) for d, r in sorted(mild.items())]
    assert set(single) == {d for (d, _), c in zip(items, plain_components(items)) if d == c}
    assert all(single[d] == source[d] for d in single)

    rows = [(d, r.text) for d, r in sorted(single.items())]
    for (d, text), (n, gone, _, digest) in zip(rows, brute_force(rows)):
        assert len(cut[d].text.encode()) <= n - gone and (gone or cut[d].text == text)
        assert cut[d].n_chars == len(cut[d].text)
        if len(cut[d].text.encode()) == n - gone:
            assert hashlib.sha256(cut[d].text.encode()).hexdigest() == digest
    assert set(cut) == set(single)

    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = {d for d, r in cut.items() if any(decontam.fold(x.encode()) in decontam.fold(r.text.encode()) for x in bench)}
    assert not holds & set(clean)
    for d in set(cut) - set(clean):
        assert min(least_edits(x, cut[d].text) / len(x.encode()) for x in bench) <= decontam.MAX_EDITS

    theirs = Tokenizer.from_file(bpe.tokenizer_path())
    assert set(tokens) == set(clean)
    for d, r in tokens.items():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(theirs, clean[d].text) and len(r.token_ids) == r.n_tokens


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100


ODD = "doc_id long, text string, lang string, source string, n_chars long, fp long, component_id string, token_ids int, _text string, block double, score boolean"


def test_stages_on_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, None, "en", None, 3), (2, "", None, "s", None), (2, "", None, "s", None), (3, "word " * 60000, "en", "s", 1), (None, "some text", "en", "s", 9)]
    odd = spark.createDataFrame([(*r, 1, "c", 2, "t", 0.5, True) for r in rows], ODD).repartition(3)
    for docs in (odd, odd.limit(0)):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == columns
        kept = sorted((r.doc_id for r in docs.collect()), key=str)
        last = corpus_pipeline.tokenize(spark, docs, SF).collect()
        assert sorted((r.doc_id for r in last), key=str) == kept
        assert kept in ([], [1, 3, None, None])  # the empty texts are one group of near copies
