"""Queries of the training-data operators and their DuckDB texts."""

from __future__ import annotations

import corpus_pipeline
from scrubspark.llm import (
    bpe,
    chat,
    decontam,
    language_id,
    license_scan,
    phrases,
    quality,
    simhash,
    suffix_dedup,
    token_files,
    toxicity,
    vector_codes,
    warc,
)

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_simhash": simhash.op2_simhash,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_decontaminate": decontam.op4_decontaminate,
    "op5_chat_format": chat.op5_chat_format,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_warc": warc.op7_warc,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_quality": quality.op9_quality,
    "op10_bpe": bpe.op10_bpe,
    "op11_phrases": phrases.op11_phrases,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_token_files": token_files.op13_token_files,
    "pipeline": corpus_pipeline.run,
}

ORACLE = {
    "op3_license_scan": license_scan.OP3_SQL,
    "op5_chat_format": chat.OP5_SQL,
    "op7_warc": warc.OP7_SQL,
    "op11_phrases": phrases.OP11_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
}

if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
