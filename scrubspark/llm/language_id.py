"""Language identification as a mixture of languages, fitted to each document by EM.

Every language has a table of byte trigram probabilities (hashed to 65,536 cells,
smoothed), counted over all texts that may be learned from. A word's likelihood in a
language is the product over its trigrams. For a document, expectation-maximisation
estimates the proportion of words from each language; languages are then taken away from
the smallest on, the proportions fitted again, and the set of least penalised likelihood
(Bayesian information criterion over words) is kept. The prediction is its largest member.

Rows whose crc32(doc_id as text) mod 3 is 1 are held out from learning, as are rows
without text or language. ``und`` with score 0 is given to texts that are null or have no
letter, and to every text if nothing could be learned. Repeated rows and null ids count
as they are (a null id is learned from and not held out); columns other than doc_id, text
and lang are ignored; empty tables give empty frames. Ties go to the first language by name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubspark.llm.common import id_remainder, small_batches, str_list

MODULUS, HELD_OUT = 3, 1
CELLS = 1 << 16
SLICES = 16  # parts of a table that are summed apart
TASKS_PER_SALT = 256  # tasks whose slices one group of the first merge adds up
SMOOTHING = 0.5
MAX_LANGUAGES = 512  # learned; a table of more would not be a bounded broadcast
LEAST_SHARE = 0.01  # of a document's mixture, for a language that its set may hold
STEPS = 8  # EM steps per set
PENALTY = 2.0  # times the usual one, as neighbouring words are not independent
LONG = 1 << 16  # characters from which a text may be counted word by word
CHUNK = 1 << 21  # words times languages handled at once

_letter = re.compile(r"[^\W\d_]")  # letters, and numerals that are no digits
_run = re.compile(rb"[A-Za-z\x80-\xff]+")
_IS_WORD = np.zeros(256, bool)
_IS_WORD[97:123] = _IS_WORD[65:91] = _IS_WORD[128:] = True


def has_letter(text: str) -> bool:
    """Whether a text has a letter; fractions, superscripts and Roman numerals are none."""
    return any(m[0].isalpha() for m in _letter.finditer(text))


def trigrams(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, first cell of each word, place of each word) of lower-cased bytes. A word is a
    run of letters (bytes from 128 on count as such); it has one trigram around each byte,
    with a blank beyond its ends."""
    buf = np.frombuffer(b" " + raw + b" ", np.uint8)
    word = _IS_WORD[buf]
    at = np.flatnonzero(word)
    plain = np.where(word, buf, np.uint8(32)).astype(np.uint32)
    code = (plain[at - 1] << np.uint32(16)) | (plain[at] << np.uint32(8)) | plain[at + 1]
    cells = (code * np.uint32(0x9E3779B1)) >> np.uint32(16)
    first = np.flatnonzero(~word[at - 1])
    return cells, first, at[first] - 1


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities): one row of ``CELLS`` per language, over all rows of
    ``docs`` that may be learned from."""
    small_batches(docs.sparkSession)
    usable = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    usable = usable.filter(F.coalesce(id_remainder(F.col("doc_id"), MODULUS) != HELD_OUT, F.lit(True)))
    width = CELLS // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        near = TaskContext.get().partitionId() // TASKS_PER_SALT
        held: dict[str, np.ndarray] = {}
        flushes = 0

        def out():
            salt = near + (flushes << 32)
            rows = [(lang, i, salt, part.tobytes()) for lang, t in held.items() for i, part in enumerate(t.reshape(SLICES, width)) if part.any()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int32(), pa.int64(), pa.binary()))], names=["lang", "part", "salt", "counts"])

        for batch in batches:
            texts, langs = str_list(batch.column(0)), batch.column(1).to_pylist()
            by: dict[str, list[str]] = {}
            for text, lang in zip(texts, langs):
                by.setdefault(lang, []).append(text)
            for lang, some in by.items():
                cells, _, _ = trigrams(" ".join(some).lower().encode())
                if lang not in held:
                    held[lang] = np.zeros(CELLS, np.int64)
                held[lang] += np.bincount(cells, minlength=CELLS)
            if len(held) > 32:
                yield from out()
                held.clear()
                flushes += 1
        yield from out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros(width, np.int64), None
        for batch in batches:
            if batch.num_rows and first is None:
                first = [batch.column(k)[0].as_py() for k in ("lang", "part", "salt")]
            for c in batch.column("counts"):
                total += np.frombuffer(c.as_py(), np.int64)
        yield pa.RecordBatch.from_pylist([dict(zip(("lang", "part", "salt"), first), counts=total.tobytes())], schema=merged)

    kind = "lang string, part int, salt long, counts binary"
    merged = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("salt", pa.int64()), ("counts", pa.binary())])
    # slices of many tasks are added up in two steps, each read batch by batch
    sums = usable.select("text", "lang").mapInArrow(count, kind)
    sums = sums.groupBy("lang", "part", "salt").applyInArrow(add, kind).groupBy("lang", "part").applyInArrow(add, kind)
    rows = sums.limit(MAX_LANGUAGES * SLICES + 1).collect()
    names = sorted({r.lang for r in rows})
    if len(rows) > MAX_LANGUAGES * SLICES or len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    counts = np.zeros((len(names), CELLS))
    for r in rows:
        counts[names.index(r.lang), r.part * width : (r.part + 1) * width] = np.frombuffer(r.counts, np.int64)
    return names, np.log((counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * CELLS)).astype(np.float32)


def mixtures(likelihood: np.ndarray, weight: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best language, its proportion, languages of the chosen set) of each document.

    ``likelihood``: log likelihoods (words, languages); ``weight``: times a word occurs;
    ``first``: first word of each document, every one having a word."""
    docs, langs = len(first), likelihood.shape[1]
    doc = np.repeat(np.arange(docs), np.diff(np.append(first, len(likelihood))))
    n = np.add.reduceat(weight, first)
    single = np.add.reduceat(likelihood * weight[:, None], first, axis=0, dtype=np.float64)
    top = likelihood.max(1, keepdims=True)
    rel = np.exp(np.maximum(likelihood - top, -60))
    offset = np.add.reduceat(top[:, 0] * weight, first, dtype=np.float64)

    def em(share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(STEPS):
            r = rel * share[doc]
            r *= (weight / r.sum(1))[:, None]
            share = np.maximum(np.add.reduceat(r, first, axis=0) / n[:, None], np.where(share > 0, 1e-12, 0))
        return share, offset + np.add.reduceat(weight * np.log((rel * share[doc]).sum(1)), first, dtype=np.float64)

    full, _ = em(np.full((docs, langs), 1 / langs, np.float32))
    rank = np.argsort(-full, axis=1, kind="stable")
    cost = PENALTY * np.log(np.maximum(n, 2))
    best = single.argmax(1)
    value = 2 * single.max(1) - cost
    chosen = np.zeros((docs, langs), np.float32)
    chosen[np.arange(docs), best] = 1
    # a document's search begins at all its languages of some share, whatever the others' do
    begin = (full > LEAST_SHARE).sum(1)
    share, k = full, int(begin.max(initial=1))
    while k > 1:
        kept = np.zeros((docs, langs), bool)
        np.put_along_axis(kept, rank[:, :k], True, 1)
        some = np.where(kept, np.maximum(share, 1e-12), 0).astype(np.float32)
        some, fit = em(some / some.sum(1, keepdims=True))
        on = begin >= k
        share = np.where(on[:, None], some, share)
        better = on & (2 * fit - k * cost > value)
        value = np.where(better, 2 * fit - k * cost, value)
        chosen[better] = share[better]
        k -= 1
    best = chosen.argmax(1)
    alone = chosen.max(1) >= 1  # one language: how much of the whole mixture it has
    return best, np.where(alone, full[np.arange(docs), best], chosen.max(1)), chosen > 0


def predict(docs: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages), one row per input row; ``languages``
    is the chosen set by name, comma-joined."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(np.ascontiguousarray(table.T))

    def words_of(raws: list[bytes], log_p: np.ndarray):
        """Likelihoods and document of each word of some lower-cased texts."""
        cells, first, place = trigrams(b" ".join(raws))
        if not len(first):
            return np.zeros((0, log_p.shape[1]), np.float32), np.zeros(0, np.int64)
        starts = np.cumsum([0, *[len(r) + 1 for r in raws[:-1]]])
        return np.add.reduceat(log_p[cells], first, axis=0), np.searchsorted(starts, place, "right") - 1

    def long_text(text: str, log_p: np.ndarray):
        """The same for one very long text: every different word once, with its count."""
        counts: Counter = Counter()
        for a in _run.finditer(text.lower().encode()):
            counts[a[0]] += 1
        words = list(counts)
        parts, weights = [], []
        for i in range(0, len(words), 1 << 16):
            some = words[i : i + (1 << 16)]
            found, doc = words_of(some, log_p)
            parts.append(found)
            weights.append(np.asarray([counts[w] for w in some], np.float32)[doc])
        return np.concatenate(parts), np.concatenate(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_p = shared.value
        langs = log_p.shape[1]
        for batch in batches:
            texts = str_list(batch.column(1))
            pred, score, sets = ["und"] * len(texts), [0.0] * len(texts), [""] * len(texts)
            todo = [i for i, t in enumerate(texts) if langs and has_letter(t)]

            def settle(rows, likelihood, weight, first):
                best, share, chosen = mixtures(likelihood, weight, first)
                for i, b, s, c in zip(rows, best.tolist(), share.tolist(), chosen):
                    pred[i], score[i] = names[b], min(1.0, max(0.0, s))
                    sets[i] = ",".join(names[k] for k in np.flatnonzero(c))

            group, size = [], 0
            for i in [*todo, None]:
                most = CHUNK * 5 // max(1, langs)  # a word has about five letters
                long = i is not None and len(texts[i]) > max(most, LONG)
                if group and (i is None or long or size + len(texts[i]) > most):
                    likelihood, doc = words_of([texts[g].lower().encode() for g in group], log_p)
                    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                    settle([group[d] for d in doc[first].tolist()], likelihood, np.ones(len(doc), np.float32), first)
                    group, size = [], 0
                if long:
                    likelihood, weight = long_text(texts[i], log_p)
                    settle([i], likelihood, weight, np.zeros(1, np.int64))
                elif i is not None:
                    group.append(i)
                    size += len(texts[i])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred), pa.array(score, pa.float64()), pa.array(sets)], names=["doc_id", "lang_pred", "score", "languages"])

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, languages string")
    held_out = F.coalesce(id_remainder(F.col("doc_id"), MODULUS) == HELD_OUT, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "languages")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return predict(docs, *learn(docs))
