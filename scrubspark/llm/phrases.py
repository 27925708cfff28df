"""Phrase collocations from FM-indexes over word ids, one per shard, counts summed.

A task gathers texts into shards of bounded size. A shard numbers its different (word,
language) pairs, lays its pieces end to end with a separator between them, and builds
the Burrows-Wheeler transforms of that sequence and of its reverse; suffixes are sorted
by as many words as the longest phrase has. Phrases are intervals in both transforms.
One pass over a transform extends all intervals of a level at once, to the left or to
the right: rows ordered by their transform symbol (the LF order) fall into the
extended intervals, and an interval in the other transform starts as many rows further
as smaller symbols precede. Counts are interval sizes; they are summed across shards.

Two scans. The first sums counts by 64-bit hashes of the phrases shorter than the
longest; hashes that may reach the least count go into a Bloom filter of at most
``FILTER_BITS``. The second extends and writes out only phrases whose parts pass it.
Hashes that meet, and a filter that is full, let more phrases through but lose none, as
a phrase is never more frequent than its parts; the sums of the second scan are exact.

Joins of phrases with the counts of their parts send parts that many phrases share by
broadcast (fewer than HOT_SHARE) and the others by shuffle. Scores are integers of
decimal(38) arithmetic, exact up to 10^13 occurrences (beyond, an error).

Defined results: null texts are empty, a null language is ``und`` and one with rows
that say so; repeated rows count each; ties go by the order stated; an empty table gives
an empty frame; columns other than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrubspark.llm.common import checkpointed, small_batches, str_list

MAX_WORDS = 3
MIN_COUNT = 10
TOP = 2000
INSIDE_PERCENT = 50
SHARD_BYTES = 6 << 20  # text of a shard, if one text is not longer
FILTER_BITS = 1 << 27  # largest filter
BITS_PER_HASH = 16
PROBES = 3
HOT_SHARE = 1000
SCORE_CLASSES = 32  # classes of scores between a power of two and the next
FEW_LANGS = 10_000  # languages of more than TOP phrases whose thresholds are broadcast
BATCH = 1 << 16
NO_LANG = "und"

_SEPARATOR = b"\xff"  # no byte of UTF-8 text
_FOLD = bytes(32 if b == 9 else 10 if chr(b) in ".,;:!?\n\v\f\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.asarray([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def words_of(raw: bytes) -> list[bytes]:
    """Words of folded text in order, with a separator wherever a piece ends."""
    return raw.translate(_FOLD).replace(b"\n", b" " + _SEPARATOR + b" ").split()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * _MIX[1]
    h = (h ^ h >> np.uint64(27)) * _MIX[2]
    return h ^ h >> np.uint64(31)


def sorted_suffixes(t: np.ndarray, depth: int) -> np.ndarray:
    """Places of a cyclic sequence, ordered by the ``depth`` symbols from each on."""
    size = int(t.max()) + 1
    rank, span = t.astype(np.int64), size
    for d in range(1, depth):
        if span > (1 << 62) // size:
            rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
            span = int(rank.max()) + 1
        rank = rank * size + np.roll(t, -d)
        span *= size
    return np.argsort(rank, kind="stable")


@dataclass
class Half:
    """One direction's transform: the rows ordered by the symbol before them."""

    order: np.ndarray  # LF order
    symbols: np.ndarray  # the symbols in that order

    @classmethod
    def build(cls, t: np.ndarray, depth: int) -> Half:
        before = np.roll(t, 1)[sorted_suffixes(t, depth)]
        order = np.argsort(before, kind="stable")
        return cls(order, before[order])


@dataclass
class Level:
    """The phrases of one length: their intervals, and the shorter phrase and the word
    that each consists of."""

    left: np.ndarray  # first row in the text's transform, which extends to the left,
    right: np.ndarray  # and in the reverse's
    count: np.ndarray
    parent: np.ndarray
    symbol: np.ndarray
    words: np.ndarray  # (phrases, words) symbols

    def some(self, keep: np.ndarray) -> Level:
        return Level(*(x[keep] for x in (self.left, self.right, self.count, self.parent, self.symbol, self.words)))


class BiIndex:
    """Bidirectional index of a sequence of symbols; 0 separates and is at both ends."""

    def __init__(self, t: np.ndarray, depth: int):
        self.size = len(t)
        self.left = Half.build(t, depth)
        self.right = Half.build(t[::-1].copy(), depth)

    def empty(self) -> Level:
        """The empty phrase, which is everywhere."""
        zero = np.zeros(1, np.int64)
        return Level(zero, zero, np.asarray([self.size]), zero, zero, np.zeros((1, 0), np.int32))

    def extend(self, level: Level, to_left: bool) -> Level:
        """All phrases with one word more than those of ``level``, before or after them."""
        half = self.left if to_left else self.right
        own, other = (level.left, level.right) if to_left else (level.right, level.left)
        holder = np.full(self.size, -1, np.int32)
        rows = np.repeat(own - (np.cumsum(level.count) - level.count), level.count) + np.arange(int(level.count.sum()))
        holder[rows] = np.repeat(np.arange(len(own), dtype=np.int32), level.count)
        holder = holder[half.order]
        at = np.flatnonzero(holder >= 0)
        holder, symbol = holder[at], half.symbols[at]
        head = np.flatnonzero(np.concatenate([[True], (symbol[1:] != symbol[:-1]) | (holder[1:] != holder[:-1])])[: len(at)])
        count, parent, symbol, start = np.diff(np.append(head, len(at))), holder[head].astype(np.int64), symbol[head], at[head]
        # in the other transform the extended phrases of one parent follow each other by symbol
        by = np.lexsort((symbol, parent))
        before = np.cumsum(count[by]) - count[by]
        first = np.searchsorted(parent[by], np.arange(len(own)))
        place = np.empty_like(before)
        place[by] = before - before[np.minimum(first, max(0, len(before) - 1))][parent[by]] + other[parent[by]]
        words = np.concatenate([symbol[:, None], level.words[parent]] if to_left else [level.words[parent], symbol[:, None]], axis=1)
        out = Level(*((start, place) if to_left else (place, start)), count, parent, symbol, words.astype(np.int32))
        return out.some(symbol > 0)


@dataclass
class Shard:
    """Words of some texts as symbols from 1 on, a symbol per (word, language)."""

    names: pa.Array  # of the symbols
    langs: list[str]
    lang: np.ndarray  # of each symbol
    t: np.ndarray

    @classmethod
    def build(cls, texts: dict[str, list[str]]) -> Shard:
        names, lang, parts, used = [pa.array([b""], pa.binary())], [np.zeros(1, np.int64)], [np.zeros(1, np.int32)], 1
        for k, own in enumerate(texts.values()):
            words = words_of((b"\n" if len(own) > 1 else b"").join(x.encode() for x in own))
            coded = pa.array([_SEPARATOR, *words, _SEPARATOR], pa.binary()).dictionary_encode()
            # the separator comes first, so it has the code 0
            parts.append(np.where((codes := coded.indices.to_numpy()) == 0, 0, codes + (used - 1)).astype(np.int32))
            names.append(coded.dictionary[1:])
            lang.append(np.full(len(coded.dictionary) - 1, k))
            used += len(coded.dictionary) - 1
        return cls(pa.concat_arrays(names), list(texts), np.concatenate(lang), np.concatenate(parts))

    def hashes(self) -> np.ndarray:
        from xxhash import xxh64_intdigest

        salt = [xxh64_intdigest(x.encode(), 7) for x in self.langs]
        own = np.asarray([xxh64_intdigest(w, 42) for w in self.names.to_pylist()], np.uint64)
        return own * _MIX[0] + np.asarray(salt or [0], np.uint64)[self.lang]


def hash_of(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A hash of each row of symbols; depends on the order of the words and their number."""
    h = np.full(len(words), words.shape[1], np.uint64)
    for k in range(words.shape[1]):
        h = mixed(h * _MIX[0] + hashes[words[:, k]])
    return h


def probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Bits of the filter that belong to each hash; ``bits`` is a power of two."""
    step = h >> np.uint64(32) | np.uint64(1)
    return [(h + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(PROBES)]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    texts, size = {}, 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), str_list(batch.column(1))):
            if not text:
                continue
            texts.setdefault(lang, []).append(text)
            size += len(text)
            if size >= SHARD_BYTES:
                yield Shard.build(texts)
                texts, size = {}, 0
    if texts:
        yield Shard.build(texts)


def _levels(shard: Shard, max_words: int, bloom: np.ndarray | None) -> Iterator[tuple[Level, np.ndarray]]:
    """Levels of a shard with the hashes of their phrases; extends to the left and to the right
    by turns. With a filter, only phrases pass whose parts are in it."""
    index, hashes = BiIndex(shard.t, max_words), shard.hashes()
    level = index.empty()
    for n in range(1, max_words + 1):
        level = index.extend(level, to_left=n % 2 == 1)
        if bloom is not None and n > 1:
            # the part that the level was extended from is in the filter, see now to the other one
            rest = level.words[:, :-1] if n % 2 == 1 else level.words[:, 1:]
            level = level.some(held(bloom, hash_of(hashes, rest)))
        own = hash_of(hashes, level.words)
        if bloom is not None and n < max_words:
            keep = held(bloom, own)
            level, own = level.some(keep), own[keep]
        yield level, own


def held(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the filter (64-bit words) holds each hash."""
    on = np.ones(len(h), bool)
    for bit in probes(h, 64 * len(bloom)):
        on &= (bloom[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
    return on


def _source(docs: DataFrame, text: str, lang: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(f"`{text}`").alias("text"))


def frequent_filter(source: DataFrame, max_words: int, min_count: int) -> np.ndarray:
    """First scan: a Bloom filter that holds the hash of every phrase of fewer than
    ``max_words`` words that occurs ``min_count`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            for level, h in _levels(shard, max_words - 1, None):
                for a in range(0, len(h), BATCH):
                    yield pa.RecordBatch.from_arrays([pa.array(h[a : a + BATCH].view(np.int64)), pa.array(level.count[a : a + BATCH])], names=["h", "n"])

    # each shard has counted already: straight to the sums
    sums = source.mapInArrow(run, "h bigint, n bigint").repartition("h").groupBy("h").agg(F.sum("n").alias("n"))
    kept = checkpointed(sums.filter(F.col("n") >= min_count).select("h"))
    bits = 1 << max(12, min((BITS_PER_HASH * kept.count()).bit_length(), FILTER_BITS.bit_length() - 1))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.concatenate(probes(batch.column(0).to_numpy().view(np.uint64), bits))
            word, mask = (bit >> np.uint64(6)).astype(np.int32), np.uint64(1) << (bit & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view(np.int64))], names=["word", "mask"])

    words = kept.mapInArrow(places, "word int, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bloom = np.zeros(bits // 64, np.uint64)
    bloom[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    return bloom


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, phrase, n_words, f): phrases of up to ``max_words`` words that occur ``min_count``
    times, and for each language the phrase of no words, whose f counts all words."""
    source = _source(docs, text, lang)
    shared = docs.sparkSession.sparkContext.broadcast(frequent_filter(source, max_words, min_count)) if max_words > 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            ends = pc.binary_join_element_wise(pa.array([""] * len(shard.langs)), pa.array(shard.langs), "\n")
            total = np.bincount(shard.lang[shard.t[shard.t > 0]], minlength=len(shard.langs))
            yield pa.RecordBatch.from_arrays([ends, pa.array(total, pa.int64())], names=["key", "n"])
            names = shard.names.cast(pa.string(), safe=False)
            for level, _ in _levels(shard, max_words, shared.value if shared else None):
                for a in range(0, len(level.count), BATCH):
                    words = level.words[a : a + BATCH]
                    phrase = pc.binary_join_element_wise(*[names.take(pa.array(words[:, k])) for k in range(words.shape[1])], " ")
                    key = pc.binary_join_element_wise(phrase, pa.array(shard.langs).take(pa.array(shard.lang[words[:, 0]])), "\n")
                    yield pa.RecordBatch.from_arrays([key, pa.array(level.count[a : a + BATCH])], names=["key", "n"])

    # no word holds a line feed, so the first one ends the phrase
    sums = source.mapInArrow(run, "key string, n bigint").repartition("key").groupBy("key").agg(F.sum("n").alias("f"))
    phrase = F.substring_index("key", "\n", 1)
    blanks = F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit("")))
    return sums.filter((F.col("f") >= min_count) | F.startswith("key", F.lit("\n"))).select(
        F.expr("substring(key, length(substring_index(key, '\n', 1)) + 2)").alias("lang"),
        phrase.alias("phrase"),
        F.when(phrase == "", 0).otherwise(blanks + 1).alias("n_words"),
        "f",
    )


def _parts_with_counts(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """``parts`` (lang, part, ...) with f of each part, all of which ``counts`` holds."""
    uses = parts.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("uses"))
    table = checkpointed(uses.join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"]))
    most = (table.agg(F.sum("uses")).first()[0] or 0) / HOT_SHARE
    hot = F.broadcast(table.filter(F.col("uses") > most).drop("uses"))
    cold = table.filter(F.col("uses") <= most).drop("uses")
    rest = parts.join(hot.select("lang", "part"), ["lang", "part"], "left_anti")
    return parts.join(hot, ["lang", "part"]).unionByName(rest.join(cold, ["lang", "part"]))


def _above_threshold(scored: DataFrame, top: int) -> DataFrame:
    """``scored`` without rows that cannot be among a language's first ``top``: those below the
    least score of the class of scores (a few hundredths wide) in which the ``top``th lies. So
    the task that ranks a language gets little more than ``top`` rows, whatever its size."""
    classes = scored.groupBy("lang", F.floor(F.log2(F.col("score") + 1) * SCORE_CLASSES).alias("c"))
    classes = classes.agg(F.count(F.lit(1)).alias("rows"), F.min("score").alias("least"))
    upto = F.sum("rows").over(Window.partitionBy("lang").orderBy(F.desc("c")))
    limits = classes.withColumn("upto", upto).filter(F.col("upto") >= top).groupBy("lang").agg(F.max("least").alias("least"))
    limits = checkpointed(limits)
    if limits.count() <= FEW_LANGS:
        limits = F.broadcast(limits)
    return scored.join(limits, "lang", "left").filter(F.col("least").isNull() | (F.col("score") >= F.col("least"))).drop("least")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT,
    inside_percent: int = INSIDE_PERCENT, top: int | None = TOP,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's collocations of 2 to ``max_words``
    words, best first by score, a (both descending) and phrase; the first ``top`` of them."""
    counts = checkpointed(phrase_counts(docs, text, lang, max_words, min_count))
    phrases = counts.filter("n_words >= 2")
    # a phrase is dropped for a longer one that has it; of all longer ones the next are most frequent
    ends = F.array(F.expr("substring_index(phrase, ' ', n_words - 1)"), F.expr("substring_index(phrase, ' ', 1 - n_words)"))
    longer = phrases.filter("n_words >= 3").select("lang", F.explode(ends).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    free = F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("f"))
    kept = checkpointed(phrases.join(longer, ["lang", "phrase"], "left").filter(free).drop("longer"))
    cuts = kept.select("lang", "phrase", "n_words", F.col("f").alias("a"), F.explode(F.expr("sequence(1, n_words - 1)")).alias("k"))
    sides = F.array(
        F.struct(F.lit("l").alias("side"), F.expr("substring_index(phrase, ' ', k)").alias("part")),
        F.struct(F.lit("r").alias("side"), F.expr("substring_index(phrase, ' ', k - n_words)").alias("part")),
    )
    parts = cuts.select("lang", "phrase", "a", "k", F.explode(sides).alias("s")).select("lang", "phrase", "a", "k", "s.side", "s.part")
    each = _parts_with_counts(parts, counts)
    both = each.groupBy("lang", "phrase", "a", "k").agg(*[F.max(F.when(F.col("side") == s, F.col("f"))).alias(s) for s in "lr"])
    score = F.expr("(cast(1000000 as decimal(7,0)) * (cast(a as decimal(13,0)) * cast(a as decimal(13,0)))) div (cast(l as decimal(13,0)) * cast(r as decimal(13,0)))")
    scored = both.withColumn("score", score.cast("bigint"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = checkpointed(best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    if top:
        best = _above_threshold(best, top)
    totals = counts.filter("n_words = 0").select("lang", F.col("f").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("bigint"))
    ranked = ranked.filter(F.col("rank") <= top) if top else ranked
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


_UPPER, _LOWER = (bytes(range(a, a + 26)).decode() for a in (65, 97))
OP11_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, '{NO_LANG}') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS MATERIALIZED (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\x09]+'), lambda w: w <> '') AS ws FROM pieces),
counts AS MATERIALIZED (
  SELECT lang, phrase, n_words, count(*) AS f FROM (
    SELECT lang, k AS n_words, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase
    FROM words, range(1, {MAX_WORDS + 1}) t(k) WHERE len(ws) >= k) GROUP BY ALL),
cands AS MATERIALIZED (
  SELECT lang, phrase, n_words, f AS a, string_split(phrase, ' ') AS ws FROM counts WHERE n_words >= 2 AND f >= {MIN_COUNT}),
longer AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(ws[1 : n_words - 1], ' '), array_to_string(ws[2 :], ' ')]) AS phrase FROM cands WHERE n_words >= 3)
  GROUP BY ALL),
cuts AS (
  SELECT c.lang, c.phrase, a, k, l.f AS l, r.f AS r,
    CAST((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, n_words)) AS k FROM cands) c
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1 : k], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(ws[k + 1 :], ' ')
  LEFT JOIN longer g ON g.lang = c.lang AND g.phrase = c.phrase
  WHERE longer IS NULL OR 100 * longer < {INSIDE_PERCENT} * a),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE n_words = 1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best JOIN totals USING (lang) QUALIFY rank <= {TOP}
"""
