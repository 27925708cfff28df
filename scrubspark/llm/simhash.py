"""SimHash near-duplicates over a byte-position inverted index with count filtering.

A 64-bit fingerprint has eight byte positions. Two fingerprints that differ in at
most three bits differ in at most three bytes, so they share at least five
positional bytes. The index keeps, for every choice of five positions, the posting
list of the bytes there. (Lists of single bytes would each hold 1/256 of all
fingerprints and so a number of pairs that grows with the square of the input.)
The members of a list tally their shared positional bytes pair by pair; a pair is
retained if the tally reaches five, and only in the first of the lists that hold
both (the one of its five lowest shared positions), then verified by its bit distance.

A posting list can hold at most 2^24 different fingerprints, as 24 bits are free;
inside a list a breadth-first search over the not yet reached members gives a
spanning forest, so a list of n members gives at most n - 1 links and never all
pairs. In a list longer than the number of differences of at most three bits every
member looks up the partners that the list would retain instead of tallying all
others. Equal fingerprints are one member.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from scrubspark.llm.common import checkpointed, small_batches, str_list, union_min_labels, word_parts

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
HOT_SHARE = 1000
BYTES = 8
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)  # byte -> its 8 bits
_LANES = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of the word shingles of a text (A-Z lower-cased, XXH64 with seed 42).

    A bit is set if it is set in more than half of the shingles' hashes, repeats
    included. Fewer words than a shingle holds: the whole sequence is one shingle;
    no words: zero.
    """
    from xxhash import xxh64_digest

    tallies, n, carry, k = np.zeros(8 * 256, np.int64), 0, [], shingle_words
    for part in word_parts(text.encode().lower()):
        words = carry + part
        if len(words) >= k:
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = [0, *ends[:-1].tolist()][: len(words) - k + 1]
            line = b" ".join(words)
            digests = b"".join([xxh64_digest(line[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())])
            lanes = np.frombuffer(digests, np.uint8).reshape(-1, 8) + _LANES
            tallies += np.bincount(lanes.ravel(), minlength=8 * 256)
            n += len(lanes)
        carry = words[-(k - 1) :] if k > 1 else []
        short = words
    if n == 0:
        if not text or not short:
            return 0
        return int.from_bytes(xxh64_digest(b" ".join(short), SEED), "big")
    bits = (tallies.reshape(8, 256) @ _BITS) * 2 > n
    return int.from_bytes(np.packbits(bits.ravel().astype(np.uint8)).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): one row per input row, fp the fingerprint's bits as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.asarray([fingerprint(t, shingle_words) for t in str_list(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")).mapInArrow(run, "doc_id long, fp long")


def _first_lists(shared: int) -> np.ndarray:
    """Per set of shared positions (a byte, the first position its highest bit) the number of
    the first list that a pair of that tally meets in; -1 if the tally is below ``shared``."""
    number = {chosen: i for i, chosen in enumerate(combinations(range(BYTES), shared))}
    sets = [[p for p in range(BYTES) if s >> (BYTES - 1 - p) & 1] for s in range(1 << BYTES)]
    return np.asarray([number.get(tuple(at[:shared]), -1) for at in sets], np.int16)


def spanning_links(members: np.ndarray, number: int, max_bits: int) -> list[tuple[int, int]]:
    """Links (a, b) of posting list ``number`` that connect all members which its pairs
    connect: a breadth-first spanning forest. Its pairs are those whose tally of shared
    positional bytes reaches the minimum, whose first list this is, and whose bits differ
    in at most ``max_bits`` places."""
    if len(members) > sum(comb(BYTES * max_bits, k) for k in range(1, max_bits + 1)):
        return _links_by_masks(members, number, max_bits)
    first = _FIRST[max_bits]
    links, rest = [], members
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            u = queue.pop()
            apart = rest ^ u
            tally = np.packbits(apart.view(np.uint8).reshape(-1, BYTES) == 0, axis=1).ravel()
            kept = np.flatnonzero(first[tally] == number)
            near = kept[np.bitwise_count(apart[kept]) <= max_bits]
            if len(near):
                found = rest[near]
                links.extend((u, v) for v in found)
                queue.extend(found)
                rest = np.delete(rest, near)
    return links


@cache
def _masks(number: int, max_bits: int) -> np.ndarray:
    """Differences of the pairs that list ``number`` retains."""
    chosen = list(combinations(range(BYTES), BYTES - max_bits))[number]
    free = [8 * p + b for p in range(BYTES) if p not in chosen for b in range(8)]
    masks = np.asarray([sum(1 << b for b in bits) for k in range(1, max_bits + 1) for bits in combinations(free, k)], np.uint64)
    tally = np.packbits(masks.view(np.uint8).reshape(-1, BYTES) == 0, axis=1).ravel()
    return masks[_FIRST[max_bits][tally] == number]


def _links_by_masks(members: np.ndarray, number: int, max_bits: int) -> list[tuple[int, int]]:
    """``spanning_links`` of a long list: every member looks its possible partners up, so the
    work grows with the list and not with its square."""
    members, masks = np.sort(members), _masks(int(number), max_bits)
    reached = np.zeros(len(members), bool)
    links = []
    for start in range(len(members)):
        queue = [] if reached[start] else [start]
        reached[start] = True
        while queue:
            u = members[queue.pop()]
            partners = u ^ masks
            at = np.minimum(np.searchsorted(members, partners), len(members) - 1)
            at = at[(members[at] == partners) & ~reached[at]]
            reached[at] = True
            links.extend((u, v) for v in members[at])
            queue.extend(at.tolist())
    return links


_FIRST = {bits: _first_lists(BYTES - bits) for bits in range(BYTES)}


def near_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links between different fingerprints that give their components.

    ``fps`` has a column fp of distinct longs. Every pair of at most ``max_bits``
    differing bits is connected by the links, and every link is such a pair.
    """
    shared = BYTES - max_bits
    masks = [sum(0xFF << 8 * p for p in chosen) for chosen in combinations(range(BYTES), shared)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    lists = F.array(*[F.struct(F.lit(i).cast("short").alias("list"), F.col("fp").bitwiseAND(F.lit(m)).alias("shared")) for i, m in enumerate(signed)])
    postings = fps.select("fp", F.explode(lists).alias("p")).select("p.list", "p.shared", "fp")
    ordered = postings.repartition("list", "shared").sortWithinPartitions("list", "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out(links):
            ab = np.asarray(links, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            number, shared_bytes, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            fp = fp.view(np.uint64)  # bits are counted, so no sign
            new = np.flatnonzero((number[1:] != number[:-1]) | (shared_bytes[1:] != shared_bytes[:-1])) + 1
            edges = np.concatenate([[0], new, [len(fp)]])
            links = []
            first_key = (number[0], shared_bytes[0])
            if held and first_key != key:
                links += spanning_links(np.concatenate(held), key[0], max_bits)
                held = []
            # lists that begin and end inside the batch
            for k in np.flatnonzero(np.diff(edges) > 1):
                if k and k < len(edges) - 2:
                    links += spanning_links(fp[edges[k] : edges[k + 1]], number[edges[k]], max_bits)
            # the first list may go on from the last batch, the last one into the next
            if len(edges) == 2:
                held.append(fp)
            else:
                if held or edges[1] > 1:
                    links += spanning_links(np.concatenate([*held, fp[: edges[1]]]), number[0], max_bits)
                held = [fp[edges[-2] :]]
            key = (number[-1], shared_bytes[-1])
            if links:
                yield out(links)
        if held:
            yield out(spanning_links(np.concatenate(held), key[0], max_bits))

    return ordered.mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    ``fingerprint`` is 16 lowercase hex digits, ``component_id`` the smallest doc_id
    that links of at most ``max_bits`` differing bits reach, the row's own included.
    Null and empty texts have fingerprint zero and link like any other; a null doc_id
    takes part but is never a component's name unless all its ids are null (then
    null); repeated rows each come out; an empty table gives an empty frame; columns
    other than the two named are ignored.
    """
    found = _components(docs, doc_id, text, shingle_words, max_bits)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _components(docs: DataFrame, doc_id: str, text: str, shingle_words: int, max_bits: int) -> DataFrame:
    """(fp, doc_id, root, component_id): as ``near_duplicates``; root, the smallest fingerprint
    of the component, tells components of one name apart."""
    rows = checkpointed(fingerprints(docs, doc_id, text, shingle_words))
    fps = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = union_min_labels(near_links(fps.select("fp"), max_bits))
    linked = checkpointed(fps.join(roots, F.col("fp") == F.col("node")).select("fp", "least", "root"))
    names = checkpointed(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")))
    named = _join_by_share(linked.select("fp", "root"), names, "root")
    table = fps.join(named, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id"))
    return _join_by_share(rows, checkpointed(table), "fp")


def _join_by_share(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each ``key`` and their number ``n``
    in ``rows``. A key that more than one in HOT_SHARE rows has goes by broadcast, as there are
    fewer than HOT_SHARE of them; the others go by shuffle."""
    most = (table.agg(F.sum("n")).first()[0] or 0) / HOT_SHARE
    hot = F.broadcast(checkpointed(table.filter(F.col("n") > most).drop("n")))
    cold = table.filter(F.col("n") <= most).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def drop_near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each component, the one of the smallest doc_id.

    All columns stay. Of rows with one id, those of one component give the row of the least
    text (then of the least row as JSON); unlike texts with one id each stay. Rows without
    doc_id cannot be told apart and all stay.
    """
    found = checkpointed(_components(docs, "doc_id", "text", shingle_words, max_bits))
    own = F.col("doc_id") == F.col("component_id")
    keep = checkpointed(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(own).alias("own")).filter("own"))
    out = docs.join(keep.filter("n = 1").select("doc_id"), "doc_id", "left_semi").select(*docs.columns).unionByName(docs.filter("doc_id is null"))
    many = keep.filter("n > 1").select("doc_id")
    if many.isEmpty():
        return out
    at, names = docs.columns.index("text"), [f"c{i}" for i in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.asarray([fingerprint(t, shingle_words) for t in str_list(b.column(at))], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps.view(np.int64))], names=[*names, "fp"])

    rows = docs.join(many, "doc_id", "left_semi").select(*docs.columns).toDF(*names)
    rows = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("fp", LongType())]))
    named = found.filter(own).select("doc_id", "fp", "root").distinct()
    joined = rows.join(named, (rows[names[docs.columns.index("doc_id")]].cast("long") == named["doc_id"]) & (rows["fp"] == named["fp"]))
    whole = F.struct(*names)
    first = joined.groupBy("doc_id", "root").agg(F.min_by(whole, F.struct(names[at], F.to_json(whole))).alias("r"))
    return out.unionByName(first.select(*[F.col(f"r.{n}").alias(c) for n, c in zip(names, docs.columns)]))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
