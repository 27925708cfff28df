"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit distance.

An item of n bytes may have k edits. Windows of the item's size are embedded by a random
walk (CGK): a step writes the letter under the pointer and moves on or stays by a random
bit of the step and the letter, so that a window and the item that differ by few edits
fall into step again and agree at many places. A sample is a few places of the embedding;
a window whose letters equal the item's at all places of some sample is a candidate
(bit-sampling LSH), and candidates are verified by the exact edit distance.

How many places a sample has and how many samples are drawn follows from a target recall:
for each class of lengths random edits of every kind, as many as the limit allows, are
embedded, and the most selective sampling is taken that finds ``TARGET_RECALL`` of them
(``tuned``). At 15 % edits long windows agree in few places, so their samples are short
and let many windows through to the verification. Lengths for which the target cannot be
reached have every place verified.

Embedding every window of every text would cost far more than reading it, so windows are
taken where a text can hold the item at all. Of p disjoint pieces of an item, k edits spoil
at most k: a place within the limit holds at least p - k pieces as they are, and their
diagonals (place in the text minus place in the item) differ by at most k. So places are
those where that many different pieces lie in two neighbouring cells of k + 1 diagonals;
none within the limit is missed. Items of more than ``PART`` bytes are cut into parts: one
of j parts has at most k / j of the edits, so each part is looked for with that limit.

A document is read once per ``BLOCKS_AT_ONCE`` blocks of items, by one task; a block has a
bounded size, so what is broadcast together does not grow with the table.
Letters are compared with A-Z lower-cased and each white-space byte as a blank. Null or
blank items match nothing; null texts are empty; repeated rows and ids each count; empty
tables give empty frames; columns other than those named pass through or are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubspark.llm.common import small_batches, text_buffer

MAX_EDITS = 0.15  # edits allowed, as a share of the item's bytes
ITEM_BLOCK_BYTES = 2 << 20  # text of the items that are broadcast together
PART = 400  # bytes of an item that are looked for together, at most
LONGEST = 8  # bytes of a piece, at most
SPARE_BYTES = 25  # a piece more than the edits for each so many bytes, where the size allows
BLOCKS_AT_ONCE = 4  # blocks that a task holds together
TARGET_RECALL = 0.97  # of windows with as many edits as the limit allows, of any kind
WALKS = 4  # independent embeddings of a window
MOST_SAMPLES = 512  # per walk
STEPS = 1.5  # steps of a walk for each byte of the window
TRIALS = 40  # edited windows of each kind that the sampling is judged on
END = 256  # the letter behind the end of a text
SEED = 11
HITS_AT_ONCE = 1 << 17
WINDOWS_AT_ONCE = 1 << 12
PLACES_AT_ONCE = 1 << 10
_K = np.uint64(0x9E3779B97F4A7C15)
_FOLD = bytes(32 if chr(b) in "\t\n\v\f\r " else b + 32 if 65 <= b <= 90 else b for b in range(256))


def fold(raw: bytes) -> bytes:
    return raw.translate(_FOLD)


def piece_size(size: int, limit: int) -> int:
    """Bytes of the pieces of a part: the most that leave enough pieces whole after ``limit`` edits."""
    for least in (max(1, size // SPARE_BYTES), 1):
        for q in range(min(LONGEST, size), 0, -1):
            if size // q - limit >= least:
                return q
    raise ValueError("the limit must be below the size")


@dataclass
class Pieces:
    """The pieces of one length: their bytes as numbers, and the part and place of each."""

    size: int
    table: np.ndarray  # a key with these top bits of the hash, or -1
    shift: np.uint64
    keys: np.ndarray  # different pieces, sorted
    first: np.ndarray  # (keys + 1) first posting of each
    part: np.ndarray
    place: np.ndarray
    need: int  # least need of a part that has them

    @classmethod
    def build(cls, q: int, rows: list[tuple[int, int, int]], need: np.ndarray) -> Pieces:
        rows = sorted(rows)  # (number, part, place)
        number, part, place = np.asarray([r[0] for r in rows], np.uint64), *np.asarray([r[1:] for r in rows], np.int64).T
        keys, first = np.unique(number, return_index=True)
        shift = np.uint64(64 - max(12, (16 * len(keys)).bit_length()))
        table = np.full(1 << int(64 - shift), -1, np.int32)
        table[(keys * _K >> shift).astype(np.int64)] = np.arange(len(keys))
        return cls(q, table, shift, keys, np.append(first, len(rows)), part, place, int(need[part].min()))

    def hits(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(offset, first posting, postings) of the offsets of ``buf`` that hold a piece."""
        n = len(buf) - self.size + 1
        if n <= 0:
            return (np.zeros(0, np.int64),) * 3
        padded = np.concatenate([buf, np.zeros(8, np.uint8)])
        mask = np.uint64((1 << 8 * self.size) - 1)
        kept = []
        for a in range(0, n, 1 << 18):
            b = min(n, a + (1 << 18))
            number = np.ndarray((b - a,), "<u8", buffer=padded, offset=a, strides=(1,)) & mask
            k = self.table.take((number * _K >> self.shift).view(np.int64))
            at = np.flatnonzero(k >= 0)
            number, k = number[at], k[at]
            same = self.keys[k] == number
            other = np.flatnonzero(~same)  # keys that share the top bits
            k[other] = np.minimum(np.searchsorted(self.keys, number[other]), len(self.keys) - 1)
            same[other] = self.keys[k[other]] == number[other]
            kept.append(np.stack([at[same] + a, k[same]]))
        at, k = np.concatenate(kept, axis=1)
        return at, self.first[k], self.first[k + 1] - self.first[k]


def embed(buf: np.ndarray, start: np.ndarray, end: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """(steps, windows) letters of the random walk from each ``start``; ``end`` closes its text."""
    at, out = start.copy(), np.empty((len(bits), len(start)), np.uint16)
    last = max(0, len(buf) - 1)
    for letters, moves in zip(out, bits):
        letters[:] = np.where(at < end, buf[np.minimum(at, last)], np.uint16(END)) if len(buf) else END
        at += moves[letters]
    return out


@dataclass
class Sampling:
    """Random walks and samples for windows of one class of lengths."""

    bits: np.ndarray  # (walks, steps, letters): whether the pointer moves on
    samples: np.ndarray  # (walks, samples, places) steps that are compared

    def agree(self, walk: int, texts: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which embedded windows equal the embedded item at all places of some sample."""
        same = texts == item
        on = np.ones((self.samples.shape[1], same.shape[1]), bool)
        for places in self.samples[walk].T:
            on &= same[places]
        return on.any(axis=0)


def window_step(limit: int) -> int:
    """Distance of the windows of a place; a start in between is so many edits off at most."""
    return max(1, (limit + 1) // 2)


def _edited(rng: np.random.Generator, window: np.ndarray, edits: int, kind: int, letters: np.ndarray) -> np.ndarray:
    """A window after random insertions (0), deletions (1), substitutions (2) or all of them (3)."""
    out = window.tolist()
    for _ in range(edits):
        k = kind if kind < 3 else int(rng.integers(3))
        at = int(rng.integers(len(out) + (k == 0))) if out or k == 0 else 0
        if k == 0:
            out.insert(at, int(rng.choice(letters)))
        elif out and k == 1:
            del out[at]
        elif out:
            out[at] = int(rng.choice(letters))
    return np.asarray(out, np.uint8)


def tuned(size: int, limit: int, letters: np.ndarray) -> Sampling | None:
    """The most selective sampling for windows of ``size`` bytes that finds ``TARGET_RECALL`` of
    windows with ``limit`` edits of the worst kind; None if none does."""
    rng = np.random.default_rng([SEED, size, limit])
    steps = max(2, int(STEPS * size))
    bits = np.concatenate([rng.integers(0, 2, (WALKS, steps, 256)), np.ones((WALKS, steps, 1), np.int64)], axis=2)
    half = window_step(limit) // 2
    agreement = np.zeros((4, TRIALS, WALKS))
    for kind in range(4):
        parts, starts, ends, items = [], [], [], []
        at = 0
        for _ in range(TRIALS):
            item = rng.choice(letters, size)
            whole = np.concatenate([rng.choice(letters, half + 1), _edited(rng, item, limit, kind, letters), rng.choice(letters, size)])
            starts.append(at + half + 1 + int(rng.integers(-half, half + 1)))
            at += len(whole)
            ends.append(at)
            parts.append(whole)
            items.append(item)
        text, item, place = np.concatenate(parts), np.concatenate(items), np.arange(TRIALS) * size
        for w in range(WALKS):
            same = embed(text, np.asarray(starts), np.asarray(ends), bits[w]) == embed(item, place, place + size, bits[w])
            agreement[kind, :, w] = same.mean(axis=0)
    for places in (4, 3, 2, 1):
        for samples in (2**k for k in range(3, MOST_SAMPLES.bit_length())):
            missed = np.prod((1 - agreement**places) ** samples, axis=2).mean(axis=1)
            if 1 - missed.max() >= TARGET_RECALL:
                return Sampling(bits, rng.integers(0, steps, (WALKS, samples, places)))
    return None


def size_class(size: int) -> int:
    """Lengths that share a sampling: up to a fourth more than the class before."""
    top = 8
    while top < size:
        top = -(-top * 5 // 4)
    return top


@dataclass
class ItemIndex:
    """What a task needs of a block of items: texts, parts and pieces."""

    ids: list
    texts: list[bytes]
    max_edits: list[int]
    parts: list[bytes]
    item: np.ndarray  # of each part: its item,
    lead: np.ndarray  # its place in it,
    limits: np.ndarray  # its edits,
    need: np.ndarray  # and pieces that a place of it holds at least
    pieces: list[Pieces]
    sampling: dict[tuple[int, int], Sampling | None]  # of each class of lengths and limit

    @classmethod
    def build(cls, rows: list[tuple], max_edits: float) -> ItemIndex:
        kept = [(i, t) for i, raw in rows if (t := fold((raw or "").encode())).strip()]
        texts = [t for _, t in kept]
        edits = [int(max_edits * len(t)) for t in texts]
        parts, about, found = [], [], {}
        for i, (t, k) in enumerate(zip(texts, edits)):
            count = -(-len(t) // PART)
            cuts = [j * len(t) // count for j in range(count + 1)]
            for a, b in zip(cuts, cuts[1:]):
                part, limit = t[a:b], k // count
                q = piece_size(b - a, limit)
                found.setdefault(q, []).extend((int.from_bytes(part[p : p + q], "little"), len(parts), p) for p in range(0, len(part) - q + 1, q))
                about.append((i, a, limit, len(part) // q - limit))
                parts.append(part)
        item, lead, limits, need = np.asarray(about, np.int64).reshape(-1, 4).T
        return cls([i for i, _ in kept], texts, edits, parts, item, lead, limits, need, [Pieces.build(q, found[q], need) for q in sorted(found)], {})

    def tune(self) -> ItemIndex:
        """Choose the samplings for the lengths and letters of these items."""
        letters = np.frombuffer(b"".join(self.texts), np.uint8)
        self.sampling = {c: tuned(*c, letters) for c in sorted({self.class_of(p) for p in range(len(self.parts))})}
        return self

    def class_of(self, part: int) -> tuple[int, int]:
        """The class of a part's length, and the edits that windows of the class are judged with."""
        top = size_class(len(self.parts[part]))
        return top, max(int(self.limits[part]), top * int(self.limits[part]) // max(1, len(self.parts[part])))


def near(patterns: list[bytes], which: np.ndarray, limits: np.ndarray, buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which stretches ``begin`` to ``end`` of ``buf`` hold their pattern within its limit of edits,
    exactly: bit vectors as in ``_edits_at``, in words of 64 bits, over many stretches at a time."""
    out = np.zeros(len(which), bool)
    sizes = np.asarray([len(t) for t in patterns], np.int64)[which]
    words = (sizes + 63) // 64
    order = np.lexsort((end - begin, words))
    first = 0
    while first < len(order):
        count = int(words[order[first]])
        last = min(first + max(64, WINDOWS_AT_ONCE // count), int(np.searchsorted(words[order], count, "right")))
        rows = order[first:last]
        first = last
        own, mine = np.unique(which[rows], return_inverse=True)
        where = np.zeros((len(own), 257, count), np.uint64)  # letter 256 stands past the end
        for k, i in enumerate(own.tolist()):
            t = np.frombuffer(patterns[i], np.uint8)
            at = np.arange(len(t))
            np.bitwise_or.at(where, (k, t, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
        where, mine = where.reshape(-1, count), mine * 257
        top = ((sizes[rows] - 1) % 64).astype(np.uint64)
        plus, minus = np.full((count, len(rows)), ~np.uint64(0)), np.zeros((count, len(rows)), np.uint64)
        score = sizes[rows].copy()
        best = score.copy()
        one, high = np.uint64(1), np.uint64(63)
        for j in range(int((end - begin)[rows].max(initial=0))):
            at = begin[rows] + j
            letter = np.where(at < end[rows], buf[np.minimum(at, len(buf) - 1)], 256)
            found = where[mine + letter]
            up_in = down_in = np.zeros(len(rows), np.uint64)
            for w in range(count):
                eq, p, m = found[:, w], plus[w], minus[w]
                x = eq | m
                eq = eq | down_in
                d0 = (((eq & p) + p) ^ p) | eq
                up, down = m | ~(d0 | p), p & d0
                if w == count - 1:
                    score += ((up >> top) & one).astype(np.int64) - ((down >> top) & one).astype(np.int64)
                up_out, down_out = up >> high, down >> high
                up, down = up << one | up_in, down << one | down_in
                plus[w], minus[w] = down | ~(x | up), up & x
                up_in, down_in = up_out, down_out
            np.minimum(best, score, out=best)
        out[rows] = best <= limits[rows]
    return out


def _edits_at(pattern: bytes, letters, anchored: int) -> Iterator[int]:
    """Edit distance of ``pattern`` to the text that ends at each letter, by bit vectors over
    the pattern: to the whole of it if ``anchored``, else to its best ending."""
    m, where = len(pattern), {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    for c in letters:
        eq = where.get(c, 0)
        x = eq | minus
        d0 = (((eq & plus) + plus) ^ plus) | x
        up, down = minus | (full & ~(d0 | plus)), plus & d0
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1 | anchored) & full, (down << 1) & full
        plus, minus = down | (full & ~(d0 | up)), up & d0
        yield score


def best_match(item: bytes, text: bytes, limit: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of ``item`` in ``text``; None beyond ``limit``.

    The first best end, and for it the shortest place."""
    edits, end = min(((e, j) for j, e in enumerate(_edits_at(item, text, 0), 1)), default=(len(item), 0))
    if edits > limit:
        return None
    if edits >= len(item):
        return len(item), 0, 0
    back = _edits_at(item[::-1], reversed(text[:end]), 1)
    size = next(j for j, e in enumerate(back, 1) if e == edits)
    return edits, end - size, end


def places_of(index: ItemIndex, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(part, row, low, high): where a part may start, from ``low`` to ``high``; offsets into
    ``buf`` that may lie outside their row. No place within the part's limit is left out."""
    width = index.limits + 1  # diagonals of a cell
    if not len(width):
        return np.zeros((4, 0), np.int64)
    most = int(width.max())
    begin = offsets[:-1] + np.arange(len(offsets) - 1) * (PART + 3 * most)  # rows set apart, so that none shares cells
    apart = np.repeat(begin - offsets[:-1], np.diff(offsets))
    end = len(buf) + len(offsets) * (PART + 3 * most) + PART
    cells = end // width + 3
    base = np.cumsum(cells) - cells  # first cell of each part
    span = PART + most  # bytes of a place of a part, at most
    kept = [np.zeros((4, 0), np.int64)]
    for own in index.pieces:
        at, low, times = own.hits(buf)
        bits = (PART // own.size).bit_length()
        key_of = base[own.part] << bits | own.place // own.size
        width_of, back = width[own.part], PART - own.place
        ends = np.cumsum(times)
        first = 0
        while first < len(at):  # postings of some hits at a time; slices overlap by a place
            last = int(np.searchsorted(ends, ends[first] - times[first] + HITS_AT_ONCE, "right"))
            last = max(last, int(np.searchsorted(at, at[first] + 2 * span)))
            t = times[first:last]
            post = np.arange(int(t.sum())) + np.repeat(low[first:last] - (np.cumsum(t) - t), t)
            start = np.repeat(at[first:last] + apart[at[first:last]], t) + back[post]
            key = key_of[post] + (start // width_of[post] << bits)
            key.sort()
            key = key[np.concatenate([[True], key[1:] != key[:-1]])] >> bits  # a piece counts once in a cell
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            cell, held = key[head], np.diff(np.append(head, len(key)))
            held[:-1] += np.where(cell[1:] == cell[:-1] + 1, held[1:], 0)
            some = held >= own.need
            cell, held = cell[some], held[some]
            part = np.searchsorted(base, cell, "right") - 1
            on = held >= index.need[part]
            part, cell = part[on], (cell - base[part])[on]
            row = np.searchsorted(begin, (cell + 1) * width[part] - 1, "right") - 1
            start = cell * width[part] - PART - (begin - offsets[:-1])[row]
            kept.append(np.stack([part, row, start, start + 2 * width[part] - 1]))
            if last >= len(at):
                break
            first = int(np.searchsorted(at, at[last] - span))
    return np.unique(np.concatenate(kept, axis=1), axis=1)


def candidates(index: ItemIndex, buf: np.ndarray, offsets: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which places hold a window that agrees with its part in some sample."""
    part, row, low, high = places
    on = np.zeros(len(part), bool)
    groups: dict[tuple[int, int], list[int]] = {}
    for k, p in enumerate(part.tolist()):
        groups.setdefault(index.class_of(p), []).append(k)
    for kind, own in groups.items():
        sampling = index.sampling.get(kind)
        if sampling is None:
            on[own] = True  # the exact way
            continue
        step = window_step(kind[1])
        for first in range(0, len(own), PLACES_AT_ONCE):
            at = np.asarray(own[first : first + PLACES_AT_ONCE])
            count = (high[at] - low[at]) // step + 1
            place = np.repeat(at, count)
            start = low[place] + step * (np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count))
            start, end = np.maximum(start, offsets[row[place]]), offsets[row[place] + 1]
            held, mine = np.unique(part[at], return_inverse=True)
            texts = [np.frombuffer(index.parts[p], np.uint8) for p in held.tolist()]
            ends = np.cumsum([len(t) for t in texts])
            begins, joined = np.append(0, ends[:-1]), np.concatenate(texts)
            mine = np.repeat(mine, count)
            for w, bits in enumerate(sampling.bits):
                rest = np.flatnonzero(~on[place])  # windows of places that no walk has found yet
                if not len(rest):
                    break
                item = embed(joined, begins, ends, bits)[:, mine[rest]]
                on[place[rest[sampling.agree(w, embed(buf, start[rest], end[rest], bits), item)]]] = True
    return on


def find_in(index: ItemIndex, texts: pa.Array, every_place: bool = True) -> list[tuple[int, int, int, int, int]]:
    """(row, item, edits, start, end): the best place of every item in every text that holds it;
    of equally good ones the first end, and for it the shortest place.

    ``every_place`` verifies all places that the pieces leave, without any loss: the exact
    search that the sampled one (of a tuned index) is measured against."""
    buf, offsets = text_buffer(texts)
    raw = fold(buf.tobytes())
    buf = np.frombuffer(raw, np.uint8)
    places = places_of(index, buf, offsets)
    if not every_place:
        places = places[:, candidates(index, buf, offsets, places)]
    part, row, low, high = places
    limits, sizes = index.limits[part], np.asarray([len(p) for p in index.parts], np.int64)[part]
    on = near(index.parts, part, limits, buf, np.maximum(offsets[row], low - limits), np.minimum(offsets[row + 1], high + sizes + limits))
    part, row, low, high = part[on], row[on], low[on], high[on]
    item = index.item[part]
    edits, sizes = (np.asarray(x, np.int64)[item] for x in (index.max_edits, [len(t) for t in index.texts]))
    begin = np.maximum(offsets[row], low - index.lead[part] - edits)
    end = np.minimum(offsets[row + 1], high - index.lead[part] + sizes + edits)
    stretches: list[list[int]] = []  # those of one row and item that overlap are read as one
    for r, k, a, b in sorted(zip(row.tolist(), item.tolist(), begin.tolist(), end.tolist())):
        if stretches and stretches[-1][:2] == [r, k] and a <= stretches[-1][3]:
            stretches[-1][3] = max(b, stretches[-1][3])
        else:
            stretches.append([r, k, a, b])
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for r, k, a, b in stretches:
        found = best_match(index.texts[k], raw[a:b], index.max_edits[k])
        if found:
            a -= int(offsets[r])
            place = (found[0], found[2] + a, -found[1] - a)
            best[r, k] = min(best.get((r, k), place), place)
    return [(r, k, e, -start, stop) for (r, k), (e, stop, start) in sorted(best.items())]


def _blocks(items: DataFrame, max_edits: float) -> Iterator[ItemIndex]:
    """Indexes of the items, a block of bounded size at a time."""
    rows = items.select(F.col("item_id").alias("i"), F.coalesce("text", F.lit("")).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = math.ceil(total / ITEM_BLOCK_BYTES)
    for b in range(count):
        part = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == b).select("i", "t")
        yield ItemIndex.build(sorted((tuple(r) for r in part.collect()), key=str), max_edits).tune()


def _groups(spark: SparkSession, items: DataFrame, max_edits: float) -> Iterator[list]:
    """Broadcast indexes of ``_blocks``, as many together as one pass over the texts takes."""
    group = []
    for index in _blocks(items.select(F.col("item_id").cast("long"), "text"), max_edits):
        group.append(spark.sparkContext.broadcast(index))
        if len(group) == BLOCKS_AT_ONCE:
            yield group
            group = []
    if group:
        yield group


def contaminated(docs: DataFrame, items: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """(doc_id, item_id, edits, similarity, start_byte, end_byte): for every row of ``docs`` and
    every item that it holds within the edit limit, the place of fewest edits."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = "doc_id long, item_id long, edits int, similarity double, start_byte long, end_byte long"
    source = docs.select(F.col("doc_id").cast("long"), "text")
    out = spark.createDataFrame([], schema)
    for group in _groups(spark, items, max_edits):

        def run(batches: Iterator[pa.RecordBatch], group=group) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for shared in group:
                    own = shared.value
                    rows = [(ids[r], own.ids[k], e, 1 - e / len(own.texts[k]), a, b) for r, k, e, a, b in find_in(own, batch.column(1), False)]
                    if rows:
                        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "item_id", "edits", "similarity", "start_byte", "end_byte"])

        out = out.unionByName(source.mapInArrow(run, schema))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """``docs`` without the rows that hold an item; all columns stay."""
    spark = docs.sparkSession
    small_batches(spark)
    at = docs.columns.index("text")
    for group in _groups(spark, items, max_edits):

        def run(batches: Iterator[pa.RecordBatch], group=group) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for shared in group:
                    clean[[r for r, *_ in find_in(shared.value, batch.column(at), False)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
