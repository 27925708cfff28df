"""Repeated passages across documents, by bucket-pointer refinement of suffixes.

A byte is removed if it lies in a string of ``length`` bytes (50) that also starts
in a document with a smaller id. Suffixes are sorted only where a repeat is possible,
and every task sorts a bounded share:

1. *Sampled offsets.* The smallest hashed 24-gram of each 50-byte window is its
   anchor; equal windows have equal anchors at equal offsets. Documents are dealt
   into blocks of some megabytes; a block sends the names of its distinct anchors (hashes of
   some 40 bits, with a document count) to the name's route, which answers with the anchors that
   more than one document holds.
2. *Bucket refinement.* For such anchors a block sends the distinct contexts (the
   bytes of all windows of one anchor) with the smallest and largest id of their
   documents. The route lays the contexts end to end, puts their suffixes into 8-gram
   buckets and refines the buckets by sorting on the bucket pointers 8, 16 and 18 bytes
   later, each round reading the pointers that the round before updated. A bucket of
   one member is never sorted again. After the last round a bucket is a class of equal
   50-byte strings, and the smallest id of its contexts decides.
3. *Removal.* The block gets (row, range, smallest id) back and cuts the bytes.

A passage in a third of all documents reaches a route once per block, not once per
document. Where it meets different surroundings (its edges) its anchors are hot: for
anchors in more than ``hot_documents`` documents each window is a context of its own,
dealt by its own bytes. Hash collisions only add contexts; equality is decided on bytes.

Matches never cross documents and are judged on the input. Null text is empty; texts
shorter than 50 bytes lose nothing; a null doc_id counts as larger than every id;
rows of equal doc_id do not remove each other's bytes; repeated rows each come out;
an empty table gives an empty frame; other columns pass through if named in ``keep``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubspark.llm.common import text_buffer

LENGTH = 50
GRAM = 24
BLOCK_BYTES = 4 << 20
ROUTE_BYTES = 4 << 20  # text per route; a route holds about 1/14 as many anchors
SORT_BYTES = 1 << 20  # text whose suffixes are sorted together, as whole anchors
HOT_DOCUMENTS = 1000
SLICE = 60_000  # windows handled at once; below 2^16, as a position takes 16 bits
WINDOW = LENGTH - GRAM + 1
WIDTH = LENGTH + WINDOW - 1  # longest context
NO_ID = (1 << 63) - 1
_K = np.asarray([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _words(buf: np.ndarray) -> np.ndarray:
    """Little-endian 8-byte word at every offset; ``buf`` is followed by padding."""
    return np.ndarray((len(buf) - 7,), "<u8", buffer=buf, strides=(1,))


def block_anchors(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lo, hi, hash) of every run of windows lo..hi that share one anchor."""
    n = int(offsets[-1])
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    words = _words(np.concatenate([buf[:n], np.zeros(LENGTH + 16, np.uint8)]))
    valid = np.ones(n, bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        valid[max(a, b - LENGTH + 1) : b] = False
    los, his, hashes = [], [], []
    local = np.arange(SLICE + WINDOW, dtype=np.uint64)
    high = np.uint64(0xFFFFFFFFFFFF0000)
    for s in range(0, n, SLICE):
        ok = valid[s : s + SLICE]
        if not ok.any():
            continue
        m = len(ok) + WINDOW - 1
        h = words[s : s + m] * _K[0]
        h ^= h >> np.uint64(29)
        h += words[s + 8 : s + 8 + m]
        h *= _K[1]
        h ^= h >> np.uint64(32)
        h += words[s + 16 : s + 16 + m]
        h *= _K[2]
        h ^= h >> np.uint64(31)
        h &= high
        h |= local[:m]
        span = 1
        while span * 2 <= WINDOW:
            h = np.minimum(h[:-span], h[span:])
            span *= 2
        h = np.minimum(h[: len(ok)], h[WINDOW - span : WINDOW - span + len(ok)])
        same = h[1:] == h[:-1]
        same &= ok[1:] & ok[:-1]
        first, last = ok.copy(), ok.copy()
        first[1:] &= ~same
        last[:-1] &= ~same
        at = np.flatnonzero(first)
        los.append(at + s)
        his.append(np.flatnonzero(last) + s)
        hashes.append(h[at] >> np.uint64(16))
    if not los:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    return np.concatenate(los), np.concatenate(his), np.concatenate(hashes)


def _planes(values: np.ndarray) -> bytes:
    """Sorted uint64 values as differences, byte plane by byte plane (compresses well)."""
    d = np.diff(values, prepend=np.uint64(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes()


def _values(planes: bytes) -> np.ndarray:
    d = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(d, dtype=np.uint64)


def _press(arrays: list[np.ndarray]) -> bytes:
    """Arrays of numbers, each byte plane by byte plane, compressed."""
    import zstandard

    head = np.asarray([a.nbytes for a in arrays], np.int64).tobytes()
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes() if len(a) else b"" for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(planes))


def _open(data: bytes, kinds: list) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 8 * len(kinds), []
    for size, kind in zip(np.frombuffer(raw, np.int64, len(kinds)).tolist(), kinds):
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(np.dtype(kind).itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel() if size else np.zeros(0, kind))
        at += size
    return out


def _starts(same: np.ndarray) -> np.ndarray:
    """First index of each group of a sorted sequence; same[i]: i + 1 belongs to i's group."""
    return np.flatnonzero(np.concatenate([[True], ~same]))


def equal_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group equal rows of a (n, words) uint64 matrix: (index of a member of each group, group of each row)."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h1, h2 = np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        x = (rows[:, j] ^ _K[j % 4]) * _K[(j + 1) % 4]
        x ^= x >> np.uint64(32)
        h1 = (h1 + x) * _K[0]
        h1 ^= h1 >> np.uint64(29)
        h2 = (h2 ^ x) * _K[3] + np.uint64(j)
        h2 ^= h2 >> np.uint64(31)
    order = np.lexsort((h2, h1))
    a, b = order[:-1], order[1:]
    same = (h1[a] == h1[b]) & (h2[a] == h2[b])
    at = np.flatnonzero(same)
    same[at] &= (rows[a[at]] == rows[b[at]]).all(1)
    first = _starts(same)
    group = np.empty(len(rows), np.int64)
    group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rows))))
    return order[first], group


def refine_buckets(text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bucket pointer of the suffixes at ``starts``: equal iff their first ``length`` bytes
    are. Every start must have ``length`` bytes after it; 16 <= length.

    The pointer of a suffix is the place in suffix order at which its bucket begins.
    """
    n = len(text)
    code = _words(np.concatenate([text, np.zeros(length + 8, np.uint8)]))[:n].byteswap()
    order = np.argsort(code, kind="stable")
    first = _starts(code[order[1:]] == code[order[:-1]])
    sizes = np.diff(np.append(first, n))
    pointer = np.zeros(n + length, np.int64)
    pointer[order] = np.repeat(first, sizes)
    pointer[n:] = n  # beyond the text
    active = order[np.repeat(sizes, sizes) > 1]
    depth = 8
    while depth < length and len(active):
        step = min(depth, length - depth)
        later = pointer[active + step]
        key = pointer[active] << np.int64(31) | later
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        old = pointer[active]
        bucket = _starts(old[1:] == old[:-1])
        inside = np.arange(len(active)) - np.repeat(bucket, np.diff(np.append(bucket, len(active))))
        sub = _starts(key[1:] == key[:-1])
        sizes = np.diff(np.append(sub, len(active)))
        pointer[active] = np.repeat(old[sub] + inside[sub], sizes)
        active = active[np.repeat(sizes, sizes) > 1]
        depth += step
    return pointer[starts]


class _Block:
    """Texts of one block end to end, in an order that does not depend on the shuffle."""

    def __init__(self, table: pa.Table):
        ids = pc.fill_null(table.column("_id"), NO_ID)
        order = pc.sort_indices(pa.table({"i": ids, "h": table.column("_digest")}), sort_keys=[("i", "ascending"), ("h", "ascending")])
        self.table = table.take(order)
        self.ids = np.asarray(ids.take(order), np.int64)
        self.buf, self.offsets = text_buffer(self.table.column("_text"))

    def repeated(self, answers: pa.Table, bits: int):
        """Runs whose anchor more than one document holds; hot ones window by window."""
        lo, hi, h = block_anchors(self.buf, self.offsets)
        h = _names(h, bits)
        known = [_values(x.as_py()) for x in answers.column("data")] if answers.num_rows else []
        known = np.sort(np.concatenate(known)) if known else np.zeros(0, np.uint64)
        names = known >> np.uint64(8)
        if not len(names):
            return lo[:0], hi[:0], h[:0], np.zeros(0, bool)
        at = np.minimum(np.searchsorted(names, h), len(names) - 1)
        on = names[at] == h
        lo, hi, h, hot = lo[on], hi[on], h[on], (known[at[on]] & np.uint64(1)).astype(bool)
        times = np.where(hot, hi - lo + 1, 1)
        which = np.repeat(np.arange(len(lo)), times)
        step = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        return lo[which] + step, np.where(hot[which], lo[which] + step, hi[which]), h[which], hot[which]


def name_bits(total_bytes: int) -> int:
    """Bits of an anchor's name: about 2^-12 of different anchors share one at any size."""
    return min(48, max(32, math.ceil(math.log2(total_bytes / 8 + 1)) + 12))


def _names(h: np.ndarray, bits: int) -> np.ndarray:
    """Names of anchor hashes. Anchors are the smallest hashes of their windows, so the
    hash is mixed once more; its own ranges would not be equally full."""
    return (h ^ h >> np.uint64(23)) * _K[1] >> np.uint64(64 - bits)


def _route(names: np.ndarray, bits: int, routes: int) -> np.ndarray:
    """Route of a name: a range of names, so that sorted names stay together."""
    return ((names >> np.uint64(bits - 32)) * np.uint64(routes) >> np.uint64(32)).astype(np.int64)


def _by_route(routes: np.ndarray) -> list[tuple[int, int, int]]:
    """(route, start, end) of a sorted array."""
    if not len(routes):
        return []
    first = _starts(routes[1:] == routes[:-1])
    return list(zip(routes[first].tolist(), first.tolist(), np.append(first[1:], len(routes)).tolist()))


SENT = "route long, block long, data binary"
_SENT = pa.schema([("route", pa.int64()), ("block", pa.int64()), ("data", pa.binary())])
ANSWER = "block long, data binary"
_ANSWER = pa.schema([("block", pa.int64()), ("data", pa.binary())])


def _send_anchors(routes: int, bits: int):
    def run(key, table):
        b = _Block(table)
        lo, _, h = block_anchors(b.buf, b.offsets)
        h = _names(h, bits)
        doc = np.searchsorted(b.offsets, lo, "right")
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        rows = []
        if len(h):
            first = _starts(h[1:] == h[:-1])
            change = np.concatenate([[1], (doc[1:] != doc[:-1]).astype(np.int64)])
            change[first] = 1
            docs = np.add.reduceat(change, first)
            values = h[first] << np.uint64(8) | np.minimum(docs, 255).astype(np.uint64)
            for r, a, z in _by_route(_route(h[first], bits, routes)):
                rows.append((r, key[0].as_py(), _planes(values[a:z])))
        cols = list(zip(*rows)) or [(), (), ()]
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, _SENT)], schema=_SENT)

    return run


def _answer_anchors(hot_documents: int):
    def run(key, table):
        parts = [_values(x.as_py()) for x in table.column("data")]
        values = np.concatenate(parts)
        names, docs = values >> np.uint64(8), (values & np.uint64(255)).astype(np.int64)
        order = np.argsort(names, kind="stable")
        first = _starts(names[order[1:]] == names[order[:-1]])
        total = np.add.reduceat(docs[order], first)
        per = np.empty(len(names), np.int64)
        per[order] = np.repeat(total, np.diff(np.append(first, len(names))))
        out, at = [], 0
        for block, part in zip(table.column("block").to_pylist(), parts):
            mine = per[at : at + len(part)]
            at += len(part)
            on = mine > 1
            if on.any():
                out.append((block, _planes((part[on] >> np.uint64(8)) << np.uint64(8) | (mine[on] > hot_documents).astype(np.uint64))))
        cols = list(zip(*out)) or [(), ()]
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, _ANSWER)], schema=_ANSWER)

    return run


#: what a block sends for its distinct contexts: steps of the low 24 bits of the anchor's name (they
#: only tell which contexts are sorted together), length, smallest id and span of ids, members; per
#: member row and place; bytes
_CONTEXT = [np.uint32, np.uint8, np.int64, np.int64, np.int32, np.int32, np.int64, np.uint8]
_LOW = np.uint64((1 << 24) - 1)


def _send_contexts(routes: int, bits: int):
    def run(key, table, answers):
        rows = []
        if table.num_rows and answers.num_rows:
            b = _Block(table)
            lo, hi, h, hot = b.repeated(answers, bits)
            if len(lo):
                wide = np.concatenate([b.buf, np.zeros(WIDTH + 8, np.uint8)])
                size = hi - lo + LENGTH
                step = 1 << 16
                words = np.empty((len(lo), 10), np.uint64)
                for i in range(0, len(lo), step):
                    cut = wide[lo[i : i + step, None] + np.arange(80)]
                    cut[np.arange(80) >= size[i : i + step, None]] = 0
                    words[i : i + step] = cut.view("<u8")
                words[:, 9] ^= size.astype(np.uint64) << np.uint64(56)  # beyond the widest context
                one, group = equal_rows(words)
                words[:, 9] &= np.uint64((1 << 56) - 1)
                doc = np.searchsorted(b.offsets, lo, "right") - 1
                order = np.argsort(group, kind="stable")
                first = _starts(group[order[1:]] == group[order[:-1]])
                ids = b.ids[doc[order]]
                least, most = np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)
                members = np.diff(np.append(first, len(order)))
                mix = words[one, 0]
                for j in range(1, 7):  # a hot window goes by its own 50 bytes
                    mix = (mix ^ mix >> np.uint64(31)) * _K[j % 4] + words[one, j]
                route = _route(np.where(hot[one], _names(mix, bits), h[one]), bits, routes)
                low = (h[one] & _LOW).astype(np.uint32)
                by = np.lexsort((low, route))
                flat = words.view(np.uint8).reshape(len(words), 80)
                for r, a, z in _by_route(route[by]):
                    c = by[a:z]
                    pick = np.concatenate([order[first[i] : first[i] + members[i]] for i in c.tolist()])
                    body = flat[one[c]][np.arange(80) < size[one[c], None]]
                    rows.append((r, key[0].as_py(), _press([np.diff(low[c], prepend=np.uint32(0)), size[one[c]].astype(np.uint8), least[c], most[c] - least[c], members[c].astype(np.int32), doc[pick].astype(np.int32), (lo[pick] - b.offsets[doc[pick]]).astype(np.int64), body])))
        cols = list(zip(*rows)) or [(), (), ()]
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, _SENT)], schema=_SENT)

    return run


def _ranges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Repeat index and running number inside each repeat, for counts per item."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def window_minima(h: np.ndarray, size: np.ndarray, least: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, smallest id) of every window of the contexts, in order: the least id of all
    contexts that hold the same bytes. Anchors with one distinct context need no sorting."""
    begin = np.concatenate([[0], np.cumsum(size)])
    words = np.zeros((len(size), 10), np.uint64)
    flat = words.view(np.uint8).reshape(len(size), 80)
    flat[np.arange(80) < size[:, None]] = body
    words[:, 9] ^= size.astype(np.uint64) << np.uint64(56)
    one, group = equal_rows(words)
    own = np.full(len(one), NO_ID, np.int64)
    np.minimum.at(own, group, least)
    names = h[one]
    order = np.argsort(names, kind="stable")
    first = _starts(names[order[1:]] == names[order[:-1]]) if len(names) else np.zeros(0, np.int64)
    shared = np.zeros(len(one), bool)
    if len(names):
        sizes = np.diff(np.append(first, len(names)))
        shared[order] = np.repeat(sizes, sizes) > 1
    windows = size[one] - LENGTH + 1
    lowest = np.repeat(own, windows)
    ends = np.cumsum(windows)
    pick = order[shared[order]]  # by anchor
    cut = np.cumsum(size[one[pick]]) // SORT_BYTES
    while len(pick):
        n = int(np.searchsorted(cut, cut[0], "right"))
        while n < len(pick) and names[pick[n]] == names[pick[n - 1]]:
            n += 1
        some, pick, cut = pick[:n], pick[n:], cut[n:]
        place, inner = _ranges(size[one[some]])
        text = body[begin[one[some]][place] + inner]
        at = np.cumsum(size[one[some]]) - size[one[some]]
        which, step = _ranges(windows[some])
        mine = (ends - windows)[some][which] + step
        bucket = refine_buckets(text, at[which] + step)
        by = np.argsort(bucket, kind="stable")
        head = _starts(bucket[by[1:]] == bucket[by[:-1]])
        low = np.minimum.reduceat(lowest[mine][by], head)
        lowest[mine[by]] = np.repeat(low, np.diff(np.append(head, len(by))))
    # back to the contexts as they came
    which, inner = _ranges(windows[group])
    return which, lowest[(ends - windows)[group][which] + inner]


def _answer_contexts(key, table):
    parts = [_open(x.as_py(), _CONTEXT) for x in table.column("data")]
    counts = [len(p[0]) for p in parts]
    h = np.concatenate([np.cumsum(p[0], dtype=np.uint32) for p in parts])
    _, size, least, most, members, row, place, body = (np.concatenate(c) for c in zip(*parts))
    del parts
    size = size.astype(np.int64)
    most = most + least  # a span may be beyond 2^63 and wraps back
    ctx, lowest = window_minima(h, size, least, body)
    inner = np.arange(len(ctx)) - np.searchsorted(ctx, ctx)
    # runs of windows of one context with the same smallest id, where a member has a larger one
    first = _starts((ctx[1:] == ctx[:-1]) & (lowest[1:] == lowest[:-1]))
    last = np.append(first[1:], len(ctx)) - 1
    on = lowest[first] < most[ctx[first]]
    first, last = first[on], last[on]
    c = ctx[first]
    begins = np.concatenate([[0], np.cumsum(members)])
    which, nth = _ranges(members[c])
    m = begins[c][which] + nth
    found = np.stack([row[m].astype(np.int64), place[m] + inner[first][which], place[m] + inner[last][which] + LENGTH, lowest[first][which]])
    blocks = np.repeat(np.arange(len(counts)), counts)[c][which]
    order = np.lexsort((found[1], found[0], blocks))
    names, out = table.column("block").to_pylist(), []
    for k, a, z in _by_route(blocks[order]):
        out.append((names[k], _press([np.ascontiguousarray(x) for x in found[:, order[a:z]]])))
    cols = list(zip(*out)) or [(), ()]
    return pa.table([pa.array(x, f.type) for x, f in zip(cols, _ANSWER)], schema=_ANSWER)


def _cut(names: list[str], as_text: bool):
    def run(key, table, answers):
        b = _Block(table)
        n = int(b.offsets[-1])
        depth = np.zeros(n + 1, np.int32)
        for x in answers.column("data") if answers.num_rows else []:
            row, lo, hi, least = _open(x.as_py(), [np.int64] * 4)
            on = b.ids[row] > least
            np.add.at(depth, b.offsets[row[on]] + lo[on], 1)
            np.subtract.at(depth, b.offsets[row[on]] + hi[on], 1)
        gone = np.cumsum(depth[:n], out=depth[:n]) > 0
        before = np.zeros(n + 1, np.int32)  # a block is smaller than 2 GB, as an Arrow column is
        np.cumsum(gone, out=before[1:])
        removed = before[b.offsets[1:]] - before[b.offsets[:-1]]
        head = gone.copy()  # first bytes of removed runs; a run ends with its document
        head[1:] &= ~gone[:-1]
        begin = b.offsets[:-1][(b.offsets[:-1] < b.offsets[1:])]
        head[begin] = gone[begin]
        runs = np.zeros(n + 1, np.int32)
        np.cumsum(head, out=runs[1:])
        spans = runs[b.offsets[1:]] - runs[b.offsets[:-1]]
        kept = b.buf[:n][~gone].tobytes()
        ends = (b.offsets - before[b.offsets]).tolist()
        del before, runs, depth
        made = [
            pa.array(np.diff(b.offsets), pa.int64()),
            pa.array(removed, pa.int64()),
            pa.array(spans, pa.int64()),
            pa.array([kept[a:z].decode("utf-8", "ignore") for a, z in zip(ends, ends[1:])], pa.string())
            if as_text
            else pa.array([kept[a:z] for a, z in zip(ends, ends[1:])], pa.binary()),
        ]
        cols = [b.table.column(f"_keep{i}") for i in range(len(names) - len(made))]
        return pa.table([*cols, *made], names=names)

    return run


def remove_repeats(docs: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text", hot_documents: int = HOT_DOCUMENTS, block_bytes: int = BLOCK_BYTES, as_text: bool = False) -> DataFrame:
    """The ``keep`` columns, n_bytes, n_removed, n_spans (maximal removed runs) and
    kept_bytes (the remaining bytes; they may cut a character) of every row. With
    ``as_text`` the last one is kept_text, without the bytes of cut characters."""
    made = ("n_bytes", "n_removed", "n_spans", "kept_text" if as_text else "kept_bytes")
    if clash := set(keep) & set(made):
        raise ValueError(f"columns {sorted(clash)} are both kept and made")
    spark = docs.sparkSession
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("_id"),
        body.alias("_text"),
        F.sha2(body.cast("binary"), 256).alias("_digest"),
        *[F.col(f"`{k}`").alias(f"_keep{i}") for i, k in enumerate(keep)],
    )
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    blocks = math.ceil(total / block_bytes) or 1
    routes, bits = math.ceil(total / ROUTE_BYTES) or 1, name_bits(total)
    parts = max(1, min(blocks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks // 8)))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("_id", "_digest"), F.lit(blocks))).repartition(parts, "block")

    anchors = dealt.groupBy("block").applyInArrow(_send_anchors(routes, bits), SENT)
    known = anchors.groupBy("route").applyInArrow(_answer_anchors(hot_documents), ANSWER)
    contexts = dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_send_contexts(routes, bits), SENT)
    found = contexts.groupBy("route").applyInArrow(_answer_contexts, ANSWER)
    out = T.StructType([docs.schema[k] for k in keep] + [T.StructField(k, T.LongType()) for k in made[:3]] + [T.StructField(made[3], T.StringType() if as_text else T.BinaryType())])
    return dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_cut(out.names, as_text), out)


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``; all columns and rows stay.

    Bytes of a character that a cut leaves incomplete go too. Null text stays null; a
    row that loses nothing keeps its text as it is."""
    keep = [c for c in docs.columns]
    renamed = docs.toDF(*[f"c{i}" for i in range(len(keep))])
    names = dict(zip(keep, renamed.columns))
    got = remove_repeats(renamed, renamed.columns, names["doc_id"], names["text"], as_text=True)
    shown = F.col(names["text"])
    cut = F.when(F.col("n_removed") == 0, shown).otherwise(F.col("kept_text"))
    return got.select(*[(cut if k == "text" else F.col(names[k])).alias(k) for k in keep])


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = remove_repeats(docs, ["doc_id"])
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))
