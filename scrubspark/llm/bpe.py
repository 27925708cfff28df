"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

``word_counts`` counts pre-tokenised words over the whole corpus with Spark. The
most frequent ones are compiled on the driver into a minimal acyclic automaton
whose arcs carry numbers: their sum along a word's path is the word's number, and
that number points to the word's token ids (``compile_lexicon``). The compiled
bytes are written once into the shared folder, shipped as a Spark file and
memory-mapped by every Python worker. A word that the automaton does not hold is
merged exactly by rank. Tokenizer files are read from a path that the caller gives.

Inputs may hold null, empty and very long texts, repeated rows, and columns of any
name: a null text is an empty one, an empty text gives an empty id list, rows are
handled one by one, and only the columns named in ``keep`` come out again.
"""

from __future__ import annotations

import heapq
import json
import mmap
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubspark.llm.common import small_batches, str_list
from scrubspark.session import shared_folder

LEXICON_WORDS = 50_000  # words in the automaton; a bound on its size, not on what is encoded
MEMO_WORDS = 200_000  # words in each of the two generations that a Python worker remembers
PART_CHARS = 1 << 20  # characters of text whose words are looked up together
COUNT_WORDS = 150_000  # distinct words a counting task holds before it hands them on
MODEL_BYTES = 64 << 20  # largest tokenizer file that is broadcast

# The word pattern of byte-level BPE, and its character classes up to U+024F.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
LATIN_NUMBERS = "0-9²³¹¼-¾"
WHITE = "\\t-\\r \u0085\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_latin_only = re.compile("[^\u0000-ɏ\u2010-\u2027]")


def _latin_words() -> Callable[[str], list[str]]:
    s, n = f"[{WHITE}]", f"{WHITE}{LATIN_LETTERS}{LATIN_NUMBERS}"
    return re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{LATIN_LETTERS}]+| ?[{LATIN_NUMBERS}]+| ?[^{n}]+|{s}+(?![^{WHITE}])|{s}+").findall


def _any_words() -> Callable[[str], list[str]]:
    import regex

    return regex.compile(WORD_PATTERN.replace(r"[^\s", f"[^{WHITE}").replace(r"(?!\S)", f"(?![^{WHITE}])").replace(r"\s", f"[{WHITE}]")).findall


def splitter(specials: list[str]) -> Callable[[str], list[str]]:
    """Function text -> words; a special token's string is a word of its own."""
    latin, wide = _latin_words(), _any_words()
    words = lambda t: (wide if _latin_only.search(t) else latin)(t)
    if not specials:
        return words
    parts = re.compile("(" + "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")")
    known = set(specials)

    def split(text: str) -> list[str]:
        if not any(s in text for s in known):
            return words(text)
        return [w for p in parts.split(text) for w in ([p] if p in known else words(p))]

    return split


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1
    bytes stand for themselves, the others for the letters from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


NO_PAIR = np.int64((1 << 63) - 1)
_HASH = np.asarray([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def _slots(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(keys * m >> np.uint64(64 - bits)).astype(np.int64) for m in _HASH]


def _pair_table(merges: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Hash table (pair -> rank << 32 | new id) in which a pair lies in one of its two slots."""
    bits = max(8, (4 * len(merges)).bit_length())
    keys, values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, NO_PAIR)
    names = np.asarray(list(merges), np.uint64)
    slots = dict(zip(merges, zip(*(x.tolist() for x in _slots(names, bits)))))
    at: dict[int, int] = {}  # slot -> pair
    for pair in merges:
        slot = slots[pair][0]
        for _ in range(1000):
            pair, at[slot] = at.get(slot), pair
            if pair is None:
                break
            a, b = slots[pair]
            slot = b if slot == a else a
        else:
            raise ValueError("the pair table is too full")
    for slot, pair in at.items():
        rank, new = merges[pair]
        keys[slot], values[slot] = pair, rank << 32 | new
    return keys, values


class BpeModel:
    """Vocabulary and merges of a byte-level BPE file (the ``tokenizers`` JSON form)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            raw = f.read(MODEL_BYTES + 1)
        if len(raw) > MODEL_BYTES:
            raise ValueError(f"{path} is larger than {MODEL_BYTES} bytes")
        spec = json.loads(raw)
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel":
            raise ValueError("a byte-level BPE without normalizer is needed")
        vocab, letters = spec["model"]["vocab"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.first = [vocab[c] for c in letters]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        self.pair_keys, self.pair_values = _pair_table(self.merges)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        shown = vocab | self.specials
        self.pieces = [b""] * (max(shown.values()) + 1)
        for token, k in shown.items():
            try:
                self.pieces[k] = bytes(byte_of[c] for c in token)
            except KeyError:
                self.pieces[k] = token.encode()

    def merge(self, word: str) -> list[int]:
        """Token ids of one word, by merging the lowest-ranked leftmost pair until none is left."""
        return self._merge_long([self.first[b] for b in word.encode()])

    def merge_many(self, raw: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for many words, laid end to end, at once: (ids, number of ids of each word).

        Every round merges one pair in each word; words without a pair leave the round."""
        ids = np.asarray(self.first, np.int64)[np.frombuffer(raw, np.uint8)]
        word = np.repeat(np.arange(len(lengths)), lengths)
        bits = len(self.pair_keys).bit_length() - 1
        done_ids, done_words = [], []
        while len(ids):
            key = ids.astype(np.uint64) << np.uint64(32)
            key[:-1] |= ids[1:].astype(np.uint64)
            one, two = _slots(key, bits)
            value = np.where(self.pair_keys[one] == key, self.pair_values[one], NO_PAIR)
            value = np.minimum(value, np.where(self.pair_keys[two] == key, self.pair_values[two], NO_PAIR))
            head = np.concatenate([[True], word[1:] != word[:-1]])
            value[:-1][head[1:]] = NO_PAIR  # the last letter of a word has no pair
            value[-1] = NO_PAIR
            first = np.flatnonzero(head)
            least = np.minimum.reduceat(value, first)
            size = np.diff(np.append(first, len(ids)))
            over = np.repeat(least == NO_PAIR, size)
            done_ids.append(ids[over])
            done_words.append(word[over])
            hit = np.flatnonzero((value == np.repeat(least, size)) & ~over)
            if not len(hit):
                break
            hit = hit[np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])]
            ids[hit] = value[hit] & np.int64(0xFFFFFFFF)
            stay = ~over
            stay[hit + 1] = False
            ids, word = ids[stay], word[stay]
        ids, word = np.concatenate([*done_ids, ids[:0]]), np.concatenate([*done_words, word[:0]])
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(lengths))

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges with a heap over a linked list, n log n for words of any length."""
        get, n = self.merges.get, len(ids)
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(f[0], i, ids[i], ids[i + 1], f[1]) for i in range(n - 1) if (f := get(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], live[j], after[i] = new, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (f := get(ids[k] << 32 | ids[after[k]])):
                    heapq.heappush(heap, (f[0], k, ids[k], ids[after[k]], f[1]))
        return [t for t, on in zip(ids, live) if on]


# --- the transducer ---------------------------------------------------------


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """Minimal acyclic transducer of word -> token ids, as one block of bytes.

    Words are added in sorted order; a finished state is replaced by an equal one
    that exists already, so suffixes are shared. Arc numbers count the words that
    sort before the arc's branch: their sum along the path is the word's number.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []  # (final, ((label, state), ...))

    def settle(state: list) -> int:
        key = (state[0], tuple(state[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # open states along the last word
    last = b""
    words = sorted(entries)
    for word in words:
        common = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        for depth in range(len(last), common, -1):
            path[depth - 1][1].append((last[depth - 1], settle(path[depth])))
        del path[common + 1 :]
        path.extend([False, []] for _ in word[common:])
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        path[depth - 1][1].append((last[depth - 1], settle(path[depth])))
    del path[1:]
    root = settle(path[0])

    below = [0] * len(states)  # words accepted from a state; targets always settle first
    first, labels, targets, numbers, final = [0], [], [], [], []
    for s, (is_final, arcs) in enumerate(states):
        n = int(is_final)
        for label, target in arcs:
            labels.append(label)
            targets.append(target)
            numbers.append(n)
            n += below[target]
        below[s] = n
        first.append(len(labels))
        final.append(is_final)
    outputs = [entries[w] for w in words]
    ends = np.cumsum([0, *map(len, outputs)])
    parts = [
        np.asarray([s << 8 | b for s, b in zip(np.repeat(np.arange(len(states)), np.diff(first)).tolist(), labels)], np.int64).tobytes(),
        np.asarray(targets, np.int64).tobytes(),
        np.asarray(numbers, np.int64).tobytes(),
        ends.astype(np.int64).tobytes(),
        np.asarray([i for o in outputs for i in o], np.int64).tobytes(),
        np.asarray(final, np.int64).tobytes(),
    ]
    head = np.asarray([root, *map(len, parts)], np.uint64).tobytes()
    return head + b"".join(parts)


class Lexicon:
    """Reader of a compiled lexicon over a memory-mapped file (or any buffer)."""

    def __init__(self, data):
        head = np.frombuffer(data, np.uint64, 7).tolist()
        self.root, at, parts = head[0], 56, []
        for size in head[1:]:
            parts.append(np.frombuffer(data, np.int64, size // 8, at))
            at += size
        # arcs in order of (state, letter), their targets and numbers; output ends and ids; final states
        self.arcs, self.targets, self.numbers, self.ends, self.ids, self.final = parts

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, raw: bytes, lengths: np.ndarray) -> np.ndarray:
        """Number of each word of many, laid end to end; -1 if the automaton does not hold it.

        All words take one arc a round; a word without an arc leaves."""
        letters, start = np.frombuffer(raw, np.uint8), np.cumsum(lengths) - lengths
        out = np.full(len(lengths), -1, np.int64)
        word, state, number = np.arange(len(lengths)), np.full(len(lengths), self.root), np.zeros(len(lengths), np.int64)
        depth = 0
        while len(word):
            ended = lengths[word] == depth
            good = ended & (self.final[state] > 0)
            out[word[good]] = number[good]
            word, state, number = word[~ended], state[~ended], number[~ended]
            if not len(self.arcs):
                break
            key = state << 8 | letters[start[word] + depth]
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            on = self.arcs[arc] == key
            word, number, state = word[on], number[on] + self.numbers[arc[on]], self.targets[arc[on]]
            depth += 1
        return out

    def get(self, word: bytes) -> list[int] | None:
        n = int(self.find(word, np.asarray([len(word)]))[0])
        return None if n < 0 else self.ids[self.ends[n] : self.ends[n + 1]].tolist()


# --- Spark jobs -------------------------------------------------------------


def word_counts(docs: DataFrame, specials: list[str], text: str = "text") -> DataFrame:
    """(word, n): occurrences of every pre-tokenised word in all texts. Tasks hand on
    partial counts, so a word of any frequency reaches the shuffle once per task."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = splitter(specials), Counter()
        known = set(specials)

        def out():
            keys = [w for w in seen if w not in known]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[w] for w in keys], pa.int64())], names=["word", "n"])

        for batch in batches:
            for t in str_list(batch.column(0)):
                seen.update(split(t))
                if len(seen) > COUNT_WORDS:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return docs.select(F.col(text)).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, model: BpeModel, text: str = "text", size: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words, at most ``size``, and ship the file; returns its name.

    Frequency steps (an eighth of a doubling) are taken whole from the top while they fit."""
    spark = docs.sparkSession
    # a word seen less than four times is never worth an entry, most words are such
    counts = word_counts(docs, list(model.specials), text).filter((F.col("n") >= 4) & (F.length("word") <= 64)).persist()
    steps = counts.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count(F.lit(1)).alias("words"))
    least, held = None, 0
    for r in sorted(steps.collect(), reverse=True):  # at most some hundred rows
        held += r.words
        if held > size:
            break
        least = r.step
    top = counts.filter(F.floor(F.log2("n") * 8) >= F.lit(least)) if least is not None else counts.limit(0)
    data = compile_lexicon({r.word.encode(): model.merge(r.word) for r in top.select("word").collect()})
    counts.unpersist()
    name = shared_folder(spark, "lexicon") + ".fst"
    jvm, sc = spark._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(name)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data))
    out.close()
    sc.addFile(path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString())
    return path.getName()


class Encoder:
    """Words -> packed int32 ids: the transducer's outputs, or exact merging if it has none.

    Words are remembered in two generations: when the young one is full it becomes the
    old one, so frequent words stay and memory is bounded."""

    def __init__(self, model: BpeModel, lexicon: Lexicon):
        self.model, self.lexicon = model, lexicon
        self.outputs, self.begins = lexicon.ids.astype(np.int32).tobytes(), 4 * lexicon.ends
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.split = splitter(list(model.specials))

    def learn(self, words: list[str]) -> None:
        """Put the ids of new words into the young generation."""
        todo = []
        for w in words:
            packed = self.old.get(w)
            if packed is not None:
                self.young[w] = packed
            elif w in self.model.specials:
                self.young[w] = np.asarray([self.model.specials[w]], np.int32).tobytes()
            elif len(w) > 48:
                self.young[w] = np.asarray(self.model.merge(w), np.int32).tobytes()
            else:
                todo.append(w)
        coded = [w.encode() for w in todo]
        number = self.lexicon.find(b"".join(coded), np.asarray([*map(len, coded)], np.int64))
        held = np.flatnonzero(number >= 0)
        for k, a, b in zip(held.tolist(), self.begins[number[held]].tolist(), self.begins[number[held] + 1].tolist()):
            self.young[todo[k]] = self.outputs[a:b]
        rest = np.flatnonzero(number < 0).tolist()
        raw = [coded[k] for k in rest]
        flat, counts = self.model.merge_many(b"".join(raw), np.asarray([*map(len, raw)], np.int64))
        packed, cut = flat.astype(np.int32).tobytes(), np.cumsum([0, *(4 * counts)]).tolist()
        for k, a, b in zip(rest, cut, cut[1:]):
            self.young[todo[k]] = packed[a:b]

    def encode_words(self, lists: list[list[str]]) -> list[bytes]:
        fresh = [w for w in set().union(*lists) if w not in self.young]
        if len(self.young) + len(fresh) > MEMO_WORDS:
            self.old, self.young = self.young, {}
            fresh = list(set().union(*lists))
        self.learn(fresh)
        return [b"".join(map(self.young.__getitem__, words)) for words in lists]

    def encode_array(self, texts: pa.Array) -> pa.Array:
        found, lists, held = [], [], 0
        for t in str_list(texts):
            if len(t) > PART_CHARS:  # a very long text goes in parts of its word list
                words = self.split(t)
                found += self.encode_words(lists)
                parts = (words[i : i + PART_CHARS // 8] for i in range(0, len(words), PART_CHARS // 8))
                found.append(b"".join(self.encode_words([p])[0] for p in parts))
                lists, held = [], 0
                continue
            lists.append(self.split(t))
            held += len(t)
            if held > PART_CHARS:
                found += self.encode_words(lists)
                lists, held = [], 0
        found += self.encode_words(lists)
        ends = np.cumsum([0, *map(len, found)]) // 4
        flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(found))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


def decode_array(pieces: bytes, starts: np.ndarray, lists: pa.Array) -> pa.Array:
    """Texts of id lists (null: empty); ``pieces`` are the tokens' bytes end to end."""
    counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
    flat = np.asarray(pc.list_flatten(lists), np.int64)
    data, cut, out = np.frombuffer(pieces, np.uint8), np.concatenate([[0], np.cumsum(counts)]), []
    first = 0
    while first < len(counts):  # some rows at a time, as the byte positions take 8 bytes each
        last = max(first + 1, int(np.searchsorted(cut, cut[first] + (1 << 17), "right")) - 1)
        ids = flat[cut[first] : cut[last]]
        begin, size = starts[ids], starts[ids + 1] - starts[ids]
        done = np.concatenate([[0], np.cumsum(size)])
        raw = data[np.arange(done[-1]) + np.repeat(begin - done[:-1], size)].tobytes()
        ends = done[cut[first : last + 1] - cut[first]].tolist()
        out += [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]
        first = last
    return pa.array(out, pa.string())


_encoders: dict[str, Encoder] = {}  # per Python worker


def _encoder(lexicon: str, model: BpeModel) -> Encoder:
    if lexicon not in _encoders:
        _encoders.clear()
        _encoders[lexicon] = Encoder(model, Lexicon.mapped(SparkFiles.get(lexicon)))
    return _encoders[lexicon]


def _pieces(model: BpeModel) -> tuple[bytes, np.ndarray]:
    return b"".join(model.pieces), np.cumsum([0, *map(len, model.pieces)])


def _mapped(rows: DataFrame, keep: list[str], source: str, made: list[T.StructField], make: Callable) -> DataFrame:
    """The ``keep`` columns and those that ``make`` gives for an Arrow array of ``source``."""
    if clash := set(keep) & {f.name for f in made}:
        raise ValueError(f"columns {sorted(clash)} are both kept and made")
    small_batches(rows.sparkSession)
    names = [*keep, *[f.name for f in made]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *make(batch.column(len(keep)))], names=names)

    source_last = rows.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{source}`"))
    return source_last.mapInArrow(run, T.StructType([rows.schema[k] for k in keep] + made))


def _ids(name: str) -> T.StructField:
    return T.StructField(name, T.ArrayType(T.IntegerType()))


def encode(docs: DataFrame, model: BpeModel, lexicon: str, keep: list[str], text: str = "text", ids: str = "token_ids") -> DataFrame:
    """The ``keep`` columns and ``ids``, the token ids (array of int) of each row's text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return _mapped(docs, keep, text, [_ids(ids)], lambda a: [_encoder(lexicon, shared.value).encode_array(a)])


def decode(rows: DataFrame, model: BpeModel, keep: list[str], ids: str = "token_ids", text: str = "text") -> DataFrame:
    """The ``keep`` columns and ``text``: the bytes of the ids end to end, as UTF-8 (bytes
    that are none become U+FFFD). Null id lists give empty texts; an id that the
    vocabulary lacks raises IndexError."""
    shared = rows.sparkSession.sparkContext.broadcast(_pieces(model))
    return _mapped(rows, keep, ids, [T.StructField(text, T.StringType())], lambda a: [decode_array(*shared.value, a)])


def round_trip(docs: DataFrame, model: BpeModel, lexicon: str, keep: list[str], text: str = "text", ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """``encode``, then ``decode`` of its ids, in one Python worker per task."""
    shared = docs.sparkSession.sparkContext.broadcast((model, _pieces(model)))

    def make(texts: pa.Array) -> list[pa.Array]:
        lists = _encoder(lexicon, shared.value[0]).encode_array(texts)
        return [lists, decode_array(*shared.value[1], lists)]

    return _mapped(docs, keep, text, [_ids(ids), T.StructField(decoded, T.StringType())], make)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, then
    decoded from the ids; ``with_ids`` keeps the ids as token_ids."""
    model = BpeModel(path)
    rows = round_trip(docs, model, build_lexicon(docs, model, text), [doc_id], text)
    return rows.select(
        F.col(doc_id).alias("doc_id"),
        *([F.col("token_ids")] if with_ids else []),
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_digests(docs, tokenizer_path())
