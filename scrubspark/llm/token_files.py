"""Token ids in Parquet: list columns with delta or dictionary encoding, controlled row
groups and pages, page indexes, and selective reads.

``write_tokens`` puts documents in ascending id order (a range shuffle of the raw
texts), encodes them with the ``tokenizers`` library and writes one row per document:
the ids as a list column, the number of ids, where they start within their file's part
of the order, and any metadata columns. Spark's own Parquet writer does the writing, so
a lost task is written again and only committed files are read. Ids go in delta encoding (or
dictionary encoding if asked for), row groups and pages have a set size, and the page
indexes that the writer adds let a reader of a few documents fetch only their pages.

``read_tokens`` reads chosen columns and chosen documents back; filters on doc_id reach
the row groups and pages. A document's place among all ids comes from the totals per
part, which is one small row per part and read without touching an id.

Encoding goes by distinct words where the tokenizer treats words apart from each other
(``splits_at_blanks``), else by whole texts; both give what the library gives for the
whole text.

Defined results: a null text is empty and has only the end id; a null doc_id sorts
before all others; rows of one doc_id all stay, in the order of their texts' hashes; an
empty table writes a folder without rows and reads back as an empty frame; a metadata
column that has the name of one of the format's own is an error, columns not asked for
are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubspark.llm.bpe import byte_letters
from scrubspark.llm.common import small_batches, text_buffer
from scrubspark.session import shared_folder

END_ID = 1
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 500  # documents of a page, at most
MODEL_BYTES = 64 << 20  # largest tokenizer file that is sent to the tasks
MEMO_WORDS = 400_000  # words after which a worker begins its memory anew
ENCODE_BYTES = 2 << 20  # text whose words are looked up together, if one text is not longer
LIBRARY_TEXTS = 10_000  # words that go to the library at a time
OWN = ("doc_id", "part", "start_in_part", "n_tokens", "ids")

MARKS = b".,;:!?)"

# Fixed value: a pattern of words that white space always ends, and in which a mark behind a
# letter begins a word (but for the apostrophe).
WORDS_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def word_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def splits_at_blanks(spec: dict) -> bool:
    """Whether ids of a text are those of its words one after another, if it is cut at runs of
    ASCII white space: the normalizer works letter by letter (composition does not pass a
    blank), the pre-tokenizer drops all white space, and no added token holds or takes any."""
    normal = spec.get("normalizer") or {}
    steps = normal.get("normalizers", [normal] if normal else [])
    for s in steps:
        blank = s["type"] == "Replace" and s.get("pattern") == {"Regex": r"\s+"} and s.get("content") == " "
        if s["type"] not in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase") and not blank:
            return False
    before = spec.get("pre_tokenizer") or {}
    parts = before.get("pretokenizers", [before])
    first, rest = parts[0], parts[1:]
    apart = first.get("type") == "Split" and first.get("pattern") == {"Regex": WORDS_APART} and first.get("behavior") == "Removed" and first.get("invert") is True
    plain = all(p["type"] == "ByteLevel" and not p.get("add_prefix_space") and not p.get("use_regex") for p in rest)
    whole = any(a["content"].split() != [a["content"]] or a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec.get("added_tokens", []))
    return apart and plain and not whole and spec["model"].get("dropout") is None and spec.get("post_processor") is None


class Encoder:
    """Texts -> ids by the ``tokenizers`` library, without the file's truncation and padding."""

    def __init__(self, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(model)
        self.by_word = splits_at_blanks(spec)
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        self.folds = any(s["type"] == "Lowercase" for s in steps)
        self.added = [a["content"].lower().encode() for a in spec.get("added_tokens", [])]
        # a word of small Latin letters is one piece that nothing but its bytes' letters changes
        plain = all(s["type"] in ("NFC", "Lowercase", "Replace") for s in steps) and not any(a.decode().isalpha() for a in self.added)
        bytewise = [p["type"] for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])] == ["Split", "ByteLevel"]
        self.model = self.tokenizer.model if self.by_word and plain and bytewise else None
        self.letters = "".join(byte_letters())
        self.tails: dict[bytes, list[int]] = {}
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[bytes, int] = {}  # word -> its number
        self.pool = np.zeros(1 << 16, np.int32)  # ids of the words, end to end
        self.starts = np.zeros(1 << 14, np.int64)  # where each word's begin; one more for the end

    def _library(self, texts: list[str]) -> Iterator[list[int]]:
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and last - first < LIBRARY_TEXTS and size < ENCODE_BYTES:
                size += len(texts[last])
                last += 1
            for e in self.tokenizer.encode_batch_fast(texts[first:last], add_special_tokens=False):
                yield e.ids
            first = last

    def _latin(self, word: bytes) -> list[int] | None:
        """Ids of a word of small Latin letters and marks behind them; None for another."""
        core = word.rstrip(MARKS)
        text = core.decode()
        if not text.isalpha() or text != text.lower() or max(text) >= "\u0250":
            return None
        tail = word[len(core) :]
        if tail and (not text[-1].isascii()):
            return None  # kept for the library: the letter before the marks may be none to it
        ids = [t.id for t in self.model.tokenize(core.decode("latin-1").translate(self.letters))]
        if tail:
            if tail not in self.tails:
                self.tails = {} if len(self.tails) > LIBRARY_TEXTS else self.tails
                self.tails[tail] = next(self._library([tail.decode()]))
            ids += self.tails[tail]
        return ids

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of each of some different words; new ones are encoded."""
        numbers = [self.memo.get(w, -1) for w in words]
        missing = [k for k, n in enumerate(numbers) if n < 0]
        n = len(self.memo)
        if n + len(missing) >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(max(len(self.starts), len(missing) + 1), np.int64)])
        found = [self._latin(words[k]) if self.model else None for k in missing]
        rest = self._library([words[k].decode() for k, ids in zip(missing, found) if ids is None])
        end, flat, ends = int(self.starts[n]), [], []
        for ids in found:
            flat += next(rest) if ids is None else ids
            ends.append(end + len(flat))
        if end + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(flat)), np.int32)])
        self.pool[end : end + len(flat)] = flat
        self.starts[n + 1 : n + 1 + len(ends)] = ends
        for new, k in enumerate(missing, n):
            self.memo[words[k]] = numbers[k] = new
        return np.asarray(numbers, np.int64)

    def _folded(self, texts: pa.Array, raw: bytes) -> pa.Array:
        """Texts with small A-Z, so that more words are equal, if the tokenizer folds them too, no
        mark to compose is there (U+0300 to U+037F have the bytes CC and CD) and no added token
        could arise. ``raw`` holds their bytes."""
        if self.folds and b"\xcc" not in raw and b"\xcd" not in raw:
            small = raw.lower()
            if not any(a in small for a in self.added):
                return pc.ascii_lower(texts)
        return texts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the number of each text's (null: empty)."""
        texts = texts.fill_null("")
        if not self.by_word:
            each = [np.asarray(ids, np.int32) for ids in self._library(texts.to_pylist())]
            return np.concatenate([np.zeros(0, np.int32), *each]), np.asarray([len(e) for e in each], np.int64)
        flat, counts = [], np.zeros(len(texts), np.int64)
        buf, offsets = text_buffer(texts)
        first = 0
        while first < len(texts):  # some texts at a time, so that their words are few enough to hold
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + ENCODE_BYTES, "right")) - 1)
            own = self._folded(texts[first:last], buf[offsets[first] : offsets[last]].tobytes())
            words = pc.ascii_split_whitespace(own)
            coded = words.flatten().dictionary_encode()
            if len(self.memo) > MEMO_WORDS:
                self._forget()
            number = self._numbers(coded.dictionary.cast(pa.binary()).to_pylist())[coded.indices.to_numpy()]
            n = self.starts[number + 1] - self.starts[number]
            ends = np.cumsum(n)
            flat.append(self.pool[np.repeat(self.starts[number] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)])
            bounds = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())])
            counts[first:last] = np.diff(np.concatenate([[0], ends])[bounds])
            first = last
        return np.concatenate([np.zeros(0, np.int32), *flat]), counts


_encoders: dict[bytes, Encoder] = {}


def encoder_of(model: bytes) -> Encoder:
    """The worker's encoder, which a later task of the same worker finds again with its words."""
    key = hashlib.sha256(model).digest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(model)
    return _encoders[key]


def _model(path: str) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(MODEL_BYTES + 1)
    if len(raw) > MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MODEL_BYTES} bytes")
    return raw


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, metadata: list[str] | None = None, end_id: int | None = END_ID,
    encoding: str = "delta", row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS,
) -> str:
    """Write the token ids of ``docs`` (doc_id, text) in ascending doc_id order; returns ``path``.

    ``end_id`` is appended to every document (None: nothing). ``metadata`` columns go along."""
    if encoding not in ("delta", "dictionary"):
        raise ValueError("encoding must be delta or dictionary")
    metadata = metadata or []
    if clash := sorted(set(metadata) & set(OWN)) or sorted({m for m in metadata if metadata.count(m) > 1}):
        raise ValueError(f"metadata columns with names of the format or repeated: {clash}")
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(_model(tokenizer))
    keep = [docs.schema[m] for m in metadata]
    fields = [T.StructField(n, T.LongType()) for n in ("doc_id", "part", "start_in_part", "n_tokens")]
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), *keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, start, part = encoder_of(shared.value), 0, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, counts = encoder.encode(batch.column(1))
            if end_id is not None:
                flat = np.insert(flat, np.cumsum(counts), end_id)
                counts += 1
            ends = np.cumsum(counts)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat, pa.int32()))
            own = [batch.column(0), pa.array(np.full(batch.num_rows, part)), pa.array(start + ends - counts), pa.array(counts), ids]
            yield pa.RecordBatch.from_arrays([*own, *batch.columns[2:]], names=[*OWN, *metadata])
            start += int(ends[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *[F.col(f"`{m}`") for m in metadata])
    # many rows of one id are told apart by their texts, equal ones by where they lie
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text"), F.monotonically_increasing_id()]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    coded = ordered.mapInArrow(run, schema)
    listed = "ids.list.element"
    options = {
        "compression": "zstd",
        "parquet.writer.version": "v2",
        f"parquet.enable.dictionary#{listed}": str(encoding == "dictionary").lower(),
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows,
        "maxRecordsPerFile": 0,
    }
    coded.write.options(**options).parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """``columns`` (all of them by default) of the documents from id ``first`` to ``last``.

    Only these columns are read, and of the ids only pages that may hold such documents."""
    rows = spark.read.parquet(path)
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.filter(F.col("doc_id") <= last)
    return rows.select(*[f"`{c}`" for c in columns]) if columns else rows


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, before): ids of all documents in the parts before it; one row per part of the order."""
    ends = spark.read.parquet(path).groupBy("part").agg(F.max(F.col("start_in_part") + F.col("n_tokens")).alias("n"))
    rows, before = [], 0
    for r in ends.orderBy("part").collect():
        rows.append((r["part"], before))
        before += r["n"]
    return spark.createDataFrame(rows, "part bigint, before bigint")


def with_starts(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """``rows`` of ``read_tokens`` (part and start_in_part among them) with start, the number of
    ids of all documents before."""
    places = F.broadcast(part_starts(spark, path))
    return rows.join(places, "part").withColumn("start", F.col("before") + F.col("start_in_part")).drop("before")


def map_ids(rows: DataFrame, name: str, kind: str, f: Callable[[np.ndarray], int]) -> DataFrame:
    """``rows`` with the column ids replaced by a number of them, a batch of documents at a time."""
    others = [c for c in rows.columns if c != "ids"]
    schema = T.StructType([*[rows.schema[c] for c in others], T.StructField(name, T._parse_datatype_string(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(len(others))
            flat, at = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            values = pa.array([f(flat[a:b]) for a, b in zip(at, at[1:])], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], values], names=[*others, name])

    return rows.select(*[f"`{c}`" for c in others], "ids").mapInArrow(run, schema)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = write_tokens(docs, shared_folder(spark, "tokens"), word_tokenizer_path())
    rows = with_starts(spark, path, read_tokens(spark, path, ["doc_id", "part", "start_in_part", "n_tokens", "ids"]))
    crc = lambda ids: zlib.crc32(ids.astype("<u4").tobytes())
    return map_ids(rows.select("doc_id", "start", "n_tokens", "ids"), "ids_crc32", "bigint", crc)
