"""WARC archives of Zstandard frames: writer and validating reader.

An archive is a skippable frame that holds the compression dictionary, then one
Zstandard frame per record. ``write_archives`` writes files into a shared
folder, ``read_archives`` reads such files with Spark's binary source, decodes
frame by frame and validates record headers, lengths and payload digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubspark.llm.common import small_batches
from scrubspark.session import shared_folder

# Fixed values of the two formats.
SKIPPABLE_MAGIC = 0x184D2A5D  # skippable frame that carries a dictionary
ZSTD_MAGIC = 0xFD2FB528
DICT_MAGIC = 0xEC30A437
WARC_VERSION = "WARC/1.1"
WARC_VERSIONS = ("WARC/1.0", "WARC/1.1")
DIGEST_BYTES = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}
RECORD_DATE = "2024-01-01T00:00:00Z"

ARCHIVE_BYTES = 32 << 20  # payload bytes per archive file
DICT_BYTES = 32 << 10
SAMPLE_BYTES = 2 << 20  # payloads at the head of an archive that its dictionary is trained on
MIN_REVISIT_BYTES = 1000
MAX_RECORD_BYTES = (1 << 31) - 1  # a binary cell holds no more
SALTS = 16


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Rows (page_id, url, html, payload_digest, payload_bytes, refers_to).

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the
    largest page_id is kept, ``refers_to`` names it on the others; it is null on
    kept rows and on smaller payloads. Null html is empty, a null page_id counts
    as smaller than any id, rows that tie on the largest page_id are all kept.
    Only digests that occur more than once are joined, over salted keys, so a
    payload that a third of all rows share is spread over many tasks.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").alias("url"),
        html.alias("html"),
        F.sha1(html.cast("binary")).alias("payload_digest"),
        F.octet_length(html).cast("long").alias("payload_bytes"),
    )
    groups = (
        base.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and keeper is not null")
        .select("payload_digest", "keeper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salted = base.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    other = ~F.col("page_id").eqNullSafe(F.col("keeper")) & F.col("keeper").isNotNull()
    return salted.join(groups.hint("shuffle_hash"), ["payload_digest", "salt"], "left").select(
        "page_id", "url", "html", "payload_digest", "payload_bytes", F.when(other, F.col("keeper")).alias("refers_to")
    )


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit carries the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", RECORD_DATE),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.append(("WARC-Refers-To", f"<urn:page:{refers_to}>"))
    named = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"{WARC_VERSION}\r\n{named}\r\n".encode() + block + b"\r\n\r\n"


def _archive(records: list[bytes]) -> bytes:
    """Dictionary frame, then a frame per record. Too few samples: empty dictionary."""
    import zstandard

    samples, size = [], 0
    for r in records:
        if size >= SAMPLE_BYTES:
            break
        samples.append(r)
        size += len(r)
    try:
        raw = zstandard.train_dictionary(DICT_BYTES, samples, k=200, d=8).as_bytes() if len(samples) > 8 else b""
    except zstandard.ZstdError:
        raw = b""
    held = zstandard.ZstdCompressor(level=9).compress(raw)
    known = zstandard.ZstdCompressionDict(raw) if raw else None
    press = zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=True, write_content_size=True)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(held)) + held + b"".join(press.compress(r) for r in records)


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> int:
    """Write rows of ``mark_revisits`` as ``*.warc.zst`` files; returns the record count.

    Rows of a partition are sorted by id, digest and url, so a retried task writes the same
    files under the same names; a file appears whole by a rename.
    """
    small_batches(records.sparkSession)
    ordered = records.sortWithinPartitions("page_id", "payload_digest", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        ctx = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        held, size, files, total = [], 0, 0, 0

        def flush():
            name = f"{root}/part-{ctx.partitionId():06d}-{files:05d}.warc.zst"
            part = f"{root}/_writing-{ctx.taskAttemptId()}-{files:05d}"
            with store.open_output_stream(part) as out:
                out.write(_archive(held))
            store.move(part, name)

        for batch in batches:
            cols = (batch.column(k).to_pylist() for k in ("page_id", "url", "html", "payload_digest", "refers_to"))
            for page_id, url, html, digest, refers_to in zip(*cols):
                held.append(_record(page_id, url, html.encode(), digest, refers_to))
                size += len(held[-1])
                if size >= archive_bytes:
                    flush()
                    total += len(held)
                    held, size, files = [], 0, files + 1
        if held:
            flush()
            total += len(held)
        yield pa.RecordBatch.from_pydict({"n": pa.array([total], pa.int64())})

    row = ordered.mapInArrow(write, "n long").agg(F.sum("n").alias("n")).first()
    return int(row["n"] or 0)


def frames(data: memoryview) -> Iterator[tuple[int, int, int]]:
    """(start, end, magic) of the frames of an archive, from frame and block headers."""
    at = 0
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError(f"truncated frame at byte {at}")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            end = at + 8 + size
        elif magic == ZSTD_MAGIC:
            flags = data[at + 4]
            single = flags >> 5 & 1
            content = (single, 2, 4, 8)[flags >> 6]
            end = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + content
            last = False
            while not last:
                if end + 3 > len(data):
                    raise ValueError(f"truncated block in the frame at byte {at}")
                block = int.from_bytes(data[end : end + 3], "little")
                last, kind = bool(block & 1), block >> 1 & 3
                end += 3 + (1 if kind == 1 else block >> 3)
            end += 4 * (flags >> 2 & 1)
        else:
            raise ValueError(f"no Zstandard frame at byte {at}")
        if end > len(data):
            raise ValueError(f"truncated frame at byte {at}")
        yield at, end, magic
        at = end


def _fields(head: bytes) -> dict[str, str]:
    """Named fields by lower-case name; folded lines are joined, the first of equal names counts."""
    out: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if not colon:
            raise ValueError("header line without a name")
        if name in out:
            name = None
        else:
            out[name] = value.strip()
    return out


def stated_digest(value: str | None) -> tuple[str, str] | None:
    """(algorithm, lower-case hex) of a labelled digest in hex, base 32 or base 64; None if it
    is absent or of an algorithm that is not known here."""
    label, _, text = (value or "").partition(":")
    algorithm = label.strip().lower().replace("-", "")
    size = DIGEST_BYTES.get(algorithm)
    if size is None:
        return None
    text = text.strip()
    if re.fullmatch(r"[0-9a-fA-F]{%d}" % (2 * size), text):
        return algorithm, text.lower()
    for decode, form in ((base64.b32decode, text.upper() + "=" * (-len(text) % 8)), (base64.b64decode, text + "=" * (-len(text) % 4))):
        try:
            raw = decode(form)
        except ValueError:
            continue
        if len(raw) == size:
            return algorithm, raw.hex()
    raise ValueError(f"unreadable digest {value!r}")


def _check_digest(what: str, stated: tuple[str, str] | None, data: bytes) -> None:
    if stated and hashlib.new(stated[0], data).hexdigest() != stated[1]:
        raise ValueError(f"{what} differs from its digest")


def parse_record(raw: bytes) -> dict:
    """Header fields and payload facts of one record; ValueError if it is not sound.

    WARC/1.0 and 1.1, field names in any case. The payload of an HTTP response is its body, that
    of other records their block. Lengths and digests that the record states are checked; the
    body's only where it is whole and not transfer-encoded. A revisit has no payload: its length
    and digest are those that it states, or null."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, _, head = head.partition(b"\r\n")
    if not gap or version.decode("latin-1").upper() not in WARC_VERSIONS:
        raise ValueError("no WARC version line")
    named = _fields(head)
    missing = [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in named]
    if missing:
        raise ValueError(f"record without {missing}")
    size = int(named["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("block length differs from Content-Length")
    block, kind = rest[:size], named["warc-type"].lower()
    stated = stated_digest(named.get("warc-payload-digest"))
    _check_digest("block", stated_digest(named.get("warc-block-digest")), block)
    body, length = block, None
    http = kind in ("response", "revisit") and named.get("content-type", "application/http").lower().startswith("application/http")
    if http and not (kind == "revisit" and not block):
        top, gap, body = block.partition(b"\r\n\r\n")
        if not gap or not top.startswith(b"HTTP/"):
            raise ValueError("no HTTP head")
        found = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", top)
        length = int(found[1]) if found else None
        coded = re.search(rb"(?im)^transfer-encoding:", top)
        if kind == "response" and not coded and "warc-truncated" not in named:
            if length is not None and len(body) != length:
                raise ValueError("payload differs from its length")
            _check_digest("payload", stated, body)
    if kind == "revisit":
        if body or not ("warc-refers-to" in named or "warc-refers-to-target-uri" in named or "warc-profile" in named):
            raise ValueError("revisit with a payload or without a target")
        digest = stated[1] if stated and stated[0] == "sha1" else None
    else:
        length, digest = len(body), hashlib.sha1(body).hexdigest()
    number = lambda s: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", s)) else None
    target = named.get("warc-refers-to") if kind == "revisit" else None
    return {
        "page_id": number(named["warc-record-id"]),
        "url": named.get("warc-target-uri"),
        "record_type": kind,
        "payload_bytes": length,
        "payload_digest": digest,
        "refers_to": number(target or ""),
        "payload": body,
        "record_id": named["warc-record-id"],
        "refers_to_id": target,
    }


def open_frame(reader, frame: bytes) -> bytes:
    """Content of one frame, of any writer: also of one that does not state its size."""
    import zstandard

    if zstandard.frame_content_size(frame) >= 0:
        return reader.decompress(frame)
    with reader.stream_reader(frame) as stream:
        parts, held = [], 0
        while part := stream.read(1 << 20):
            parts.append(part)
            held += len(part)
            if held > MAX_RECORD_BYTES:
                raise ValueError(f"record of more than {MAX_RECORD_BYTES} bytes")
    return b"".join(parts)


READ = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
    "refers_to long, payload binary, record_id string, refers_to_id string"
)


def read_archives(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """Records of all ``*.warc.zst`` files of a folder, one row each, of any record type.

    Archives of other writers are read as well: ids that are not those of pages are null in
    ``page_id`` and ``refers_to`` and found in ``record_id`` and ``refers_to_id``. A file is
    read by one task, a record is held whole.

    A damaged frame, header, length or digest raises ValueError with the file's
    path. ``payload=False`` leaves the payload column null after its check.
    """
    small_batches(spark)
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        schema = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("record_id", pa.string()), ("refers_to_id", pa.string())]
        )
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                data = memoryview(content.as_buffer())
                open_, rows, held = zstandard.ZstdDecompressor(), [], 0
                try:
                    for start, end, magic in frames(data):
                        if magic == SKIPPABLE_MAGIC and start == 0:
                            raw = bytes(data[8:end])
                            if raw[:4] == struct.pack("<I", ZSTD_MAGIC):
                                raw = zstandard.ZstdDecompressor().decompress(raw)
                            if raw:
                                open_ = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
                        elif magic == ZSTD_MAGIC:
                            rows.append(parse_record(open_frame(open_, bytes(data[start:end]))))
                            held += len(rows[-1]["payload"])
                            if not payload:
                                rows[-1]["payload"] = None
                        if held >= 8 << 20 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                except (ValueError, KeyError, zstandard.ZstdError) as exc:
                    raise ValueError(f"{path}: {exc}") from exc
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.mapInArrow(read, READ)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = shared_folder(spark, "warc")
    if not write_archives(mark_revisits(pages), folder):
        return spark.createDataFrame([], READ).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return read_archives(spark, folder, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN keeper IS NULL OR page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""
