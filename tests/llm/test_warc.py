"""WARC archives: round trip, revisits by plain loops, damaged files, edges of input."""

import hashlib
import os
import struct
import tempfile

import pytest
import zstandard

from scrubspark.llm import warc

PAGES = "page_id long, url string, html string, salt string, keeper int"


def wanted(rows):
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        same = [i for i, _, h in rows if (h or "") == (html or "") and i is not None]
        keeper = max(same, default=None) if len(raw) >= 1000 else None
        revisit = keeper is not None and page_id != keeper
        out.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(out, key=str)


def archive(spark, rows, **more):
    folder = os.path.join(tempfile.mkdtemp(prefix="scrubspark-warc-"), "w")
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES).repartition(4)
    assert warc.write_archives(warc.mark_revisits(df), folder, **more) == len(rows)
    return folder


ROWS = [(i, f"http://x.org/{i % 7}\n?q=é", "<p>page %d é</p>" % (i % 9) * (120 if i % 3 else 10)) for i in range(60)]
ROWS += [(100, None, None), (101, "u", ""), (None, "u", "z" * 1500), (102, "u", "z" * 1500), (103, "u", "z" * 999), (104, "u", "z" * 999), (105, "u", "é" * 500), (106, "u", "é" * 500)]
ROWS += [(107, "u", "w" * 400000), (107, "u", "w" * 400000), (None, "v", "only null ids" * 100), (None, "v", "only null ids" * 100)]


def test_round_trip(spark):
    folder = archive(spark, ROWS)
    got = warc.read_archives(spark, folder).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == wanted(ROWS)
    payloads = sorted(bytes(r.payload).decode() for r in got if r.record_type == "response")
    assert set(payloads) == {h or "" for _, _, h in ROWS}
    again = {r.payload_digest: bytes(r.payload) for r in got if r.record_type == "response"}
    assert all(hashlib.sha1(p).hexdigest() == d for d, p in again.items())


def test_many_archives_and_repeated_writes(spark):
    folder = archive(spark, ROWS, archive_bytes=3000)
    names = sorted(os.listdir(folder))
    assert len(names) > 10 and not [n for n in names if n.startswith("_")]
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], PAGES).repartition(4)
    warc.write_archives(warc.mark_revisits(df), folder, archive_bytes=3000)  # a retry writes the same files
    got = warc.read_archives(spark, folder, payload=False).collect()
    assert sorted(os.listdir(folder)) == names and len(got) == len(ROWS) and all(r.payload is None for r in got)


def test_archive_form(spark):
    data = warc._archive([warc._record(i, "u", b"<p>some page</p>" * 90, hashlib.sha1(b"<p>some page</p>" * 90).hexdigest(), None) for i in range(40)])
    parts = list(warc.frames(memoryview(data)))
    assert parts[0][2] == warc.SKIPPABLE_MAGIC and len(parts) == 41
    raw = zstandard.ZstdDecompressor().decompress(data[8 : parts[0][1]])
    assert raw[:4] == struct.pack("<I", warc.DICT_MAGIC)
    open_ = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    assert [warc.parse_record(open_.decompress(data[a:b]))["page_id"] for a, b, _ in parts[1:]] == list(range(40))


@pytest.mark.parametrize("damage", ["cut", "flip", "junk"])
def test_damaged_archives_are_refused(spark, damage):
    folder = archive(spark, ROWS[:5])
    path = os.path.join(folder, sorted(os.listdir(folder))[0])
    with open(path, "rb") as f:
        data = bytearray(f.read())
    if damage == "cut":
        data = data[:-3]
    elif damage == "flip":
        data[-12] ^= 0xFF
    else:
        data += b"junk junk"
    with open(path, "wb") as f:
        f.write(data)
    with pytest.raises(Exception, match="warc.zst"):
        warc.read_archives(spark, folder).collect()


def test_record_validation():
    good = warc._record(5, "u", b"body", hashlib.sha1(b"body").hexdigest(), None)
    assert warc.parse_record(good)["payload"] == b"body"
    for bad in (good.replace(b"body", b"bodi"), good.replace(b"Content-Length: 4", b"Content-Length: 5"), good[:-2], good.replace(b"WARC/1.1", b"WARC/0.1"), good.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_empty_table(spark):
    empty = spark.createDataFrame([], PAGES)
    assert warc.mark_revisits(empty).collect() == []
    assert warc.write_archives(warc.mark_revisits(empty), os.path.join(tempfile.mkdtemp(prefix="scrubspark-warc-"), "w")) == 0


def foreign(kind, block, version="WARC/1.0", lower=False, **fields):
    named = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{kind}>", "WARC-Date": "2020-01-01T00:00:00Z", "Content-Length": str(len(block))}
    named |= {k.replace("_", "-"): v for k, v in fields.items()}
    lines = "".join(f"{k.lower() if lower else k}:{'' if lower else ' '}{v}\r\n" for k, v in named.items())
    return f"{version}\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def test_archive_of_another_writer(spark):
    import base64

    body = b"<p>hello</p>" * 20
    http = b"HTTP/1.1 200 OK\r\ncontent-length:%d\r\n\r\n" % len(body) + body
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n0\r\n\r\n"
    sha1, sha256 = hashlib.sha1(body), hashlib.sha256(body)
    kind = {"Content_Type": "application/http; msgtype=response"}
    records = [
        foreign("warcinfo", b"software: x\r\n", Content_Type="application/warc-fields"),
        foreign("request", b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http; msgtype=request"),
        foreign("metadata", b"a: b", "WARC/1.1", lower=True),
        foreign("resource", b"plain", WARC_Block_Digest="md5:" + hashlib.md5(b"plain").hexdigest()),
        foreign("response", http, lower=True, WARC_Payload_Digest="SHA-256:" + sha256.hexdigest().upper(), **kind),
        foreign("response", http, WARC_Payload_Digest="sha1:" + base64.b32encode(sha1.digest()).decode().lower(), **kind),
        foreign("response", http, WARC_Payload_Digest="crc99:abc", WARC_Target_URI="http://a/\r\n b", **kind),
        foreign("response", chunked, WARC_Payload_Digest="sha1:" + "A" * 32, **kind),
        foreign("response", b"a.org. 60 IN A 1.2.3.4", Content_Type="text/dns"),
        foreign("response", http[:-9], WARC_Truncated="length", **kind),
        foreign("revisit", b"", WARC_Refers_To_Target_URI="http://a/", **kind),
        foreign("revisit", b"HTTP/1.1 200 OK\r\n\r\n", WARC_Refers_To="<urn:uuid:response>", WARC_Payload_Digest="sha1:" + sha1.hexdigest(), **kind),
        foreign("conversion", b""),
    ]
    raw = zstandard.train_dictionary(1024, [b"WARC-Type: response %d hello there" % i for i in range(2000)]).as_bytes()
    for name, dictionary in (("raw", raw), ("none", b"")):
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(dict_data=known, write_content_size=False)
        data = struct.pack("<II", warc.SKIPPABLE_MAGIC, len(dictionary)) + dictionary if dictionary else b""
        for r in records:
            stream = press.compressobj()
            data += stream.compress(r) + stream.flush()
        data += struct.pack("<II", 0x184D2A50, 3) + b"end"  # a skippable frame of another kind
        folder = tempfile.mkdtemp(prefix="scrubspark-warc-")
        with open(os.path.join(folder, f"{name}.warc.zst"), "wb") as f:
            f.write(data)
        got = warc.read_archives(spark, folder).collect()
        assert [r.record_type for r in got] == [r.split(b"arc-type:" if b"warc-type" in r else b"WARC-Type: ")[1].split(b"\r\n")[0].strip().decode() for r in records]
        assert all(r.page_id is None and r.refers_to is None and r.record_id == f"<urn:uuid:{r.record_type}>" for r in got)
        assert [bytes(r.payload) for r in got[4:7]] == [body] * 3 and {r.payload_digest for r in got[4:7]} == {sha1.hexdigest()}
        assert got[6].url == "http://a/ b" and bytes(got[8].payload).startswith(b"a.org") and got[9].payload_bytes == len(body) - 9
        assert (got[10].payload_bytes, got[10].payload_digest) == (None, None)
        assert (got[11].payload_digest, got[11].refers_to_id) == (sha1.hexdigest(), "<urn:uuid:response>") and got[12].payload_bytes == 0


@pytest.mark.parametrize("bad", [
    foreign("response", b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nab"),
    foreign("response", b"HTTP/1.1 200 OK\r\n\r\nab", WARC_Payload_Digest="sha1:" + "0" * 40),
    foreign("resource", b"ab", WARC_Block_Digest="md5:" + "0" * 32),
    foreign("resource", b"ab", WARC_Payload_Digest="sha1:short"),
    foreign("response", b"no head", Content_Type="application/http"),
    foreign("revisit", b"HTTP/1.1 200 OK\r\n\r\nbody", WARC_Refers_To="<urn:uuid:x>"),
    foreign("revisit", b""),
    foreign("metadata", b"", "WARC/2.0"),
])
def test_unsound_foreign_records(bad):
    with pytest.raises(ValueError):
        warc.parse_record(bad)
