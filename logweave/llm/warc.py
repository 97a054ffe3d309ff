"""WARC archives in Zstandard form: one frame per record, dictionary in front.

An archive is a row (archive, content), the shape that Spark's ``binaryFile``
reader gives for ``*.warc.zst`` files, so archives can lie in any store that
Spark reads.  The first frame is skippable (magic number 0x184D2A5D) and holds
the dictionary, plain or itself a Zstandard frame; each later frame is one
record.  The reader finds frame ends by walking block headers, so it never
copies the rest of an archive, and checks headers, lengths and digests.

Defined results: a null html is an empty payload; among pages with equal
payloads those with the smallest page_id are responses, the others revisits (a
null page_id is larger than all); repeated rows give a record each; an empty
table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as K

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BadArchive(ValueError):
    """An archive or record that breaks the format."""


# --------------------------------------------------------------------------- records


def record_id(page_id: object) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def build_record(page_id: object, url: str | None, payload: bytes, refers_to: object, is_revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    uri = "".join(c if 32 < ord(c) < 127 else "".join(f"%{x:02X}" for x in c.encode("utf-8", "replace")) for c in url or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if is_revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name or name != name.strip():
            raise BadArchive(f"bad header line {line[:80]!r}")
        out[name.lower()] = value.strip()
    return out


def parse_record(raw: bytes) -> dict:
    """Fields of one record after checks of its headers, lengths and digest."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise BadArchive("no WARC header")
    h = _fields(lines[1:])
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - h.keys():
        raise BadArchive(f"missing {sorted(missing)}")
    if not h["content-length"].isdigit() or int(h["content-length"]) + 4 != len(rest) or rest[-4:] != b"\r\n\r\n":
        raise BadArchive("Content-Length is not the block's length")
    block = rest[:-4]
    http, sep, payload = block.partition(b"\r\n\r\n")
    if not sep:
        raise BadArchive("no HTTP header")
    inner = _fields(http.split(b"\r\n")[1:])
    size = int(inner.get("content-length", len(payload)))
    digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
    if h["warc-type"] == "response":
        if size != len(payload):
            raise BadArchive("the HTTP length is not the payload's")
        if digest and digest != base64.b32encode(hashlib.sha1(payload).digest()).decode():
            raise BadArchive("the payload's digest differs")
    elif h["warc-type"] == "revisit" and payload:
        raise BadArchive("a revisit with a payload")
    return {"record_id": h["warc-record-id"], "record_type": h["warc-type"], "target_uri": h.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "refers_to": h.get("warc-refers-to"), "payload": payload if h["warc-type"] == "response" else None}


# --------------------------------------------------------------------------- frames


def train(samples: list[bytes], size: int):
    """A dictionary of at most ``size`` bytes from these records.

    Where there is too little for training, the dictionary is the samples' own
    bytes, the last ones first in use, as Zstandard allows for any content.
    """
    import zstandard as Z

    fit = min(size, sum(map(len, samples)) // 16)
    if len(samples) >= 16 and fit >= 1024:
        try:
            return Z.train_dictionary(fit, samples, level=3, steps=4, d=8, k=256)
        except Z.ZstdError:  # samples without common parts
            pass
    return Z.ZstdCompressionDict(b"".join(samples)[-size:], dict_type=Z.DICT_TYPE_RAWCONTENT)


def sample(records: list[bytes], most: int, size: int) -> list[bytes]:
    """Parts of ``size`` bytes, about ``most`` of them, at equal steps through all bytes of the records."""
    total = sum(map(len, records))
    step = max(size, total // most)
    out, at, begin = [], 0, 0
    for r in records:
        while at < begin + len(r):
            out.append(r[at - begin : at - begin + size])
            at += step
        begin += len(r)
    return out


def write_archive(records: list[bytes], level: int = 3, dict_size: int = 16 << 10, most: int = 256, part: int = 4096) -> bytes:
    """A dictionary frame, then a frame per record.

    The dictionary is trained on about ``most`` parts of ``part`` bytes, taken at
    equal steps from all records and from all of each.
    """
    import zstandard as Z

    known = train(sample(records, most, part), dict_size)
    body = Z.ZstdCompressor(level=level).compress(known.as_bytes())
    c = Z.ZstdCompressor(level=level, dict_data=known, write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(body)), body, *[c.compress(r) for r in records]])


def frame_end(buf: memoryview, at: int) -> int:
    """Where the frame that begins at ``at`` ends, by its header and block headers."""
    try:
        (magic,) = struct.unpack_from("<I", buf, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            end = at + 8 + struct.unpack_from("<I", buf, at + 4)[0]
        elif magic != FRAME_MAGIC:
            raise BadArchive(f"no frame at byte {at}")
        else:
            flags = buf[at + 4]
            single = flags >> 5 & 1
            sizes = (1 if single else 0, 2, 4, 8)
            end = at + 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + sizes[flags >> 6]
            last = 0
            while not last:
                b = buf[end] | buf[end + 1] << 8 | buf[end + 2] << 16
                last, kind, size = b & 1, b >> 1 & 3, b >> 3
                if kind == 3:
                    raise BadArchive("reserved block type")
                end += 3 + (1 if kind == 1 else size)
            end += 4 * (flags >> 2 & 1)
    except (struct.error, IndexError):
        raise BadArchive("the archive is cut short") from None
    if end > len(buf):
        raise BadArchive("the archive is cut short")
    return end


def read_archive(content: bytes, most: int = 1 << 31) -> Iterator[dict]:
    """Records of an archive; one frame is decoded at a time."""
    import zstandard as Z

    buf, at, known = memoryview(content), 0, None
    if len(buf) >= 8 and struct.unpack_from("<I", buf)[0] == DICTIONARY_MAGIC:
        at = frame_end(buf, 0)
        body = bytes(buf[8:at])
        if body[:4] == struct.pack("<I", FRAME_MAGIC):
            body = Z.ZstdDecompressor().decompress(body)
        known = Z.ZstdCompressionDict(body)
    d = Z.ZstdDecompressor(dict_data=known)
    while at < len(buf):
        end = frame_end(buf, at)
        if buf[at] & 0xF0 != 0x50 or buf[at + 1] != 0x2A:  # else a skippable frame
            try:
                raw = d.decompress(buf[at:end], max_output_size=most)
            except Z.ZstdError as e:
                raise BadArchive(str(e)) from None
            yield parse_record(raw)
        at = end


# --------------------------------------------------------------------------- operators


def with_revisits(pages: DataFrame, min_bytes: int, tmp: K.Scratch) -> DataFrame:
    """page_id, url, payload, is_revisit, refers_to."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    p = pages.select("page_id", "url", payload.alias("payload")).withColumn("d", F.unhex(F.sha1("payload")))
    # only payloads that occur more than once are looked up; the counts combine before the shuffle
    many = pages.select("page_id", payload.alias("b")).where(F.octet_length("b") >= min_bytes).select("page_id", F.unhex(F.sha1("b")).alias("d"))
    many = many.groupBy("d").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("d", "first")
    p = p.join(tmp.keep(many, "repeated"), "d", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return p.select("page_id", "url", "payload", again.alias("is_revisit"), F.when(again, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, tmp: K.Scratch, min_bytes: int = 0, archive_bytes: int = 8 << 20, level: int = 3) -> DataFrame:
    """(archive, content): a record per page; an archive holds about ``archive_bytes`` before compression."""
    K.prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{k:05d}.warc.zst"]), pa.array([write_archive(held, level)], pa.binary())], ["archive", "content"])

        for b in batches:
            for i in range(b.num_rows):
                page_id, url, payload, again, first = (c[i].as_py() for c in b.columns)
                held.append(build_record(page_id, url, payload, first, again))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield done()
                    k, held, size = k + 1, [], 0
        if held:
            yield done()

    return with_revisits(pages, min_bytes, tmp).mapInArrow(K.trimmed(run), "archive string, content binary")


RECORD = "archive string, record_id string, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to string, payload binary, error string"


def read_archives(archives: DataFrame, on_error: str = "raise", payloads: bool = True) -> DataFrame:
    """A row per record of (archive, content) rows.

    ``on_error``: "raise" ends the job at a bad archive; "report" gives one row
    whose ``error`` says why the rest of that archive could not be read.
    """
    K.prepare(archives.sparkSession)
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names)

        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[dict] = []
                try:
                    for r in read_archive(content or b""):
                        r["archive"] = name
                        if not payloads:
                            r["payload"] = None
                        rows.append(r)
                        if len(rows) == 500:
                            yield table(rows)
                            rows = []
                except BadArchive as e:
                    if on_error == "raise":
                        raise
                    rows.append({"archive": name, "error": str(e)})
                if rows:
                    yield table(rows)

    return archives.select("archive", "content").mapInArrow(K.trimmed(run), RECORD)


def page_of(record: Column) -> Column:
    """The page_id in a record's id; null where it had none."""
    return F.regexp_extract(record, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
