"""Receivers' decoding steps as DataFrame functions of raw bodies.

Listening sockets stay outside Spark: a collector lands bodies as files or in a
broker, and these functions turn its rows into records, in batch or in streams.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gotime, maps, regex
from . import msgpack

#: Records, and their bytes, that a worker holds before it hands them on.
CHUNK_ROWS, CHUNK_BYTES = 2000, 1 << 20

#: The environments that a path may name.
ENVS = ("sit", "perf", "uat", "prod")


def with_id(df: DataFrame, *parts: str) -> Column:
    """An id from the place of a record at its source: the same when a task runs again."""
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 63) - 1))


# --------------------------------------------------------------------------- forward protocol


def _entries(packed: bytes) -> Iterator[object]:
    """The values of a packed frame up to a broken one."""
    at = 0
    while at < len(packed):
        try:
            e, at = msgpack.unpack(packed, at)
        except (ValueError, RecursionError):
            return
        yield e


def _frames(body: bytes) -> Iterator[tuple[str, dict]]:
    """(tag, record) of all frames; a bad frame is dropped, a broken one ends the body."""
    at = 0
    while at < len(body):
        try:
            frame, at = msgpack.unpack(body, at)
        except (ValueError, RecursionError):
            return
        if not isinstance(frame, list) or len(frame) < 2:
            continue
        tag = frame[0].decode("utf-8", "replace") if isinstance(frame[0], bytes) else frame[0]
        if not isinstance(tag, str):
            continue
        entries: Iterable[object] = []
        if isinstance(frame[1], list):
            entries = frame[1]
        elif isinstance(frame[1], (bytes, str)):
            entries = _entries(frame[1] if isinstance(frame[1], bytes) else frame[1].encode())
        elif len(frame) > 2:
            entries = [[frame[1], frame[2]]]
        for e in entries:
            if isinstance(e, list) and len(e) > 1 and isinstance(e[1], dict):
                yield tag, e[1]


def _plain(v: object) -> object:
    if isinstance(v, bytes):
        return v.decode("utf-8", "replace")
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    return [_plain(x) for x in v] if isinstance(v, list) else v


def decode_forward(df: DataFrame, body: str = "body") -> DataFrame:
    """(tag, message, frame_no) and the other columns, a row per record of the frames in ``body``.

    Bodies are not repeated with their records, and rows go on in small batches,
    so a worker's memory doesn't grow with the records of a partition.
    """
    out = df.withColumn("__b", F.col(body)).drop(body)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[:-1]]

    def chunk(names: list[str], kept: list[list[pa.Array]], *own: list) -> pa.RecordBatch:
        rest = [pa.concat_arrays(c) for c in zip(*kept, strict=True)]  # ``take`` would set aside the mean size of all rows for each
        new = [pa.array(x, kind) for x, kind in zip(own, (pa.string(), pa.string(), pa.int64()), strict=True)]
        return pa.RecordBatch.from_arrays([*rest, *new], [*names, "tag", "json", "frame_no"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, rest, tags, texts, nos, held = b.schema.names[:-1], [], [], [], [], 0
            for i, v in enumerate(b.columns[-1]):
                row = [c.slice(i, 1) for c in b.columns[:-1]]
                width = sum(c.nbytes for c in row)
                for n, (tag, record) in enumerate(_frames(v.as_py() or b"")):
                    rest.append(row)
                    tags.append(tag)
                    texts.append(json.dumps(_plain(record), ensure_ascii=False))
                    nos.append(n)
                    held += width + len(tag) + len(texts[-1])
                    if len(nos) >= CHUNK_ROWS or held >= CHUNK_BYTES:
                        yield chunk(names, rest, tags, texts, nos)
                        rest, tags, texts, nos, held = [], [], [], [], 0
            if nos:
                yield chunk(names, rest, tags, texts, nos)

    rows = out.mapInArrow(run, ", ".join([*kept, "tag string", "json string", "frame_no long"]))
    return rows.withColumn("message", maps.from_json(F.col("json"))).drop("json")


def encode_forward(df: DataFrame) -> DataFrame:
    """(tag, body): batch frames ``[tag, [[0, record], ...]]`` per tag and partition, at most 500 records and about 1 MB each."""

    def frames(by: dict[str, list]) -> pa.RecordBatch:
        parts = [(t, r[i : i + 500]) for t, r in by.items() for i in range(0, len(r), 500)]
        return pa.RecordBatch.from_arrays([pa.array([t for t, _ in parts], pa.string()), pa.array([msgpack.pack([t, r]) for t, r in parts], pa.binary())], ["tag", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list] = {}
            held = 0
            for tag, text in zip(b.column(0), b.column(1), strict=True):
                record = text.as_py() or "{}"
                by.setdefault(tag.as_py(), []).append([0, json.loads(record)])
                held += len(record)
                if held >= CHUNK_BYTES:
                    yield frames(by)
                    by, held = {}, 0
            if by:
                yield frames(by)

    return df.select("tag", F.to_json("message").alias("m")).mapInArrow(run, "tag string, body binary")


def tag_from_field(df: DataFrame, origin_key: str, tag_key: str = "tag") -> DataFrame:
    """The tag is taken from a field; records where it is no text are dropped."""
    df = df.where(maps.is_text(F.col("message"), origin_key)).withColumn("tag", maps.text(F.col("message"), origin_key))
    return stamp_tag(df, tag_key)


def stamp_tag(df: DataFrame, tag_key: str = "tag") -> DataFrame:
    return df.withColumn("message", maps.put(F.col("message"), {tag_key: F.col("tag")}))


# --------------------------------------------------------------------------- HTTP


def decode_http(
    df: DataFrame, *, tag: str, orig_tag: str, env: str, signature_key: str = "sig", signature_salt: str, time_key: str = "@timestamp",
    time_format: str = "2006-01-02T15:04:05.000Z", ts_regexp: str = "", max_allowed_delay_sec: int = 300,
    max_allowed_ahead_sec: int = 60, max_body_byte: int = 1 << 20, tag_key: str = "tag", now: Column | None = None, body: str = "body", path_env: str = "env",
) -> DataFrame:
    """Adds tag, message and ``reject_reason`` (null for valid bodies).

    Without ``ts_regexp`` a time must have the layout's characters, any digits for its digits.
    """
    ts_regexp = ts_regexp or f"^{re.sub('[0-9]', '[0-9]', re.escape(time_format))}$"
    msg = maps.from_json(F.col(body))
    d = df.withColumn("__m", msg)
    ts, sig = maps.text(F.col("__m"), time_key), maps.text(F.col("__m"), signature_key)
    at = F.unix_timestamp(gotime.parse(ts, time_format))
    now = F.current_timestamp() if now is None else now
    age = F.unix_timestamp(now.cast("timestamp")) - at
    rules = [
        (~F.col(path_env).isin(*ENVS), "env"), (F.octet_length(body) > max_body_byte, "size"), (F.col("__m").isNull(), "json"),
        (~maps.is_text(F.col("__m"), time_key), "time key"), (~regex.matches(ts, ts_regexp), "time format"), (~maps.is_text(F.col("__m"), signature_key), "no signature"),
        (sig != F.md5(F.concat(ts, F.lit(signature_salt)).cast("binary")), "signature"), (at.isNull(), "time"), (age > max_allowed_delay_sec, "expired"), (age < -max_allowed_ahead_sec, "from the future"),
    ]
    reason = F.coalesce(*[F.when(cond, F.lit(name)) for cond, name in rules])
    d = d.withColumn("reject_reason", reason)
    stamped = maps.put(maps.flatten(F.col("__m")), {tag_key: F.concat(F.lit(orig_tag + "."), F.col(path_env))})
    return d.select(*df.columns, F.lit(f"{tag}.{env}").alias("tag"), F.when(F.col("reject_reason").isNull(), stamped).alias("message"), "reject_reason")


# --------------------------------------------------------------------------- broker


def decode_kafka(df: DataFrame, *, tag: str, is_json_format: bool = True, json_tag_key: str = "", msg_key: str = "log", tag_key: str = "tag", rewrite_tag: str = "") -> DataFrame:
    """Records from rows with a broker source's ``value``; bad bodies are skipped.

    The message keeps the original tag; ``rewrite_tag`` names the record's own.
    """
    value = F.col("value").cast("string")
    d = df.withColumn("message", maps.from_json(value) if is_json_format else F.create_map(F.lit(msg_key), maps.variant(value))).where("message is not null")
    origin = F.lit(tag)
    if is_json_format and json_tag_key:
        d = d.where(~F.map_contains_key("message", json_tag_key) | maps.is_text(F.col("message"), json_tag_key))
        origin = F.coalesce(maps.text(F.col("message"), json_tag_key), origin)
    d = d.withColumn("tag", origin).withColumn("message", maps.put(F.col("message"), {tag_key: F.col("tag")}))
    return d.withColumn("tag", F.lit(rewrite_tag)) if rewrite_tag else d


# --------------------------------------------------------------------------- syslog

RFC3164 = r"(?s)^<(?P<priority>\d{1,3})>(?P<timestamp>[A-Z][a-z]{2} [ \d]\d \d{2}:\d{2}:\d{2}) (?P<hostname>\S+) (?P<tag>[^\s:\[]+)(?:\[(?P<pid>\d+)\])?: ?(?P<content>.*)$"
RFC5424 = r"(?s)^<(?P<priority>\d{1,3})>\d{1,2} (?P<timestamp>\S+) (?P<hostname>\S+) (?P<app_name>\S+) (?P<proc_id>\S+) (?P<msg_id>\S+) (?:-|(?P<structured_data>(?:\[[^\]]*\])+)) ?(?P<message>.*)$"


def decode_syslog(df: DataFrame, *, tag: str, tag_key: str = "tag", msg_key: str = "content", time_key: str = "timestamp", new_time_key: str = "@timestamp", new_time_format: str = "2006-01-02T15:04:05.000Z", time_shift_sec: int = 0, rewrite_tags: dict[str, str] | None = None, year: int = 1970, line: str = "line") -> DataFrame:
    """Records from lines of either syslog form; other lines are dropped.

    RFC 3164 has no year, so it is given.  A record without a time is kept.
    """
    old_ok, old = regex.extract(F.col(line), RFC3164)
    new_ok, new = regex.extract(F.col(line), RFC5424)
    d = df.withColumn("__old", old_ok).withColumn("__new", new_ok & ~old_ok).where("__old or __new")
    at = F.when(F.col("__old"), F.try_to_timestamp(F.concat(F.lit(f"{year} "), F.regexp_replace(old["timestamp"], "  ", " 0")), F.lit("yyyy MMM dd HH:mm:ss"))).otherwise(F.try_to_timestamp(new["timestamp"]))
    shown = gotime.show(F.timestamp_seconds(F.unix_millis(at) / 1000 + time_shift_sec), new_time_format)
    number = F.when(F.col("__old"), old["priority"]).otherwise(new["priority"]).cast("int")
    values: dict[str, Column] = {"priority": number, "facility": F.floor(number / 8).cast("int"), "severity": number % 8}
    for name in {*old, *new} - {"priority", "timestamp"}:
        values[name] = F.when(F.col("__old"), old.get(name, F.lit(None))).otherwise(new.get(name, F.lit(None)))
    if time_key == "timestamp":
        values[new_time_key] = shown
    text = values.pop(msg_key, None)
    if text is not None:
        values["message"] = F.coalesce(text, values["message"]) if "message" in values else text
    for a, b in (rewrite_tags or {}).items():
        if a in values:
            values[b] = values.pop(a)
    msg = maps.put(F.create_map().cast(maps.MESSAGE), {**values, tag_key: F.lit(tag)})
    return d.select(*df.columns, F.lit(tag).alias("tag"), msg.alias("message"))
