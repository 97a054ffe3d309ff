"""Sinks: each has a projection that can be tested, and a writer for partitions."""

from __future__ import annotations

import gzip
import json
import socket
import time
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import maps
from . import decoders


@dataclass
class Sink:
    """Where records of some tags go.  ``dry`` logs counts instead of sending."""

    name: str
    kind: str
    tags: list[str]
    options: dict = field(default_factory=dict)
    batch_size: int = 500
    dry: bool = False
    on_error: str = "fail"  # or "skip"


#: Further types of sinks: a writer gets the records of the sink's tags, and raises to refuse them.
WRITERS: dict[str, Callable[[DataFrame, Sink], None]] = {}


def register(kind: str) -> Callable:
    def take(writer: Callable[[DataFrame, Sink], None]) -> Callable[[DataFrame, Sink], None]:
        WRITERS[kind] = writer
        return writer

    return take


def to_bulk(df: DataFrame, indices: dict[str, str], tag_key: str = "tag") -> DataFrame:
    """bulk_line: action and body for a search engine's bulk API.

    The index is looked up by the field ``tag_key``, or by the tag where it is
    missing; records without an index are left out (and count as sent).
    """
    pairs = [F.lit(x) for kv in indices.items() for x in kv]
    where = F.coalesce(maps.text(F.col("message"), tag_key), F.col("tag"))
    index = F.try_element_at(F.create_map(*pairs), where)
    line = F.concat(F.lit('{"index": {"_index": "'), index, F.lit('", "_type": "logs"}}\n'), F.to_json("message"), F.lit("\n"))
    return df.where(index.isNotNull()).select(*[c for c in df.columns if c != "message"], line.alias("bulk_line"))


def to_kafka(df: DataFrame) -> DataFrame:
    return df.select(F.to_json("message").alias("value"))


def to_lines(df: DataFrame) -> DataFrame:
    return df.select("tag", "id", F.to_json("message").alias("line"))


def chunks(rows: Iterable, size: int) -> Iterator[list]:
    held: list = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield held
            held = []
    if held:
        yield held


def _retry(send: Callable[[], None], times: int = 3) -> None:
    for k in range(times):
        try:
            return send()
        except OSError:
            if k == times - 1:
                raise
            time.sleep(0.2 * (k + 1))


def _post(url: str, body: bytes, kind: str) -> None:
    headers = {"Content-Type": kind, "Content-Encoding": "gzip"}

    def send() -> None:
        with urllib.request.urlopen(urllib.request.Request(url, gzip.compress(body), headers), timeout=30) as r:
            if r.status // 100 != 2:
                raise OSError(f"status {r.status}")

    _retry(send)


def write(df: DataFrame, sink: Sink) -> None:
    """Send a batch of records.  Sinks are told apart by ``kind``."""
    df = df.where(F.col("tag").isin(*sink.tags))
    size, options = sink.batch_size, sink.options
    if sink.kind in WRITERS and not sink.dry:
        WRITERS[sink.kind](df, sink)
    elif sink.dry:
        print(f"{sink.name}: {df.count()} records, dry")
    elif sink.kind == "es":

        def bulk(rows: Iterator) -> None:
            for part in chunks((r.bulk_line for r in rows), size):
                _post(options["addr"], "".join(part).encode(), "application/x-ndjson")

        to_bulk(df, options["indices"], options.get("tag_key", "tag")).foreachPartition(bulk)
    elif sink.kind == "http":

        def post(rows: Iterator) -> None:
            for part in chunks((r.line for r in rows), size):
                _post(options["addr"], ("[" + ",".join(part) + "]").encode(), "application/json")

        to_lines(df).foreachPartition(post)
    elif sink.kind == "kafka":
        to_kafka(df).write.format("kafka").option("kafka.bootstrap.servers", options["brokers"]).option("topic", options["topic"]).option("kafka.acks", "1").save()
    elif sink.kind == "fluentd":
        host, _, port = options["addr"].rpartition(":")

        def forward(rows: Iterator) -> None:
            held: list[socket.socket] = []  # one connection for a partition, made anew after an error

            def send(body: bytes) -> None:
                try:
                    if not held:
                        held.append(socket.create_connection((host, int(port)), timeout=30))
                    held[0].sendall(body)
                except OSError:
                    for s in held:
                        s.close()
                    held.clear()
                    raise

            try:
                for r in rows:
                    _retry(lambda body=bytes(r.body): send(body))
            finally:
                for s in held:
                    s.close()

        decoders.encode_forward(df).foreachPartition(forward)
    elif sink.kind == "stdout":
        for r in to_lines(df).toLocalIterator():  # all records, a partition at a time
            print(sink.name, json.dumps({"tag": r.tag, "id": r.id}), r.line)
        if not options.get("is_commit", True):
            raise RuntimeError(f"{sink.name} does not commit")
    elif sink.kind in ("parquet", "json", "noop", "memory"):
        rows = df.withColumn("message", F.to_json("message"))
        if sink.kind == "memory":
            options["rows"] = options.get("rows", []) + rows.collect()
        else:
            w = rows.write.format(sink.kind).mode("append" if sink.kind != "noop" else "overwrite")
            w.save(options["path"]) if "path" in options else w.save()
    else:
        raise ValueError(f"sink type {sink.kind!r} is not known")
