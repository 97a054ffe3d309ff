"""Batch and streaming readers that give rows for the decoders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window as W


def lines(spark: SparkSession, path: str, *, stream: bool = False, column: str = "line") -> DataFrame:
    """Lines of text files."""
    r = spark.readStream if stream else spark.read
    return r.format("text").load(path).select(F.col("value").alias(column))


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their place: file, modified, position in the file, and
    place, a number without gaps over all files in order of modification and path.

    Positions do not depend on how files are split: the lines of each split are
    counted, and only these counts are summed up in one task.
    """
    m = F.col("_metadata")
    rows = spark.read.format("text").load(path).select(F.col("value").alias("line"), m["file_path"].alias("file"), m["file_modification_time"].alias("modified"), m["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("__i"))
    counts = rows.groupBy("file", "modified", "split").agg(F.min("__i").alias("__first"), F.count(F.lit(1)).alias("__n"))
    of_all = W.orderBy("modified", "file", "split").rowsBetween(W.unboundedPreceding, -1)
    before = lambda w: F.coalesce(F.sum("__n").over(w), F.lit(0))
    counts = counts.select("file", "modified", "split", "__first", before(of_all).alias("__all"), before(W.partitionBy("file", "modified").orderBy("split").rowsBetween(W.unboundedPreceding, -1)).alias("__own"))
    at = F.col("__i") - F.col("__first")
    return rows.join(F.broadcast(counts), ["file", "modified", "split"]).select("line", "file", "modified", (F.col("__own") + at).alias("position"), (F.col("__all") + at).alias("place"))


def bodies(spark: SparkSession, path: str, *, stream: bool = False) -> DataFrame:
    """Whole files, as a collector lands frames or request bodies."""
    r = spark.readStream.schema("path string, modificationTime timestamp, length bigint, content binary") if stream else spark.read
    return r.format("binaryFile").load(path).select("path", F.col("modificationTime").alias("_ingest_ts"), F.col("content").alias("body"))


def kafka(spark: SparkSession, brokers: str, topics: str, *, stream: bool = True, starting: str = "latest", most: int | None = None) -> DataFrame:
    """A broker's rows (needs Spark's Kafka connector on the class path)."""
    r = (spark.readStream if stream else spark.read).format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", topics).option("startingOffsets", starting if stream else "earliest")
    return (r.option("maxOffsetsPerTrigger", most) if most else r).load()


def receive(df: DataFrame, kind: str, options: dict, env: str) -> DataFrame:
    """(tag, message) and the other columns of raw rows, as a document's receiver decodes them.

    ``df`` has body (fluentd), body and env (http), value (kafka) or line (rsyslog).
    Bodies that a receiver refuses are left out.
    """
    from ..operators.filters import add_rules
    from . import decoders

    o = dict(options)
    take = lambda *names: {n: o[n] for n in names if n in o}
    if kind == "fluentd":
        out = decoders.decode_forward(df)
        if o.get("is_rewrite_tag_from_tag_key"):
            return decoders.tag_from_field(out, o["origin_rewrite_tag_key"], o.get("tag_key", "tag"))
        return decoders.stamp_tag(out, o.get("tag_key", "tag"))
    if kind == "http":
        kept = take("tag", "orig_tag", "signature_key", "signature_salt", "time_key", "time_format", "ts_regexp", "max_allowed_delay_sec", "max_allowed_ahead_sec", "max_body_byte", "tag_key")
        out = decoders.decode_http(df, env=env, **kept)
        return out.where("reject_reason is null").drop("body", "env", "reject_reason")
    if kind == "kafka":
        kept = take("is_json_format", "json_tag_key", "msg_key", "tag_key", "rewrite_tag")
        out = decoders.decode_kafka(df, tag=o.get("tags", ""), **kept).withColumn("id", F.lit(None).cast("bigint"))
        return add_rules(o.get("add") or {})(out).drop("value", "id")
    if kind == "rsyslog":
        kept = take("tag", "tag_key", "msg_key", "time_key", "new_time_key", "new_time_format", "time_shift_sec", "rewrite_tags", "year")
        return decoders.decode_syslog(df, **kept).drop("line")
    raise ValueError(f"receiver type {kind!r} is not known")


def landed(spark: SparkSession, receiver, path: str, env: str, *, stream: bool = False, first: int = 0) -> DataFrame:
    """Records of one of a document's receivers from the folder where a collector lands its input.

    fluentd: files of frames.  http: a folder for each environment of the path, with
    a body a line.  kafka and rsyslog: a value or line a line.  An id comes from the
    place in the input, so it is the same when files are read again; ``_seq`` orders
    records by the time, then the name of their files.  A stream reads each file as
    a whole, to number its lines, so files should be small there.
    """
    from .decoders import with_id

    if receiver.kind == "fluentd":
        rows = bodies(spark, path, stream=stream).withColumnRenamed("path", "file").withColumnRenamed("_ingest_ts", "modified")
        out = receive(rows.drop("length"), "fluentd", receiver.options, env).withColumnRenamed("frame_no", "position")
    else:
        name = {"http": "body", "kafka": "value", "rsyslog": "line"}[receiver.kind]
        if stream:
            m = F.col("_metadata")
            rows = spark.readStream.format("text").option("wholetext", "true").load(path).select(m["file_path"].alias("file"), m["file_modification_time"].alias("modified"), F.posexplode(F.split("value", "\r?\n")).alias("position", "line"))
            rows = rows.where("line != ''")
        else:
            rows = placed_lines(spark, path).drop("place")
        rows = rows.withColumnRenamed("line", name)
        if receiver.kind == "http":
            rows = rows.withColumn("env", F.element_at(F.split("file", "/"), -2))
        elif receiver.kind == "kafka":
            rows = rows.withColumn("value", F.col("value").cast("binary"))
        out = receive(rows, receiver.kind, receiver.options, env)
    order = F.unix_micros("modified") * 1024 + F.pmod(F.xxhash64("file"), F.lit(1024))  # files of one time by their names' hashes
    out = out.withColumn("__order", order)
    if stream:
        seq = F.col("__order") + F.col("position")
    else:
        files = out.groupBy("__order", "file").agg((F.max("position") + 1).alias("__n"))
        before = F.coalesce(F.sum("__n").over(W.orderBy("__order", "file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        out = out.join(F.broadcast(files.select("__order", "file", before.alias("__before"))), ["__order", "file"])  # a row for each file
        seq = F.col("__before") + F.col("position")
    return out.select("tag", "message", with_id(out, "file", "modified", "position").alias("id"), F.lit(None).cast("array<bigint>").alias("ext_ids"), (seq + first).alias("_seq"), F.col("modified").alias("_ingest_ts"))


def landed_all(spark: SparkSession, spec, paths: dict[str, str], *, stream: bool = False, first: int = 0) -> DataFrame:
    """Records of all receivers of a document that have a folder in ``paths`` (by name), in one DataFrame."""
    known = {r.name: r for r in spec.receivers}
    if missing := paths.keys() - known.keys():
        raise ValueError(f"no receivers named {sorted(missing)} are active")
    out = None
    for name, path in paths.items():
        one = landed(spark, known[name], path, spec.env, stream=stream, first=first)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no receiver has a folder")
    return out


class FrameSource(DataSource):
    """``spark.read.format("forward_frames").option("hex", ...)``: records of frames given as hex, ``;`` between partitions."""

    @classmethod
    def name(cls) -> str:
        return "forward_frames"

    def schema(self) -> str:
        return "tag string, record string"

    def reader(self, schema) -> DataSourceReader:
        return _FrameReader(self.options.get("hex", ""))


class _FrameReader(DataSourceReader):
    def __init__(self, text: str):
        self.parts = [p for p in text.split(";") if p]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.parts]

    def read(self, partition: InputPartition):
        import json

        from .decoders import _frames, _plain

        for tag, record in _frames(bytes.fromhex(partition.value)):
            yield tag, json.dumps(_plain(record), ensure_ascii=False)
