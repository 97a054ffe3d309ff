"""Run a pipeline document on landed files: ``python -m logweave.cli --config x.yml --env sit --input DIR``.

A record's id comes from its file, when that was written, and its position there.
With a journal, files left in the folder are not sent again, and equal lines of
other files or positions are.  With ``--checkpoint`` the receivers' folders are read
as a stream.
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import maps
from .operators import journal
from .plans import config, pipeline
from .schema import configure
from .sources import decoders, readers
from .streaming import metrics, run


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--config", required=True)
    p.add_argument("--env", required=True)
    p.add_argument("--input", help="folder of text lines, one JSON record with a 'tag' field each")
    p.add_argument("--landed", action="append", default=[], metavar="NAME=DIR", help="folder with the input of one of the document's receivers")
    p.add_argument("--host", default="localhost")
    p.add_argument("--dry", action="store_true", help="count records instead of sending them")
    p.add_argument("--checkpoint", help="read --landed folders as a stream, with its progress in this folder")
    p.add_argument("--interval", help="go on, with a batch every so often ('5 seconds'); without it a stream ends when its input does")
    p.add_argument("--addr", help="host:port that answers /health, /monitor and /metrics while a stream runs")
    p.add_argument("--heartbeat", type=float, default=60, help="seconds between log lines while a stream runs")
    a = p.parse_args(argv)
    if a.checkpoint and (a.input or not a.landed):
        p.error("--checkpoint reads --landed folders")
    spark = SparkSession.builder.getOrCreate()
    configure(spark)
    spec = config.load(a.config, a.env, a.host)
    for s in spec.sinks:
        s.dry = s.dry or a.dry
    if a.checkpoint:
        return stream(spark, spec, a)
    first = 0
    if spec.journal_path and journal.next_batch(spark, f"{spec.journal_path}/data"):  # the order goes on after what is logged
        first = (journal.read_log(spark, f"{spec.journal_path}/data").agg(F.max("_seq")).first()[0] or 0) + 1
    records = []
    if a.landed:
        records.append(readers.landed_all(spark, spec, dict(x.split("=", 1) for x in a.landed), first=first))
    if a.input:
        records.append(tagged_lines(spark, a.input, first))
    if not records:
        p.error("--input or --landed is needed")
    return 0 if pipeline.run_batch(reduce(DataFrame.unionByName, records), spec).committed else 1


def stream(spark: SparkSession, spec: config.PipelineSpec, a: argparse.Namespace) -> int:
    """Runs until the stream ends; 1 if it failed."""
    registry = metrics.Registry()
    spark.streams.addListener(registry)
    server, stop = metrics.serve(registry, a.addr) if a.addr else None, metrics.heartbeat(registry, a.heartbeat)
    try:
        source = readers.landed_all(spark, spec, dict(x.split("=", 1) for x in a.landed), stream=True)
        run.start(source, spec, a.checkpoint, processing_time=a.interval).awaitTermination()
        return 0
    except StreamingQueryException as e:
        print(f"stream: {str(e)[:300]}")
        return 1
    finally:
        stop()
        if server:
            server.shutdown()
            server.server_close()


def tagged_lines(spark: SparkSession, path: str, first: int) -> DataFrame:
    """Records of JSON lines, in the order of files and lines."""
    rows = readers.placed_lines(spark, path).withColumn("message", maps.from_json(F.col("line"))).where("message is not null")
    rows = rows.withColumn("tag", F.coalesce(maps.text(F.col("message"), "tag"), F.lit(""))).withColumn("_seq", F.col("place") + first)
    return rows.select("tag", "message", decoders.with_id(rows, "file", "modified", "position").alias("id"), F.lit(None).cast("array<bigint>").alias("ext_ids"), "_seq", F.current_timestamp().alias("_ingest_ts"))


if __name__ == "__main__":
    raise SystemExit(main())
