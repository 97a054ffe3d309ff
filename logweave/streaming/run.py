"""A compiled pipeline as a streaming query."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import maps, regex
from ..operators import journal
from ..operators.concat import ConcatRule
from ..plans import pipeline
from ..plans.config import PipelineSpec
from . import metrics
from .concat import stream_concat


def stitched(df: DataFrame, rules: dict[str, ConcatRule], max_len: int, wait_sec: float) -> DataFrame:
    """Records of the concat rules' tags through the stateful operator; others, and
    records that lack the text or identifier, pass.

    Fields besides the text are those every line of an identifier shares: the
    tag, the text and the identifier.
    """
    text = ident = head = None
    for tag, r in rules.items():
        here, line = F.col("tag") == tag, maps.text(F.col("message"), r.msg_key)
        one = (line, maps.text(F.col("message"), r.identifier), regex.matches(line, r.head_regexp))
        text, ident, head = (F.when(here, c) if acc is None else acc.when(here, c) for acc, c in zip((text, ident, head), one, strict=True))
    d = df.select("*", text.alias("__t"), ident.alias("__id"), F.coalesce(head, F.lit(False)).alias("__h"))
    ready = F.col("__t").isNotNull() & F.col("__id").isNotNull()
    rows = d.where(ready).select("tag", F.col("__id").alias("identifier"), "_seq", F.col("__t").alias("text"), F.col("__h").alias("head"), F.col("_ingest_ts").cast("double").alias("ts"))
    out = stream_concat(rows, max_len=max_len, wait_sec=wait_sec)
    of = lambda name: F.create_map(*[F.lit(x) for t, r in rules.items() for x in (t, getattr(r, name))])[F.col("tag")]
    msg = F.map_from_entries(F.array(F.struct(of("msg_key").alias("key"), maps.variant(F.col("text")).alias("value")), F.struct(of("identifier").alias("key"), maps.variant(F.col("identifier")).alias("value"))))
    out = out.select("tag", msg.alias("message"), F.col("_seq").alias("id"), F.slice("ids", 2, F.greatest(F.size("ids") - 1, F.lit(1))).alias("ext_ids"), "_seq", F.lit(None).cast("timestamp").alias("_ingest_ts"))
    return out.unionByName(d.where(~ready).select(*out.columns))


def _end_when_done(q: StreamingQuery) -> None:
    """Stops a query whose source is used up once no record waits in its state."""
    import threading
    import time

    def watch() -> None:
        while q.isActive:
            p = q.lastProgress
            if p and not p["numInputRows"] and not any(s["numRowsTotal"] for s in p["stateOperators"]):
                q.stop()
                return
            time.sleep(0.2)

    threading.Thread(target=watch, daemon=True).start()


def start(source: DataFrame, spec: PipelineSpec, checkpoint: str, *, processing_time: str | None = None) -> StreamingQuery:
    """Start a streaming query that filters, stitches, logs, parses and fans out.

    A batch that a sink refuses raises, so its offsets are not committed and the
    whole batch is sent again to every sink.  With a journal, records are logged
    after stitching and before parsing, in a folder of their batch, which goes when
    their ids are committed; with a new checkpoint, what an older one left
    uncommitted is sent first.  Without ``processing_time`` all that is available
    is processed, records that wait for more lines go out when idle, and the query
    ends.  Stages ``accepted`` and ``stitched`` are observed, with counts of the
    tags that sinks take.
    """
    spark = source.sparkSession
    log, first = f"{spec.journal_path}/data", zlib.crc32(checkpoint.encode()) << 31  # batches of other checkpoints have other numbers
    if spec.journal_path and not journal._glob(spark, checkpoint, "offsets")[1]:
        pipeline.replay(spark, spec)
    tags = tuple(sorted(pipeline.wanted_tags(spec)))
    df = metrics.observe(pipeline.before_concat(spec)(source), "accepted", tags)
    stateful = False
    for rules, most, wait in ((spec.concat, spec.concat_max_len, spec.concat_wait_sec), (spec.tag_concat, spec.tag_concat_max_len, spec.tag_concat_wait_sec)):
        if rules:
            if stateful:
                raise ValueError("in a stream, concat rules are either the receivers' or the tag filters'")
            df, stateful = stitched(df, rules, most, wait), True

    if stateful:
        df = metrics.observe(df, "stitched", tags)

    def batch(out: DataFrame, batch_id: int) -> None:
        out = out.persist()
        try:
            if out.isEmpty():
                return
            if spec.journal_path:
                journal.write_ahead(out, log, first + batch_id)
            outcome = pipeline.deliver(pipeline.after_concat(spec)(out), spec)
            if not outcome.committed:
                raise RuntimeError(f"batch {batch_id} was not committed: {outcome.ok}")
            if spec.journal_path:
                pipeline.commit(out, spec)
                journal.drop_batches(spark, log, f"batch={first + batch_id}")
        finally:
            out.unpersist()

    w = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(batch)
    if processing_time:
        return w.trigger(processingTime=processing_time).start()
    q = w.trigger(availableNow=True).start()
    if stateful:
        _end_when_done(q)
    return q
