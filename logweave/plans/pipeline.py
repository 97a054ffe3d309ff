"""A spec compiled to one DataFrame plan, and its runs in batch."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, journal
from ..operators.concat import concat_records
from ..sources import sinks
from .config import PipelineSpec


def wanted_tags(spec: PipelineSpec) -> set[str]:
    return {t for s in spec.sinks for t in s.tags}


def before_concat(spec: PipelineSpec):
    """Acceptor stage: the throttle, which counts all records, then the filters."""

    def run(df: DataFrame) -> DataFrame:
        if spec.throttle_per_sec and df.isStreaming:
            warnings.warn("is_throttle has no effect in a stream: all records pass", stacklevel=2)
        elif spec.throttle_per_sec:
            df = journal.throttle_burst(df, "_ingest_ts", "_seq", spec.throttle_per_sec, spec.throttle_max)
        return filters.acceptor_pipeline(spec.acceptor)(df)

    return run


def after_concat(spec: PipelineSpec):
    """Tag filters and post filters; tags without filters pass."""
    return filters.chain([*spec.tag_filters, *spec.post])


def concat_all(df: DataFrame, spec: PipelineSpec) -> DataFrame:
    """Rules of receivers and rules of tag filters, each with their own length and wait."""
    for rules, most, wait in ((spec.concat, spec.concat_max_len, spec.concat_wait_sec), (spec.tag_concat, spec.tag_concat_max_len, spec.tag_concat_wait_sec)):
        if rules:
            df = concat_records(df, rules, max_len=most, wait_sec=wait)
    return df


def compile_batch(spec: PipelineSpec):
    """Records in, records out: one plan, with a shuffle only for tags that are stitched."""

    def run(df: DataFrame) -> DataFrame:
        df = before_concat(spec)(df)
        if spec.concat or spec.tag_concat:
            df = concat_all(df, spec)
        return after_concat(spec)(df)

    return run


@dataclass
class Outcome:
    """Which sinks took a batch."""

    ok: dict[str, bool]

    @property
    def committed(self) -> bool:
        return all(self.ok.values())


def deliver(df: DataFrame, spec: PipelineSpec) -> Outcome:
    """Send records to every sink that takes their tag; a sink's failure fails the batch unless it may skip."""
    df = journal.stamp(df, spec.host_key).persist()
    ok = {}
    try:
        for s in spec.sinks:
            try:
                sinks.write(df, s)
                ok[s.name] = True
            except Exception as e:
                print(f"sink {s.name}: {str(e)[:300]}")
                ok[s.name] = s.on_error == "skip"
    finally:
        df.unpersist()
    return Outcome(ok)


def uncommitted(spark: SparkSession, spec: PipelineSpec) -> DataFrame | None:
    """Records of the log that no run has committed, each id once; None where there is no log."""
    log, done = f"{spec.journal_path}/data", f"{spec.journal_path}/ids"
    if not journal.next_batch(spark, log):
        return None
    df = journal.read_log(spark, log).where(F.col("id").isNotNull())
    try:
        df = journal.replay(df, spark.read.parquet(done))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    return journal.drop_replayed(df)


def commit(df: DataFrame, spec: PipelineSpec) -> None:
    """Note the ids of records that all sinks took, with the ids merged into them."""
    journal.committed_ids(df).write.mode("append").parquet(f"{spec.journal_path}/ids")


def run_batch(df: DataFrame, spec: PipelineSpec, batch_id: int | None = None) -> Outcome:
    """Log ahead, transform, deliver, commit.  Uncommitted records can be replayed.

    Without ``batch_id`` the batch comes after all of the log; a given one
    replaces that batch.  An id that several batches hold is sent once.  The log
    holds what is not yet committed: a commit covers all of it and empties it, so
    runs do not get slower with history; the ids stay.
    """
    spark = df.sparkSession
    accepted = before_concat(spec)(df)
    if spec.journal_path:
        log = f"{spec.journal_path}/data"
        journal.write_ahead(accepted, log, journal.next_batch(spark, log) if batch_id is None else batch_id)
        accepted = uncommitted(spark, spec)
    out = accepted
    if spec.concat or spec.tag_concat:
        out = concat_all(out, spec)
    outcome = deliver(after_concat(spec)(out), spec)
    if spec.journal_path and outcome.committed:
        commit(accepted, spec)
        journal.drop_batches(spark, f"{spec.journal_path}/data")
    return outcome


def replay(spark: SparkSession, spec: PipelineSpec) -> Outcome | None:
    """Deliver what a log holds uncommitted, as it was logged by a stream (stitched, not parsed)."""
    left = uncommitted(spark, spec)
    if left is None:
        return None
    outcome = deliver(after_concat(spec)(left), spec)
    if outcome.committed:
        commit(left, spec)
        journal.drop_batches(spark, f"{spec.journal_path}/data")
    return outcome
