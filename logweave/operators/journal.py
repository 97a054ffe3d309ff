"""Write-ahead log, commits and replay; throttling and micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# --------------------------------------------------------------------------- journal


def write_ahead(df: DataFrame, path: str, batch_id: int, max_records: int = 0) -> None:
    """Append a batch to the log, one folder per tag; the same batch id overwrites itself."""
    rows = df.select("tag", "id", F.to_json("message").alias("message"), "_seq", "_ingest_ts")
    w = rows.write.mode("overwrite").option("compression", "zstd").partitionBy("tag")
    (w.option("maxRecordsPerFile", max_records) if max_records else w).parquet(f"{path}/batch={batch_id}")


def read_log(spark, path: str) -> DataFrame:
    schema = "id bigint, message string, _seq bigint, _ingest_ts timestamp, batch bigint, tag string"
    df = spark.read.schema(schema).option("basePath", path).parquet(path)
    return df.select("tag", F.from_json("message", "map<string,variant>").alias("message"), "id", F.lit(None).cast("array<bigint>").alias("ext_ids"), "_seq", "_ingest_ts")


def committed_ids(df: DataFrame) -> DataFrame:
    """Each record's id and the ids merged into it."""
    ids = F.concat(F.array("id"), F.coalesce("ext_ids", F.array().cast("array<bigint>")))
    return df.select(F.explode(ids).alias("id")).where("id is not null")


def replay(log: DataFrame, committed: DataFrame) -> DataFrame:
    """Records whose id was never committed."""
    return log.join(committed.select("id"), "id", "left_anti").select(*log.columns)


def max_id(df: DataFrame) -> DataFrame:
    return df.agg(F.max("id").alias("max_id"))


#: Fixed value: ids begin again after this one.
MAX_ROTATE_ID = 372036854775807


def next_id(df: DataFrame, max_rotate_id: int = MAX_ROTATE_ID) -> int:
    """Where ids go on after a restart."""
    return ((max_id(df).first()[0] or 0) + 1) % max_rotate_id


def drop_replayed(df: DataFrame, ttl: str | None = None) -> DataFrame:
    """One record per id; in a stream, within ``ttl`` of ``_ingest_ts``."""
    if df.isStreaming:
        return df.withWatermark("_ingest_ts", ttl or "10 minutes").dropDuplicatesWithinWatermark(["id"])
    return df.dropDuplicates(["id"])


def _glob(spark, path: str, pattern: str) -> tuple:
    """The file system and what matches below ``path``."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, [s.getPath() for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/{pattern}")) or []]


def next_batch(spark, path: str) -> int:
    """The first batch id after all of the log; 0 where there is no log."""
    return max([-1, *(int(p.getName().partition("=")[2]) for p in _glob(spark, path, "batch=*")[1])]) + 1


def drop_batches(spark, path: str, which: str = "batch=*") -> None:
    """Remove all of the log, or one batch, once its records are committed."""
    fs, found = _glob(spark, path, which)
    for p in found:
        fs.delete(p, True)


def drop_tag(spark, path: str, tag: str) -> None:
    """Remove one tag's folders from the log."""
    fs, found = _glob(spark, path, f"batch=*/tag={tag}")
    for p in found:
        fs.delete(p, True)


# --------------------------------------------------------------------------- producer


def stamp(df: DataFrame, host_key: str) -> DataFrame:
    """msgid = host key, a dash and the id."""
    msgid = F.concat(F.lit(host_key + "-"), F.col("id").cast("string"))
    return df.withColumn("message", F.map_concat("message", F.create_map(F.lit("msgid"), msgid.cast("variant"))))


def commit_barrier(results: DataFrame, key: str = "id", ok: str = "ok") -> DataFrame:
    """(key, n_sinks, committed): committed if every sink's result is good."""
    return results.groupBy(key).agg(F.count(F.lit(1)).alias("n_sinks"), F.bool_and(ok).alias("committed"))


def assign_batches(df: DataFrame, partition: list[str], order: str, size: int) -> DataFrame:
    """Numbers micro-batches of ``size`` records within each partition key."""
    rn = F.row_number().over(W.partitionBy(*partition).orderBy(order)) - 1
    return df.withColumn("batch_no", F.floor(rn / size).cast("bigint"))


# --------------------------------------------------------------------------- throttle, rates


def throttle(df: DataFrame, ts: str, order: str, per_sec: int, partition: list[str] | None = None) -> DataFrame:
    """At most ``per_sec`` records of each second (and partition key), the first in order.

    A bucket for each second is independent of the others, so it is partitioned
    by second: no task sees the whole table.
    """
    second = F.date_trunc("second", F.col(ts).cast("timestamp"))
    by = W.partitionBy(*(partition or []), second).orderBy(order)
    return df.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= per_sec).drop("__n")


def throttle_burst(df: DataFrame, ts: str, order: str, per_sec: int, burst: int) -> DataFrame:
    """A token bucket that gets ``per_sec`` tokens at the start of each second and holds
    ``burst`` at most, full at first.  Records of a second pass in order until it is empty.

    The bucket goes from second to second over their counts, one row each, in
    one task; records are partitioned by second.  Records without a time have
    one bucket of their own.
    """
    import pandas as pd

    def run(frames):
        left, last = float(burst), None
        for pdf in frames:
            allowed = []
            for t, n in zip(pdf["__t"], pdf["__n"], strict=True):
                if pd.isna(t):
                    allowed.append(burst)
                    continue
                left = min(float(burst), left + (0 if last is None else (t - last) * per_sec))
                last = t
                allowed.append(int(left))
                left -= min(left, n)
            yield pd.DataFrame({"__t": pdf["__t"].astype("Int64"), "__allowed": allowed})

    d = df.withColumn("__s", F.unix_timestamp(F.date_trunc("second", F.col(ts).cast("timestamp"))))
    counts = d.groupBy(F.col("__s").alias("__t")).agg(F.count(F.lit(1)).alias("__n"))
    allowed = counts.repartition(1).sortWithinPartitions("__t").mapInPandas(run, "__t long, __allowed long")
    d = d.withColumn("__n", F.row_number().over(W.partitionBy("__s").orderBy(order)))
    d = d.join(allowed, d["__s"].eqNullSafe(allowed["__t"])).where(F.col("__n") <= F.col("__allowed"))
    return d.select(*df.columns)


def token_bucket(df: DataFrame, ts: str, order: str, per_sec: int, burst: int, key: str) -> DataFrame:
    """Exact token bucket for each ``key``: ``burst`` tokens at most, ``per_sec`` refilled a second.

    The bucket's state goes from record to record, so this is a grouped Python
    function; ``throttle`` is the scalable approximation.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        tokens, last, keep = float(burst), None, []
        for t in pd.to_datetime(pdf[ts]):
            if last is not None:
                tokens = min(float(burst), tokens + max(0.0, (t - last).total_seconds()) * per_sec)
            last = t
            keep.append(tokens >= 1)
            tokens -= keep[-1]
        return pdf[keep]

    return df.groupBy(key).applyInPandas(run, df.schema)


def tag_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def tag_rates(df: DataFrame, ts: str, width: str = "1 second") -> DataFrame:
    """Records of each tag in tumbling windows."""
    w = F.window(F.col(ts).cast("timestamp"), width)
    return df.groupBy("tag", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("tag", F.col("w.start").alias("start"), "n")
