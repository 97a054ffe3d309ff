"""The envelope that all operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import maps

ENVELOPE = "tag string, message map<string,variant>, id bigint, ext_ids array<bigint>, _seq bigint, _ingest_ts timestamp"
COLUMNS = ["tag", "message", "id", "ext_ids", "_seq", "_ingest_ts"]


def configure(spark) -> None:
    """Session settings the operators rely on."""
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns set or replaced, each evaluated once per row.

    A later filter on a plain projection is pushed below it with the whole
    expression copied into it, so a regular expression would run again for every
    use.  A generator of one row is not copied.
    """
    names = {n: f"__once_{n}" for n in columns}
    out = df.select("*", F.inline(F.array(F.struct(*[c.alias(names[n]) for n, c in columns.items()]))))
    kept = [F.col(names[c]).alias(c) if c in names else F.col(c) for c in df.columns]
    return out.select(*kept, *[F.col(a).alias(n) for n, a in names.items() if n not in df.columns])


def envelope(df: DataFrame, tag: Column, values: dict[str, Column], seq: Column, ts: Column | None = None) -> DataFrame:
    """Records from typed columns: tag, message entries, and an order that is also the id."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), maps.variant(v))]
    return df.select(
        tag.alias("tag"), F.create_map(*pairs).cast("map<string,variant>").alias("message"), seq.cast("bigint").alias("id"), F.lit(None).cast("array<bigint>").alias("ext_ids"),
        seq.cast("bigint").alias("_seq"), (ts if ts is not None else F.lit(None)).cast("timestamp").alias("_ingest_ts"),
    )


def to_columns(df: DataFrame, fields: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Message entries as typed columns."""
    return df.select(*keep, *[F.try_variant_get(F.try_element_at("message", F.lit(k)), "$", t).alias(k.replace("@", "")) for k, t in fields.items()])
