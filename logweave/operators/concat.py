"""Multi-line records stitched together: a closed form over windows for batch.

Per (tag, identifier) in order of arrival, a running count of head lines numbers
the groups.  In a group, line i belongs to the merged record while no gap since
the head is longer than ``wait_sec`` and the bytes merged before it are fewer
than ``max_len`` (a head alone is never too long).  All other lines, and lines
before the first head, stay alone.  One shuffle, by (tag, identifier).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import maps, regex


@dataclass(frozen=True)
class ConcatRule:
    msg_key: str
    identifier: str
    head_regexp: str


def concat_lines(df: DataFrame, keys: list[str], order: str, text: str, head: str, *, max_len: int = 300_000, wait_sec: float | None = 3.0, ts: str | None = None, sep: str = "", adopt: bool = False) -> DataFrame:
    """Adds the grouping of lines: one row per record with keys, the head's order,
    ``text`` joined, ``ids`` of the merged lines in order and ``n_lines``.

    ``head`` is a boolean column; ``ts`` (a timestamp or seconds) is needed when
    ``wait_sec`` is given.  ``order`` must be unique within the keys.
    With ``adopt`` a line after the wait begins the next record, unless none is pending.
    """
    by = W.partitionBy(*keys).orderBy(order)
    d = df.withColumn("__g", F.sum(F.col(head).cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0)))
    late = F.lit(False)
    if wait_sec is not None and ts is not None:
        seconds = F.col(ts) if dict(df.dtypes)[ts] in ("double", "float", "bigint", "int") else F.col(ts).cast("timestamp").cast("double")
        late = F.coalesce(seconds - F.lag(seconds).over(by) > wait_sec, F.lit(False))
    d = d.withColumn("__late", late)
    of_g = W.partitionBy(*keys, "__g").orderBy(order)
    up_to = of_g.rowsBetween(W.unboundedPreceding, 0)
    late = F.col("__late") & (F.row_number().over(of_g) > 1)
    if adopt:  # late lines part a head's group; a record that is full ends it
        d = d.withColumn("__s", F.sum(F.when(late & (F.col("__g") > 0), 1).otherwise(0)).over(up_to))
        of_s = W.partitionBy(*keys, "__g", "__s").orderBy(order)
        cum = F.sum(F.octet_length(text)).over(of_s.rowsBetween(W.unboundedPreceding, 0))
        d = d.withColumn("__full", (F.row_number().over(of_s) > 1) & (cum >= max_len))
        ended = F.coalesce(F.max("__full").over(of_g.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
        d = d.withColumn("__alone", (F.col("__g") == 0) | ended)
    else:  # after a late line, or one that fills the record, all lines of the group are alone
        d = d.withColumn("__s", F.lit(0)).withColumn("__i", F.row_number().over(of_g) - 1).withColumn("__cum", F.sum(F.octet_length(text)).over(up_to))
        full = (F.col("__i") >= 2) & (F.lag("__cum").over(of_g) >= max_len)
        d = d.withColumn("__alone", (F.col("__g") == 0) | ((F.col("__i") >= 1) & (full | F.max(late).over(up_to))))
    group = F.when(F.col("__alone"), F.struct("__g", "__s", F.col(order).alias("o"))).otherwise(F.struct("__g", "__s", F.lit(None).alias("o")))
    rest = [c for c in df.columns if c not in (*keys, order, text, head)]
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    out = d.groupBy(*keys, group.alias("__k")).agg(F.min(order).alias(order), lines.alias("__l"), *[F.min_by(c, order).alias(c) for c in rest])
    joined = F.array_join(F.transform("__l", lambda x: x["t"]), sep)
    return out.select(*keys, order, joined.alias(text), F.transform("__l", lambda x: x["o"]).alias("ids"), F.size("__l").alias("n_lines"), *rest)


def concat_records(df: DataFrame, rules: dict[str, ConcatRule], *, max_len: int = 300_000, wait_sec: float | None = 3.0) -> DataFrame:
    """Records of the rules' tags stitched together; others, and records that lack
    the text or identifier, pass.  ``ext_ids`` gets the ids merged into a head.
    """
    text = ident = head = None
    for tag, r in rules.items():
        here = F.col("tag") == tag
        line = maps.text(F.col("message"), r.msg_key)
        one = (line, maps.text(F.col("message"), r.identifier), regex.matches(line, r.head_regexp))
        text, ident, head = (F.when(here, c) if acc is None else acc.when(here, c) for acc, c in zip((text, ident, head), one, strict=True))
    if text is None:
        return df
    d = df.select("*", text.alias("__t"), ident.alias("__id"), F.coalesce(head, F.lit(False)).alias("__h"))
    ready = F.col("__t").isNotNull() & F.col("__id").isNotNull()
    out = concat_lines(d.where(ready), ["tag", "__id"], "_seq", "__t", "__h", max_len=max_len, wait_sec=wait_sec, ts="_ingest_ts")
    key = F.create_map(*[F.lit(x) for t, r in rules.items() for x in (t, r.msg_key)])[F.col("tag")]
    msg = F.map_concat("message", F.create_map(key, maps.variant(F.col("__t"))))
    merged = F.when(F.col("n_lines") > 1, F.slice("ids", 2, F.greatest(F.size("ids") - 1, F.lit(1))))
    out = out.select("tag", msg.alias("message"), "id", merged.alias("ext_ids"), "_seq", "_ingest_ts")
    return out.unionByName(d.where(~ready).select(*out.columns))
