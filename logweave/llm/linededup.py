"""Line dedup: explode normalised lines, hash, count documents, drop, reassemble.

Only hashes and positions are shuffled; texts move once, and only the numbers of
dropped lines come to them.  Everything is DataFrame code.

Defined results: a null or empty text is one empty line.  Documents are counted
by distinct non-null doc_id; rows of one id count once.  Lines of rows with a
null id are dropped when their key is over the threshold.  A document that loses
every line keeps an empty text.  Empty tables give empty results.  Further
columns stay as they are, but n_lines and n_dropped replace columns of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, ascii_lower, but, join_on, quoted

BLANKS = " \t\n\x0b\f\r"
#: Internal names, which no other column may have.
KEY = ["doc_id", "__lw_hash"]
DROPPED = "__lw_dropped"
LINES = "__lw_lines"
#: Lines found in so many documents are joined by a broadcast of their hashes, so no task gets all their rows.
HOT_DOCS = 10_000


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _rows_over(hashed: DataFrame, over: DataFrame) -> DataFrame:
    """Rows of ``hashed`` whose key is in ``over``: by broadcast where ``over`` is small, else only for hot keys."""
    by = ["k1", "k2"]
    if over.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return hashed.join(F.broadcast(over), by)
    hot = over.where(F.col("n") >= HOT_DOCS)
    if hot.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return hashed.join(over, by)
    rest = hashed.join(F.broadcast(hot.select(*by)), by, "left_anti").join(over.where(F.col("n") < HOT_DOCS), by)
    return hashed.join(F.broadcast(hot), by).unionByName(rest)


def dropped_lines(docs: DataFrame, min_chars: int, min_docs: int, tmp: Scratch) -> DataFrame:
    """Per document that loses lines, its KEY and their positions."""
    rows = docs.select("doc_id", F.xxhash64("text").alias(KEY[1]), F.posexplode(lines(F.col("text"))).alias("pos", "line"))
    keyed = rows.select(*KEY, "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    # two 64-bit hashes of different inputs: equal pairs are equal keys
    hashed = keyed.select(*KEY, "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.reverse("key"), F.lit(1)).alias("k2"))
    hashed = tmp.keep(hashed, "lines")
    once = hashed.select("k1", "k2", "doc_id").distinct()  # a hot line is spread over its documents here
    over = once.groupBy("k1", "k2").agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
    over = tmp.keep(over.where(F.col("n") >= min_docs).select("k1", "k2", "keeper", "n"), "over")
    out = _rows_over(hashed, over).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return out.groupBy(*KEY).agg(F.collect_set("pos").alias(DROPPED))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """All columns of ``docs`` with the text left, n_lines (before) and n_dropped."""
    tmp = Scratch(docs.sparkSession, "linededup")
    docs = docs.select(*but(docs, "n_lines", "n_dropped"))
    gone = tmp.keep(dropped_lines(docs, min_chars, min_docs, tmp), "dropped")
    out = join_on(docs.withColumn(KEY[1], F.xxhash64("text")), gone, KEY, "left").withColumn(LINES, lines(F.col("text")))
    kept = F.array_except(F.sequence(F.lit(0), F.size(LINES) - 1), DROPPED)
    picked = F.transform(kept, lambda i: F.element_at(F.col(LINES), i + 1))
    text = F.when(F.col(DROPPED).isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(picked, "\n"))
    n_dropped = F.when(F.col(DROPPED).isNull(), 0).otherwise(F.size(DROPPED))
    kept_columns = [text.alias("text") if c == "text" else F.col(quoted(c)) for c in docs.columns]
    return out.select(*kept_columns, F.size(LINES).cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"))
