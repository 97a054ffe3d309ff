"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import decontaminate as _decontaminate
from logweave.llm import linededup, ngramjoin, packing, toxicity
from logweave.llm.common import Scratch, join_on
from logweave.llm.queries import TOXIC_AT, table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is below one half.

    A null or empty text gets the base rate, so it stays; repeated rows are
    decided alike; without labels of both kinds all stay.
    """
    chain = toxicity.train_chain(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs.select(*COLUMNS), chain).where(F.col("p_toxic") < TOXIC_AT).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines of three or more documents stay in one of them; n_chars follows the text.

    A null text becomes an empty one; rows of one id count as one document.
    """
    out = linededup.dedup_lines(docs.select(*COLUMNS), 20, 3)
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by word-5-gram Jaccard of 0.8 or more, that with the smallest id.

    A document is an id and a text.  Null ids come after all others, the text's
    hash decides between equal ids, and of equal rows one stays.  Documents
    without words are in no group, so all of them stay.
    """
    tmp = Scratch(spark, "dedup-documents")
    docs = docs.select(*COLUMNS).withColumn("h", F.xxhash64("text"))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    groups = ngramjoin.jaccard_components(docs.select(key.alias("doc_id"), "text"), 5, 80, 100)
    rows = groups.select("doc_id.doc_id", "doc_id.h", "n_shingles", (~F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("gone"))
    keys = rows.groupBy("doc_id", "h").agg(F.max("gone").alias("gone"), F.count(F.lit(1)).alias("n"), F.max("n_shingles").alias("n_shingles"))
    keys = tmp.keep(keys.where("gone or (n > 1 and n_shingles > 0)").select("doc_id", "h", "gone"), "keys")
    out = join_on(docs, keys.select("doc_id", "h"), ["doc_id", "h"], "left_anti").select(*COLUMNS)
    repeated = keys.where("not gone").select("doc_id", "h")
    if repeated.limit(1).count():
        one = join_on(docs, repeated, ["doc_id", "h"], "left_semi").groupBy("doc_id", "h").agg(F.min(F.struct(*COLUMNS)).alias("row"))
        out = out.unionByName(one.select("row.*"))
    return out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs, however long they are.

    Rows are told apart by id and text, so nulls and repeated rows are decided
    alike; documents without words stay, and an empty benchmark drops nothing.
    """
    found = _decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), n=13)
    bad = found.where("n_hit > 0").select("doc_id", "h").distinct()
    out = join_on(docs.select(*COLUMNS, F.xxhash64("text").alias("h")), bad, ["doc_id", "h"], "left_anti")
    return out.select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens; a null or empty text has the end id alone."""
    out = packing.pack(docs, tokenizer_path())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", dedup_documents),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Tokenization, a trained model and a differencing heuristic have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    tmp = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = tmp.keep(docs, f"{k}_{name}")
    return docs
