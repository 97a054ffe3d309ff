"""Benchmark decontamination with a distributed positional inverted index.

Training tokens become postings ``(document, position, term)`` stored in the
shared folder.  A benchmark phrase is found by taking the list of its rarest
term, shifting it by the term's offset in the phrase, and intersecting it with
the shifted lists of the next rarer terms.  Everything is DataFrame code.

Only terms of the benchmark's vocabulary get postings: no other list is ever
read.  Each document also has one posting of term -1 at the position after its
last word, which carries its length (as indexes keep document norms).

Defined results: a null or empty text has no words.  Rows are told apart by
(doc_id, hash of the text), so repeated ids, repeated rows and null ids each
give a row.  A null benchmark text has no windows; a repeated item counts once.
Empty tables give empty results or clean rows.  Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import BROADCAST_ROWS, Scratch, ascii_lower, broadcast_if_small, join_on

#: After A-Z are lower-cased, a word is a run of 0-9, a-z and non-ASCII characters; these are between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LENGTH_TERM = -1
KEY = ["doc_id", "h"]


def words(text: Column) -> Column:
    """The words of a text as an array; null and wordless texts give an empty one.

    Splitting takes a tenth of the time that collecting all matches does.
    """
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), BETWEEN, -1), "")


def windows(bench: DataFrame, n: int) -> DataFrame:
    """(item_id, terms): each run of ``n`` words; a shorter item is one window."""
    w = bench.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    at = F.sequence(F.lit(0), F.greatest(F.size("w") - F.lit(n), F.lit(0)))
    return w.select("item_id", "w", F.explode(at).alias("i")).select("item_id", F.slice("w", F.col("i") + 1, F.lit(n)).alias("terms")).distinct()


class Phrases:
    """Benchmark windows with numbered terms; small beside the corpus, but size-checked."""

    def __init__(self, bench: DataFrame, n: int, tmp: Scratch):
        self.n = n
        flat = tmp.keep(windows(bench, n), "windows")
        ids = flat.select("terms").distinct().withColumn("wid", F.monotonically_increasing_id())
        #: Numbers come from the written table, so they hold when a task is run again.
        self.windows = tmp.keep(ids, "window_ids")
        self.items = tmp.keep(flat.join(self.windows, "terms").select("wid", "item_id"), "window_items")
        terms = self.windows.select(F.explode("terms").alias("term")).distinct()
        self.vocabulary = tmp.keep(terms.withColumn("t", F.monotonically_increasing_id()), "vocabulary")
        placed = self.windows.select("wid", F.size("terms").alias("len"), F.posexplode("terms").alias("j", "term"))
        self.placed = tmp.keep(placed.join(self.vocabulary, "term").select("wid", "len", "j", "t"), "placed")


def build_index(docs: DataFrame, phrases: Phrases, tmp: Scratch) -> DataFrame:
    """Store postings (doc_id, h, pos, t) of the vocabulary's terms and each length."""
    # a range, as rows from a list would start Python workers on the executors
    stop = docs.sparkSession.range(0, 1, 1, 1).select(F.lit("").alias("term"), F.lit(LENGTH_TERM).cast("long").alias("t"))
    wanted = broadcast_if_small(phrases.vocabulary.unionByName(stop))
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.concat(words(F.col("text")), F.array(F.lit(""))).alias("w"))
    posted = rows.select(*KEY, F.posexplode("w").alias("pos", "term")).join(wanted, "term").select(*KEY, "pos", "t")
    return tmp.keep(posted, "postings")


def rank_terms(index: DataFrame, phrases: Phrases, tmp: Scratch) -> DataFrame:
    """Terms of each window from the rarest (r = 1); windows with an absent term go."""
    counts = index.where(F.col("t") != LENGTH_TERM).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    counts = tmp.keep(counts, "counts")
    by = W.partitionBy("wid")
    ranked = phrases.placed.join(counts, "t").withColumn("r", F.row_number().over(by.orderBy("n", "t", "j")))
    ranked = ranked.withColumn("found", F.count(F.lit(1)).over(by)).where(F.col("found") == F.col("len"))
    return tmp.keep(ranked.select("wid", "len", "r", "j", "t"), "ranked")


def _intersect(cands: DataFrame, lists: DataFrame, terms: DataFrame, slop: int) -> DataFrame:
    """Candidates that every list of ``terms`` confirms at its offset (within ``slop``)."""
    probes = cands.join(broadcast_if_small(terms), "wid")
    if slop:
        probes = probes.withColumn("d", F.explode(F.sequence(F.lit(-slop), F.lit(slop))))
    shift = F.col("start") + F.col("j") + (F.col("d") if slop else F.lit(0))
    probes = probes.select(*KEY, "start", "wid", "len", "r", "need", shift.cast("int").alias("pos"), "t")
    met = join_on(probes, lists.withColumn("ok", F.lit(True)), [*KEY, "pos", "t"])
    confirmed = met.groupBy(*KEY, "start", "wid", "len").agg(F.count_distinct("r").alias("got"), F.max("need").alias("need"))
    return confirmed.where(F.col("got") == F.col("need")).select(*KEY, "start", "wid", "len")


def phrase_matches(index: DataFrame, ranked: DataFrame, tmp: Scratch, slop: int = 0, first: int = 4) -> DataFrame:
    """(doc_id, h, start, wid, len) of every place where a window occurs.

    ``slop`` = 0 asks for the exact phrase; otherwise each term may stand up to
    ``slop`` positions away from its place relative to the rarest term.
    Ranks 2 to ``first`` thin the rarest term's list before the common terms'
    lists are read, and those only for documents that still have a candidate.
    """
    postings = index.where(F.col("t") != LENGTH_TERM)
    anchors = broadcast_if_small(ranked.where("r = 1").select("wid", "len", "j", "t"))
    start = F.col("pos") - F.col("j")
    found = postings.join(anchors, "t").select(*KEY, start.cast("int").alias("start"), "wid", "len")
    if not slop:
        found = found.where("start >= 0")
    found = tmp.keep(found, f"candidates1_{slop}")
    for k, (low, high) in enumerate(((2, first), (first + 1, 1 << 30)), start=2):
        terms = ranked.where((F.col("r") >= low) & (F.col("r") <= high))
        terms = terms.withColumn("need", F.count(F.lit(1)).over(W.partitionBy("wid")))
        terms = tmp.keep(terms.select("wid", "r", "j", "t", "need"), f"terms{k}_{slop}")
        through = join_on(found, terms.select("wid").distinct(), ["wid"], "left_anti")  # windows without such ranks
        lists = postings.join(broadcast_if_small(terms.select("t").distinct()), "t", "left_semi")
        if k == 3:
            keys = tmp.keep(found.select(*KEY).distinct(), f"documents{k}_{slop}")
            lists = join_on(lists, broadcast_if_small(keys, BROADCAST_ROWS), KEY, "left_semi")
        found = tmp.keep(_intersect(found, lists, terms, slop).unionByName(through), f"candidates{k}_{slop}").distinct()
    return found


def decontaminate(docs: DataFrame, bench: DataFrame, n: int = 13, ratio: int = 20, slop: int = 0) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items (sorted as strings), contaminated.

    ``docs`` has doc_id and text, ``bench`` item_id and text.  A word is hit if an
    occurrence of a window covers it; a document is contaminated if it has a hit
    and ``ratio * n_hit >= n_words``.  With ``slop`` an occurrence is a proximity
    match (see ``phrase_matches``) and covers the window's place in the document.
    """
    tmp = Scratch(docs.sparkSession, "decontaminate")
    phrases = Phrases(bench, n, tmp)
    index = build_index(docs, phrases, tmp)
    ranked = rank_terms(index, phrases, tmp)
    found = tmp.keep(phrase_matches(index, ranked, tmp, slop), "matches")
    by_start = W.partitionBy(*KEY).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    cover = found.select(*KEY, "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    if slop:  # a place may begin before the document or end after it
        lengths = index.where(F.col("t") == LENGTH_TERM).select(*KEY, F.col("pos").alias("n_words")).distinct()
        cover = join_on(cover, lengths, KEY).select(*KEY, F.greatest("start", F.lit(0)).alias("start"), F.least("end", "n_words").alias("end")).distinct()
    cover = cover.withColumn("till", F.coalesce(F.max("end").over(by_start), F.lit(0)))
    fresh = F.greatest(F.col("end") - F.greatest("start", "till"), F.lit(0))
    hits = cover.groupBy(*KEY).agg(F.sum(fresh).alias("n_hit"))
    items = found.select(*KEY, "wid").distinct().join(broadcast_if_small(phrases.items), "wid")
    items = items.groupBy(*KEY).agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    out = index.where(F.col("t") == LENGTH_TERM).select(*KEY, F.col("pos").cast("long").alias("n_words"))
    out = join_on(join_on(out, hits, KEY, "left"), items, KEY, "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    listed = F.array_sort(F.coalesce("items", F.array().cast("array<string>")))
    out = out.select("doc_id", "h", "n_words", n_hit.alias("n_hit"), listed.alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(ratio) * F.col("n_hit") >= F.col("n_words")))
