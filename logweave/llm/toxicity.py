"""Toxicity by a classifier chain.

Categories are predicted one after another by logistic models over the presence
of words and of word beginnings.  Each later model also gets the earlier
categories' log-odds; in training these come from models that did not see the
row (out-of-fold), so the later models learn from predictions as good as those
they will meet.

The chain is low_quality, toxic, severe.  The first two are labels.  ``severe``
holds for toxic rows with at least the median count of features that toxic
training rows have far more often than others.

Training uses at most ``max_rows`` labelled rows of each class of ``toxic``
(those with the smallest hash of doc_id) and of each at most ``max_features``
features; prediction covers whole texts of all rows, long ones in pieces.  Defined results: a null or empty text has no features and gets the base
rates; labels that are null are ignored, repeated ones count as toxic if any row
says so; without labels of both kinds nothing is toxic; repeated rows each get
a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as K

CATEGORIES = ("low_quality", "toxic", "severe")
_WORD = np.zeros(256, bool)
_WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def features(data: np.ndarray, offs: np.ndarray, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word and each word beginning, with repeats."""
    data = K.fold(data)
    starts, ends, first = K.spans(_WORD, data, offs)
    rows = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    long = ends - starts > prefix
    salt = np.uint64(0x5851F42D4C957F2D)
    heads = K.run_hashes(data, starts[long], starts[long] + prefix) ^ salt
    return np.concatenate([rows, rows[long]]), np.concatenate([K.run_hashes(data, starts, ends), heads])


@dataclass
class Chain:
    """Sorted feature hashes; for each category weights (features, then earlier log-odds) and a bias."""

    keys: np.ndarray
    weights: list[np.ndarray]
    bias: list[float]
    prefix: int

    def margins(self, rows: np.ndarray, feats: np.ndarray, n: int) -> np.ndarray:
        """Log-odds (n x categories) from (row, feature index) pairs without repeats."""
        out = np.zeros((n, len(self.bias)))
        for c, (w, b) in enumerate(zip(self.weights, self.bias, strict=True)):
            out[:, c] = b + np.bincount(rows, w[feats], n) + out[:, :c] @ w[len(self.keys) :]
        return out


def _fit(x: np.ndarray, y: np.ndarray, use: np.ndarray, l2: float, steps: int = 150) -> tuple[np.ndarray, float]:
    """Logistic regression with class weights on the rows in ``use``, by accelerated gradient steps."""
    n, m = int(use.sum()), x.shape[1]
    share = float(y[use].mean()) if n else 0.0
    if not 0 < share < 1:
        return np.zeros(m), 20.0 if share else -20.0
    c = np.where(use, np.where(y > 0, 0.5 / share, 0.5 / (1 - share)), 0)
    w, b = np.zeros(m, np.float32), 0.0
    vw, vb = w, b
    squares = np.einsum("ij,ij->i", x, x)[use].mean()
    size = 0.25 * float(c.max()) * (float(squares) * 0.5 + 1) + l2
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ vw + vb, -30, 30)))
        g = (c * (p - y)).astype(np.float32)
        nw, nb = vw - (g @ x / n + l2 * vw) / size, vb - float(g.sum()) / n / size
        k = t / (t + 3)
        vw, vb = (nw + k * (nw - w)).astype(np.float32), nb + k * (nb - b)
        w, b = nw, nb
    return w.astype(np.float64), float(b)


def fit_chain(keys: np.ndarray, odds: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, prefix: int, folds: int = 3, l2: float = 1e-3) -> Chain:
    """``rows``: places in ``keys`` of each row's features; ``labels``: columns low_quality, toxic; ``odds``: how much each feature tells toxic rows."""
    n, m = len(rows), len(keys)
    if not n or not labels[:, 1].any() or labels[:, 1].all():
        return Chain(np.zeros(0, np.uint64), [np.zeros(c) for c in range(3)], [-20.0] * 3, prefix)
    x = np.zeros((n, m + 2), np.float32)  # the last two columns: earlier categories' out-of-fold log-odds
    for i, r in enumerate(rows):
        x[i, r] = 1
    marks = x[:, np.flatnonzero(odds > 2)].sum(axis=1)
    toxic = labels[:, 1] > 0
    severe = toxic & (marks >= max(1.0, float(np.median(marks[toxic]))))
    y = np.stack([labels[:, 0] > 0, toxic, severe], axis=1).astype(np.float32)
    fold = np.arange(n) % folds
    weights, bias = [], []
    for c in range(3):
        xc = x[:, : m + c]
        w, b = _fit(xc, y[:, c], np.ones(n, bool), l2)
        w[m:] /= 4
        weights.append(w)
        bias.append(b)
        if c < 2:
            for k in range(folds):
                fw, fb = _fit(xc, y[:, c], fold != k, l2, 80)
                x[fold == k, m + c] = np.clip((xc @ fw.astype(np.float32))[fold == k] + fb, -20, 20) / 4
    return Chain(keys, weights, bias, prefix)


def sample_labelled(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """doc_id, low_quality, toxic, text of at most ``max_rows`` labels of each class.

    Of rows with one doc_id, that with the smallest hash of its text is taken.
    """
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(F.coalesce("quality", F.lit(1))).alias("quality"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = one.where("toxic = 1").orderBy(*order).limit(max_rows).unionByName(one.where("toxic = 0").orderBy(*order).limit(max_rows))
    texts = docs.where("text is not null").select("doc_id", "text")  # at most 2 * max_rows ids are sent
    return texts.join(F.broadcast(picked), "doc_id").select("doc_id", (F.col("quality") == 0).cast("int").alias("low_quality"), "toxic", "text")


def _sketch(hashes: np.ndarray, most: int) -> np.ndarray:
    """The features with the smallest hashes: all of a row's, or a share that is the same for all rows' features."""
    u = np.unique(hashes)
    return u[np.argpartition(u, most)[:most]] if len(u) > most else u


def telling_features(rows: DataFrame, most: int) -> DataFrame:
    """(key, odds) of the ``most`` features that tell labels best, of those in three rows or more.

    ``rows``: doc_id, low_quality, toxic, features.  Counts are summed per batch,
    then by Spark; a feature's score is the larger of its two labels' z values, that
    of toxic counted twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(2)]
            size = [len(x) for x in each]
            keys, back = np.unique(np.concatenate([np.zeros(0, np.int64), *each]), return_inverse=True)
            low, toxic = (np.repeat(b.column(i).to_numpy(zero_copy_only=False), size) for i in range(2))
            count = lambda w: pa.array(np.bincount(back, w, len(keys)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), count(None), count(low), count(toxic)], ["key", "df", "low", "toxic"])

    n, low, toxic = rows.agg(F.count(F.lit(1)), F.sum("low_quality"), F.sum("toxic")).first()
    counts = rows.select("low_quality", "toxic", "features").mapInArrow(K.trimmed(run), "key long, df long, low long, toxic long")
    counts = counts.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("df", "low", "toxic")]).where("df >= 3")
    score = F.lit(0.0)
    for name, y, times in (("low", low or 0, 1), ("toxic", toxic or 0, 2)):
        if 0 < y < n:
            with_y, p = F.col(name), F.col("df") / n
            z = F.abs(with_y / y - (F.col("df") - with_y) / (n - y)) / F.sqrt(p * (1 - p) * (1 / y + 1 / (n - y)) + 1e-12)
            score = F.greatest(score, z * times)
    odds = F.log((F.col("toxic") + 0.5) / ((toxic or 0) + 1)) - F.log((F.col("df") - F.col("toxic") + 0.5) / (n - (toxic or 0) + 1))
    return counts.select("key", odds.alias("odds"), score.alias("score")).where("score > 0").orderBy(F.desc("score"), "key").limit(most).select("key", "odds")


def train_chain(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, prefix: int = 5, max_features: int = 4000, n_features: int = 2048) -> Chain:
    """Fit on at most ``max_rows`` labelled rows of each class, ``max_features`` distinct
    features of each row (those with the smallest hashes), and the ``n_features`` of
    these that tell most.  The driver gets places among these features only: at most
    2 * max_rows * n_features numbers of two bytes.
    """
    spark = K.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[list[np.ndarray]] = [[] for _ in range(b.num_rows)]
            for lo, hi, data, offs in K.pieces(b.column(3), keep=_WORD):
                rows, hashes = features(data, offs, prefix)
                for i, own in enumerate(_split(rows, hashes, hi - lo)):
                    found[lo + i].append(own)
            out = [_sketch(np.concatenate([np.zeros(0, np.uint64), *x]), max_features).tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.binary())], ["doc_id", "low_quality", "toxic", "features"])

    rows = sample_labelled(docs, labels, max_rows)
    got = rows.mapInArrow(K.trimmed(run), K.schema(rows, "features binary", drop=("text",)))
    one = got.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("features"), "features", "low_quality", "toxic")).alias("r")).select("doc_id", "r.low_quality", "r.toxic", "r.features")
    one = K.Scratch(spark, "toxicity").keep(one, "rows")
    told = telling_features(one, n_features).collect()  # bounded by n_features
    keys = np.array([r.key for r in told], np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, odds = keys[order], np.array([r.odds for r in told])[order]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(3):
                u = np.frombuffer(x.as_buffer(), np.uint64)
                at = np.searchsorted(keys, u)
                at[at == len(keys)] = 0
                out.append((at[keys[at] == u] if len(keys) else at[:0]).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.binary())], ["doc_id", "low_quality", "toxic", "places"])

    told = one.mapInArrow(K.trimmed(places), K.schema(one, "places binary", drop=("features",)))
    found = told.select(F.col("doc_id").cast("string").alias("id"), "low_quality", "toxic", "places").orderBy("id").collect()
    y = np.array([[r.low_quality, r.toxic] for r in found], np.int8).reshape(-1, 2)
    return fit_chain(keys, odds, [np.frombuffer(r.places, np.uint16) for r in found], y, prefix)


def _split(rows: np.ndarray, hashes: np.ndarray, n: int) -> list[np.ndarray]:
    order = np.argsort(rows, kind="stable")
    cut = np.searchsorted(rows[order], np.arange(n + 1))
    return [np.unique(hashes[order[cut[i] : cut[i + 1]]]) for i in range(n)]


def score_toxicity(docs: DataFrame, chain: Chain) -> DataFrame:
    """All columns of ``docs`` and a probability p_* for each category (which replace columns of these names)."""
    K.prepare(docs.sparkSession)
    names = [f"p_{c}" for c in CATEGORIES]
    docs = docs.select(*K.but(docs, *names))
    at, m = docs.columns.index("text"), len(chain.keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [np.zeros(0, np.int64)]
            for lo, _, data, offs in K.pieces(b.column(at), keep=_WORD):
                rows, hashes = features(data, offs, chain.prefix)
                if m:
                    f = np.searchsorted(chain.keys, hashes)
                    f[f == m] = 0
                    hit = chain.keys[f] == hashes
                    pairs.append(np.unique((rows[hit] + lo).astype(np.int64) * m + f[hit]))
            pair = np.unique(np.concatenate(pairs))
            p = 1 / (1 + np.exp(-np.clip(chain.margins(pair // max(m, 1), pair % max(m, 1), b.num_rows), -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(np.round(p[:, c], 9)) for c in range(len(names))]], [*b.schema.names, *names])

    return K.map_arrow(docs, run, ", ".join(f"{n} double" for n in names))
