"""Language identification by a convolutional network over bytes, in numpy.

A text is cut into fixed windows of bytes.  Filters of widths 2, 3 and 4 slide
over a window, each filter's largest response is kept (max pooling), and a
softmax over the pooled responses gives probabilities.  A text's score is the
mean over all its windows, weighted by their lengths.

A filter over one-hot bytes is a sum of table entries, so inference looks up
pairs of bytes: two gathers a position give all filters of all widths.

Training uses about ``per_lang`` rows of each language (those with the smallest
hash of doc_id), never the held-out rows; prediction covers whole texts.
Defined results: ``und`` with score 0 for a null text, a text without a letter,
and everything when there is nothing to learn from; repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as K

WIDTHS = (2, 3, 4)


@dataclass
class Net:
    langs: list[str]
    tables: list[np.ndarray]  # for each width (width, 256, filters)
    bias: np.ndarray  # (widths * filters)
    out: np.ndarray  # (widths * filters, languages)
    out_bias: np.ndarray
    window: int


def _pool(net: Net, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    pooled, where = [], []
    for t in net.tables:
        w = len(t)
        n = x.shape[1] - w + 1
        r = t[0][x[:, :n]]
        for j in range(1, w):
            r += t[j][x[:, j : j + n]]
        at = r.argmax(axis=1)
        where.append(at)
        pooled.append(np.take_along_axis(r, at[:, None, :], 1)[:, 0])
    return np.concatenate(pooled, axis=1) + net.bias, where


def train(x: np.ndarray, y: np.ndarray, langs: list[str], filters: int = 16, epochs: int = 8, seed: int = 7) -> Net:
    """Adam on windows ``x`` (rows of bytes) with language numbers ``y``."""
    rng = np.random.default_rng(seed)
    m = len(WIDTHS) * filters
    net = Net(langs, [rng.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in WIDTHS], np.zeros(m, np.float32), rng.normal(0, 0.2, (m, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32), x.shape[1])
    params = [*net.tables, net.bias, net.out, net.out_bias]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, batch = 0, 64
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            xb, yb = x[order[a : a + batch]], y[order[a : a + batch]]
            # texts may be short: show part of the windows with their ends blanked
            short = rng.random(len(xb)) < 0.3
            keep = rng.integers(6, x.shape[1] + 1, len(xb))
            xb = np.where(short[:, None] & (np.arange(x.shape[1]) >= keep[:, None]), 0, xb).astype(np.uint8)
            h, where = _pool(net, xb)
            act = np.maximum(h, 0)
            z = act @ net.out + net.out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(yb)), yb] -= 1
            p /= len(yb)
            dh = (p @ net.out.T) * (h > 0)
            grads = []
            for k, t in enumerate(net.tables):
                g = np.zeros_like(t)
                d = dh[:, k * filters : (k + 1) * filters]
                f = np.broadcast_to(np.arange(filters), d.shape)
                for j in range(len(t)):
                    np.add.at(g[j], (np.take_along_axis(xb, where[k] + j, 1), f), d)
                grads.append(g)
            grads += [dh.sum(axis=0), act.T @ p, p.sum(axis=0)]
            step += 1
            for q, g, u, v in zip(params, grads, m1, m2, strict=True):
                u += 0.1 * (g - u)
                v += 0.001 * (g * g - v)
                q -= (0.01 / (1 + step / 2000)) * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    return net


class Fast:
    """The net over pairs of bytes, in 16-bit fixed point."""

    def __init__(self, net: Net):
        self.net = net
        top = max(float(np.abs(t).max()) for t in net.tables) * 4
        self.scale = 30000 / max(top, 1e-6)
        q = [np.rint(t * self.scale).astype(np.int16) for t in net.tables]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        self.f = q[0].shape[2]
        # at a position: width 2 whole, the first two bytes of widths 3 and 4; two bytes on: the rest
        self.near = np.ascontiguousarray(np.concatenate([pair(q[0][0], q[0][1]), pair(q[1][0], q[1][1]), pair(q[2][0], q[2][1])], axis=1))
        zero = np.zeros_like(q[1][0])
        self.far = np.ascontiguousarray(np.concatenate([pair(q[1][2], zero), pair(q[2][2], q[2][3])], axis=1))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        n, f = x.shape[1], self.f
        pairs = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
        r = self.near[pairs]  # (rows, n - 1, 3f)
        two = r[:, :, :f].max(axis=1)
        rest = r[:, : n - 3, f:]
        rest += self.far[pairs[:, 2:]]
        more = rest.max(axis=1)
        # width 3 has one more position at the end
        last = r[:, n - 3, f : 2 * f] + self._third(x[:, n - 1])
        more[:, :f] = np.maximum(more[:, :f], last)
        h = np.concatenate([two, more], axis=1) / self.scale + self.net.bias
        z = np.maximum(h, 0) @ self.net.out + self.net.out_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def _third(self, b: np.ndarray) -> np.ndarray:
        return self.far[b.astype(np.int32) << 8, : self.f]


def windows(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all rows (zero-filled at ends), each one's row, and bytes in it."""
    n = np.diff(offs)
    count = -(-n // size)
    row = np.repeat(np.arange(len(n)), count)
    at = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * size + offs[:-1][row]
    have = np.minimum(size, offs[1:][row] - at)
    padded = np.concatenate([data, np.zeros(size, np.uint8)])
    x = np.lib.stride_tricks.sliding_window_view(padded, size)[at] if len(row) else np.zeros((0, size), np.uint8)
    if len(row):
        cut = have < size
        x = x.copy()
        x[cut] = np.where(np.arange(size) < have[cut][:, None], x[cut], 0)
    return K.fold(x), row, have


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_langid(docs: DataFrame, per_lang: int = 300, windows_each: int = 8, window: int = 128) -> Net | None:
    """Fit on about ``per_lang`` rows of each language and ``windows_each`` windows of each."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # a share of the 2^31 values of the hash that leaves about per_lang rows
    share = F.least(F.lit(1.0), F.lit(float(per_lang)) / F.col("n")) * F.lit(float(1 << 31))
    limits = counts.select("lang", share.alias("share"))
    picked = usable.join(K.broadcast_if_small(limits, 10_000), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 31)) < F.col("share"))
    step = F.greatest(F.octet_length("text") / F.lit(windows_each), F.lit(float(window)))
    at = F.sequence(F.lit(0), F.lit(windows_each - 1))
    cut = F.transform(at, lambda i: F.substring(F.col("text").cast("binary"), (i * step).cast("int") + 1, F.lit(window)))
    rows = picked.select("doc_id", "lang", F.filter(cut, lambda b: F.octet_length(b) > 0).alias("w")).collect()  # bounded by per_lang * windows_each
    rows = sorted(rows, key=lambda r: (r.lang, str(r.doc_id), [bytes(w) for w in r.w]))  # repeated ids have one order too
    langs = sorted({r.lang for r in rows})
    if not langs:
        return None
    x = np.zeros((sum(len(r.w) for r in rows), window), np.uint8)
    y = np.zeros(len(x), np.int64)
    k = 0
    for r in rows:
        for w in r.w:
            x[k, : len(w)] = np.frombuffer(bytes(w), np.uint8)
            y[k] = langs.index(r.lang)
            k += 1
    return train(K.fold(x), y, langs)


def identify(docs: DataFrame, net: Net | None) -> DataFrame:
    """All columns of ``docs`` with lang_pred and score, which replace columns of these names (``text`` alone is looked at).

    A long text comes in pieces of whole windows.
    """
    K.prepare(docs.sparkSession)
    docs = docs.select(*K.but(docs, "lang_pred", "score"))
    at = docs.columns.index("text")
    letters = np.zeros(256, bool)
    letters[65:91] = letters[97:123] = True
    step = net.window if net else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fast = Fast(net) if net else None
        for b in batches:
            col = b.column(at)
            size = np.diff(K.buffers(col)[1])
            total = np.zeros((b.num_rows, len(net.langs) if net else 1))
            ok = np.zeros(b.num_rows, bool)
            for lo, hi, data, offs in K.pieces(col, 1 << 19, step=step):
                n = hi - lo
                seen = np.zeros(len(data) + 1, np.int64)
                np.cumsum(letters[data], out=seen[1:])
                ok[lo:hi] |= seen[offs[1:]] > seen[offs[:-1]]
                if fast is None:
                    continue
                x, row, have = windows(data, offs, net.window)
                for a in range(0, len(x), 256):
                    p = fast.probabilities(x[a : a + 256]) * have[a : a + 256, None]
                    for c in range(p.shape[1]):
                        total[lo:hi, c] += np.bincount(row[a : a + 256], p[:, c], n)
            for i in np.flatnonzero(~ok & (size > 0)).tolist():
                ok[i] = any(c.isalpha() for c in col[i].as_py())
            total /= np.maximum(size, 1)[:, None]
            ok &= fast is not None
            pred = [net.langs[k] if o else "und" for k, o in zip(total.argmax(axis=1).tolist(), ok.tolist(), strict=True)]
            score = np.where(ok, np.clip(total.max(axis=1, initial=0), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return K.map_arrow(docs, run, "lang_pred string, score double")
