"""Exact Jaccard self-join of shingle sets with set-relation skipping.

Two sets link when their overlap is at least ``num / den`` of their union.  The
result is exact but for chance collisions: 64-bit hashes stand for shingles and 128-bit
ones for sets.  Words of one length up to eight bytes never share a hash.

1. Equal texts collapse: a set's signature is a node, documents are its members.
2. Shingles are ordered from rare to common.  Their counts are gathered in
   buckets of the hash space and kept as one table of fixed size with a byte
   (the logarithm of the count) per slot.  Any order is correct; this one keeps
   passages that many documents share out of the prefixes.
   A second table has a bit per slot for shingles of two sets or more.  Others
   are in no overlap, so sets are compared by their shared shingles only.
3. Index: each set posts the first part of its sorted shared shingles (the prefix
   that two linked sets must have in common) with the set's size, the count of
   its shared shingles, the shingle's position among them, and the counts of
   shared shingles in each of 32 classes of the hash.
4. Answers from similar sets: within each list, sorted by size, neighbours are
   verified first, and each set with the likeliest originals about its size, found
   by an aggregate so that it does not matter how lists are dealt out.  Linked
   sets become one component; a member's answers are then those of its
   component, except for sets outside it.
5. Index-level skipping: in lists that still hold several components, blocks of
   (size, position) are compared as wholes and skipped when sizes or positions
   rule out a link, and so are blocks of one component.  A long list is dealt out
   by classes of sizes and salts, a task for each pair of blocks that may link.
   Pairs of different components are kept if the sum of the lesser counts of all
   classes allows a link.
6. Answer-level skipping: each set of such a pair has a similar set, the linked one
   with the most links (or itself).  The overlaps of these similar sets are
   computed first.  A pair's overlap is then known within what its sets differ
   from their similar ones: at most what either adds more, at least what either
   lacks less.  Only pairs that these bounds leave open are compared as wholes.
   The components of linked pairs are joined for good.

Sets in a verified pair are at most 2**27 slots of a bitmap; more sets than slots
cost moved bytes, never links.

Defined results: a document without words has an empty set, links with nothing
and is its own component; repeated rows and ids are members of one component; a
component of null ids only has a null id; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as K
from .components import components, extend

_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
_MUL = K.splitmix(64, 0xA0761D6478BD642F) | np.uint64(1)
_A, _B = np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3)


# --------------------------------------------------------------------------- sets


def shingle_sets(h: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row, from its words' hashes."""
    n, count = len(h), np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    i = np.arange(n)
    left = first[1:][row] - i  # words from here to the row's end
    s = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            here = left > j
            s[here] += h[i[here] + j] * _MUL[j % 64]
        short = (count[row] < k) & (i == first[:-1][row])
        s[short] += _MUL[32] * count[row][short].astype(np.uint64)
    use = (left >= k) | short
    s = K.mix(s[use])
    cut = np.concatenate([[0], np.cumsum(use)])[first]
    return [np.unique(s[cut[r] : cut[r + 1]]) for r in range(len(count))]


def signature(u: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return np.array([K.mix(u ^ _A).sum(dtype=np.uint64), K.mix(u ^ _B).sum(dtype=np.uint64)], ">u8").tobytes()


def scan(col: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """(row, set, signature).  A long text comes in pieces, of which only the words' hashes are held."""
    held: list[np.ndarray] = []
    at = 0

    def whole() -> tuple[int, np.ndarray, bytes]:
        h = np.concatenate(held)
        u = shingle_sets(h, np.array([0, len(h)]), k)[0]
        return at, u, signature(u)

    for lo, hi, data, offs in K.pieces(col, keep=_NOT_SPACE):
        data = K.fold(data)
        starts, ends, first = K.spans(_NOT_SPACE, data, offs)
        h = K.run_hashes(data, starts, ends)
        if held and lo != at:
            yield whole()
            held = []
        if hi - lo == 1:  # more of this row may follow
            at = lo
            held.append(h)
            continue
        for r, u in enumerate(shingle_sets(h, first, k)):
            yield lo + r, u, signature(u)
    if held:
        yield whole()


def _table(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary column of equally long rows of bytes."""
    rows = np.ascontiguousarray(rows)
    offs = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offs), pa.py_buffer(rows)])


def _rows(col: pa.Array, size: int) -> np.ndarray:
    """The rows of a binary column of equally long values."""
    d, o = K.buffers(col)
    return d[o[0] : o[-1]].reshape(-1, size)


def _hist(col: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(_rows(col, 64)).view("<u2")


class Join:
    """One run of the join over (doc_id, text) rows."""

    def __init__(self, docs: DataFrame, k: int, num: int, den: int, long_list: int = 8192):
        self.spark = K.prepare(docs.sparkSession)
        self.k, self.num, self.den, self.long = k, num, den, long_list
        self.texts = docs.select(F.col("text").cast("binary").alias("text"))
        self.docs = docs
        self.tmp = K.Scratch(self.spark, "ngramjoin")

    # -- 1. signatures

    def signatures(self) -> DataFrame:
        k = self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n, sig = np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, 16), np.uint8)
                for r, u, s in scan(b.column(1), k):
                    n[r] = len(u)
                    sig[r] = np.frombuffer(s, np.uint8)
                yield _table({"doc_id": b.column(0), "n": pa.array(n), "sig": _binary(sig)})

        d = self.docs.select("doc_id", F.col("text").cast("binary").alias("text"))
        kind = d.schema["doc_id"].dataType.simpleString()
        return self.tmp.keep(d.mapInArrow(K.trimmed(run), f"doc_id {kind}, n long, sig binary"), "signatures")

    # -- 2. order

    def levels(self, total: int) -> tuple[bytes, int, bytes, int]:
        """Tables by the first bits of a shingle's hash.

        2**m bytes: the logarithm of the count.  2**w bits: in two sets or more.
        Both have an upper bound, beyond which slots are shared by more shingles:
        that costs selectivity, never links.
        """
        m = min(24, max(16, int(max(total, 2) - 1).bit_length() - 3))
        w = m + 4
        b = min(m - 4, 16, max(4, int(max(total, 2) // 500_000).bit_length()))
        k = self.k

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[bytes] = set()
            held, size = [], 0

            def out() -> pa.RecordBatch:
                h, n = np.unique(np.concatenate(held), return_counts=True)
                cut = np.searchsorted(h >> np.uint64(64 - b), np.arange((1 << b) + 1))
                keys = ((h >> np.uint64(32 - b)) & np.uint64(0xFFFFFFFF)).astype("<u4")
                n = np.minimum(n, 255).astype(np.uint8)
                at = np.flatnonzero(np.diff(cut))
                return _table({"bucket": pa.array(at.astype(np.int32)), "keys": pa.array([keys[cut[i] : cut[i + 1]].tobytes() for i in at], pa.binary()), "counts": pa.array([n[cut[i] : cut[i + 1]].tobytes() for i in at], pa.binary())})

            for batch in batches:
                for _, u, s in scan(batch.column(0), k):
                    if len(u) and s not in seen:
                        seen.add(s)
                        held.append(u)
                        size += len(u)
                        if size >= 1_000_000:
                            yield out()
                            held, size = [], 0
            if held:
                yield out()

        def reduce(t: pa.Table) -> pa.Table:
            keys = np.concatenate([np.frombuffer(x, "<u4") for x in t.column("keys").to_pylist()])
            n = np.concatenate([np.frombuffer(x, np.uint8) for x in t.column("counts").to_pylist()])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order].astype(np.int64)
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            n, keys = np.add.reduceat(n, at), keys[at]
            many = n >= 2
            table = np.zeros(1 << (m - b), np.uint8)
            np.maximum.at(table, keys[many] >> np.uint32(32 - (m - b)), np.log2(n[many]).astype(np.uint8))
            bits = np.zeros(1 << (w - b), np.uint8)
            bits[keys[many] >> np.uint32(32 - (w - b))] = 1
            both = [zlib.compress(x.tobytes(), 1) for x in (table, np.packbits(bits, bitorder="little"))]
            return pa.table({"bucket": t.column("bucket")[:1], "level": pa.array(both[:1], pa.binary()), "bits": pa.array(both[1:], pa.binary())})

        parts = self.texts.mapInArrow(K.trimmed(count), "bucket int, keys binary, counts binary")
        got = parts.groupBy("bucket").applyInArrow(reduce, "bucket int, level binary, bits binary").collect()  # tables of fixed size: 48 MB at most, in one job
        out, bits = np.zeros(1 << m, np.uint8), np.zeros(1 << (w - 3), np.uint8)
        for r in got:
            out[r.bucket << (m - b) : (r.bucket + 1) << (m - b)] = np.frombuffer(zlib.decompress(bytes(r.level)), np.uint8)
            bits[r.bucket << (w - b - 3) : (r.bucket + 1) << (w - b - 3)] = np.frombuffer(zlib.decompress(bytes(r.bits)), np.uint8)
        return out.tobytes(), m, bits.tobytes(), w

    # -- 3. index

    def postings(self, table: bytes, m: int, bits: bytes, w: int) -> DataFrame:
        """(o, n, c, pos, sig, hist): prefixes of the shared shingles of each set that can have a link."""
        k, num, den = self.k, self.num, self.den
        shared = self.spark.sparkContext.broadcast((table, bits))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            level, many = (np.frombuffer(x, np.uint8) for x in shared.value)
            seen: set[bytes] = set()
            for b in batches:
                os, ns, cs, ps, sigs, hists = [], [], [], [], [], []
                for _, u, s in scan(b.column(0), k):
                    n = len(u)
                    if not n or s in seen:
                        continue
                    seen.add(s)
                    slot = u >> np.uint64(64 - w)
                    u = u[(many[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
                    prefix = len(u) + num * -n // den + 1  # an overlap has num / den of each set at least
                    if prefix < 1 or not len(u):
                        continue
                    o = level[u >> np.uint64(64 - m)].astype(np.uint64) << np.uint64(56) | u >> np.uint64(8)
                    o = np.sort(np.partition(o, prefix - 1)[:prefix])
                    os.append(o)
                    ps.append(np.arange(prefix))
                    ns.append(n)
                    cs.append(len(u))
                    sigs.append(s)
                    hists.append(np.minimum(np.bincount((u & np.uint64(31)).astype(np.int64), minlength=32), 65535).astype("<u2").tobytes())
                if os:
                    each = [len(x) for x in os]
                    wide = lambda x, size: _binary(np.repeat(np.frombuffer(b"".join(x), np.uint8).reshape(-1, size), each, axis=0))
                    long = lambda x: pa.array(np.repeat(np.array(x, np.int64), each))
                    yield _table({"o": pa.array(np.concatenate(os).astype(np.int64)), "n": long(ns), "c": long(cs), "pos": pa.array(np.concatenate(ps).astype(np.int64)), "sig": wide(sigs, 16), "hist": wide(hists, 64)})

        return self.tmp.keep(self.texts.mapInArrow(K.trimmed(run), "o long, n long, c long, pos long, sig binary, hist binary"), "postings")

    # -- 4. neighbours in lists

    def neighbours(self, postings: DataFrame) -> DataFrame:
        """Pairs (a, b) of sets beside each other in a list, and of each set with the
        first of its size, which has the most shared shingles: the likely original
        of which the others are edited copies.
        """
        may, need = self._may_link, self._need

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last = None
            for b in batches:
                if not b.num_rows:
                    continue
                now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)] + [_rows(b.column(4), 16), _hist(b.column(5))]
                if last is not None:
                    now = [np.concatenate([x, y]) for x, y in zip(last, now, strict=True)]
                o, n, c, pos, sig, hist = now
                fresh = np.concatenate([[True], (o[1:] != o[:-1]) | (n[1:] != n[:-1])])
                first = np.maximum.accumulate(np.where(fresh, np.arange(len(o)), 0))
                last = [x[[first[-1], len(o) - 1]] for x in now]  # the next batch may go on with this size
                here = np.arange(1, len(o))
                i = np.concatenate([here - 1, first[1:]])
                j = np.concatenate([here, here])
                ok = (o[i] == o[j]) & (sig[i] != sig[j]).any(axis=1) & may(n[i], c[i], pos[i], n[j], c[j], pos[j])
                i, j = i[ok], j[ok]
                ok = (np.minimum(hist[i], hist[j]).sum(axis=1, dtype=np.int64) >= need(n[i], n[j])) | (n[i] > 65535)  # counts are 16 bits wide
                if ok.any():
                    yield _pairs(sig[i[ok]], sig[j[ok]])

        # ranges may cut a long list: neighbours across a cut are left to the last step
        order = [F.col("o"), F.col("n"), F.desc("c"), F.col("sig")]
        ordered = postings.repartitionByRange(*order).sortWithinPartitions(*order)
        pairs = ordered.mapInArrow(K.trimmed(run), "a binary, b binary")
        return self.tmp.keep(pairs.unionByName(self.originals(postings)).distinct(), "neighbours")

    def originals(self, postings: DataFrame) -> DataFrame:
        """Pairs of each set with the likely originals of its list: in each class of
        sizes, and in those beside it, the set with the largest share of shared shingles.

        An edit makes shingles that no other set has, so copies have a smaller share.
        At most three pairs a posting; the aggregate is combined before the shuffle.
        """
        may, need = self._may_link, self._need
        width = max(math.log(self.den / self.num) / 2, 0.01)
        of = postings.withColumn("size", F.floor(F.log("n") / width))
        best = F.min(F.struct((-F.col("c") / F.col("n")).alias("rank"), "sig", "n", "c", "pos", "hist")).alias("top")
        tops = of.groupBy("o", "size").agg(best)
        tops = tops.select("o", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"), *[F.col(f"top.{c}").alias(f"{c}2") for c in ("n", "c", "pos", "sig", "hist")])
        both = of.join(tops, ["o", "size"]).where("sig != sig2").select("n", "c", "pos", "sig", "hist", "n2", "c2", "pos2", "sig2", "hist2")

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                n, c, pos, n2, c2, pos2 = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 5, 6, 7))
                overlap = np.minimum(_hist(b.column(4)), _hist(b.column(9))).sum(axis=1, dtype=np.int64)
                ok = may(n, c, pos, n2, c2, pos2) & ((overlap >= need(n, n2)) | (n > 65535) | (n2 > 65535))
                if ok.any():
                    yield _pairs(_rows(b.column(3), 16)[ok], _rows(b.column(8), 16)[ok])

        return both.mapInArrow(K.trimmed(check), "a binary, b binary")

    # -- verification

    def _need(self, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
        """Least overlap of linked sets: ceil(t / (1 + t) * (n1 + n2))."""
        return -(-self.num * (n1 + n2) // (self.den + self.num))

    def _may_link(self, n1, c1, p1, n2, c2, p2):
        """Whether sets with a common shingle at these positions among c1 and c2 shared ones may link."""
        before, after = np.minimum(p1, p2), np.minimum(c1 - p1, c2 - p2) - 1
        return before + 1 + after >= self._need(n1, n2)

    def sets_of(self, nodes: DataFrame, name: str) -> DataFrame:
        """(sig, items) of these sets (one column, distinct); only they are moved."""
        nodes = self.tmp.keep(nodes.toDF("sig"), f"{name}_nodes")
        m = min(27, max(16, (16 * nodes.count()).bit_length()))
        wanted = self.spark.sparkContext.broadcast(self._bitmap(nodes, m))
        k = self.k

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.frombuffer(wanted.value, np.uint8)
            seen: set[bytes] = set()
            for b in batches:
                sig, items, size = [], [], 0
                for _, u, s in scan(b.column(0), k):
                    slot = int.from_bytes(s[:8], "big") >> (64 - m)
                    if len(u) and bits[slot >> 3] >> (slot & 7) & 1 and s not in seen:
                        seen.add(s)
                        sig.append(s)
                        items.append(u.tobytes())
                        size += len(items[-1])
                        if size > 8 << 20:
                            yield _table({"sig": pa.array(sig, pa.binary()), "items": pa.array(items, pa.binary())})
                            sig, items, size = [], [], 0
                if sig:
                    yield _table({"sig": pa.array(sig, pa.binary()), "items": pa.array(items, pa.binary())})

        found = self.texts.mapInArrow(K.trimmed(sets), "sig binary, items binary").dropDuplicates(["sig"])
        found = self.tmp.keep(found, f"{name}_sets")
        wanted.destroy()
        K.release(self.spark)
        return found

    def compare(self, pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        """(a, b, both, na, nb): the overlap and sizes of each pair (a, b)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = np.zeros((b.num_rows, 3), np.int64)
                for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                    u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    got[i, 1:] = len(u), len(v)
                    if len(u) < len(v):
                        u, v = v, u
                    at = np.searchsorted(u, v)
                    at[at == len(u)] = 0
                    got[i, 0] = (u[at] == v).sum()
                yield pa.RecordBatch.from_arrays([*b.columns[:2], *[pa.array(got[:, c]) for c in range(3)]], ["a", "b", "both", "na", "nb"])

        one = pairs.join(sets.select(F.col("sig").alias("a"), F.col("items").alias("x")), "a")
        two = one.join(sets.select(F.col("sig").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y")
        return self.tmp.keep(two.mapInArrow(K.trimmed(run), "a binary, b binary, both long, na long, nb long"), f"{name}_overlaps")

    def linked(self, overlap: Column) -> Column:
        """Whether sets of na and nb shingles with this overlap link."""
        return F.lit(self.den + self.num) * overlap >= F.lit(self.num) * (F.col("na") + F.col("nb"))

    def verify(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that link, by their whole sets, with overlap and sizes."""
        if not pairs.limit(1).count():
            return pairs.withColumns({c: F.lit(0).cast("long") for c in ("both", "na", "nb")})
        sets = self.sets_of(pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct(), name)
        out = self.compare(pairs, sets, name).where(self.linked(F.col("both")))
        self.tmp.drop(f"{name}_sets")
        return out

    def derive(self, pairs: DataFrame, links: DataFrame) -> DataFrame:
        """The pairs (a, b) that link, from the answers of similar sets as far as these decide.

        For a with the similar set x, and b with y:
        |a & b| <= |x & y| + |a - x| + |b - y| and |a & b| >= |x & y| - |x - a| - |y - b|.
        """
        ends = links.select(F.col("a").alias("s"), F.col("b").alias("x"), "both", F.col("na").alias("ns"), F.col("nb").alias("nx"))
        ends = ends.unionByName(links.select(F.col("b").alias("s"), F.col("a").alias("x"), "both", F.col("nb").alias("ns"), F.col("na").alias("nx")))
        degree = ends.groupBy(F.col("s").alias("x")).agg(F.count(F.lit(1)).alias("links"))
        nodes = self.tmp.keep(pairs.select(F.col("a").alias("s")).union(pairs.select("b")).distinct(), "open_nodes")
        near = ends.join(nodes, "s", "left_semi").join(degree, "x")
        best = near.groupBy("s").agg(F.max(F.struct("links", "x", (F.col("ns") - F.col("both")).alias("more"), (F.col("nx") - F.col("both")).alias("less"))).alias("near"))
        near = nodes.join(best, "s", "left").select("s", F.coalesce("near.x", "s").alias("x"), F.coalesce("near.more", F.lit(0)).alias("more"), F.coalesce("near.less", F.lit(0)).alias("less"))
        near = self.tmp.keep(near, "similar")
        of = lambda side: near.select(F.col("s").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("x", "more", "less")])
        both = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b")
        both = both.withColumns({"lo": F.least("x_a", "x_b"), "hi": F.greatest("x_a", "x_b"), "more": F.col("more_a") + F.col("more_b"), "less": F.col("less_a") + F.col("less_b")})
        both = self.tmp.keep(both.select("a", "b", "lo", "hi", "more", "less"), "lifted")
        sets = self.sets_of(near.select("s").union(near.select("x")).distinct(), "second")
        sizes = sets.select("sig", (F.octet_length("items") / 8).cast("long").alias("n"))
        asked = both.select(F.col("lo").alias("a"), F.col("hi").alias("b")).where("a != b").distinct()
        known = self.compare(asked, sets, "similar").select(F.col("a").alias("lo"), F.col("b").alias("hi"), F.col("both").alias("known"))
        own = sizes.select(F.col("sig").alias("lo"), F.col("sig").alias("hi"), F.col("n").alias("known"))  # one set is similar to both
        same = both.where("lo = hi").join(own, ["lo", "hi"])
        both = both.where("lo != hi").join(known, ["lo", "hi"]).unionByName(same)
        both = both.join(sizes.select(F.col("sig").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("sig").alias("b"), F.col("n").alias("nb")), "b")
        sure = self.linked(F.col("known") - F.col("less"))
        told = F.when(sure, F.lit(True)).when(~self.linked(F.col("known") + F.col("more")), F.lit(False))
        both = self.tmp.keep(both.select("a", "b", told.alias("told")), "told")
        rest = self.compare(both.where("told is null").select("a", "b"), sets, "rest").where(self.linked(F.col("both")))
        return both.where("told").select("a", "b").unionByName(rest.select("a", "b"))

    def _bitmap(self, nodes: DataFrame, m: int) -> bytes:
        """2**m bits, set at the first m bits of each signature."""

        def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _rows(b.column(0), 16)[:, :8].copy().view(">u8")[:, 0].astype(np.uint64) >> np.uint64(64 - m)
                x = np.unique(x)
                seg = (x >> np.uint64(16)).astype(np.int32)
                cut = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]])) if len(x) else np.zeros(0, int)
                low = (x & np.uint64(0xFFFF)).astype("<u2")
                ends = np.append(cut[1:], len(x))
                yield _table({"seg": pa.array(seg[cut]), "low": pa.array([low[a:e].tobytes() for a, e in zip(cut, ends, strict=True)], pa.binary())})

        def merge(t: pa.Table) -> pa.Table:
            bits = np.zeros(65536, np.uint8)
            for x in t.column("low").to_pylist():
                bits[np.frombuffer(x, "<u2")] = 1
            return pa.table({"seg": t.column("seg")[:1], "bits": pa.array([zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)], pa.binary())})

        out = np.zeros((1 << m) // 8, np.uint8)
        for r in nodes.select("sig").mapInArrow(K.trimmed(slots), "seg int, low binary").groupBy("seg").applyInArrow(merge, "seg int, bits binary").collect():
            out[r.seg * 8192 : (r.seg + 1) * 8192] = np.frombuffer(zlib.decompress(bytes(r.bits)), np.uint8)
        return out.tobytes()

    # -- 5. pairs of different components

    def crossing(self, postings: DataFrame, labels: DataFrame, block: int = 512) -> DataFrame:
        """Pairs of sets of different components that lists and positions allow.

        Lists of more than ``long_list`` postings are dealt out to a task for each pair of
        blocks: sizes are cut into classes so wide that linked sets are in one class
        or in classes beside each other, and a class has a salt for every
        ``long_list`` / 4 of its postings.
        """
        p = postings.join(labels, postings.sig == labels.node, "left").select("o", "n", "c", "pos", "sig", "hist", F.coalesce("label", "sig").alias("label"))
        p = self.tmp.keep(p, "labelled")
        mixed = p.groupBy("o").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo != hi").select("o", "size")
        mixed = self.tmp.keep(mixed, "mixed")
        dealt = p.join(mixed.where(F.col("size") <= self.long).select("o"), "o").withColumn("side", F.lit(-1)).withColumnRenamed("o", "task")
        hot = mixed.where(F.col("size") > self.long).select("o")
        if hot.limit(1).count():
            dealt = dealt.unionByName(self._block_pairs(p.join(hot, "o"), max(1, self.long // 4)))
        join = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            at = None
            for b in batches:
                if not b.num_rows:
                    continue
                o, n, c, pos, side = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
                sig, hist, lab = _rows(b.column(5), 16), _hist(b.column(6)), _rows(b.column(7), 16)
                cut = np.concatenate([[0], np.flatnonzero(o[1:] != o[:-1]) + 1, [len(o)]])
                for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    if held and o[i] != at:
                        yield from join._list(held, block)
                        held = []
                    at = o[i]
                    held.append((n[i:j], c[i:j], pos[i:j], side[i:j], sig[i:j], hist[i:j], lab[i:j]))
            if held:
                yield from join._list(held, block)

        ordered = dealt.select("task", "n", "c", "pos", "side", "sig", "hist", "label").repartition("task").sortWithinPartitions("task", "n", "c", "sig")
        return ordered.mapInArrow(K.trimmed(run), "a binary, b binary").distinct()

    def _block_pairs(self, p: DataFrame, most: int) -> DataFrame:
        """Postings of long lists, once for each task that compares their block with another.

        ``side`` is 0 and 1 for the two blocks of a task, -1 where a block meets itself.
        """
        width = math.log(self.den / self.num)
        # a little wider, as rounding must not part sets that link; alike sizes have one class where only equal sizes link
        p = p.withColumn("class", F.floor(F.log("n") / (width * 1.001)) if width else F.col("n").cast("long"))
        salts = p.groupBy("o", "class").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("salts"))
        salts = self.tmp.keep(salts, "salts")
        beside = lambda step, name: salts.select("o", (F.col("class") + step).alias("class"), F.col("salts").alias(name))
        d = p.join(salts, ["o", "class"]).join(beside(-1, "above"), ["o", "class"], "left").join(beside(1, "below"), ["o", "class"], "left")
        d = d.withColumn("salt", F.pmod(F.xxhash64("sig"), F.col("salts")).cast("int"))
        each = lambda count, f: F.transform(F.sequence(F.lit(1), F.coalesce(count, F.lit(0)), F.lit(1)), lambda i: f(i - 1))
        some = lambda count, f: F.when(F.coalesce(count, F.lit(0)) > 0, each(count, f)).otherwise(F.array().cast("array<struct<k:bigint,side:int>>"))
        key = lambda c1, s1, c2, s2: F.xxhash64(F.col("o"), c1, s1, c2, s2)
        own, cls = F.col("salt"), F.col("class")
        task = lambda k, side: F.struct(k.alias("k"), side.cast("int").alias("side"))
        within = some(F.col("salts"), lambda j: task(key(cls, F.least(own, j), cls, F.greatest(own, j)), F.when(j == own, F.lit(-1)).otherwise((own > j).cast("int"))))
        up = some(F.col("above"), lambda j: task(key(cls, own, cls + 1, j), F.lit(0)))
        down = some(F.col("below"), lambda j: task(key(cls - 1, j, cls, own), F.lit(1)))
        d = d.select("n", "c", "pos", "sig", "hist", "label", F.explode(F.concat(within, up, down)).alias("t"))
        return d.select(F.col("t.k").alias("task"), "n", "c", "pos", "sig", "hist", "label", F.col("t.side").alias("side"))

    def __getstate__(self) -> dict:  # workers need the thresholds only
        return {"num": self.num, "den": self.den}

    def _list(self, held: list[tuple], block: int) -> Iterator[pa.RecordBatch]:
        n, c_, pos, side, sig, hist, lab = (np.concatenate(x) for x in zip(*held, strict=True))
        _, lab = np.unique(np.ascontiguousarray(lab).view("V16")[:, 0], return_inverse=True)
        if not lab.any():
            return
        edges = [(i, min(i + block, len(n))) for i in range(0, len(n), block)]
        for x, (a, b) in enumerate(edges):
            for c, d in edges[x:]:
                # sizes ascend: when the smallest of the later block is too large, so are all that follow
                if self.den * n[b - 1] < self.num * n[c]:
                    break
                if lab[a:b].min() == lab[a:b].max() == lab[c:d].min() == lab[c:d].max():
                    continue
                # a whole block is skipped if even its best positions rule out a link
                best = min(pos[a:b].max(), pos[c:d].max()) + min((c_[a:b] - pos[a:b]).max(), (c_[c:d] - pos[c:d]).max())
                if best < self._need(n[a], n[c]):
                    continue
                ok = (lab[a:b, None] != lab[None, c:d]) & ((side[a:b, None] < 0) | (side[a:b, None] != side[None, c:d])) & self._may_link(n[a:b, None], c_[a:b, None], pos[a:b, None], n[None, c:d], c_[None, c:d], pos[None, c:d])
                i, j = np.nonzero(ok)
                i, j = i + a, j + c
                keep = i < j
                i, j = i[keep], j[keep]
                for q in range(0, len(i), 1 << 16):  # the classes' counts bound the overlap
                    x, y = i[q : q + (1 << 16)], j[q : q + (1 << 16)]
                    keep = np.minimum(hist[x], hist[y]).sum(axis=1, dtype=np.int64) >= self._need(n[x], n[y])
                    keep |= n[x] > 65535  # counts are 16 bits wide
                    if keep.any():
                        yield _pairs(sig[x[keep]], sig[y[keep]])

    # -- all

    def run(self) -> DataFrame:
        docs = self.signatures()
        total = docs.agg(F.sum("n")).first()[0] or 0
        nodes = docs.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("members"))
        nodes = self.tmp.keep(nodes, "nodes")
        postings = self.postings(*self.levels(total))
        K.release(self.spark)
        pairs = self.neighbours(postings)
        links = self.tmp.keep(self.verify(pairs, "first"), "links")
        labels = self.tmp.keep(components(links, self.tmp, "cc"), "labels")
        more = self.crossing(postings, labels).join(pairs, ["a", "b"], "left_anti")
        more = self.tmp.keep(more, "crossing")
        self.tmp.drop("labelled", "postings", "first_overlaps")
        K.release(self.spark)
        if more.limit(1).count():
            again = self.tmp.keep(self.derive(more, links), "links2")
            labels = self.tmp.keep(extend(labels, again, self.tmp, "dd"), "labels2")
        # the least id of each component, for nodes whose members may differ from it
        named = nodes.join(labels, nodes.sig == labels.node, "left").where("members > 1 or label is not null")
        named = named.select("sig", "first", F.coalesce("label", "sig").alias("label"))
        least = named.groupBy("label").agg(F.min("first").alias("component_id"))
        named = self.tmp.keep(named.join(least, "label").select("sig", "component_id"), "named")
        out = docs.join(named.withColumn("found", F.lit(True)), "sig", "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _pairs(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs with the smaller signature first."""
    xs, ys = (np.ascontiguousarray(s).view(">u8").astype(np.uint64) for s in (x, y))
    swap = (xs[:, 0] > ys[:, 0]) | ((xs[:, 0] == ys[:, 0]) & (xs[:, 1] > ys[:, 1]))
    both = np.where(swap[:, None], np.concatenate([y, x], axis=1), np.concatenate([x, y], axis=1))
    both = np.unique(np.ascontiguousarray(both).view("V32")[:, 0]).view(np.uint8).reshape(-1, 32)
    return _table({"a": _binary(both[:, :16]), "b": _binary(both[:, 16:])})


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, long_list: int = 8192) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text; other columns are ignored).

    Lists of more than ``long_list`` postings are dealt out to several tasks.
    """
    return Join(docs, k, num, den, long_list).run()
