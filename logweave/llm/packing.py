"""Packing by Karmarkar-Karp multiway differencing.

Texts are tokenized, cut into full windows and a rest, and the rests of a batch
are divided into near-equal windows: each rest starts as a partial partition of
itself against empty windows, and the two partial partitions of the largest
spread are merged again and again, the fullest window of one with the emptiest
of the other.  If a window exceeds the capacity, the count of windows rises.

Token ids are those of the tokenizer: texts are split at ASCII white space and
at borders between ASCII punctuation and letters, which its pre-tokenizer never
crosses, and each distinct part is encoded by it once per worker.  Parts near
other characters are not split, and texts that hold a special token's string are
encoded whole.

Defined results: a null or empty text has the end id alone; repeated rows are
packed each; an empty table gives no rows.  Sequences never span partitions, so
a lost task is run again by itself and gives the same rows.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as K

SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

_SPACE, _LETTER, _DIGIT, _PUNCT, _OTHER = range(5)
_CLASS = np.full(256, _PUNCT, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[128:] = _OTHER
_NOT_SPACE = _CLASS != _SPACE
#: Control characters and the apostrophe (contractions) are never split from what is beside them.
_CLASS[[*range(9), *range(14, 32), 39, 127]] = _OTHER


def parts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends of parts that can be encoded alone; each row's first part."""
    c = _CLASS[data]
    n = len(data)
    # U+00C0 to U+00FF without the two signs are letters: lead byte 0xC3 and its trail byte
    lead = np.flatnonzero(data[:-1] == 0xC3) if n else np.zeros(0, np.int64)
    trail = data[lead + 1] if n else lead
    lead = lead[(trail >= 0x80) & (trail != 0x97) & (trail != 0xB7)]
    c[lead] = c[lead + 1] = _LETTER
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    # a space-delimited chunk with a character of another class is one part
    chunk_start, chunk_end, _ = K.spans(np.arange(256) > 0, (c != _SPACE).view(np.uint8), offs)
    odd = np.zeros(n + 1, np.int32 if n < 1 << 31 else np.int64)
    np.cumsum(c == _OTHER, out=odd[1:])
    whole = (odd[chunk_end] - odd[chunk_start]) > 0
    is_whole = np.zeros(n + 1, np.int8)
    np.add.at(is_whole, chunk_start[whole], 1)
    np.add.at(is_whole, chunk_end[whole], -1)
    is_whole = np.cumsum(is_whole[:n], dtype=np.int8).view(bool)
    cut = np.zeros(n + 1, bool)
    if n:
        cut[1:n] = (c[1:] != c[:-1]) & ~(is_whole[1:] & is_whole[:-1])
    cut |= edge
    at = np.flatnonzero(cut)
    starts, ends = at[:-1], at[1:]
    word = c[starts] != _SPACE if n else np.zeros(0, bool)
    starts, ends = starts[word], ends[word]
    return starts, ends, np.searchsorted(starts, offs)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a place of each, and for each place the number of its value."""
    order = np.argsort(x)
    s = x[order]
    new = np.ones(len(x), bool)
    new[1:] = s[1:] != s[:-1]
    back = np.empty(len(x), np.int64)
    back[order] = np.cumsum(new) - 1
    return s[new], order[new], back


def _runs(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of runs of ``size`` from ``starts`` on, one run after the other."""
    end = np.cumsum(size)
    return np.repeat(starts - (end - size), size) + np.arange(end[-1] if len(end) else 0)


#: Parts that are encoded at once, as the library's result for a part is far larger than its ids.
ENCODED = 4096


class Encoder:
    """Token ids of batches of texts, with a bounded memory of parts seen.

    Parts are looked up by hash, and their bytes are compared with the remembered
    ones, so different parts of one hash get their own ids.
    """

    def __init__(self, path: str, most: int = 2_000_000):
        # a task has one core; a thread for each of the machine's cores would also have a heap of its own
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.most = most
        self.keys = np.zeros(0, np.uint64)  # sorted; for each the places and counts of its ids and bytes
        self.first, self.count = np.zeros(0, np.uint32), np.zeros(0, np.uint16)
        self.at, self.size = np.zeros(0, np.uint32), np.zeros(0, np.uint16)
        self.ids = np.zeros(0, np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32)
        self.raw = np.zeros(0, np.uint8)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        first = np.zeros(len(texts) + 1, np.int64)
        flat = [np.zeros(0, np.uint32)]
        for a in range(0, len(texts), ENCODED):
            found = [e.ids for e in self.tok.encode_batch_fast(texts[a : a + ENCODED], add_special_tokens=False)]
            size = [len(x) for x in found]
            first[a + 1 : a + 1 + len(size)] = size
            flat.append(np.fromiter((i for x in found for i in x), np.uint32, sum(size)))
        return np.cumsum(first, out=first), np.concatenate(flat)

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tok.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)

    def rows(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows in one array, and each row's first (one more than rows)."""
        folded = K.fold(data)
        starts, ends, first = parts(folded, offs)
        hashes = K.run_hashes(folded, starts, ends)
        known, at, back = _distinct(hashes)
        where = np.searchsorted(self.keys, known)
        where[where == len(self.keys)] = 0
        new = self.keys[where] != known if len(self.keys) else np.ones(len(known), bool)
        fresh, old = at[new], where[~new]
        size = ends - starts
        rep = at[back]
        same = (size == size[rep]).all() and K.same_runs(folded, starts, folded, starts[rep], size).all()
        kept = at[~new]
        if not same or (len(old) and not ((self.size[old] == size[kept]).all() and K.same_runs(folded, starts[kept], self.raw, self.at[old].astype(np.int64), size[kept]).all())):
            return self._apart(folded.tobytes(), starts, ends, first)
        raw = folded.tobytes()
        nf, ni = self._encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[fresh].tolist(), ends[fresh].tolist(), strict=True)])
        count = np.empty(len(known), np.int64)
        src = np.empty(len(known), np.int64)
        used = self.ids[_runs(self.first[old].astype(np.int64), self.count[old].astype(np.int64))]
        count[~new], count[new] = self.count[old], np.diff(nf)
        src[~new], src[new] = np.cumsum(count[~new]) - count[~new], nf[:-1] + len(used)
        n = count[back]
        out = np.concatenate([used, ni])[_runs(src[back], n)].astype(np.uint32, copy=False)
        begin = np.concatenate([[0], np.cumsum(n)])[first]
        short = (size[fresh] < 1 << 16) & (np.diff(nf) < 1 << 16)
        if len(self.keys) + len(fresh) <= self.most and short.any():
            self._learn(known[new][short], nf[:-1][short], np.diff(nf)[short], ni, folded, starts[fresh][short], size[fresh][short])
        return out, begin

    def _apart(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids where a hash stands for several parts: each part by its bytes."""
        texts = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        number = {t: i for i, t in enumerate(dict.fromkeys(texts))}
        nf, ni = self._encode([t.decode("utf-8", "replace") for t in number])
        each = [ni[nf[number[t]] : nf[number[t] + 1]] for t in texts]
        begin = np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)])[first]
        return np.concatenate([np.zeros(0, np.uint32), *each]).astype(np.uint32), begin

    def _learn(self, keys: np.ndarray, first: np.ndarray, count: np.ndarray, ids: np.ndarray, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> None:
        where = np.searchsorted(self.keys, keys)
        end = np.cumsum(size)
        for name, new in (("keys", keys), ("first", first + len(self.ids)), ("count", count), ("at", end - size + len(self.raw)), ("size", size)):
            old = getattr(self, name)
            setattr(self, name, np.insert(old, where, new.astype(old.dtype)))
        self.ids = np.concatenate([self.ids, ids.astype(self.ids.dtype)])
        self.raw = np.concatenate([self.raw, data[_runs(starts, size)]])


def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary, until a task of another operator comes."""
    own = K.remembered.setdefault(__name__, {})
    if path not in own:
        own[path] = Encoder(path)
    return own[path]


def tokenize(col: pa.Array, path: str, end_id: int) -> Iterator[np.ndarray]:
    """Ids of each row with the end id.

    A long text comes in pieces cut at white space, where the tokenizer splits too.
    A piece with a special token's string is encoded whole.
    """
    enc = encoder(path)
    held: list[np.ndarray] = []
    at = 0
    for a, b, data, offs in K.pieces(col, 1 << 20, _NOT_SPACE):
        raw = data.tobytes()
        odd = any(s in raw for s in enc.special)
        ids, begin = enc.rows(data, offs)
        if held and a != at:
            yield _ended(held, end_id)
            held = []
        for i in range(b - a):
            own = ids[begin[i] : begin[i + 1]]
            if odd and any(s in raw[offs[i] : offs[i + 1]] for s in enc.special):
                own = enc.whole(raw[offs[i] : offs[i + 1]])
            if b - a == 1:  # more of this row may follow
                at = a
                held.append(own)
            else:
                yield _ended([own], end_id)
    if held:
        yield _ended(held, end_id)


def _ended(ids: list[np.ndarray], end_id: int) -> np.ndarray:
    return np.concatenate([*ids, np.array([end_id], np.uint32)]).astype("<u4")


def difference(sizes: np.ndarray, k: int) -> list[list[int]]:
    """Karmarkar-Karp: indexes of ``sizes`` in each of ``k`` near-equal windows.

    A partial partition holds its sums from the largest, less the least one, and how
    it was made: from which two, and in which order their sums stand.  Windows are
    told from the last one back to the single sizes.
    """
    heap: list = []
    made: list = [None] * len(sizes)
    # what a partition holds is never over the largest size; numbers of two bytes are sorted fastest
    kind = np.int16 if not len(sizes) or sizes.max() < 1 << 14 else np.int64
    for i, s in enumerate(sizes.tolist()):
        sums = np.zeros(k, kind)
        sums[0] = s
        heap.append((-s, i, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heap[0]
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]
        heapq.heapreplace(heap, (-int(sums[0]), len(made), sums))
        made.append((i, j, order))
    out: list[list[int]] = [[] for _ in range(k)]
    window = {len(made) - 1: np.arange(k)}
    for n in range(len(made) - 1, -1, -1):
        own = window.pop(n)
        if made[n] is None:
            out[own[0]].append(n)
            continue
        i, j, order = made[n]
        window[i], window[j] = np.empty(k, np.int64), np.empty(k, np.int64)
        window[i][order] = own
        window[j][k - 1 - order] = own
    return out


def windows_of(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """As few near-equal windows as differencing can keep within the capacity."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        got = difference(sizes, k)
        if all(sizes[m].sum() <= capacity for m in got if m):
            return [m for m in got if m]
        k += 1


#: Bytes of ids after which a worker hands its rows on.
OUT_BYTES = 1 << 20


class Packer:
    """Cuts, batches and packs the documents of one partition."""

    def __init__(self, part: int, capacity: int, batch: int, piece: int):
        self.capacity, self.batch, self.piece = capacity, batch, piece
        self.next = part << 33
        self.out: list[tuple] = []
        self.out_bytes = 0
        self.rest: list[tuple] = []
        self.waiting = 0

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        n = len(ids)
        full = n - n % self.capacity
        for a in range(0, full, self.capacity):
            self._place([(doc_id, a, ids[a : a + self.capacity], n)])
        # a rest is cut into pieces, of which many make windows nearly equal
        for a in range(full, n, self.piece):
            cut = ids[a : min(a + self.piece, n)].copy()  # else all ids of the document would wait with it
            self.rest.append((doc_id, a, cut, n))
            self.waiting += len(cut)
        if self.waiting >= self.batch * self.capacity:
            self.flush(False)

    def _place(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, n in pieces:
            self.out.append((doc_id, start, len(ids), ids.tobytes(), n, self.next, at))
            self.out_bytes += ids.nbytes
            at += len(ids)
        self.next += 1

    def flush(self, last: bool) -> None:
        if not self.rest:
            return
        take, keep = self.rest, []
        if not last:  # leave a sliver of room, so that near-equal windows fit
            room, total, i = self.batch * (self.capacity - 4), 0, 0
            while i < len(take) and total + len(take[i][2]) <= room:
                total += len(take[i][2])
                i += 1
            take, keep = take[:i], take[i:]
        sizes = np.array([len(x[2]) for x in take], np.int64)
        for m in windows_of(sizes, self.capacity):
            self._place([take[i] for i in sorted(m)])
        self.rest, self.waiting = keep, sum(len(x[2]) for x in keep)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, batch: int = 128, piece: int = 256) -> DataFrame:
    """A row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    ``batch`` windows are filled at a time, and rests are cut into pieces of at
    most ``piece`` ids.  ``docs`` has doc_id and text.
    """
    K.prepare(docs.sparkSession)
    schema = K.schema(docs.select("doc_id"), SCHEMA)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, id_type = Packer(TaskContext.get().partitionId(), capacity, batch, piece), None

        def taken() -> pa.RecordBatch:
            cols = list(zip(*packer.out, strict=True)) or [[]] * 7
            packer.out, packer.out_bytes = [], 0
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for b in batches:
            id_type = b.column(0).type
            for doc_id, ids in zip(b.column(0).to_pylist(), tokenize(b.column(1), tokenizer, end_id), strict=True):
                packer.add(doc_id, ids)
                if len(packer.out) >= 4000 or packer.out_bytes >= OUT_BYTES:
                    yield taken()
            K.trim()
        if id_type is not None:
            packer.flush(True)
            yield taken()

    return docs.select("doc_id", "text").mapInArrow(K.trimmed(run, __name__), schema)
