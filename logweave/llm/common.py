"""Shared plumbing: scratch tables, worker imports, null-safe joins, byte kernels.

The byte kernels work on whole Arrow columns at once: a column of texts is one
contiguous byte array plus offsets, so word boundaries and word hashes of a few
megabytes of text are found by a handful of numpy passes.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROOT = str(Path(__file__).resolve().parents[2])

#: Rows up to which a side is sent to every executor; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


# --------------------------------------------------------------------------- session


#: Bytes of input that a Python worker gets at once; a longer row comes alone.
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when it is run from a checkout, and bound their batches."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).rstrip("b") != str(BATCH_BYTES):
        spark.conf.set(name, BATCH_BYTES)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *paths])
    return spark


_own_dirs: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder all machines share; a temporary one only where a local session has none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="logweave-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone by then
        pass


class Scratch:
    """Tables written for one query; lineage ends at them, so lost executors cost little.

    ``keep`` writes a DataFrame as Parquet in the shared folder and reads it back.
    ``drop`` removes tables that no later step reads; the rest go when Python exits.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/logweave-{name}-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, self.path)

    def keep(self, df: DataFrame, name: str, **options: str | int) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _remove(self.spark, f"{self.path}/{name}")


def release(spark: SparkSession) -> None:
    """Have the driver drop references to finished shuffles, so their files go."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes of texts and binaries up to which such a side is sent.
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after counting at most ``limit + 1`` rows and the bytes of their texts.

    ``df`` should be a written table, as it is read for this.
    """
    wide = [F.octet_length(quoted(c)) for c, t in df.dtypes if t in ("string", "binary")]
    size = sum((F.coalesce(F.sum(x), F.lit(0)) for x in wide), F.lit(0))
    n, total = df.limit(limit + 1).agg(F.count(F.lit(1)), size).first()
    return F.broadcast(df) if n <= limit and total <= BROADCAST_BYTES else df


def quoted(name: str) -> str:
    """A column's name for ``select`` and ``col``, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def but(df: DataFrame, *names: str) -> list[str]:
    """Quoted names of the columns but these."""
    return [quoted(c) for c in df.columns if c not in names]


def schema(df: DataFrame, more: str = "", drop: tuple[str, ...] = ()) -> StructType:
    """Fields of ``df`` without ``drop``, then those of the DDL text ``more``."""
    return StructType([f for f in df.schema.fields if f.name not in drop] + (StructType.fromDDL(more).fields if more else []))


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; the left side's keys stay."""
    names = {k: f"__r_{k}" for k in keys}
    right = right.select(*[F.col(quoted(k)).alias(names[k]) for k in keys], *but(right, *keys))
    cond = None
    for k in keys:
        c = F.col(quoted(k)).eqNullSafe(F.col(names[k]))
        cond = c if cond is None else cond & c
    return left.join(right, cond, how).drop(*names.values())


def trim() -> None:
    """Give free memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: What a worker process remembers from task to task, by the name of the operator that needs it.
remembered: dict[str, dict] = {}


def forget(but: str | None = None) -> None:
    """Drop what this worker has ``remembered`` for other operators than ``but``."""
    for name in [k for k in remembered if k != but]:
        del remembered[name]


def trimmed(run: Callable, remembers: str | None = None) -> Callable:
    """``run``, after which its worker gives memory that it no longer needs back, as workers outlive tasks.

    What the worker has ``remembered`` for other operators than ``remembers`` goes before.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(remembers)
        yield from run(batches)
        trim()

    return whole


def map_arrow(df: DataFrame, run: Callable, more: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """``mapInArrow`` whose result has the columns of ``df`` without ``drop``, then ``more``.

    Within, the columns of ``df`` have plain names, as Spark takes no backtick there.
    """
    plain = df.toDF(*[f"__c{i}" for i in range(len(df.columns))])
    run = trimmed(run)
    gone = tuple(p for p, c in zip(plain.columns, df.columns, strict=True) if c in drop)
    out = plain.mapInArrow(run, schema(plain, more, gone))
    kept = [c for c in df.columns if c not in drop]
    return out.toDF(*kept, *out.columns[len(kept) :])


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only.  Pure ASCII strings take the JVM's fast path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


# --------------------------------------------------------------------------- byte kernels


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (one more than rows) of a binary column; null is empty."""
    wide = pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return d, o


def pieces(col: pa.Array, limit: int = 1 << 20, keep: np.ndarray | None = None, step: int = 1) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of pieces of about ``limit`` bytes.

    A row longer than that comes as several pieces: cut before a byte outside
    ``keep``, so no run of kept bytes is cut, or else at a multiple of ``step``.
    """
    if not len(col):
        return
    data, offs = buffers(col)
    size = np.diff(offs)
    a = 0
    while a < len(col):
        if size[a] <= limit:
            b = int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1
            b = min(max(b, a + 1), len(col))
            yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            a = b
            continue
        lo, end = int(offs[a]), int(offs[a + 1])
        while lo < end:
            hi = min(lo + max(limit // step, 1) * step, end)
            while keep is not None and hi < end:
                out = np.flatnonzero(~keep[data[hi : min(hi + 65536, end)]])
                if len(out):
                    hi += int(out[0])
                    break
                hi = min(hi + 65536, end)
            yield a, a + 1, data[lo:hi], np.array([0, hi - lo])
            lo = hi
        a += 1


def splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(seed)
        return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (works in place on a uint64 array)."""
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def spans(keep: np.ndarray, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes whose class in ``keep`` is true.

    Runs end at row boundaries.  The third array gives each row's first run.
    """
    inside = keep[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first, last = inside.copy(), inside.copy()
    if n:
        first[1:] &= ~inside[:-1] | edge[1:n]
        last[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


#: Runs of up to this many 8-byte lanes are hashed together; longer ones one by one.
LANES = 8
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_SEED = np.uint64(0x1F83D9ABFB41BD6B)


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number (places need not be aligned)."""
    padded = np.empty(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    padded[len(data) :] = 0
    return np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs.

    Each lane of eight bytes is mixed into the state by a bijection, so runs of
    one length up to eight bytes never collide, and others do by chance only.
    """
    lanes, size = _lanes(data), ends - starts
    with np.errstate(over="ignore"):
        h = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _SEED)
    h ^= lanes[starts] & _MASK[np.minimum(size, 8)]
    mix(h)
    at = np.flatnonzero(size > 8)
    for j in range(1, LANES):
        if not len(at):
            break
        rest = size[at] - 8 * j
        h[at] = mix(h[at] ^ (lanes[starts[at] + 8 * j] & _MASK[np.minimum(rest, 8)]))
        at = at[rest > 8]
    if len(at):
        import xxhash

        h[at] = [xxhash.xxh3_64_intdigest(data[a:b].tobytes(), int(_SEED)) for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
    return h


def same_runs(x: np.ndarray, x_starts: np.ndarray, y: np.ndarray, y_starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether runs of ``x`` and ``y`` (of equal sizes) have the same bytes."""
    a, b = _lanes(x), _lanes(y)
    ok = (a[x_starts] ^ b[y_starts]) & _MASK[np.minimum(size, 8)] == 0
    at = np.flatnonzero(ok & (size > 8))
    for j in range(1, LANES):
        if not len(at):
            break
        rest = size[at] - 8 * j
        same = (a[x_starts[at] + 8 * j] ^ b[y_starts[at] + 8 * j]) & _MASK[np.minimum(rest, 8)] == 0
        ok[at[~same]] = False
        at = at[same & (rest > 8)]
    for i in at.tolist():
        ok[i] = np.array_equal(x[x_starts[i] : x_starts[i] + size[i]], y[y_starts[i] : y_starts[i] + size[i]])
    return ok


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def fold(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return _FOLD[data]
