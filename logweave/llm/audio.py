"""Telephony audio in media columns: mu-law, A-law and IMA ADPCM in WAV form.

Mu-law and A-law samples are expanded by 256-entry tables.  ADPCM blocks are
decoded side by side: numpy steps through the samples of a block, with one lane
for each block.  Decoded samples are resampled by linear interpolation and
stored as 16-bit PCM.

A cell holds a whole payload, so a text's samples are in one task's memory.  PCM
is stored by ``code_pcm``, which loses nothing.

Defined results: a null payload is empty; a null or broken media value gives a
row with ``error`` set and no samples; equal payloads give equal values.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as K

PCM, ALAW, MULAW, IMA = 1, 6, 7, 17


def mulaw_table() -> np.ndarray:
    u = ~np.arange(256, dtype=np.uint8)
    x = (((u & 15).astype(np.int32) << 3) + 132 << (u >> 4 & 7)) - 132
    return np.where(u & 128, -x, x).astype(np.int16)


def alaw_table() -> np.ndarray:
    a = np.arange(256, dtype=np.uint8) ^ 0x55
    seg, x = a >> 4 & 7, (a & 15).astype(np.int32) << 4
    x = np.where(seg == 0, x + 8, (x + 264) << np.maximum(seg.astype(np.int32) - 1, 0))
    return np.where(a & 128, x, -x).astype(np.int16)


#: Fixed values of the IMA ADPCM format: changes of the step index.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def step_table() -> np.ndarray:
    """The 89 step sizes: about a tenth more each, from 7 to 32767."""
    out = [7, 8, 9, 10, 11, 12, 13, 14, 16, 17]  # fixed values of the format, as are the next
    out += [19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307]
    out += [337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660]
    out += [4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767]
    return np.array(out, np.int32)


MU, AL, STEPS = mulaw_table(), alaw_table(), step_table()


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """Mono IMA ADPCM blocks, a row each (4 header bytes, then two samples a byte)."""
    head = blocks[:, :4]
    value = (head[:, 0].astype(np.int32) | head[:, 1].astype(np.int32) << 8).astype(np.uint16).view(np.int16).astype(np.int32)
    index = np.clip(head[:, 2].astype(np.int32), 0, 88)
    body = blocks[:, 4:]
    out = np.empty((len(blocks), 1 + 2 * body.shape[1]), np.int16)
    out[:, 0] = value
    for k in range(2 * body.shape[1]):
        code = (body[:, k >> 1] >> (4 * (k & 1))) & 15
        step = STEPS[index]
        diff = step >> 3
        for bit, shift in ((4, 0), (2, 1), (1, 2)):
            diff = diff + np.where(code & bit, step >> shift, 0)
        value = np.clip(value + np.where(code & 8, -diff, diff), -32768, 32767)
        index = np.clip(index + INDEX_STEP[code], 0, 88)
        out[:, k + 1] = value
    return out


def wav(payload: bytes, codec: int, rate: int, align: int = 1) -> bytes:
    """A WAV file whose data chunk is the payload."""
    bits = {PCM: 16, IMA: 4}.get(codec, 8)
    extra = struct.pack("<H", 2 * (align - 4) + 1) if codec == IMA else b""
    per_second = rate * 2 if codec == PCM else rate * align // max(1, 2 * (align - 4) + 1) if codec == IMA else rate
    fmt = struct.pack("<HHIIHHH", codec, 1, rate, per_second, align, bits, len(extra)) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """(codec, rate, block align, data)."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE" or struct.unpack_from("<I", media, 4)[0] + 8 != len(media):
        raise ValueError("not a WAV file, or its length is wrong")
    at, fmt = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if at + 8 + size > len(media):
            raise ValueError("a chunk is cut short")
        if name == b"fmt ":
            if size < 16:
                raise ValueError("the format chunk is too short")
            fmt = struct.unpack_from("<HHIIH", media, at + 8)
        elif name == b"data":
            if fmt is None or fmt[1] != 1:
                raise ValueError("no format before the data, or not mono")
            return fmt[0], fmt[2], fmt[4], media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def decode(codec: int, align: int, data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if codec == MULAW:
        return MU[raw]
    if codec == ALAW:
        return AL[raw]
    if codec == PCM:
        return raw[: len(raw) & ~1].view("<i2")
    if codec == IMA:
        if align < 5 or len(raw) % align:
            raise ValueError("the data is not whole blocks")
        return decode_ima(raw.reshape(-1, align)).ravel()
    raise ValueError(f"codec {codec} is not supported")


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    if rate == to or not len(x):
        return x.astype("<i2")
    n = -(-len(x) * to // rate)
    at = np.arange(n, dtype=np.float64) * (rate / to)
    low = np.minimum(at.astype(np.int64), len(x) - 1)
    part = at - low
    high = np.minimum(low + 1, len(x) - 1)
    return np.rint(x[low] * (1 - part) + x[high] * part).astype("<i2")


def feature(pcm: np.ndarray) -> str:
    """Samples, peak, mean absolute value and sign changes: integers, so equal everywhere."""
    if not len(pcm):
        return "n=0"
    wide = pcm.astype(np.int32)
    changes = int(np.count_nonzero((wide[1:] < 0) != (wide[:-1] < 0)))
    return f"n={len(pcm)};peak={int(np.abs(wide).max())};mean_abs={int(np.abs(wide).sum(dtype=np.int64)) // len(pcm)};sign_changes={changes};pcm_crc={zlib.crc32(pcm.tobytes())}"


def code_pcm(pcm: np.ndarray) -> bytes:
    """Samples in a form that compresses well, without loss.

    The samples at even places, then what those at odd places differ from the mean
    of their neighbours (the predict step of an integer wavelet), as 16-bit numbers
    modulo 2^16.
    """
    even, odd = pcm[::2], pcm[1::2]
    after = np.append(even[1:], even[-1:])[: len(odd)].astype(np.int32)
    rest = odd - ((even[: len(odd)] + after) >> 1)
    return even.astype("<i2").tobytes() + rest.astype(np.int32).astype("<i2").tobytes()


def read_pcm(coded: bytes) -> np.ndarray:
    """The samples that ``code_pcm`` was given."""
    x = np.frombuffer(coded, "<i2")
    n = len(x)
    even, rest = x[: n - n // 2], x[n - n // 2 :]
    after = np.append(even[1:], even[-1:])[: len(rest)].astype(np.int32)
    out = np.empty(n, "<i2")
    out[::2] = even
    out[1::2] = (rest + ((even[: len(rest)] + after) >> 1)).astype("<i2")
    return out


def _some(b: pa.RecordBatch, limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` bytes by the last column, so that what is made of them stays small."""
    for lo, hi, _, _ in _rows(b.column(b.num_columns - 1), limit):
        yield b.slice(lo, hi - lo)


def _rows(col: pa.Array, limit: int) -> Iterator[tuple]:
    last = -1
    for lo, hi, data, offs in K.pieces(col, limit):
        if lo > last:  # a long row comes in several pieces
            last = hi - 1
            yield lo, hi, data, offs


def store_audio(df: DataFrame, payload: str, codec: int = MULAW, rate: int = 8000, pad: int = 576, align: int = 1) -> DataFrame:
    """``n_bytes`` and ``media``, the payload filled with bytes 255 to a positive multiple of ``pad`` as a WAV file, after all columns but these."""
    K.prepare(df.sparkSession)
    out = df.select(*K.but(df, "n_bytes", "media"), F.coalesce(F.col(K.quoted(payload)).cast("binary"), F.lit(b"")).alias("__lw_payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _some(whole):
                p = b.column(b.num_columns - 1).to_pylist()
                filled = (x + b"\xff" * (-len(x) % pad or (0 if x else pad)) for x in p)
                media = pa.array([wav(x, codec, rate, align) for x in filled], pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([len(x) for x in p], pa.int64()), media], [*b.schema.names[:-1], "n_bytes", "media"])

    return K.map_arrow(out, run, "n_bytes long, media binary", ("__lw_payload",))


READ = "codec int, rate int, payload binary, pcm binary, feature string, error string"
READ_NAMES = tuple(x.split()[0] for x in READ.split(", "))


def read_audio(df: DataFrame, media: str = "media", to_rate: int = 16000, keep_pcm: bool = True, coded: bool = False) -> DataFrame:
    """codec, rate, payload (the data chunk), resampled pcm, feature and error, after all columns but these.

    ``coded``: pcm is as ``code_pcm`` gives it, to be stored.
    """
    K.prepare(df.sparkSession)
    df = df.select(*K.but(df, media, *READ_NAMES), K.quoted(media))

    def one(x: bytes | None) -> tuple:
        try:
            codec, rate, align, data = parse_wav(x or b"")
            pcm = resample(decode(codec, align, data), rate, to_rate)
            kept = (code_pcm(pcm) if coded else pcm.tobytes()) if keep_pcm else None
            return codec, rate, data, kept, feature(pcm), None
        except ValueError as e:
            return None, None, None, None, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.string()]
        for whole in batches:
            for b in _some(whole):
                cols = list(zip(*[one(v.as_py()) for v in b.column(b.num_columns - 1)], strict=True))
                yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], [*b.schema.names, *READ_NAMES])

    return K.map_arrow(df, run, READ)


def read_stored(df: DataFrame) -> DataFrame:
    """From stored media and coded pcm to payload (the data chunk) and the pcm's feature; other columns stay."""
    K.prepare(df.sparkSession)
    df = df.select(*K.but(df, "media", "pcm", "payload", "feature"), "media", "pcm")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _some(whole):
                payload = [parse_wav(v.as_py())[3] for v in b.column(b.num_columns - 2)]
                told = [feature(read_pcm(v.as_py())) for v in b.column(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(payload, pa.binary()), pa.array(told)], [*b.schema.names[:-1], "payload", "feature"])

    return K.map_arrow(df, run, "payload binary, feature string", ("pcm",))
