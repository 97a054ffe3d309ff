"""The parts of the msgpack format that log frames use."""

from __future__ import annotations

import struct
from typing import Any


class Truncated(ValueError):
    """The bytes end inside a value."""


#: Fixed values of the format: first byte -> (kind, struct code or width of the length).
_NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
_SIZED = {0xC4: ("bin", 1), 0xC5: ("bin", 2), 0xC6: ("bin", 4), 0xD9: ("str", 1), 0xDA: ("str", 2), 0xDB: ("str", 4), 0xDC: ("arr", 2), 0xDD: ("arr", 4), 0xDE: ("map", 2), 0xDF: ("map", 4), 0xC7: ("ext", 1), 0xC8: ("ext", 2), 0xC9: ("ext", 4)}


def unpack(buf: bytes, at: int = 0) -> tuple[Any, int]:
    """(value, end).  Extension values come as bytes."""

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(buf):
            raise Truncated
        at += n
        return buf[at - n : at]

    b = take(1)[0]
    if b < 0x80:
        return b, at
    if b >= 0xE0:
        return b - 256, at
    if b in (0xC0, 0xC2, 0xC3):
        return (None, None, False, True)[b - 0xC0], at
    if b in _NUMBERS:
        code = _NUMBERS[b]
        return struct.unpack(code, take(struct.calcsize(code)))[0], at
    if 0xD4 <= b <= 0xD8:
        return take(1 + (1 << (b - 0xD4)))[1:], at
    if b in _SIZED:
        kind, width = _SIZED[b]
        n = int.from_bytes(take(width), "big")
    elif b < 0x90:
        kind, n = "map", b & 15
    elif b < 0xA0:
        kind, n = "arr", b & 15
    elif b < 0xC0:
        kind, n = "str", b & 31
    else:
        raise ValueError(f"unknown byte {b:#x}")
    if kind == "str":
        return take(n).decode("utf-8", "replace"), at
    if kind == "bin":
        return take(n), at
    if kind == "ext":
        return take(n + 1)[1:], at
    out: list | dict = [] if kind == "arr" else {}
    for _ in range(n):
        v, at = unpack(buf, at)
        if kind == "arr":
            out.append(v)
        else:
            out[v if isinstance(v, str) else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)], at = unpack(buf, at)
    return out, at


def pack(v: Any) -> bytes:
    def sized(n: int, fix: int, most: int, codes: tuple[int, ...]) -> bytes:
        if n < most:
            return bytes([fix | n])
        for code, width in zip(codes, (1, 2, 4) if len(codes) == 3 else (2, 4), strict=True):
            if n < 1 << 8 * width:
                return bytes([code]) + n.to_bytes(width, "big")
        raise ValueError("too long")

    if v is None or isinstance(v, bool):
        return bytes([0xC0 if v is None else 0xC2 + v])
    if isinstance(v, int):
        if -32 <= v < 128:
            return struct.pack(">b", v)
        return b"\xd3" + struct.pack(">q", v) if v < 1 << 63 else b"\xcf" + struct.pack(">Q", v)
    if isinstance(v, float):
        return b"\xcb" + struct.pack(">d", v)
    if isinstance(v, str):
        raw = v.encode()
        return sized(len(raw), 0xA0, 32, (0xD9, 0xDA, 0xDB)) + raw
    if isinstance(v, (bytes, bytearray)):
        return sized(len(v), 0, 0, (0xC4, 0xC5, 0xC6)) + bytes(v)
    if isinstance(v, (list, tuple)):
        return sized(len(v), 0x90, 16, (0xDC, 0xDD)) + b"".join(map(pack, v))
    if isinstance(v, dict):
        return sized(len(v), 0x80, 16, (0xDE, 0xDF)) + b"".join(pack(k) + pack(x) for k, x in v.items())
    raise TypeError(type(v).__name__)
