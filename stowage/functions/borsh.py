"""A codec for the Borsh encoding, driven by type descriptions.

Types: "u8", "u32", "u64", "bool", "string", "bytes" (a list of u8), ("fixed",
n), ("option", t), ("list", t), ("struct", [(name, t), ...]) and ("enum",
[(name, t or None), ...]). Structs are dictionaries, enums (name, value).
Public specification: little-endian numbers, u32 counts, one-byte tags.
"""

from __future__ import annotations

import struct

_NUMBERS = {"u8": "<B", "u32": "<I", "u64": "<Q"}


def encode(kind, value) -> bytes:
    if isinstance(kind, str) and kind in _NUMBERS:
        return struct.pack(_NUMBERS[kind], value)
    if kind == "bool":
        return b"\1" if value else b"\0"
    if kind == "string":
        data = value.encode()
        return struct.pack("<I", len(data)) + data
    if kind == "bytes":
        return struct.pack("<I", len(value)) + bytes(value)
    name, of = kind
    if name == "fixed":
        if len(value) != of:
            raise ValueError(f"{of} bytes are due, not {len(value)}")
        return bytes(value)
    if name == "option":
        return b"\0" if value is None else b"\1" + encode(of, value)
    if name == "list":
        return struct.pack("<I", len(value)) + b"".join(encode(of, x) for x in value)
    if name == "struct":
        return b"".join(encode(t, value[n]) for n, t in of)
    at = next(k for k, (n, _) in enumerate(of) if n == value[0])
    return bytes([at]) + (encode(of[at][1], value[1]) if of[at][1] is not None else b"")


def _take(data: bytes, at: int, n: int) -> tuple[bytes, int]:
    if at + n > len(data):
        raise ValueError("the record is cut short")
    return data[at : at + n], at + n


def decode(kind, data: bytes, at: int = 0):
    """The value at ``at`` and where it ends."""
    if isinstance(kind, str) and kind in _NUMBERS:
        raw, at = _take(data, at, struct.calcsize(_NUMBERS[kind]))
        return struct.unpack(_NUMBERS[kind], raw)[0], at
    if kind == "bool":
        raw, at = _take(data, at, 1)
        if raw[0] > 1:
            raise ValueError("not a truth value")
        return raw == b"\1", at
    if kind in ("string", "bytes"):
        n, at = decode("u32", data, at)
        raw, at = _take(data, at, n)
        return (raw.decode() if kind == "string" else raw), at
    name, of = kind
    if name == "fixed":
        return _take(data, at, of)
    if name == "option":
        some, at = decode("bool", data, at)
        return decode(of, data, at) if some else (None, at)
    if name == "list":
        n, at = decode("u32", data, at)
        out = []
        for _ in range(n):
            x, at = decode(of, data, at)
            out.append(x)
        return out, at
    if name == "struct":
        out = {}
        for n, t in of:
            out[n], at = decode(t, data, at)
        return out, at
    tag, at = decode("u8", data, at)
    if tag >= len(of):
        raise ValueError("no such variant")
    if of[tag][1] is None:
        return (of[tag][0], None), at
    x, at = decode(of[tag][1], data, at)
    return (of[tag][0], x), at
