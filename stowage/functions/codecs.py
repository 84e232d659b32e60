"""Compression of byte columns: Arrow-batched functions over zstandard and gzip."""

from __future__ import annotations

import gzip
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the format.
CHUNK = 65_536
FRAME = 5 << 20
PROBE = 8192
PADDING_MAGIC = b"\x5f\x2a\x4d\x18"


def padding_frame(size: int) -> bytes:
    """A skippable frame of ``size`` bytes in all."""
    if size < 8:
        raise ValueError("a frame has 8 bytes at least")
    return PADDING_MAGIC + struct.pack("<I", size - 8) + bytes(size - 8)


def zstd_pack(data: bytes, level: int = 3, frame: int = FRAME, pad: bool = True) -> bytes:
    """Frames of at most ``frame`` raw bytes; all but the last are padded to whole chunks.

    Where less than a frame's header is missing to a whole chunk, a chunk more is padded.
    """
    import zstandard

    press, out = zstandard.ZstdCompressor(level=level), []
    for at in range(0, max(1, len(data)), frame):
        part = press.compress(data[at : at + frame])
        out.append(part)
        if pad and at + frame < len(data) and (rest := -len(part) % CHUNK):
            out.append(padding_frame(rest if rest >= 8 else rest + CHUNK))
    return b"".join(out)


def zstd_unpack(data: bytes) -> bytes:
    """The content of all frames in a row; skippable frames have none."""
    import zstandard

    out, at = [], 0
    while at < len(data):
        if data[at + 1 : at + 4] == b"\x2a\x4d\x18" and 0x50 <= data[at] <= 0x5F:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        one = zstandard.ZstdDecompressor().decompressobj()
        out.append(one.decompress(data[at:]))
        if not one.eof:
            raise ValueError("a compressed frame is cut short")
        at = len(data) - len(one.unused_data)
    return b"".join(out)


def worth_compressing(sample: bytes) -> bool:
    """Whether a sample shrinks below seven eighths."""
    import zstandard

    return len(sample) * 7 // 8 > len(zstandard.ZstdCompressor().compress(sample))


def _over(function, kind: str):
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else function(bytes(x)))

    run.__annotations__ = {"column": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


def zstd_compress(data: Column) -> Column:
    return _over(zstd_pack, "binary")(data)


def zstd_decompress(data: Column) -> Column:
    return _over(zstd_unpack, "binary")(data)


def gzip_compress(data: Column) -> Column:
    return _over(lambda x: gzip.compress(x, mtime=0), "binary")(data)


def gzip_decompress(data: Column) -> Column:
    return _over(gzip.decompress, "binary")(data)


def compressible(data: Column) -> Column:
    """The probe on the first bytes of each payload."""
    return _over(worth_compressing, "boolean")(F.substring(data, 1, PROBE))
