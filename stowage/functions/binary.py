"""Byte-level column functions without Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: zstandard's frame magic and its sixteen skippable magics, little-endian as stored.
ZSTD_MAGIC = "28B52FFD"
SKIPPABLE_MAGICS = tuple(f"{n:02X}2A4D18" for n in range(0x50, 0x60))
#: Skippable magics that the format gives a meaning: trailer, key packets, table of contents, padding.
EOF_MAGIC, PACKETS_MAGIC, TOC_MAGIC, PADDING_MAGIC = (bytes([0x50 + n, 0x2A, 0x4D, 0x18]) for n in (0, 1, 2, 15))


def little_endian(n: Column, size: int) -> Column:
    """The lowest ``size`` bytes of a whole number, least significant first."""
    return F.concat(*[F.unhex(F.lpad(F.hex(F.shiftrightunsigned(n, 8 * k).bitwiseAND(F.lit(255))), 2, "0")) for k in range(size)])


def zeros(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("00"), n.cast("int")))


def is_zstd(data: Column) -> Column:
    """Whether bytes begin like a zstandard or a skippable frame."""
    return F.hex(F.substring(data, 1, 4)).isin(ZSTD_MAGIC, *SKIPPABLE_MAGICS)


def skippable_frame(size: Column) -> Column:
    """A padding frame of ``size`` bytes in all; an error below the 8 bytes of its header."""
    frame = F.concat(F.lit(PADDING_MAGIC), little_endian(size - 8, 4), zeros(size - 8))
    return F.when(size >= 8, frame).otherwise(F.raise_error(F.lit("a frame has 8 bytes at least")).cast("binary"))


def padding_bytes(size: Column) -> Column:
    """Padding that tells its own length: up to 3 zeros, else zeros, the length in two bytes, and a zero."""
    told = F.concat(zeros(size - 3), F.unhex(F.lpad(F.hex(size.cast("long")), 4, "0")), F.unhex(F.lit("00")))
    return F.when(size <= 3, zeros(size)).otherwise(told)


def hex_decode(text: Column) -> Column:
    """Bytes of an even-length hexadecimal text; an error for an odd length."""
    return F.when(F.char_length(text) % 2 == 0, F.unhex(text)).otherwise(F.raise_error(F.lit("odd number of hexadecimal digits")).cast("binary"))


def set_flag(flags: Column, bit: Column) -> Column:
    return flags.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))


def clear_flag(flags: Column, bit: Column) -> Column:
    return flags.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit)))


def has_flag(flags: Column, bit: Column) -> Column:
    return F.call_function("bit_get", flags, bit) == 1


def log_level(name: Column) -> Column:
    """A level's upper-case name; INFO for what is not known."""
    up = F.upper(F.trim(name))
    return F.when(up.isin("TRACE", "DEBUG", "INFO", "WARN", "ERROR"), up).otherwise(F.lit("INFO"))


def merge_keys(a: Column, b: Column) -> Column:
    """Interleave two lists and drop consecutive repeats."""
    mixed = F.filter(F.flatten(F.zip_with(a, b, lambda x, y: F.array(x, y))), lambda x: x.isNotNull())
    return F.aggregate(mixed, F.array().cast("array<string>"), lambda acc, x: F.when(F.get(acc, F.size(acc) - 1).eqNullSafe(x), acc).otherwise(F.concat(acc, F.array(x))))
