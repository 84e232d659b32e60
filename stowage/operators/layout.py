"""Where bytes lie: blocks, frames, offsets, TAR layout, and byte ranges.

Ranges are half-open. Offsets are running sums in index order, computed in two
levels so that one large archive is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import running_sum

#: Fixed values of the format: block, nonce and tag of the cipher, compressed frame, TAR record.
BLOCK = 65_536
NONCE, TAG = 12, 16
OVERHEAD = NONCE + TAG
FRAME = 5 << 20
RECORD = 512
TAR_END = 1024


def block_count(size: Column, block: int = BLOCK) -> Column:
    return F.ceil(size / block).cast("long")


def encrypted_size(size: Column, block: int = BLOCK) -> Column:
    """Size after encryption: every block gains a nonce and a tag."""
    return (size + OVERHEAD * block_count(size, block)).cast("long")


def toc_offsets(files: DataFrame, disk_size: Column) -> DataFrame:
    """Add file_start and file_end: exclusive and inclusive running sums of on-disk sizes by idx in each archive."""
    sized = files.withColumn("disk_size", disk_size)
    summed = running_sum(sized, "archive", "idx", F.col("disk_size"), "file_end")
    return summed.withColumn("file_start", F.col("file_end") - F.col("disk_size"))


def cut_blocks(files: DataFrame, payload: Column, block: int = BLOCK) -> DataFrame:
    """One row per block of the payload: block_no, raw_offset, raw_len, bytes. Empty payloads have none."""
    data = files.withColumn("_data", payload)
    n = F.ceil(F.octet_length("_data") / block).cast("int")
    rows = data.withColumn("block_no", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))))
    piece = F.substring(F.col("_data"), F.col("block_no") * block + 1, F.lit(block))
    return rows.withColumn("raw_offset", (F.col("block_no") * F.lit(block)).cast("long")).withColumn("bytes", piece).withColumn("raw_len", F.octet_length("bytes").cast("long")).drop("_data")


def chunk_sizes(size: Column, block: int) -> Column:
    """The raw sizes of all blocks in order."""
    n = F.ceil(size / block).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.least(F.lit(block).cast("long"), size - i.cast("long") * block))).otherwise(F.array().cast("array<bigint>"))


def tar_layout(files: DataFrame, size: Column) -> DataFrame:
    """Add header_at, data_at, padding and next_at of a TAR of each archive by idx."""
    padding = (RECORD - size % RECORD) % RECORD
    sized = files.withColumn("tar_padding", padding.cast("long")).withColumn("_entry", RECORD + size + padding)
    summed = running_sum(sized, "archive", "idx", F.col("_entry"), "next_at")
    return summed.withColumn("header_at", F.col("next_at") - F.col("_entry")).withColumn("data_at", F.col("header_at") + RECORD).drop("_entry")


def byte_range(data: Column, first: int, last: int) -> Column:
    """Bytes first..last of a binary column, half-open; what does not exist is left out."""
    return F.substring(data, first + 1, max(0, last - first))


def edit_list(data: Column, edits: Column) -> Column:
    """Apply alternating discard and keep lengths; what follows the list is discarded, a null list keeps all."""
    empty = F.lit(b"").cast("binary")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("keep"), empty.alias("out"))

    def step(a: Column, n: Column) -> Column:
        piece = F.when(a["keep"], F.substring(data, (a["at"] + 1).cast("int"), n.cast("int"))).otherwise(empty)
        return F.struct((a["at"] + n).alias("at"), (~a["keep"]).alias("keep"), F.concat(a["out"], piece).alias("out"))

    return F.when(edits.isNull(), data).otherwise(F.aggregate(F.transform(edits, lambda x: x.cast("long")), start, step, lambda a: a["out"]))


def range_to_blocks(sizes: Column, first: Column, last: Column, compressed: Column, encrypted: Column, total: Column, block: int = BLOCK) -> Column:
    """The blocks that a byte range of the raw file needs.

    Returns a struct: disk_from and disk_to, the bytes on disk to read, and
    discard and keep, the edit list that leaves the range after decoding.
    A compressed file is cut by the raw ``sizes`` of its blocks, another by
    ``block``; a compressed file without block sizes is one block.
    """
    extra = F.when(encrypted, F.lit(OVERHEAD)).otherwise(F.lit(0))
    one = F.array(total)
    raw = F.when(~compressed, F.lit(None)).otherwise(F.when(sizes.isNull() | (F.size(sizes) == 0), one).otherwise(sizes))
    ends = F.aggregate(raw, F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + x.cast("bigint"))))
    low_c = F.size(F.filter(ends, lambda e: e <= first))
    high_c = F.size(F.filter(ends, lambda e: e < last)) + 1
    before = F.when(compressed, F.coalesce(F.get(ends, low_c - 1), F.lit(0))).otherwise(F.floor(first / block) * block)
    low = F.when(compressed, low_c).otherwise(F.floor(first / block))
    high = F.when(compressed, F.least(high_c, F.size(raw))).otherwise(F.ceil(last / block))
    unit = F.lit(block) + extra
    return F.struct((low * unit).cast("long").alias("disk_from"), (high * unit).cast("long").alias("disk_to"), (first - before).cast("long").alias("discard"), (last - first).cast("long").alias("keep"))


def file_of_position(files: DataFrame, positions: DataFrame, stripe: int = 1 << 20) -> DataFrame:
    """The file that holds each (archive, position), with the offset in it; positions past the end are dropped.

    An equi-join on stripes of the archive: a file is listed once for every
    stripe it touches, so no archive is compared position by position.
    """
    spans = files.where("file_end > file_start").select("archive", "idx", "file_start", "file_end").withColumn("_stripe", F.explode(F.sequence(F.floor(F.col("file_start") / stripe), F.floor((F.col("file_end") - 1) / stripe))))
    at = positions.withColumn("_stripe", F.floor(F.col("position") / stripe))
    inside = (F.col("position") >= F.col("file_start")) & (F.col("position") < F.col("file_end"))
    return at.join(spans, ["archive", "_stripe"]).where(inside).drop("_stripe").withColumn("in_file", F.col("position") - F.col("file_start"))


def split_plan(files: DataFrame, blocks: Column, target: int) -> DataFrame:
    """Deal files of an archive to readers of about ``target`` blocks each, by cumulative block count."""
    summed = running_sum(files.withColumn("_blocks", blocks), "archive", "idx", F.col("_blocks"), "_end")
    return summed.withColumn("reader", F.floor((F.col("_end") - F.col("_blocks")) / target).cast("long")).drop("_end", "_blocks")
