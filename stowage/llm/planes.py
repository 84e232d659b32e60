"""Token ids in files of compressed bit or byte planes.

A file holds blocks of a fixed number of ids. Each block is transposed, so
that plane k has bit (or byte) k of every id, and each plane is compressed with
zstandard; planes of zeros take no bytes. A chunk index at the end gives the
length of every plane and a checksum for every block, a document index the ids
and token counts of the documents.

    "PLN1" | blocks | index (zstandard) | u64 length of index | "PLN1"

Executors and driver share no local folder, so a file is one binary cell of a
Parquet table in shared storage and is written and read through Spark;
``export_files`` puts the same bytes into plain files.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scratch import broadcast_if_small, materialise
from .common import table
from .tokens import encoder, tokenizer_path

MAGIC = b"PLN1"
BLOCK = 1 << 16
#: A file is closed at this many ids.
FILE_IDS = 1 << 23
LEVEL = 1


def split_planes(ids: np.ndarray, bits: bool) -> np.ndarray:
    """The planes of a block of uint32 ids, least significant first, one per row."""
    cells = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return np.ascontiguousarray(cells.T)
    return np.packbits(np.unpackbits(cells, axis=1, bitorder="little").T, axis=1, bitorder="little")


def join_planes(planes: np.ndarray, n: int, bits: bool) -> np.ndarray:
    """The ids that :func:`split_planes` took apart."""
    if bits:
        planes = np.packbits(np.unpackbits(planes, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little").T
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def write_file(ids: np.ndarray, doc_ids: list[int | None], counts: list[int], bits: bool = False, block: int = BLOCK, level: int = LEVEL) -> bytes:
    """The bytes of a file of ``ids``, which belong to documents of ``counts`` ids each."""
    import zstandard

    press = zstandard.ZstdCompressor(level=level)
    out, index = [MAGIC], []
    for at in range(0, len(ids), block):
        part = ids[at : at + block]
        lengths = []
        for plane in split_planes(part, bits):
            data = press.compress(plane.tobytes()) if plane.any() else b""
            out.append(data)
            lengths.append(len(data))
        index.append(struct.pack(f"<II{len(lengths)}I", len(part), zlib.crc32(part.tobytes()), *lengths))
    known = np.array([x is not None for x in doc_ids], dtype=np.uint8)
    docs = np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes() + known.tobytes() + np.array(counts, dtype="<u8").tobytes()
    tail = press.compress(struct.pack("<BQIQ", bits, len(ids), block, len(counts)) + b"".join(index) + docs)
    return b"".join([*out, tail, struct.pack("<Q", len(tail)), MAGIC])


def read_file(data: bytes) -> tuple[np.ndarray, list[int | None], list[int]]:
    """Ids, document ids and token counts of a file; ValueError if it is damaged."""
    import zstandard

    if data[:4] != MAGIC or data[-4:] != MAGIC:
        raise ValueError("not a plane file")
    (n,) = struct.unpack("<Q", data[-12:-4])
    open_up = zstandard.ZstdDecompressor()
    tail = open_up.decompress(data[-12 - n : -12])
    bits, total, block, n_docs = struct.unpack_from("<BQIQ", tail)
    at, planes, start = struct.calcsize("<BQIQ"), 32 if bits else 4, 4
    ids = np.empty(total, dtype="<u4")
    for first in range(0, total, block):
        size, crc, *lengths = struct.unpack_from(f"<II{planes}I", tail, at)
        at += 8 + 4 * planes
        width = (size + 7) // 8 if bits else size
        cells = np.zeros((planes, width), dtype=np.uint8)
        for k, length in enumerate(lengths):
            if length:
                cells[k] = np.frombuffer(open_up.decompress(data[start : start + length]), dtype=np.uint8)
                start += length
        part = join_planes(cells, size, bool(bits))
        if zlib.crc32(part.tobytes()) != crc:
            raise ValueError("a block does not match its checksum")
        ids[first : first + size] = part
    docs = np.frombuffer(tail, dtype="<i8", count=n_docs, offset=at).tolist()
    known = np.frombuffer(tail, dtype=np.uint8, count=n_docs, offset=at + 8 * n_docs)
    counts = np.frombuffer(tail, dtype="<u8", count=n_docs, offset=at + 9 * n_docs).tolist()
    return ids, [d if k else None for d, k in zip(docs, known, strict=True)], counts


FILES = "part int, seq int, n_docs long, n_ids long, payload binary"


def encode_files(docs: DataFrame, path: str, words: bool, end_id: int, bits: bool = False, block: int = BLOCK, file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Files of the ids of all texts in ascending id order, each text closed by ``end_id``; one row per file.

    Files are ordered by (part, seq). Null ids come first, a null text is
    empty, a text of any length is in one file, rows with the same id are
    ordered by a hash of their text. Other columns are left out, whatever
    their names. An empty table gives no file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, end = TaskContext.get().partitionId(), 0, struct.pack("<I", end_id)
        encode = encoder(path, words).encode
        parts: list[bytes] = []
        names: list[int | None] = []
        counts: list[int] = []
        size = 0

        def close() -> pa.RecordBatch:
            data = write_file(np.frombuffer(b"".join(parts), dtype="<u4"), names, counts, bits, block)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(names)], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], ["part", "seq", "n_docs", "n_ids", "payload"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = encode(text) + end
                parts.append(data)
                names.append(name)
                counts.append(len(data) // 4)
                size += counts[-1]
                if size >= file_ids:
                    yield close()
                    parts, names, counts, size, seq = [], [], [], 0, seq + 1
        if names:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("_x6_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_x6_text"))
    rows = rows.withColumn("_x6_tie", F.xxhash64("_x6_text")).repartitionByRange("_x6_id", "_x6_tie").sortWithinPartitions("_x6_id", "_x6_tie")
    return rows.select("_x6_id", "_x6_text").mapInArrow(run, FILES)


def read_documents(files: DataFrame) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens and ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids, names, counts = read_file(data.as_py())
                view, at, starts, sums = memoryview(ids.tobytes()), 0, [], []
                for n in counts:
                    starts.append(at)
                    sums.append(zlib.crc32(view[4 * at : 4 * (at + n)]))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(names), pa.int32()), pa.array([seq] * len(names), pa.int32()), pa.array(names, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    # One row per file: the running total is over as many rows as there are files.
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = files.select("part", "seq", (F.sum("n_ids").over(order) - F.col("n_ids")).alias("before"))
    docs = files.select("part", "seq", "payload").mapInArrow(run, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(broadcast_if_small(before, 1_000_000), ["part", "seq"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def export_files(files: DataFrame, folder: str) -> None:
    """Write every file to ``folder``, which all executors must see at the same path."""

    def put(rows) -> None:
        for r in rows:
            target = os.path.join(folder, f"ids-{r['part']:06d}-{r['seq']:04d}.pln")
            with open(f"{target}.tmp{os.getpid()}", "wb") as f:
                f.write(r["payload"])
            os.replace(f.name, target)

    files.foreachPartition(put)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("word_bpe_49k.json")
    files = materialise(encode_files(table(spark, sf_dir, "documents"), path, words=True, end_id=1), "planes")
    return read_documents(files)
