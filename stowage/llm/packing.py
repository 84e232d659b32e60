"""Sequences of a fixed length packed from documents by length patterns.

All decisions are made on the histogram of piece lengths, which has at most
one bin for every length a sequence can hold, so they take the driver the same
time for any corpus. Patterns of up to four length classes that fill a sequence
are enumerated, non-negative least squares fits how often each is to be used,
the counts are rounded down to patterns of exact lengths without room, and
pieces left over are packed by filling up the largest or by best fit, whichever
takes fewer sequences. The result is a table of ranges: the pieces of one
length with ranks from a to b take the same place in consecutive sequences.
Pieces get their ranks from counts per task, without gathering the pieces of a
length anywhere.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialise
from .common import table
from .tokens import encoder, tokenizer_path

LENGTH = 2048
#: Length classes for the fit, and the most documents in a pattern.
CLASSES = 64
MOST = 4


def patterns(classes: int = CLASSES, most: int = MOST) -> list[tuple[int, ...]]:
    """All ways to fill a sequence with two to ``most`` classes, largest first."""
    out = []

    def grow(have: tuple[int, ...], rest: int, top: int) -> None:
        if rest == 0:
            out.append(have)
        elif len(have) < most:
            for c in range(min(rest, top), 0, -1):
                if c * (most - len(have)) >= rest:
                    grow((*have, c), rest - c, c)

    grow((), classes, classes - 1)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 with least |ax - b|, by the active-set method."""
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    limit = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[used] = -np.inf
        k = int(np.argmax(gain))
        if gain[k] <= limit:
            break
        used[k] = True
        while True:
            z = np.zeros_like(x)
            z[used] = np.linalg.lstsq(a[:, used], b, rcond=None)[0]
            low = used & (z <= 1e-12)
            if not low.any():
                x = z
                break
            step = np.min(x[low] / np.maximum(x[low] - z[low], 1e-300))
            x = np.where(used, x + step * (z - x), 0)
            used &= x > 1e-12
            x[~used] = 0
    return x


def fitted(left: np.ndarray, length: int, classes: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of exact lengths that fill a sequence to the end, as often as the fit says and pieces are there, which are taken from ``left``."""
    width = -(-length // classes)
    classes = -(-length // width)
    of = -(-np.arange(length + 1) // width)
    done: list[tuple[tuple[int, ...], int]] = []

    def largest(top: int, low: int, taken: list[int]) -> int:
        """The largest length of low..top that is left after ``taken``, or 0."""
        for n in range(top, low - 1, -1):
            if left[n] > taken.count(n):
                return n
        return 0

    kinds = patterns(classes, most)
    if not kinds or not left.any():
        return done
    a = np.zeros((classes, len(kinds)))
    for j, kind in enumerate(kinds):
        for c in kind:
            a[c - 1, j] += 1
    wanted = np.bincount(of[1:], weights=left[1:], minlength=classes + 1)[1 : classes + 1]
    counts = np.floor(nnls(a, wanted)).astype(np.int64)
    for j in np.nonzero(counts)[0]:
        kind, n = kinds[j], int(counts[j])
        while n > 0:
            chosen: list[int] = []
            for c in kind[:-1]:
                chosen.append(largest(c * width, (c - 1) * width + 1, chosen))
                if not chosen[-1]:
                    break
            room = length - sum(chosen)
            if not chosen[-1] or room < 1 or left[room] <= chosen.count(room):
                break
            chosen.append(room)
            n -= take(left, chosen, n, done)
    return done


def take(left: np.ndarray, chosen: list[int], most: int, done: list[tuple[tuple[int, ...], int]]) -> int:
    """Use a pattern as often as pieces are left, up to ``most`` times; returns how often."""
    used = {x: chosen.count(x) for x in chosen}
    m = min(most, *(int(left[x]) // k for x, k in used.items()))
    for x, k in used.items():
        left[x] -= m * k
    done.append((tuple(chosen), m))
    return m


def fill(left: np.ndarray, length: int) -> list[tuple[tuple[int, ...], int]]:
    """Pack ``left`` by filling up the largest piece: with one piece or two that leave no room, else with the largest that fits."""
    left, done = left.copy(), []
    for size in range(length, 0, -1):
        while left[size]:
            chosen, room = [size], length - size
            left[size] -= 1
            while room:
                fit = np.flatnonzero(left[1 : room + 1]) + 1
                if not len(fit):
                    break
                one = fit[(fit < room) & (left[room - fit] > (2 * fit == room))]
                picked = [room] if fit[-1] == room else [int(one[-1]), room - int(one[-1])] if len(one) else [int(fit[-1])]
                for x in picked:
                    left[x] -= 1
                chosen += picked
                room -= sum(picked)
            for x in chosen:
                left[x] += 1
            take(left, chosen, 1 << 62, done)
    return done


def best_fit(left: np.ndarray, length: int) -> list[tuple[tuple[int, ...], int]]:
    """Pack ``left`` from the largest piece to the smallest, each into the least room that holds it."""
    done: list[tuple[tuple[int, ...], int]] = []
    holes: dict[int, list[list]] = defaultdict(list)
    rests: list[int] = []
    for size in range(length, 0, -1):
        k = int(left[size])
        while k:
            at = bisect.bisect_left(rests, size)
            while at < len(rests) and not holes[rests[at]]:
                del holes[rests[at]], rests[at]
            if at < len(rests):
                rest = rests[at]
                pattern, count = holes[rest].pop()
                times = min(rest // size, k)
                m = min(k // times, count)
                if count > m:
                    holes[rest].append([pattern, count - m])
            else:
                pattern, rest, times = (), length, min(length // size, k)
                m = k // times
            k -= m * times
            fresh = rest - times * size
            if not fresh:
                done.append((pattern + (size,) * times, m))
                continue
            if fresh not in holes:
                bisect.insort(rests, fresh)
            holes[fresh].append([pattern + (size,) * times, m])
    return done + [(p, n) for stack in holes.values() for p, n in stack]


def plan(histogram: dict[int, int], length: int = LENGTH, classes: int = CLASSES, most: int = MOST) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of exact lengths and how many sequences use each; together they hold every piece once.

    Fitted patterns leave no room. While what is left over needs more
    sequences than its volume, a further part of the fitted ones, those of
    most pieces first, is taken back and packed with it, up to a half.
    """
    left = np.zeros(length + 1, dtype=np.int64)
    for n, k in histogram.items():
        left[n] = k
    whole: list[tuple[tuple[int, ...], int]] = []
    if left[length]:
        whole.append(((length,), int(left[length])))
        left[length] = 0
    fit = sorted(fitted(left, length, classes, most), key=lambda x: (len(x[0]), x))
    volume = int((left * np.arange(length + 1)).sum())
    sequences, best = sum(n for _, n in fit), None
    for back in (0, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2):
        again, kept, more = left.copy(), [], int(back * sequences)
        for pattern, n in reversed(fit):
            m = min(n, more)
            more -= m
            for x in pattern:
                again[x] += m
            if n > m:
                kept.append((pattern, n - m))
        rest = min((f(again, length) for f in (fill, best_fit)), key=lambda done: sum(n for _, n in done))
        now = sum(n for _, n in kept) + sum(n for _, n in rest)
        if best is None or now < best[0]:
            best = now, kept + rest
        if best[0] == sequences - (-volume // length):
            break
    return whole + best[1]


def places(planned: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: ranks of a length from there on go to sequences from there on."""
    rows, next_rank, sequence = [], defaultdict(int), 0
    for pattern, count in planned:
        offset = 0
        for size in pattern:
            rows.append((size, next_rank[size], sequence, offset))
            next_rank[size] += count
            offset += size
        sequence += count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def cut_pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``length`` ids of every text. The first piece of a longer text takes what the others, all full, leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, end = TaskContext.get().partitionId(), struct.pack("<I", end_id)
        encode, seen = encoder(path).encode, [0] * (length + 1)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                total, at, piece = len(ids) // 4, 0, 0
                while at < total:
                    size = (total - 1) % length + 1 if at == 0 else length
                    for column, v in zip(out, (name, piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), seen[size]), strict=True):
                        column.append(v)
                    seen[size] += 1
                    at += size
                    piece += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            a = [pa.array(v, k) for v, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*a[:5], pa.array([part] * len(a[0]), pa.int32()), a[5]], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole texts into sequences of at most ``length`` ids.

    Returns one row per piece: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset``. Null texts count as empty and hold the end id
    alone; texts of any length are cut into pieces and none is dropped; null
    and repeated ids are packed like any others; other columns are left out,
    whatever their names; an empty table gives an empty result.
    """
    pieces = materialise(cut_pieces(docs, path, length, end_id, id_col, text_col), "pieces")
    counts = pieces.groupBy("part", "length").count()
    counts = materialise(counts, "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    table_ = places(plan(histogram, length))
    shift = 1 << 44
    keys, first, sequence, offset = table_[:, 0] * shift + table_[:, 1], table_[:, 1], table_[:, 2], table_[:, 3]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, size * shift + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = counts.select("part", "length", (F.sum("count").over(earlier) - F.col("count")).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
