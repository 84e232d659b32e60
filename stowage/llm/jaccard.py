"""Similarity join of shingle sets by grouped prefixes.

Every set is ordered by one global order, and two sets that are similar enough
share an element of their prefixes. Documents with the same set are one
element of the join; those with the same prefix and size are one group, which
takes part in the join once.

Order. Hash values, but elements that are frequent in some stretch of the
corpus come last, so that passages which many documents share stay out of the
prefixes. Any order gives the same result; this one keeps lists short.

Lists. The groups of a prefix element are compared pairwise when few. In a
longer list all are compared with one of them, the pivot. Groups linked to
the pivot are connected and need no comparison with each other. As Jaccard
distance is a metric, a group that is not linked can only be linked to those
whose distance to the pivot is near its own, and only these and the others that
are not linked are left; with copies in thousands, next to none are. Members of
lists too long for any partitioning meet their pivot through a broadcast of the
pivots, of which there are a few for each shuffle partition.

Rest. What is left of a list is compared directly where it is short or few of
it are not linked, every one of these with all. Of other lists the smallest set
becomes the pivot. A set that is not linked to it shares too few elements with
it for a link to any set of the list, all of which are as large; so both must
share an element outside the pivot, and as many as are lacking. The list is
dealt out anew by the first elements outside the pivot. The pivot is in none of
the lists that come out, so this ends, and texts that are alike only in what
all of the list have in common part at once.

Sieve. Each set has a bitmap with the parity of its elements in every bit. The
Hamming distance of two bitmaps is no more than the sets' symmetric difference,
which bounds their similarity from above; only pairs that the bound lets pass
have their sets compared.

Groups. Members linked to the group's leader stay in the group, others leave
it. For two groups that are not linked themselves, members become a list of
their own where the distances to the leaders leave room for a link.

What must reach the driver is the set of frequent elements, of a bounded size.
Sets, links and components stay in tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import broadcast_if_small, materialise
from .common import table
from .components import components
from .shingles import shingle_set

#: An element is frequent when so many different sets of a stretch of so many elements hold it.
FREQUENT, STRETCH = 5, 4_000_000
#: Frequent elements put last; further ones, the less frequent, keep their place.
MOST_FREQUENT = 1_000_000
#: Lists up to this size are compared pairwise.
SHORT = 6
#: A list counts as too long for one task from so many rows, or half the mean rows of a shuffle partition; told by one group in so many.
LONG, PART_SEEN = 256, 16
#: What a pivot leaves of a list is compared directly if it has so many sets, or so few that are not linked; in blocks of so many, up to ALL in one.
MOST, FEW, ALL, BLOCK = 4096, 16, 64, 1024
#: Allowance for these in comparisons of distances.
SLACK = 0.02


def chance(n: Column) -> Column:
    """More matches of half hashes by chance than two sets of ``n`` elements together will have."""
    mean = n * n / F.lit(float(1 << 34))
    return 4 + 2 * mean + 10 * F.sqrt(mean)


def needed(n: int, percent: int) -> int:
    """The least intersection that a set of ``n`` elements has with any similar set."""
    return -(-percent * n // 100)


def parity_bits(s: np.ndarray) -> bytes:
    """A bitmap of one to two bits per element: whether an odd number of elements fall on each bit."""
    bits = 1 << max(6, (len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of the symmetric difference of two sets, by their bitmaps."""
    a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    while len(a) != len(b):  # the longer map, folded, is that of fewer bits
        if len(a) < len(b):
            a, b = b, a
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _summaries(docs: DataFrame, width: int) -> DataFrame:
    """Per document: id, size and signature of its set; and the frequent elements of every stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        held: list[np.ndarray] = []
        signs: set[bytes] = set()
        size = 0

        def out(ids, sizes, sigs, toks, counts):
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(toks, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n", "sig", "tok", "seen"])

        def frequent():
            toks, counts = np.unique(np.concatenate(held), return_counts=True)
            toks, counts = toks[counts >= FREQUENT], counts[counts >= FREQUENT]
            none = [None] * len(toks)
            return out(none, none, none, toks.view(np.int64), counts)

        for batch in batches:
            ids, sizes, sigs = batch.column(0), [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, width)
                sig = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                sizes.append(len(s))
                sigs.append(sig)
                if len(s) and sig not in signs:
                    signs.add(sig)
                    held.append(s)
                    size += len(s)
                    if size >= STRETCH:
                        yield frequent()
                        held, signs, size = [], set(), 0
            yield out(ids.to_pylist(), sizes, sigs, [None] * len(sizes), [None] * len(sizes))
        if held:
            yield frequent()

    return docs.mapInArrow(run, "doc_id long, n long, sig binary, tok long, seen long")


def _prefixes(docs: DataFrame, width: int, percent: int, frequent) -> DataFrame:
    """Per document: id, size, prefix, a key of size and prefix, and the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        last = frequent.value
        for batch in batches:
            ids, sizes, keys, prefixes, maps = [], [], [], [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle_set(text, width)
                n = len(s)
                if not n:
                    continue
                p = n - needed(n, percent) + 1
                late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s if len(last) else np.zeros(n, dtype=bool)
                order = np.concatenate([s[~late], s[late]])[:p].tobytes()
                ids.append(name)
                sizes.append(n)
                prefixes.append(order)
                maps.append(parity_bits(s))
                keys.append(xxhash.xxh3_128_digest(order + n.to_bytes(8, "little")))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(prefixes, pa.binary()), pa.array(maps, pa.binary())], ["doc_id", "n", "pkey", "prefix", "bits"])

    return docs.mapInArrow(run, "doc_id long, n long, pkey binary, prefix binary, bits binary")


def _compare_sets(docs: DataFrame, pairs: DataFrame, width: int, percent: int, short: bool, frequent=None) -> DataFrame:
    """Intersection and union of the sets of every pair (a, b): columns a, b, i, u.

    The set of each ``b`` is sent to that of its ``a``; an ``a`` with many
    partners is sent to several tasks, so that none gets more than a few
    thousand. ``short`` compares the upper halves of the hashes: ``i`` is
    then no less than the intersection, and hardly ever more. With
    ``frequent``, the elements that come last, a column ``rest`` has the
    elements of ``b`` outside ``a`` of which one must be in any set that is
    linked to ``b``, and all of them if ``b`` is linked to ``a``.
    """

    def hash_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [shingle_set(x, width) for x in batch.column(1).to_pylist()]
            data = [((x >> np.uint64(32)).astype("<u4") if short else x).tobytes() for x in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "s"])

    def outside(s: np.ndarray, n_own: int, both: int) -> list[int]:
        last = frequent.value
        late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s if len(last) else np.zeros(len(s), dtype=bool)
        lacking = max(1, -(-percent * (len(s) + both + n_own) // (100 + percent)) - both)
        return np.concatenate([s[~late], s[late]])[: max(0, len(s) - lacking + 1)].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, of, own = np.dtype("<u4" if short else "<u8"), None, None
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            rests: list[np.ndarray] = []
            for a, b, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = np.frombuffer(s.as_buffer(), dtype=kind)
                if b is None:
                    of, own = a, s.copy()
                    continue
                assert of == a, "a pair came before its set"
                at = np.minimum(np.searchsorted(own, s), len(own) - 1)
                same = own[at] == s
                both = min(int(same.sum()), len(own), len(s))
                for column, v in zip(out, (a, b, both, len(own) + len(s) - both), strict=True):
                    column.append(v)
                if frequent is not None:
                    rests.append(outside(s[~same], len(own), both))
            cells = [pa.array(x, pa.int64()) for x in out]
            yield pa.RecordBatch.from_arrays(cells if frequent is None else [*cells, pa.array(rests, pa.list_(pa.int64()))], ["a", "b", "i", "u", *(["rest"] if frequent is not None else [])])

    many = pairs.groupBy("a").count().select("a", F.ceil(F.col("count") / 2000).cast("int").alias("ways"))
    dealt = pairs.join(broadcast_if_small(many, 1_000_000), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("ways")).cast("int").alias("way"))
    heads = many.select("a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("way"))
    wanted = materialise(dealt.select(F.col("b").alias("doc_id"), "a", "b", "way").union(heads.select("a", "a", "b", "way")), "wanted")
    ids = broadcast_if_small(wanted.select("doc_id").distinct(), 1_000_000)
    found = docs.join(ids, "doc_id", "left_semi").mapInArrow(hash_sets, "doc_id long, s binary")
    sent = found.join(broadcast_if_small(wanted, 2_000_000), "doc_id").select("a", "b", "s", "way")
    sent = sent.repartition("a", "way").sortWithinPartitions("a", "way", F.asc_nulls_first("b")).select("a", "b", "s")
    out = sent.mapInArrow(run, "a long, b long, i long, u long" + (", rest array<long>" if frequent is not None else ""))
    return materialise(out, "compared")


def _sieve(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs with the least distance that their bitmaps allow (d), and whether they may be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            apart = np.fromiter((least_difference(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)), dtype=np.int64, count=len(n))
            both = (n - apart) // 2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(1 - both / np.maximum(n - both, 1)), pa.array(100 * both >= percent * (n - both))], ["a", "b", "d", "may"])

    x, y = (maps.select(F.col("doc_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}")) for k in "ab")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long, d double, may boolean")


def _verify(docs: DataFrame, pairs: DataFrame, maps: DataFrame, width: int, percent: int) -> DataFrame:
    """Verdicts on the pairs (a, b): columns a, b, d (distance, or a lower bound if not linked) and linked.

    Half hashes settle all pairs but those that a few chance matches could
    have lifted over the limit; these are compared by whole hashes.
    """
    sieved = materialise(_sieve(pairs, maps, percent), "sieved")
    out = sieved.where("NOT may").select("a", "b", "d", F.lit(False).alias("linked"))
    pairs = sieved.where("may").select("a", "b").distinct()
    if pairs.isEmpty():
        return out
    passes = lambda i: 100 * i >= percent * (F.col("u") + F.col("i") - i)
    halves = _compare_sets(docs, pairs, width, percent, True).withColumn("open", passes(F.col("i")) & ~passes(F.col("i") - chance(F.col("i") + F.col("u"))))
    close = materialise(halves.where("open").select("a", "b").distinct(), "close")
    sure = halves.where("NOT open").drop("open")
    if not close.isEmpty():
        sure = sure.union(_compare_sets(docs, close, width, percent, False))
    return out.union(sure.select("a", "b", (1 - F.col("i") / F.col("u")).alias("d"), passes(F.col("i")).alias("linked")).distinct())


LIST = "tok long, gid long, n long, pos long, r double, open boolean"
FOUND = "a long, b long, tok long, gid long, n long, pos long, r double, open boolean, lead long, lead_n long"


def _explode(groups: DataFrame) -> DataFrame:
    """One row per group and prefix element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in batch.column(2)]
            many = np.array([len(x) for x in data], dtype=np.int64)
            for at in range(0, len(data), 2000):
                part = slice(at, at + 2000)
                k = many[part]
                toks = np.concatenate(data[part])
                pos = np.arange(len(toks)) - np.repeat(np.cumsum(k) - k, k)
                cells = [toks, *(np.repeat(batch.column(c).to_numpy()[part], k) for c in (0, 1)), pos, np.repeat(batch.column(3).to_numpy()[part], k)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cells), pa.array(np.ones(len(toks), dtype=bool))], ["tok", "gid", "n", "pos", "r", "open"])

    return groups.select("gid", "n", "prefix", "r").mapInArrow(run, LIST)


def _too_long(groups: DataFrame) -> DataFrame:
    """The elements of lists too long for one task, and their pivots: tok, lead, lead_n. There are no more than two for each shuffle partition.

    Which lists these are is estimated from one group in ``PART_SEEN``; either
    way of meeting the pivot gives the same pairs.
    """
    some = _explode(groups.where(F.pmod(F.xxhash64("gid"), F.lit(PART_SEEN)) == 0)).groupBy("tok").count()
    some = materialise(some.where("count > 1"), "some")
    rows = groups.select(F.sum(F.octet_length("prefix") / 8)).first()[0] or 0
    parts = 2 * int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = some.where(F.col("count") * PART_SEEN >= max(LONG, rows / parts)).orderBy(F.desc("count"), "tok").limit(parts).select("tok")
    return materialise(found, "long")


def _meet_pivots(lists: DataFrame, percent: int) -> DataFrame:
    """The rows of long lists with the pivot of each, as :func:`_compare` gives them, without a shuffle of the rows."""
    first = lists.groupBy("tok").agg(F.min(F.struct(~F.col("open"), "pos", "n", "gid")).alias("x")).select("tok", F.col("x.gid").alias("lead"), F.col("x.n").alias("lead_n"))
    near = (100 * F.least("n", "lead_n") >= percent * F.greatest("n", "lead_n")) & (F.col("gid") != F.col("lead"))
    pair = [F.when(near, f("gid", "lead")).alias(k) for f, k in ((F.least, "a"), (F.greatest, "b"))]
    return lists.join(F.broadcast(materialise(first, "pivots")), "tok").select(*pair, "tok", "gid", "n", "pos", "r", "open", "lead", "lead_n")


def _compare(groups: DataFrame, percent: int) -> DataFrame:
    """Pairs to compare in all lists of ``groups``, and members of longer lists with their pivots."""
    lists, long = _explode(groups), _too_long(groups)
    if long.isEmpty():
        return materialise(_compare_cold(lists, percent), "compared")
    cold = _compare_cold(lists.join(F.broadcast(long), "tok", "left_anti"), percent)
    return materialise(cold.union(_meet_pivots(lists.join(F.broadcast(long), "tok", "left_semi"), percent)), "compared")


def _compare_cold(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs to compare in lists up to ``SHORT``, and longer lists with their pivot.

    The pivot is the open group with the fewest elements before the list's
    own: as rare elements come first, the one that is least changed.
    Rows are streamed in list order; what is held is a batch and the list
    that runs into it, cut at ``SHORT`` + 1 rows.
    """
    short = SHORT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("tok", "gid", "n", "pos", "r", "open")
        kinds = (np.int64, np.int64, np.int64, np.int64, np.float64, bool)
        held = [np.empty(0, dtype=k) for k in kinds]
        long_tok, pivot = None, (0, 0)

        def may(n1, n2, p1=None, p2=None):
            ok = 100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)
            if p1 is not None:  # room for the overlap from the first common element on
                ok &= (100 + percent) * np.minimum(n1 - p1, n2 - p2) >= percent * (n1 + n2)
            return ok

        def pairs(x, y):
            a, b = np.minimum(x, y), np.maximum(x, y)
            both = np.unique(np.stack([a, b], axis=1)[a != b], axis=0) if len(a) else np.empty((0, 2), dtype=np.int64)
            k = len(both)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), *(pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64()))], [x.split()[0] for x in FOUND.split(", ")])

        def members(rows, lead, lead_n):
            k = len(rows[0])
            near = may(rows[2], lead_n)
            a, b = np.minimum(rows[1], lead), np.maximum(rows[1], lead)
            return pa.RecordBatch.from_arrays([pa.array(a, mask=~near | (a == b)), pa.array(b, mask=~near | (a == b)), pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2]), pa.array(rows[3]), pa.array(rows[4]), pa.array(rows[5]), pa.array(np.full(k, lead)), pa.array(np.full(k, lead_n))], [x.split()[0] for x in FOUND.split(", ")])

        def work(rows, done: bool):
            """Emit what is complete; returns the rows of the list that may go on."""
            nonlocal long_tok, pivot
            toks = rows[0]
            if long_tok is not None and len(toks):
                k = int(np.searchsorted(toks != long_tok, True)) if toks[0] == long_tok else 0
                if k:
                    yield members([c[:k] for c in rows], *pivot)
                    rows = [c[k:] for c in rows]
                    toks = rows[0]
                if len(toks):
                    long_tok = None
            if not len(toks):
                held[:] = rows
                return
            starts = np.flatnonzero(np.concatenate([[True], toks[1:] != toks[:-1]]))
            sizes = np.diff(np.append(starts, len(toks)))
            if not done and sizes[-1] <= short:
                held[:] = [c[starts[-1] :] for c in rows]
                rows, starts, sizes = [c[: starts[-1]] for c in rows], starts[:-1], sizes[:-1]
            else:
                held[:] = [c[:0] for c in rows]
            for s, k in zip(starts[sizes > short], sizes[sizes > short], strict=True):
                lead = (int(rows[1][s]), int(rows[2][s]))
                yield members([c[s : s + k] for c in rows], *lead)
                if s == starts[-1] and not done:
                    long_tok, pivot = int(rows[0][s]), lead
            few = np.repeat((sizes > 1) & (sizes <= short), sizes)
            tok, gid, n, pos, _, open_ = (c[few] for c in rows)
            x, y = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
            for d in range(1, short):
                same = tok[:-d] == tok[d:] if d < len(tok) else np.empty(0, dtype=bool)
                if not same.any():
                    break
                ok = same & (open_[:-d] | open_[d:]) & may(n[:-d], n[d:], pos[:-d], pos[d:])
                x.append(gid[:-d][ok])
                y.append(gid[d:][ok])
            if len(few):
                yield pairs(np.concatenate(x), np.concatenate(y))

        for batch in batches:
            fresh = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            yield from work([np.concatenate(c) for c in zip(held, fresh, strict=True)], False)
        yield from work(list(held), True)

    dealt = lists.repartition("tok").sortWithinPartitions("tok", F.desc("open"), "pos", "n", "gid")
    return dealt.mapInArrow(run, FOUND)


def _by_list(rows: DataFrame, of: DataFrame, name: str = "lst", how: str = "inner", most: int = 1_000_000, ways: int = 32) -> DataFrame:
    """Join what is known of each list to its rows: by a broadcast, or with the rows of a list dealt over several keys."""
    if of.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(of), name, how)
    salted = rows.withColumn("_way", F.pmod(F.xxhash64("gid"), F.lit(ways)).cast("int"))
    return salted.join(of.withColumn("_way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1)))), [name, "_way"], how).drop("_way")


def _distinct_lists(lists: DataFrame) -> DataFrame:
    """Lists (lst, gid, n, open) in which something is left to compare. Copies share many elements, and so many lists have the same rows: one of them will do."""
    signs = lists.groupBy("lst").agg(F.count(F.lit(1)).alias("k"), F.count_if("open").alias("o"), *[F.sum(F.xxhash64(F.lit(x), "gid", "open").cast("decimal(20,0)")).alias(f"s{x}") for x in (1, 2)])
    one = signs.where("k > 1 AND o > 0").groupBy("k", "o", "s1", "s2").agg(F.min("lst").alias("lst")).select("lst", "k", "o")
    return materialise(_by_list(lists, materialise(one, "signs")), "lists")


def _compare_direct(lists: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """Pairs of lists that may be linked by sizes and bitmaps, at least one of each pair open.

    A short list is one task's unit. Of a longer one, with its few open sets,
    the units are blocks, each of which gets all the open ones; pairs are
    tested there and only those that pass are returned.
    """

    def width_classes(bits: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        by: dict[int, list[int]] = {}
        for k, x in enumerate(bits):
            by.setdefault(len(x) // 8, []).append(k)
        return {w: (np.array(at), np.frombuffer(b"".join(bits[k] for k in at), dtype=np.uint64).reshape(len(at), w)) for w, at in by.items()}

    def folded(m: np.ndarray, width: int) -> np.ndarray:
        while m.shape[1] > width:
            m = m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :]
        return m

    def tested(left: list[tuple], right: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        cells = [[np.array([r[k] for r in side]) for k in range(3)] for side in (left, right)]
        (gid1, n1, open1), (gid2, n2, open2) = cells
        x, y = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        for w1, (at1, m1) in width_classes([r[3] for r in left]).items():
            for w2, (at2, m2) in width_classes([r[3] for r in right]).items():
                a, b = folded(m1, min(w1, w2)), folded(m2, min(w1, w2))
                step = max(1, (4 << 20) // max(1, len(at2) * min(w1, w2)))
                for k in range(0, len(at1), step):
                    own = at1[k : k + step]
                    sum_ = n1[own][:, None] + n2[at2][None, :]
                    both = (sum_ - np.bitwise_count(a[k : k + step, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int64)) // 2
                    ok = (100 * both >= percent * (sum_ - both)) & (open1[own][:, None] | open2[at2][None, :])
                    ok &= 100 * np.minimum(n1[own][:, None], n2[at2][None, :]) >= percent * np.maximum(n1[own][:, None], n2[at2][None, :])
                    i, j = np.nonzero(ok)
                    x.append(gid1[own[i]])
                    y.append(gid2[at2[j]])
        return np.concatenate(x), np.concatenate(y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left, right = None, [], []

        def out() -> pa.RecordBatch:
            x, y = tested(left, right) if left and right else (np.empty(0, dtype=np.int64),) * 2
            both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1)[x != y], axis=0).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        for batch in batches:
            for lst, block, side, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lst, block) != key:
                    yield out()
                    key, left, right = (lst, block), [], []
                if side != 1:
                    left.append(row)
                if side != 0:
                    right.append(row)
        yield out()

    rows = lists.join(maps.select(F.col("doc_id").alias("gid"), "bits").dropDuplicates(["gid"]), "gid")
    blocks, whole = F.ceil(F.col("k") / BLOCK).cast("int"), F.col("k") <= ALL
    own = rows.select("lst", F.pmod(F.xxhash64("gid"), blocks).cast("int").alias("block"), F.when(whole, 2).otherwise(0).alias("side"), "gid", "n", "open", "bits")
    few = rows.where(F.col("open") & ~whole).select("lst", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(1).alias("side"), "gid", "n", "open", "bits")
    return own.union(few).repartition("lst", "block").sortWithinPartitions("lst", "block").mapInArrow(run, "a long, b long")


def _outside_pivots(lists: DataFrame, docs: DataFrame, frequent, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links of lists' sets to their smallest, and the lists of what they have outside it: edges (a, b), lists (lst, gid, n, open)."""
    first = lists.groupBy("lst").agg(F.min(F.struct("n", "open", "gid")).alias("x")).select("lst", F.col("x.gid").alias("lead"), F.col("x.open").alias("lead_open"))
    rows = _by_list(lists.select("lst", "gid", "n", "open"), materialise(first, "pivots")).where("gid <> lead")
    rows = materialise(rows, "members")
    compared = _compare_sets(docs, rows.select(F.col("lead").alias("a"), F.col("gid").alias("b")).distinct(), width, percent, False, frequent)
    linked = (100 * F.col("i") >= percent * F.col("u")).alias("linked")
    told = compared.select(F.col("a").alias("lead"), F.col("b").alias("gid"), linked, "rest").dropDuplicates(["lead", "gid"])
    # A set stays closed that is linked to the pivot, or to one that the pivot is linked to.
    new = rows.join(told, ["lead", "gid"]).select("lst", "gid", "n", (~F.col("linked") & (F.col("open") | F.col("lead_open"))).alias("open"), "rest")
    new = materialise(new, "outside").withColumn("tok", F.explode("rest")).select(F.xxhash64("lst", "tok").alias("lst"), "gid", "n", "open")
    # Closed sets are dealt out by the elements of open ones only.
    met = materialise(new.where("open").select("lst").distinct(), "met")
    return compared.where(linked).select("a", "b"), new.where("open").union(_by_list(new.where("NOT open"), met))


def _resolve(lists: DataFrame, docs: DataFrame, maps: DataFrame, frequent, width: int, percent: int) -> list[DataFrame]:
    """The links (a, b) that lists (lst, gid, n, open) of single documents hold: every link of an open one, or others that connect the same."""
    lists = _distinct_lists(materialise(lists.distinct(), "lists"))
    edges: list[DataFrame] = []
    if lists.isEmpty():
        return edges
    docs = materialise(docs.join(broadcast_if_small(lists.select(F.col("gid").alias("doc_id")).distinct(), 1_000_000), "doc_id", "left_semi"), "texts")
    known, direct = None, (F.col("k") <= MOST) | (F.col("o") <= FEW)
    while not lists.isEmpty():
        known = _judge(docs, _compare_direct(lists.where(direct), maps, percent), known, maps, width, percent)
        if lists.where(~direct).isEmpty():
            break
        links, new = _outside_pivots(lists.where(~direct), docs, frequent, width, percent)
        edges.append(links)
        lists = _distinct_lists(materialise(new, "lists"))
    return [*edges, known.where("linked").select("a", "b")]


def jaccard_join(docs: DataFrame, percent: int = 85, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link documents whose sets of distinct ``width``-word shingles are similar to ``percent`` or more.

    Returns one row per input row: ``id_col, n_shingles, component_id`` (the
    smallest id that links reach, or the row's own). Rows without words are
    linked with nothing; texts of any length have all their shingles. A row
    with a null id has a size but neither links nor a component; rows that
    share an id count as one document; other columns are left out, whatever
    their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    least = 1 - percent / 100 + SLACK
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seen = materialise(_summaries(rows, width), "summaries")
    top = seen.where("tok IS NOT NULL").groupBy("tok").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "tok").limit(MOST_FREQUENT).select("tok")
    frequent = spark.sparkContext.broadcast(np.sort(top.toArrow().column("tok").to_numpy().astype(np.int64).view(np.uint64)))
    each = seen.where("tok IS NULL").select("doc_id", "n", "sig")
    named = each.where("n > 0 AND doc_id IS NOT NULL")
    reps = materialise(named.groupBy("sig").agg(F.min("doc_id").alias("doc_id")), "reps")

    # Groups of the same prefix and size; members not linked to the leader go their own ways.
    heads = _prefixes(rows.where("doc_id IS NOT NULL"), width, percent, frequent).join(broadcast_if_small(reps.select("doc_id").distinct(), 1_000_000), "doc_id", "left_semi")
    heads = materialise(heads, "prefixes")
    heads = materialise(heads.dropDuplicates(["doc_id", "pkey"]), "prefixes") if not _unique(heads) else heads
    maps = heads.select("doc_id", "n", "bits")
    lead = heads.groupBy("pkey").agg(F.min("doc_id").alias("gid"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    member = heads.select("doc_id", "pkey").join(lead, "pkey").where("doc_id <> gid").select(F.col("gid").alias("a"), F.col("doc_id").alias("b")).distinct()
    close = materialise(_verify(rows, materialise(member, "members"), maps, width, percent).where("linked").select(F.col("b").alias("doc_id"), F.col("a").alias("gid"), "d"), "close")
    radius = close.groupBy("gid").agg(F.max("d").alias("r"))
    groups = heads.join(broadcast_if_small(close.select("doc_id").distinct(), 1_000_000), "doc_id", "left_anti").withColumnRenamed("doc_id", "gid").join(broadcast_if_small(radius, 1_000_000), "gid", "left").select("gid", "n", "prefix", F.coalesce("r", F.lit(0.0)).alias("r"))
    edges = [close.select(F.col("gid").alias("a"), F.col("doc_id").alias("b"))]

    found = _compare(groups, percent)
    verdicts = _judge(rows, found.where("a IS NOT NULL").select("a", "b"), None, maps, width, percent)
    edges.append(verdicts.where("linked").select("a", "b"))

    # What pivots leave of lists, member by member, and members of groups that are not linked but near enough for their members to be.
    left = _left_over(found, verdicts, least).select(F.col("tok").alias("lst"), "gid", "n", "open")
    member = close.select("gid", F.col("doc_id").alias("member"), "d")
    lists = left.union(left.join(member, "gid").select("lst", F.col("member").alias("gid"), "n", "open"))
    r_a, r_b = (radius.select(F.col("gid").alias(k), F.col("r").alias(f"r_{k}")) for k in "ab")
    apart = verdicts.where("NOT linked").join(r_a, "a", "left").join(r_b, "b", "left").withColumn("r_a", F.coalesce("r_a", F.lit(0.0))).withColumn("r_b", F.coalesce("r_b", F.lit(0.0)))
    apart = materialise(apart.where(f"d <= r_a + r_b + {least} AND r_a + r_b > 0").select("a", "b", "d", "r_a", "r_b").distinct(), "apart")
    if not apart.isEmpty():
        whole = member.union(groups.select("gid", F.col("gid").alias("member"), F.lit(0.0))).withColumnRenamed("d", "own")
        sizes = groups.select("gid", "n")
        for own, other in (("a", "r_b"), ("b", "r_a")):
            side = apart.withColumn("gid", F.col(own)).join(whole, "gid").where(F.col("own") + F.col(other) + least >= F.col("d")).join(sizes, "gid")
            lists = lists.union(side.select(F.xxhash64("a", "b").alias("lst"), F.col("member").alias("gid"), "n", F.lit(True).alias("open")))
    edges += _resolve(lists, rows, maps, frequent, width, percent)

    links = edges[0]
    for e in edges[1:]:
        links = links.union(e)
    # A document whose repeated rows differ belongs to several sets; their first documents are linked through it.
    links = links.union(named.join(reps.withColumnRenamed("doc_id", "rep"), "sig").where("rep <> doc_id").join(reps.select("doc_id"), "doc_id", "left_semi").select("rep", "doc_id"))
    comp = components(links)
    out = each.join(reps.select("sig", F.col("doc_id").alias("rep")), "sig", "left").join(comp, F.col("rep") == F.col("node"), "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))


def _unique(heads: DataFrame) -> bool:
    """Whether no document comes twice, as it does where rows repeat an id."""
    return heads.groupBy("doc_id").count().where("count > 1").isEmpty()


def _judge(docs: DataFrame, pairs: DataFrame, known: DataFrame | None, maps: DataFrame, width: int, percent: int) -> DataFrame:
    """``known`` with verdicts on the pairs that it lacks, as a table."""
    pairs = pairs.distinct()
    if known is not None:
        pairs = pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")
    new = _verify(docs, materialise(pairs, "pairs"), maps, width, percent)
    return materialise(new if known is None else known.union(new), "verdicts")


def _left_over(found: DataFrame, verdicts: DataFrame, least: float) -> DataFrame:
    """What long lists still have to compare after their pivot.

    ``open`` rows are not linked to the pivot; of the linked ones those stay
    that are so far from it that an open one may be near them.
    """
    rows = found.where("tok IS NOT NULL AND gid <> lead").withColumn("a", F.least("gid", "lead")).withColumn("b", F.greatest("gid", "lead"))
    by_size = 1 - F.least("n", "lead_n") / F.greatest("n", "lead_n")
    known = rows.join(verdicts.select("a", "b", "d", "linked"), ["a", "b"], "left").withColumn("d", F.coalesce("d", by_size)).withColumn("now_open", F.col("open") & ~F.coalesce("linked", F.lit(False)))
    known = materialise(known.select("tok", "gid", "n", "r", "d", "now_open"), "judged")
    near = materialise(known.where("now_open").groupBy("tok").agg(F.min(F.col("d") - F.col("r")).alias("low")), "near")
    left = _by_list(known, near, "tok").where(F.col("now_open") | (F.col("d") + F.col("r") + least >= F.col("low")))
    return materialise(left.select("tok", "gid", "n", F.col("now_open").alias("open")), "left")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
