"""Sharding, mixing, exact duplicates and licence scans against plain Python."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stowage.llm import dedup, licences, mixing, sharding

ODD = [(1, None, "s"), (2, "", "s"), (3, "abc", None), (3, "abc", None), (4, "ABC", "t"), (5, "É", "t"), (6, "é", "t"), (None, "abc", "t"), (None, None, "u"), (7, "x" * 50_000, "u")]
SCHEMA = "doc_id long, text string, source string"


def odd(spark, times=1):
    """Rows with nulls, repeats and columns that clash with those of results and internals."""
    extra = [f"'{c}' AS `{c}`" for c in ("keep_id", "kept", "shard", "depth", "mix_copy", "mix_key", "licences", "n_matches", "count", "rate")]
    return spark.createDataFrame(ODD * times, SCHEMA).selectExpr("*", *extra)


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def groups(rows, keep=max):
    by = {}
    for i, t in rows:
        by.setdefault(lower(t), []).append(i)
    best = {t: keep((i for i in ids if i is not None), default=None) for t, ids in by.items()}
    return Counter((i, best[lower(t)], len(by[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows), len(by)


@pytest.mark.parametrize("hot", [None, 2, 0])
@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_duplicates(spark, hot, keep):
    for df in (odd(spark), odd(spark, 7).repartition(3)):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = dedup.exact_dedup(df, keep=keep, hot_rows=hot, buckets=3).collect()
        want, n = groups(rows, max if keep == "max" else min)
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
        kept = [r for r in got if r["kept"]]
        assert len(kept) == n == len({r["text_sha256"] for r in kept})
        assert all(r["doc_id"] == r["keep_id"] for r in kept)


@pytest.mark.parametrize("hot", [None, 2])
def test_exact_duplicates_carry_their_columns(spark, hot):
    df = odd(spark)
    out = dedup.exact_dedup(df, carry=True, hot_rows=hot)
    assert set(out.columns) == {*df.columns, "keep_id", "group_size", "kept", "text_sha256"}
    plain = ["doc_id", "text", "source", "shard"]
    assert sorted(map(str, out.select(plain).collect())) == sorted(map(str, df.select(plain).collect()))
    assert dedup.exact_dedup(df.limit(0)).count() == 0


def shards(rows, limit):
    """Split oversized buckets bit by bit."""
    key = lambda i, t: int(hashlib.md5(f"{'' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:15], 16)
    todo, done = [("", [(key(i, t), i, len((t or "").encode())) for i, t in rows])], []
    while todo:
        name, held = todo.pop()
        size = sum(x[2] for x in held)
        if size <= limit or len({x[0] for x in held}) == 1:
            done += [(i, n, name, len(name), size > limit) for _, i, n in held]
            continue
        bit = 59 - len(name)
        todo += [(name + b, part) for b in "01" if (part := [x for x in held if str(x[0] >> bit & 1) == b])]
    return Counter(done)


@pytest.mark.parametrize(("limit", "first", "step"), [(20_000, None, 12), (3000, 2, 3), (10, 1, 20)])
def test_sharding(spark, sf_dir, limit, first, step):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for df in (docs, odd(spark, 3)):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = sharding.shard_documents(df, limit, first_bits=first, step_bits=step).collect()
        assert Counter(map(tuple, got)) == shards(rows, limit)
    assert sharding.shard_documents(docs, limit, most_broadcast=0, first_bits=first).count() == docs.count()
    assert sharding.shard_documents(docs.limit(0), limit).count() == 0


def test_shards_are_written(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sharding.write_shards(docs, f"{tmp_path}/out", 50_000)
    sizes = spark.read.parquet(f"{tmp_path}/out").groupBy("shard").agg(F.sum(F.octet_length("text"))).collect()
    assert len(sizes) > 5 and max(r[1] for r in sizes) <= 50_000


def poisson(rate, u):
    k, p, below = 0, math.exp(-rate), 0.0
    while True:
        below += p
        if below > u:
            return k
        k += 1
        p *= rate / k


def test_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, weights = docs.collect(), {"src0": 1.0, "src1": 6.0, "src2": 0.5}
    volume = Counter()
    for r in rows:
        volume[r["source"]] += len(r["text"].encode())
    used = sum(w for s, w in weights.items() if volume[s])
    rates = {s: 3 * sum(volume.values()) * weights.get(s, 0) / used / v for s, v in volume.items()}
    assert max(rates.values()) > mixing.PART
    want = Counter()
    for r in rows:
        key, rate = f"{r['doc_id']}:{hashlib.md5(r['text'].encode()).hexdigest()}", rates[r["source"]]
        parts = max(1, math.ceil(rate / mixing.PART))
        for j in range(1, parts + 1):
            u = int(hashlib.md5(f"{mixing.SEED}:{j}:{key}".encode()).hexdigest()[:13], 16) / 2**52
            want[r["doc_id"]] += poisson(rate / parts, u)
    for most in (0, 1000):
        out = mixing.mix_sources(docs, weights, 3.0, most_broadcast=most)
        assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == +want
    keys = [r["mix_key"] for r in mixing.mix_sources(docs, weights, 3.0).select("mix_key").collect()]
    assert keys == sorted(keys)
    assert out.columns == [*docs.columns, "mix_copy", "mix_key"]
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_mixing_odd_rows(spark):
    df = odd(spark, 4)
    out = mixing.mix_sources(df, epochs=5.0)
    assert set(out.columns) == set(df.columns)
    assert {r["source"] for r in out.collect()} <= {None, "t", "u"}  # "s" has no volume
    assert mixing.mix_sources(df, {"none such": 1.0}).count() == 0


NOTICES = [
    ("Released under the MIT License.", "MIT"),
    ("  released UNDER the mit license  ", "MIT"),
    ("Released under the license.", ""),
    ("words\nLicensed under CC BY-NC 4.0.\nwords\nReleased under the MIT License.", "CC-BY-NC-4.0,MIT"),
    ("Redistribution and use in source and binary\nforms, with or without modification, are permitted\nprovided that the following conditions are met:", "BSD-3-Clause"),
    ("a license for software under the terms of the gnu", ""),
    (None, ""),
    ("", ""),
]


def scan(text):
    units = (text or "").lower().split("\n") if text else []
    blocks = [b for b in __import__("re").split("\n[\x20\x09-\x0d]*\n", (text or "").lower()) if "\n" in b]
    best, names, hits = 0, set(), 0
    for u in units + blocks:
        own, found = licences.bigrams(u), {}
        for name, t in licences.TEMPLATES:
            known = licences.bigrams(t)
            ppm = 2_000_000 * len(own & known) // (len(own) + len(known))
            if ppm >= 800_000:
                found[name] = max(found.get(name, 0), ppm)
        hits += len(found)
        names |= set(found)
        best = max([best, *found.values()])
    return ",".join(sorted(names)), hits, best


def test_licences(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10_000 + n, t) for n, (t, _) in enumerate(NOTICES + [(t, "") for _, t in licences.TEMPLATES])], "doc_id long, text string")
    rows = {r["doc_id"]: r["text"] for r in docs.union(extra).collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in licences.scan_licences(docs.union(extra)).collect()}
    assert got == {i: scan(t) for i, t in rows.items()}
    for n, (_, name) in enumerate(NOTICES):
        assert got[10_000 + n][0] == name
    assert licences.scan_licences(odd(spark, 2)).count() == 2 * len(ODD)
    assert licences.scan_licences(docs.limit(0)).count() == 0


EMBEDDED = [
    ("/*\n * Copyright Basel Tools\n *\n * " + licences.TEMPLATES[4][1].replace("deal in", "deal\n * in").replace("copies of", "copies\n * of") + "\n *\n * " + " ".join(f"word{n}" for n in range(80)) + "\n */\nint main;", "MIT"),
    ("Many words come first and say\nmuch. This work is licensed under the GNU\nGeneral Public License, version 3. And other words follow\nthat have nothing to do with it at all, in number.", "GPL-3.0"),
    ("This tool was written in Basel in 2019 and is released under the MIT License.", "MIT"),
    ("A licence is released under the usual terms, of which MIT knows.", ""),
]


def passages(text):
    """All runs of words of the sizes that the limit allows, without those that overlap a better one."""
    w = [x for x in __import__("re").split("[^a-z0-9]+", text.lower()) if x]
    g, every, kept = [f"{a} {b}" for a, b in zip(w, w[1:])], [], []
    for name, t in licences.TEMPLATES:
        known = licences.bigrams(t)
        for i in range(len(g)):
            for j in range(i + 1, min(len(g), i + int(1.5 * len(known) + 1e-9)) + 1):
                own = set(g[i:j])
                ppm = 2_000_000 * len(own & known) // (len(own) + len(known))
                if ppm >= 800_000:
                    every.append((-ppm, i, j, name))
    for x in sorted(every):
        if not any(k[0] < x[0] and k[1] < x[2] and k[2] > x[1] for k in kept):
            kept.append(x)
    return {x[3]: -x[0] for x in reversed(kept)}


def test_licences_inside_lines_and_blocks(spark):
    df = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(EMBEDDED)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licences.scan_licences(df).collect()}
    for n, (text, want) in enumerate(EMBEDDED):
        found = passages(text)
        assert scan(text) == ("", 0, 0)
        assert tuple(got[n])[1:] == (want, len(found), max(found.values(), default=0))
        assert want == ",".join(sorted(found))


def test_anchors_cover_what_a_match_may_not_miss():
    for limit in (0.5, 0.8, 0.95):
        chosen = licences.anchors(limit=limit)
        for _, text in licences.TEMPLATES:
            own = licences.bigrams(text)
            least = math.ceil(round(len(own) * limit / (2 - limit), 9))
            covered = sum(any(a in f" {b} " for a in chosen) for b in own)
            assert covered > len(own) - least
