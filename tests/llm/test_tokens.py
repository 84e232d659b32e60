"""Token files and packing against encoding each text in one go."""

import bisect
import math
import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stowage.llm import packing, planes, tokens
from stowage.plans.scratch import materialise

BYTES, WORDS = tokens.tokenizer_path("byte_bpe_50k.json"), tokens.tokenizer_path("word_bpe_49k.json")
ODD = ["a  b", " a", "a ", "a \nb", "\n b", "", " ", "<|endoftext|> x", "\0x y", "x \0y", "É́ x", "a\x1cb c", "don't 'S  \t x", "x. y., ا. ʰ. 1. a.b. ß. x", "a  b c", "it's. we'll, don't; 'tis"]


library = lru_cache(Tokenizer.from_file)


def whole(path, text):
    return np.asarray(library(path).encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@pytest.mark.parametrize(("path", "words"), [(BYTES, False), (WORDS, True)])
@pytest.mark.parametrize("text", ODD)
def test_pieces_give_the_ids_of_the_whole(path, words, text):
    assert tokens.encoder(path, words).encode(text) == whole(path, text)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("ab'sé .,\n\t1-ß́ ")), max_size=30))
def test_any_text_gives_the_ids_of_the_whole(text):
    for path, words in ((BYTES, False), (WORDS, True)):
        e = tokens.encoder(path, words)
        assert e.encode(text) == np.asarray(e.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


LETTERS = [chr(c) for c in range(0x250) if chr(c).isalpha()]


@pytest.mark.parametrize(("path", "words"), [(BYTES, False), (WORDS, True)])
def test_every_letter_before_every_mark(path, words):
    e = tokens.Encoder(path, words)
    for c in LETTERS:
        for m in tokens.MARKS:
            for text in (f"{c}{m}", f"a{c}{m} b", f"1{c}{m}", f"a{c}", f"x {c.upper()}A{m}", f"{c}{m}{c}{m}", f"'{c}{m}", f"{c}'{c}{m}"):
                assert e.encode(text) == whole(path, text), text


@pytest.mark.parametrize(("path", "words"), [(BYTES, False), (WORDS, True)])
def test_random_texts_of_all_letters(path, words):
    rnd, e = random.Random(5), tokens.Encoder(path, words, remembered=1000)
    alphabet = [*LETTERS, *"İİ" * 20, *tokens.MARKS * 20, *" '’1\n" * 20, "\u0307", "\u0301"]
    for _ in range(20_000):
        text = "".join(rnd.choices(alphabet, k=rnd.randrange(1, 14)))
        assert e.encode(text) == whole(path, text), text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=70), st.booleans(), st.integers(1, 33))
def test_plane_files_round_trip(ids, bits, block):
    ids = np.array(ids, dtype="<u4")
    counts = [len(ids) // 2, 0, len(ids) - len(ids) // 2]
    got, names, n = planes.read_file(planes.write_file(ids, [5, None, -7], counts, bits, block))
    assert got.tolist() == ids.tolist() and names == [5, None, -7] and n == counts


def test_a_damaged_file_is_told():
    data = bytearray(planes.write_file(np.arange(5000, dtype="<u4"), [1], [5000]))
    data[100] ^= 1
    with pytest.raises(Exception):  # noqa: B017, PT011
        planes.read_file(bytes(data))


def texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10_000 + n, t) for n, t in enumerate([*ODD, None, "word " * 9000, "x " * 2047, "x " * 2048])], "doc_id long, text string")
    return docs.union(odd).repartition(5)


def test_planes(spark, sf_dir, tmp_path):
    docs = texts(spark, sf_dir)
    files = materialise(planes.encode_files(docs, WORDS, True, 1, bits=True, block=1000, file_ids=20_000), "planes")
    got = sorted(planes.read_documents(files).collect())
    want, at = [], 0
    for r in sorted(docs.collect()):
        ids = whole(WORDS, r["text"] or "") + b"\1\0\0\0"
        want.append((r["doc_id"], at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert list(map(tuple, got)) == want
    planes.export_files(files, str(tmp_path))
    names = sorted(x for x in tmp_path.iterdir())
    assert len(names) == files.count() > 5
    assert sum(len(planes.read_file(x.read_bytes())[0]) for x in names) == at
    twice = docs.limit(3).union(docs.limit(3)).selectExpr("IF(doc_id % 2 = 0, NULL, doc_id) AS doc_id", "text", "1 AS part")
    assert planes.read_documents(materialise(planes.encode_files(twice, WORDS, True, 1), "planes")).count() == 6
    assert planes.read_documents(materialise(planes.encode_files(docs.limit(0), WORDS, True, 1), "planes")).count() == 0


def held(got, length):
    """Sequences are filled from 0 without gaps and not over their length."""
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= length
    return len(by)


def test_packing(spark, sf_dir):
    docs = texts(spark, sf_dir)
    got = packing.pack(docs, BYTES).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    total = 0
    for r in docs.collect():
        ids, at = whole(BYTES, r["text"] or "") + b"\0\0\0\0", 0
        total += len(ids) // 4
        for n, p in enumerate(sorted(by.pop(r["doc_id"]), key=lambda p: p["piece"])):
            assert (p["piece"], p["start"]) == (n, at)
            assert p["length"] <= 2048 and (n == 0 or p["length"] == 2048)
            assert p["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + p["length"])])
            at += p["length"]
        assert at == len(ids) // 4
    assert not by
    assert held(got, 2048) <= 1.02 * math.ceil(total / 2048) + 1
    odd = docs.limit(4).union(docs.limit(4)).selectExpr("IF(doc_id % 2 = 0, NULL, doc_id) AS doc_id", "text", "1 AS length")
    held(packing.pack(odd, BYTES, length=16).collect(), 16)
    assert packing.pack(docs.limit(0), BYTES).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=64))
def test_a_plan_holds_every_piece_once(histogram):
    planned, used = packing.plan(histogram, 64, 16), Counter()
    for pattern, n in planned:
        assert sum(pattern) <= 64 and n > 0
        for x in pattern:
            used[x] += n
    assert used == Counter(histogram)


def plain_best_fit(lengths, size):
    rooms = []
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, x)
        room = rooms.pop(at) if at < len(rooms) else size
        if room > x:
            bisect.insort(rooms, room - x)
        elif room == x:
            bisect.insort(rooms, 0)
    return len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plans_take_no_more_than_plain_best_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip((rng.gamma(1.2, 250, 1500) + rng.integers(1, 40, 1500)).astype(int), 1, 2048)
    lengths[:200] = 2048
    used = sum(n for _, n in packing.plan(Counter(lengths.tolist())))
    assert -(-int(lengths.sum()) // 2048) <= used <= plain_best_fit(lengths.tolist(), 2048)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000))
def test_nnls_meets_its_optimality_conditions(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.random((8, 12)), rng.random(8) * 10
    x = packing.nnls(a, b)
    gain = a.T @ (b - a @ x)
    assert (x >= 0).all() and (gain <= 1e-6).all() and abs(gain @ x) < 1e-6
