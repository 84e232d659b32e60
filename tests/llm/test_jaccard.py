"""The similarity join against comparing every pair."""

import random
import re
from itertools import combinations

import pytest

from stowage.llm import jaccard, shingles


def sets(t, width=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, percent=85):
    known = {i: sets(t) for i, t in rows if i is not None}
    root = {i: i for i in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(known, 2):
        x, y = known[a], known[b]
        if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return sorted((i, len(known[i]), find(i)) for i in known)


def got(spark, rows, **k):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, jaccard.jaccard_join(df, **k).collect()), key=str)


def test_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(got(spark, rows)) == brute(rows)


#: Sizes at which lists go other ways than in the queries: all but the shortest take pivot after pivot or many blocks.
WAYS = [{"SHORT": 2, "MOST": 2, "FEW": 0}, {"SHORT": 2, "MOST": 30, "ALL": 3, "FEW": 4, "BLOCK": 7}, {"LONG": 4, "PART_SEEN": 1, "MOST": 2, "FEW": 1}]


@pytest.mark.parametrize(("seed", "ways"), [(2, WAYS[0]), (3, WAYS[1]), (4, WAYS[2])])
def test_near_copies(spark, seed, ways, monkeypatch):
    for k, v in ways.items():
        monkeypatch.setattr(jaccard, k, v)
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(14)]
    rows = []
    for _ in range(6):  # chains of ever more changed copies, and copies around a centre
        text = [word() for _ in range(rnd.choice((30, 60, 90)))]
        for step in range(24):
            if step % 2:
                text = list(text)
            new = list(text)
            for _ in range(rnd.choice((0, 1, 1, 2, 3))):
                new[rnd.randrange(len(new))] = word()
            if step % 3 == 0:
                text = new
            rows.append((rnd.randrange(10**6) * 1000 + len(rows), " ".join(new)))
    for _ in range(60):  # unlike texts with a common passage
        rows.append((rnd.randrange(10**6) * 1000 + len(rows), " ".join(passage + [word() for _ in range(rnd.choice((2, 3, 4, 30)))])))
    assert sorted(got(spark, rows)) == brute(rows)


@pytest.mark.parametrize(("seed", "ways"), [(3, WAYS[2])])
def test_texts_nearly_alike_in_one_passage(spark, seed, ways, monkeypatch):
    """Most of every text is one passage, too little for a link; some are linked by what they have beside it."""
    for k, v in ways.items():
        monkeypatch.setattr(jaccard, k, v)
    rnd, rows = random.Random(seed), []
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    passage = [word() for _ in range(90)]
    tails = [[word() for _ in range(14)] for _ in range(9)]
    for n in range(220):
        own = [word() for _ in range(rnd.choice((8, 10, 11, 12, 13, 14)))]
        if n % 3 == 0:  # with others' words, more or less of them
            tail = rnd.choice(tails)
            own = tail[: rnd.randrange(4, 14)] + own[: rnd.randrange(0, 9)]
        keep = passage[rnd.choice((0, 0, 0, 1, 2, 5)) :]
        rows.append((n * 7 % 1000, " ".join(keep + own if rnd.random() < 0.8 else own + keep)))
    assert sorted(got(spark, rows)) == brute(rows)


def test_many_texts_nearly_alike(spark, monkeypatch):
    """3,000 texts that share all but a tenth, and 20,000 that share a shingle: all pairs would be millions."""
    monkeypatch.setattr(jaccard, "MOST", 64)
    word = lambda *k: "w" + "x".join(map(str, k))
    passage = " ".join(word("p", n) for n in range(90))
    rows = [(n, passage + " " + " ".join(word(n, k) for k in range(11))) for n in range(3000)]
    rows += [(5000 + n, "the same four words " * (n % 2) + " ".join(word(n, k, "t") for k in range(9))) for n in range(20_000)]
    rows += [(50_000 + n, rows[n][1] + " more") for n in (5, 700, 2999)] + [(60_000, rows[3100][1])]
    want = {50_005: 5, 50_700: 700, 52_999: 2999, 60_000: rows[3100][0]}
    assert {r[0]: r[2] for r in got(spark, rows) if r[0] != r[2]} == want


def test_chance_matches_of_large_sets():
    """Two random sets of a million elements: the allowance covers what half hashes match by chance."""
    import numpy as np

    rng = np.random.default_rng(1)
    n = 1_000_000
    a, b = rng.integers(0, 1 << 32, n), rng.integers(0, 1 << 32, n)
    by_chance = int(np.isin(a, b).sum())
    mean = (2.0 * n) ** 2 / (1 << 34)
    assert 100 < by_chance < 4 + 2 * mean + 10 * mean**0.5


def test_odd_rows(spark):
    rows = [(9, None), (8, ""), (7, " \n"), (6, "One two"), (5, "one TWO"), (4, "É two"), (3, "é two"), (2, "a b c d e"), (2, "a b c d e"), (None, "one two"), (1, "w " * 30000), (0, "w w w w")]
    want = [(0, 1, 0), (1, 1, 0), (2, 2, 2), (2, 2, 2), (3, 1, 3), (4, 1, 4), (5, 1, 5), (6, 1, 5), (7, 0, 7), (8, 0, 8), (9, 0, 9), (None, 1, None)]
    assert got(spark, rows) == sorted(want, key=str)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS sig", "2 AS tok")
    assert jaccard.jaccard_join(df).count() == len(rows)
    assert got(spark, []) == []


def test_shingles():
    assert len(shingles.shingle_set("a b c d e f")) == 3
    assert shingles.shingle_set("A b\x0bC\x0cd").tolist() == shingles.shingle_set("a B c D").tolist()
    assert len(shingles.shingle_set("a\x1cb c")) == 1
