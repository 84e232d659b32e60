"""Chains of steps over payloads."""

import hashlib

import pytest
from pyspark.sql import functions as F

from stowage.operators import chain

ROWS = [("a", 0, b"zero"), ("a", 1, b""), ("a", 2, None), (None, 0, b"x" * 100_000), ("b", None, b"abc")]


def given(spark):
    return spark.createDataFrame([(a, i, None if p is None else bytearray(p)) for a, i, p in ROWS], "archive string, idx long, payload binary")


def values(df):
    return {(r["archive"], r["idx"]): None if r["payload"] is None else bytes(r["payload"]) for r in df.collect()}


def test_there_and_back(spark):
    key = F.lit(b"k" * 32)
    steps = [chain.digest("md5", "md5"), chain.compress(), chain.encrypt(key), chain.decrypt(key), chain.decompress()]
    out = chain.Chain(given(spark)).add(*steps).process()
    assert values(out) == {(a, i): p for a, i, p in ROWS}
    assert {(r["archive"], r["idx"]): r["md5"] for r in out.collect()} == {(a, i): None if p is None else hashlib.md5(p).hexdigest() for a, i, p in ROWS}
    assert values(given(spark).transform(chain.cut(1, 3))) == {(a, i): None if p is None else p[1:3] for a, i, p in ROWS}
    sealed = chain.Chain(given(spark)).add(chain.encrypt(key)).process()
    assert values(sealed)["a", 0] != b"zero"
    with pytest.raises(Exception, match="no key opens"):  # noqa: PT011
        sealed.transform(chain.decrypt(F.lit(b"o" * 32))).collect()


def test_rows_that_pass_by(spark):
    out = given(spark).transform(chain.unless(F.col("archive") == "a", chain.cut(0, 2)))
    assert values(out) == {(a, i): p if a == "a" or p is None else p[:2] for a, i, p in ROWS}
    wrong = chain.unless(F.lit(True), chain.decrypt(F.lit(b"k" * 32)))
    assert values(given(spark).transform(wrong)) == {(a, i): p for a, i, p in ROWS}


def test_control(spark):
    said = chain.contexts(spark, [{"archive": "a", "idx": 0, "edits": [1, 2]}, {"archive": None, "idx": 0, "edits": [0, 5]}, {"archive": "none", "idx": 9}])
    out = chain.Chain(given(spark)).attach(said).add(chain.edit(F.col("edits"))).process()
    assert values(out) == {(a, i): p for a, i, p in ROWS} | {("a", 0): b"er", (None, 0): b"xxxxx"}
    with pytest.raises(ValueError, match="attached already"):
        chain.Chain(given(spark)).attach(said).attach(said)
    with pytest.raises(ValueError, match="not known of a file: owner"):
        chain.contexts(spark, [{"archive": "a", "idx": 0, "owner": 1}])
    with pytest.raises(Exception, match="named twice"):  # noqa: PT011
        chain.Chain(given(spark)).attach(said.union(said)).process().collect()


def test_steps_in_python_share_a_worker(spark, sf_dir):
    """One node for all steps in a row, and the columns that digests and conditions read and write are those of their place."""
    from stowage.queries import QUERIES

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(QUERIES["transform_chain"](spark, sf_dir)).count("EvalPython") == 1
    plain = F.substring("payload", 1, 4) != F.unhex(F.lit("28B52FFD"))
    steps = [chain.digest("md5", "first"), chain.compress(), chain.digest("md5", "packed"), chain.unless(plain, chain.decompress()), chain.unless(plain, chain.decompress()), chain.digest("md5", "first")]
    out = chain.Chain(given(spark)).add(*steps).process()
    assert values(out) == {(a, i): p for a, i, p in ROWS}
    for r in out.collect():
        p = dict(((a, i), p) for a, i, p in ROWS)[r["archive"], r["idx"]]
        assert r["first"] == (None if p is None else hashlib.md5(p).hexdigest())
        assert (r["packed"] is None) == (p is None) and (p is None or r["packed"] != r["first"])
    late = [chain.digest("md5", "seen"), chain.unless(F.col("seen") == hashlib.md5(b"abc").hexdigest(), chain.compress()), chain.encrypt(F.unhex(F.sha2("seen", 256))), chain.decrypt(F.unhex(F.sha2("seen", 256)))]
    got = values(chain.Chain(given(spark)).add(*late).process())
    assert got["b", None] == b"abc" and got["a", 0] != b"zero" and got["a", 2] is None
