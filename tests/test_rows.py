"""Python functions of rows: one worker for steps in a row, pieces by bytes, nulls."""

import hashlib

import pytest
from pyspark.sql import functions as F

from stowage.functions import rows
from stowage.queries import QUERIES


def workers(df):
    """Python nodes of a plan: each takes a worker in every task."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sum(plan.count(x) for x in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "MapInArrow"))


@pytest.mark.parametrize("name", ["decrypt_parts", "encrypt_roundtrip", "multi_key_decrypt", "pack_roundtrip", "zstd_roundtrip", "gzip_roundtrip"])
def test_one_worker_and_null_texts(spark, tmp_path, name):
    texts = [None, "", "é", "x" * 1499, "y" * 1500, "z" * 1501, "ab" * 5000]
    df = spark.createDataFrame([(n, "s", "en", t) for n, t in enumerate(texts)], "doc_id long, source string, lang string, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES[name](spark, str(tmp_path))
    assert workers(out) == 1
    assert {r["doc_id"]: r["md5"] for r in out.collect()} == {n: None if t is None else hashlib.md5(t.encode()).hexdigest() for n, t in enumerate(texts)}


def test_results_go_back_in_pieces(spark, monkeypatch):
    """Pieces of a few bytes and of many rows give the same rows in the same order."""
    df = spark.range(0, 1000, 1, 3).select("id", F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("t"))
    for held in (1, 100, 1 << 20):
        monkeypatch.setattr(rows, "HELD", held)
        out = df.select("id", rows.by_row(lambda t: {"n": len(t), "t": t.upper()}, "struct<n:bigint,t:string>", F.col("t")).alias("r")).select("id", "r.*").collect()
        assert [tuple(r) for r in out] == [(k, k % 50, "X" * (k % 50)) for k in range(1000)]
    assert rows.size_of({"a": b"123", "b": None, "c": "4567"}) == 15


def test_rows_of_archives_go_back_in_pieces(spark, monkeypatch):
    """What an archive holds is handed on file by file, not gathered for all archives of a batch."""
    from stowage.sources import archive as arc
    from stowage.sources import archive_format as fmt

    given = {f"f{n}": bytes([n]) * 1000 for n in range(20)}
    data = fmt.build_archive([{"kind": "file", "path": k, "payload": v, "compress": True} for k, v in given.items()])
    df = spark.createDataFrame([(f"a{k}", bytearray(data)) for k in range(5)], "archive string, content binary").coalesce(1)
    monkeypatch.setattr(rows, "HELD", 3000)
    seen = []

    class Frame:
        """Takes the place of a table of archives: runs the function over batches in this process."""

        select = lambda self, *c: self

        def mapInArrow(self, run, schema):
            import pyarrow as pa

            seen.extend(x.num_rows for x in run(iter([pa.RecordBatch.from_pylist([{"archive": "a", "content": data}] * 5)])))
            return self

    arc.archives_from_binary(Frame(), "content")
    assert sum(seen) == 100 and max(seen) == 3
    back = arc.archives_from_binary(df, "content").collect()
    assert {(r["archive"], r["path"]): bytes(r["bytes"]) for r in back} == {(f"a{k}", p): v for k in range(5) for p, v in given.items()}


def test_long_values_are_not_copied(monkeypatch):
    """A long binary value goes back in a batch of its own, and comes as a view where that is asked for."""
    import pyarrow as pa

    monkeypatch.setattr(rows, "HELD", 1000)
    data, seen = bytes(range(250)) * 8, []

    class Frame:
        """Takes the place of a table: runs the function over one batch in this process."""

        def mapInArrow(self, run, schema):
            seen.append(list(run(iter([pa.RecordBatch.from_pylist([{"c": x} for x in (b"a", data, None, b"b")])]))))

    given = []
    rows.map_rows(Frame(), lambda c: iter([(given.append(c) or (None if c is None else bytes(c)),)]), "c binary", views=True)
    assert [b.column(0).to_pylist() for b in seen[0]] == [[b"a"], [data], [None, b"b"]]
    assert [type(c) for c in given] == [memoryview, memoryview, type(None), memoryview]
    made = rows.array_of((data,), pa.binary())
    assert made.to_pylist() == [data] and made.buffers()[2].address == pa.py_buffer(data).address
    assert rows.array_of((None,), pa.binary()).to_pylist() == [None]
