"""Every archive query against its SQL, and the data source."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from stowage.functions import binary as fb
from stowage.functions import crypto
from stowage.operators import catalog, layout
from stowage.queries import QUERIES, SQL
from stowage.sources import archive as arc
from stowage.sources import archive_format as fmt


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(str([v[k] for k in order]) for v in values)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = duck.execute(SQL[name])
    assert sorted(c[0] for c in want.description) == sorted(df.columns)
    assert got == rows([c[0] for c in want.description], want.fetchall())


def test_data_source(spark, tmp_path):
    key, private = os.urandom(32), os.urandom(32)
    given = {f"f{n}": os.urandom(70_000 * n) for n in range(5)}
    spark.dataSource.register(arc.ArchiveSource)
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in given.items()], "path string, payload binary").repartition(2)
    write = df.write.format("stowage_archive").mode("append").option("compress", "true").option("data_key", key.hex())
    write.option("readers", crypto.x25519(private).hex()).save(str(tmp_path))
    assert not [x for x in os.listdir(tmp_path) if x.endswith(".tmp")]
    read = lambda table, **k: spark.read.format("stowage_archive").options(table=table, private_keys=private.hex(), **k).load(str(tmp_path))
    assert {r["path"]: r["raw_size"] for r in read("files").collect()} == {k: len(v) for k, v in given.items()}
    assert read("eof").agg(F.sum("raw_file_size")).first()[0] == sum(map(len, given.values()))
    parts = sorted(read("content", blocks="1").collect(), key=lambda r: (r["path"], r["raw_offset"]))
    assert len(parts) > 5
    for k, v in given.items():
        assert b"".join(bytes(r["bytes"]) for r in parts if r["path"] == k) == v
    one = read("content", file="f3", first="1000", last="140000", blocks="1").orderBy("raw_offset").collect()
    assert b"".join(bytes(r["bytes"]) for r in one) == given["f3"][1000:140_000]


def test_errors_are_raised(spark):
    one = spark.createDataFrame([("abc", 7)], "h string, n long")
    for bad in (fb.hex_decode(F.col("h")), catalog.expected_hash(F.col("h"), 32), fb.skippable_frame(F.col("n"))):
        with pytest.raises(Exception, match="digits|digest|bytes"):  # noqa: PT011
            one.select(bad).collect()


def test_running_sum_in_blocks(spark):
    df = spark.range(0, 1000).selectExpr("IF(id % 3 = 0, 'a', 'b') AS k", "id", "id * 7 % 11 AS v")
    got = catalog.running_sum(df, "k", "id", F.col("v"), "s", block=64).collect()
    for k in "ab":
        total = 0
        for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["id"]):
            total += r["v"]
            assert r["s"] == total


def test_ranges_need_the_blocks_that_hold_them(spark):
    df = spark.createDataFrame([([50, 123_455], 123_505)], "sizes array<long>, n long")
    p = df.select(layout.range_to_blocks(F.col("sizes"), F.lit(100), F.lit(1000), F.lit(True), F.lit(True), F.col("n")).alias("p")).select("p.*").first()
    assert tuple(p) == (65_564, 131_128, 50, 900)
    p = df.select(layout.range_to_blocks(F.lit(None).cast("array<bigint>"), F.lit(0), F.lit(100), F.lit(False), F.lit(False), F.lit(100)).alias("p")).select("p.*").first()
    assert tuple(p) == (0, 65_536, 0, 100)


def test_edit_lists(spark):
    data = bytes(range(100))
    for edits, want in (([10, 5], data[10:15]), ([0, 200], data), ([90, 50], data[90:]), ([], b""), (None, data), ([1, 2, 3, 4], data[1:3] + data[6:10])):
        df = spark.createDataFrame([(bytearray(data), edits)], "b binary, e array<long>")
        assert bytes(df.select(layout.edit_list(F.col("b"), F.col("e"))).first()[0]) == want
    assert fmt.TRAILER == 73


def test_digests_of_whole_archives(spark):
    """A source of more than 64 documents, at sf0.1, has one digest of all its texts."""
    want = duckdb.execute("SELECT source, count(*), sha256(string_agg(text, '' ORDER BY doc_id)) FROM '/root/testdata/sf0.1/documents.parquet' GROUP BY source").fetchall()
    assert max(n for _, n, _ in want) > 64
    got = QUERIES["stream_digest"](spark, "/root/testdata/sf0.1").collect()
    assert sorted((r["archive"], r["n_files"], r["sha256"]) for r in got) == sorted(want)


def test_extraction_writes_files(spark, tmp_path):
    """Archives become a tree with the same bytes, and none of them lies outside it."""
    given = {f"/a/b{n % 3}/f{n}": os.urandom(70_000 * (n % 2) + n) for n in range(7)}
    entries = [{"kind": "dir", "path": "a/none"}, *({"kind": "file", "path": k, "payload": v, "compress": True} for k, v in given.items())]
    df = spark.createDataFrame([("one", bytearray(fmt.build_archive(entries)))], "archive string, content binary")
    for _ in range(2):
        arc.extract_archives(df, f"file://{tmp_path}/out")
        assert {f"/{p.relative_to(tmp_path / 'out')}": p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()} == given
    assert (tmp_path / "out/a/none").is_dir()
    bad = fmt.build_archive([{"kind": "file", "path": "a/../../x", "payload": b"x"}])
    with pytest.raises(Exception, match="no path to extract to"):  # noqa: PT011
        arc.extract_archives(spark.createDataFrame([("two", bytearray(bad))], "archive string, content binary"), f"file://{tmp_path}/out")
    assert not (tmp_path / "x").exists()


def test_extract_list_lists_what_was_written(spark, sf_dir, monkeypatch):
    """Without the files that extraction writes there is nothing to list."""
    assert QUERIES["extract_list"](spark, sf_dir).count()
    monkeypatch.setattr(arc, "extract_archives", lambda *a, **k: None)
    with pytest.raises(Exception, match="FileNotFoundError|does not exist"):  # noqa: PT011
        QUERIES["extract_list"](spark, sf_dir).collect()


def test_indexes_of_odd_rows(spark):
    """Null archives and ids, repeated and sparse ids: every row gets an index, the same at every evaluation."""
    rows = [(None, 1, "a"), (None, 1, "b"), (None, None, "c"), ("x", None, "d"), ("x", 5, "e"), ("x", 5, "e"), ("x", 5, "f"), ("x", 1 << 60, "g"), ("x", -(1 << 40), "h")]
    df = spark.createDataFrame(rows, "archive string, id long, path string").repartition(3)
    got = [sorted(map(tuple, catalog.assign_index(df.repartition(n)).collect()), key=str) for n in (1, 4)]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    for name in (None, "x"):
        own = sorted((r[3], r[1]) for r in got[0] if r[0] == name)
        assert [k for k, _ in own] == list(range(len(own)))
        assert [i for _, i in own] == sorted((r[1] for r in rows if r[0] == name), key=lambda i: (i is not None, i or 0))
