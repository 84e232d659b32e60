"""Folder trees, archives of them, volumes cut by bytes, and the command line."""

import os

import pytest
from pyspark.sql import functions as F

from stowage.__main__ import main
from stowage.operators import catalog
from stowage.sources import archive as arc
from stowage.sources import archive_format as fmt
from stowage.sources import tree


def make(root, n=7):
    """A tree with empty and deep folders, odd names, an empty file and links of which one leads nowhere."""
    given = {f"a/b{k % 3}/ü {k}": os.urandom(50 * k) for k in range(n)} | {"a/b0/c/d/e": b"deep", "top": b"x"}
    (root / "a/none").mkdir(parents=True)
    for name, data in given.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    os.chmod(root / "top", 0o600)
    os.symlink("../../top", root / "a/b0/up")
    os.symlink("c", root / "a/b0/folder")
    os.symlink("nowhere", root / "a/dangling")
    return given


def test_scan(spark, tmp_path):
    given = make(tmp_path)
    got = {r["path"]: r for r in tree.scan_tree(spark, f"file://{tmp_path}", 3).collect()}
    assert {p: r["raw_size"] for p, r in got.items() if r["kind"] == "file"} == {p: len(v) for p, v in given.items()}
    assert {p for p, r in got.items() if r["kind"] == "dir"} == {"a", "a/none", "a/b0", "a/b1", "a/b2", "a/b0/c", "a/b0/c/d"}
    assert {p: r["target"] for p, r in got.items() if r["kind"] == "symlink"} == {"a/b0/up": "../../top", "a/b0/folder": "c", "a/dangling": "nowhere"}
    assert got["top"]["mode"] == 0o600 and got["top"]["uid"] == os.getuid() and got["top"]["mtime"] == int(os.lstat(tmp_path / "top").st_mtime)
    assert tree.scan_tree(spark, str(tmp_path / "a/none")).count() == 0
    with pytest.raises(Exception, match="No such file"):  # noqa: PT011
        tree.scan_tree(spark, str(tmp_path / "missing")).collect()
    with pytest.raises(ValueError, match="not a mounted folder"):
        tree.scan_tree(spark, "store://bucket/x")


def test_archives_of_a_tree(spark, tmp_path):
    given = make(tmp_path / "in")
    found = tree.scan_tree(spark, str(tmp_path / "in"))
    entries = tree.with_payload(tree.tree_entries(found).withColumn("archive", F.lit("one")), str(tmp_path / "in"))
    every = tree.tree_entries(found)
    assert {(r["path"], r["target"]) for r in every.where("kind = 'symlink'").collect()} == {("a/b0/folder", "a/b0/c"), ("a/b0/up", "top")}
    volumes = arc.pack_volumes(entries, lambda name, pdf: fmt.build_archive(arc.entries_of(pdf, compress=True)))
    content = arc.archives_from_binary(volumes, "content").collect()
    assert {r["path"]: bytes(r["bytes"]) for r in content} == given
    rows = {r["path"]: r for r in arc.archives_from_binary(volumes, "files").collect()}
    assert rows["top"]["mode"] == 0o600 and rows["top"]["symlinks"] == ["a/b0/up"] and rows["top"]["uid"] == os.getuid()
    assert {r["path"] for r in arc.archives_from_binary(volumes, "dirs").collect()} >= {"a/none", "a/b0/c/d"}


def test_volumes_are_cut_by_bytes(spark):
    given = {f"f{n:02d}": bytes([n]) * (1000 if n != 5 else 9000) for n in range(40)}
    df = spark.createDataFrame([("a", n, p, bytearray(v)) for n, (p, v) in enumerate(given.items())], "archive string, idx long, path string, payload binary").repartition(3)
    volumes = arc.pack_volumes(df, lambda name, pdf: fmt.build_archive(arc.entries_of(pdf)), per_volume=16, max_bytes=4000)
    sizes = {r["archive"]: r["n"] for r in arc.archives_from_binary(volumes, "files").groupBy("archive").agg(F.sum("raw_size").alias("n")).collect()}
    assert volumes.select("archive").distinct().count() == volumes.count() == len(sizes) > 8
    assert all(n < 4000 + 9000 for n in sizes.values()) and sum(n > 4000 for n in sizes.values()) == 1
    back = arc.archives_from_binary(volumes, "content")
    assert {r["path"]: bytes(r["bytes"]) for r in back.collect()} == given


def test_stretches_hold_every_block_once(spark, tmp_path):
    """Content of archives with many small and some large files, read in stretches of any length."""
    given = {f"f{n}": os.urandom(90_000 if n % 9 == 0 else 3000) for n in range(40)}
    with open(tmp_path / "x.arc", "wb") as f:
        fmt.write_archive(f, ({"kind": "file", "path": k, "payload": v, "compress": n % 2 == 0} for n, (k, v) in enumerate(given.items())))
    spark.dataSource.register(arc.ArchiveSource)
    for blocks in ("1", "2", "1024"):
        df = spark.read.format("stowage_archive").options(table="content", blocks=blocks).load(str(tmp_path))
        assert df.rdd.getNumPartitions() == max(1, -(-os.path.getsize(tmp_path / "x.arc") // (int(blocks) * fmt.BLOCK)))
        parts = sorted(df.collect(), key=lambda r: (r["path"], r["raw_offset"]))
        assert all(b"".join(bytes(r["bytes"]) for r in parts if r["path"] == k) == v for k, v in given.items())
        assert sum(len(r["bytes"]) for r in parts) == sum(map(len, given.values()))


def test_sink_keeps_the_columns_of_an_entry(spark, tmp_path):
    spark.dataSource.register(arc.ArchiveSource)
    rows = [("f1", bytearray(b"one"), "{}", 7, None), ("f2", bytearray(b"two"), None, None, bytearray(b"k" * 32))]
    df = spark.createDataFrame(rows, "path string, payload binary, metadata string, uid long, data_key binary").coalesce(1)
    df.write.format("stowage_archive").mode("append").save(str(tmp_path))
    got = {r["path"]: r for r in spark.read.format("stowage_archive").load(str(tmp_path)).collect()}
    assert (got["f1"]["metadata"], got["f1"]["uid"], got["f1"]["encrypted"]) == ("{}", 7, False)
    assert (got["f2"]["metadata"], got["f2"]["uid"], got["f2"]["encrypted"]) == (None, None, True)
    back = spark.read.format("stowage_archive").options(table="content", data_keys=(b"k" * 32).hex()).load(str(tmp_path)).collect()
    assert {r["path"]: bytes(r["bytes"]) for r in back} == {"f1": b"one", "f2": b"two"}


@pytest.mark.parametrize("block", [2, 3, 1 << 16])
def test_sums_of_sparse_orders(spark, block):
    """Orders over the whole range of a long, with few or many levels."""
    ids = [-(1 << 63), (1 << 63) - 1, 0, 1, 2, 3, -5, None] + [(k * 0x9E3779B97F4A7C15) % (1 << 64) - (1 << 63) for k in range(1, 41)]
    df = spark.createDataFrame([(k, i) for k in ("x", None) for i in ids], "k string, id long").repartition(3)
    levels = catalog.levels_of(df, "id", block)
    assert block**levels < 1 << 64 <= block ** (levels + 1)
    got = catalog.running_sum(df, "k", "id", F.lit(1).cast("long"), "n", block, levels=min(levels, 3)).collect()
    want = {i: n + 1 for n, i in enumerate(sorted(ids, key=lambda i: (i is not None, i or 0)))}
    assert len(got) == 2 * len(ids)
    assert {(r["k"], r["id"]): r["n"] for r in got} == {(k, i): n for k in ("x", None) for i, n in want.items()}
    assert catalog.levels_of(df.limit(0), "id") == catalog.levels_of(df.where("id BETWEEN 0 AND 3"), "id") == 1


@pytest.mark.parametrize("form", ["pem", "crypt4gh", "raw"])
def test_command_line(tmp_path, capfd, form, monkeypatch):
    given = make(tmp_path / "in")
    (tmp_path / "in/top.meta").write_text('{"a": 1}')
    os.remove(tmp_path / "in/a/dangling")
    monkeypatch.chdir(tmp_path)
    for name in ("one", "two", "three"):
        main(["create-keypair", "-o", name, "--format", form])
        assert os.stat(name).st_mode & 0o777 == 0o600
    with pytest.raises(FileExistsError):
        main(["create-keypair", "-o", "one"])
    main(["create", "in", "-o", "x.arc", "--compress", "--metadata", "--reader-public-key", "one.pub"])
    main(["add-reader", "x.arc", "--private-key", "one", "--reader-public-key", "two.pub"])
    main(["info", "x.arc"])
    assert f"raw_file_size: {sum(map(len, given.values()))}" in capfd.readouterr().out
    main(["list", "x.arc", "--private-key", "two"])
    out = capfd.readouterr().out
    assert "in/a/b0/up -> in/top" in out and "in/a/none" in out and "top.meta" not in out
    main(["data", "x.arc", "--private-key", "two", "--path", "in/a/b0/c/d/e"])
    assert capfd.readouterr().out == "deep"
    main(["extract", "x.arc", "--private-key", "two", "-o", "out"])
    made = tmp_path / "out/in"
    assert {str(p.relative_to(made)): p.read_bytes() for p in made.rglob("*") if p.is_file() and not p.is_symlink()} == given
    assert (made / "a/none").is_dir() and os.readlink(made / "a/b0/up") == "../../top" and (made / "a/b0/up").read_bytes() == b"x"
    with pytest.raises(ValueError, match="no key"):
        main(["list", "x.arc", "--private-key", "three"])
    assert not [p for p in os.listdir(tmp_path) if p.endswith(".tmp")]


def test_payloads_go_back_in_pieces(tmp_path, monkeypatch):
    """Files are gathered up to some bytes: neither one batch for each nor all of them at once."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    from stowage.functions import rows

    for n in range(20):
        (tmp_path / f"f{n}").write_bytes(bytes([n]) * 1000)
    monkeypatch.setattr(rows, "HELD", 3000)
    seen = []

    class Frame:
        """Takes the place of a tree: runs the function over one batch in this process."""

        schema, columns = StructType.fromDDL("path string, kind string"), ["path", "kind"]

        def mapInArrow(self, run, schema):
            given = [{"path": f"f{n}", "kind": "file"} for n in range(20)] + [{"path": "d", "kind": "dir"}]
            seen.extend(run(iter([pa.RecordBatch.from_pylist(given)])))

    tree.with_payload(Frame(), str(tmp_path))
    assert [b.num_rows for b in seen] == [3] * 6 + [3]
    got = {r["path"]: r["payload"] for b in seen for r in b.to_pylist()}
    assert got == {f"f{n}": bytes([n]) * 1000 for n in range(20)} | {"d": None}


def test_a_tree_is_packed_and_listed_in_one_worker(spark, sf_dir):
    """Payloads and archives do not pass from one Python worker to another."""
    from stowage.queries import QUERIES

    plan = QUERIES["tree_archive"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and not plan.count("FlatMapGroups")


def test_volumes_listed_where_they_are_packed(spark, tmp_path):
    """Files read as they are packed, cut by the sizes of the scan, give the tables that archives of their payloads give."""
    make(tmp_path, 40)
    entries = tree.tree_entries(tree.scan_tree(spark, str(tmp_path))).withColumn("archive", F.when(F.col("path") != "top", "one"))
    whole = tree.with_payload(entries.where("target IS NULL"), str(tmp_path))
    volumes = arc.pack_volumes(whole, lambda name, rows: fmt.build_archive(arc.entries_of(rows, compress=True)), 16, 4000)

    def build(name, rows):
        return fmt.build_archive(tree.read_payloads(arc.entries_of(rows, compress=True), str(tmp_path)))

    for table in ("files", "dirs", "content", "eof"):
        there = arc.pack_volumes(entries.where("target IS NULL"), build, 16, 4000, F.col("raw_size"), arc.table_of(table), arc.SCHEMAS[table])
        got, want = (sorted(map(str, df.drop("disk_hash_sha256").collect())) for df in (there, arc.archives_from_binary(volumes, table)))
        assert got == want and len(got) > 5


def test_volumes_take_a_row_at_a_time(spark, monkeypatch):
    """A volume's rows are taken from the partition as its entries are asked for, and none of the next one's before it is done."""
    caught, taken, ahead = [], [], []
    monkeypatch.setattr(arc, "map_partition", lambda df, function, schema: caught.append((df.columns, function)))

    def build(name, rows):
        for n, e in enumerate(arc.entries_of(rows)):
            ahead.append((name, n, len(taken)))
        return name.encode()

    arc.pack_volumes(spark.createDataFrame([], "archive string, idx long, path string, payload binary"), build, 4)
    columns, packed = caught[0]
    given = ({"archive": None, "idx": n, "path": f"f{n}", "payload": b"x", "volume": n // 4, "slice": 0} for n in range(10))
    rows = (taken.append(r) or tuple(r[c] for c in columns) for r in given)
    made = list(packed(rows))
    assert [m[0] for m in made] == ["None-0", "None-1", "None-2"] and [m[1:4] for m in made] == [(None, n, 0) for n in range(3)]
    assert ahead == [(f"None-{n // 4}", n % 4, n + 1) for n in range(10)]
