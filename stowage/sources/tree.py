"""Folder trees as tables: what a file system says of every entry, and payloads of files.

Folders are listed in tasks, one level after the other, so the driver holds
neither names nor sizes. The tree must be mounted where executors run, since
owner, mode and link targets come from the file system itself.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..functions.rows import map_rows
from ..plans.scratch import materialise

COLUMNS = ["path", "kind", "raw_size", "uid", "gid", "mode", "mtime", "target"]
SCHEMA = "path string, kind string, raw_size long, uid long, gid long, mode long, mtime long, target string"
#: Entries that a task hands on at once.
BATCH = 4096


def local_path(root: str) -> str:
    """A mounted path without its scheme; an error for stores that only Spark opens."""
    path = root.removeprefix("file:")
    if ":/" in path:
        raise ValueError(f"not a mounted folder: {root}")
    return "/" + path.strip("/")


def entry_row(root: str, path: str) -> tuple:
    """The row of one entry below ``root``; links are not followed."""
    s = os.lstat(os.path.join(root, path))
    kind = "dir" if stat.S_ISDIR(s.st_mode) else "symlink" if stat.S_ISLNK(s.st_mode) else "file" if stat.S_ISREG(s.st_mode) else "other"
    target = os.readlink(os.path.join(root, path)) if kind == "symlink" else None
    return (path, kind, s.st_size if kind == "file" else None, s.st_uid, s.st_gid, stat.S_IMODE(s.st_mode), int(s.st_mtime), target)


def scan_tree(spark: SparkSession, root: str, parallel: int | None = None) -> DataFrame:
    """Every entry below ``root``: path relative to it, kind (file, dir, symlink, other), size of files, owner, mode, modification time in seconds and the target that a link names.

    The folders of a level are dealt over up to ``parallel`` tasks (the shuffle
    partitions of the session, where it is not given) and its rows are
    written to the shared folder; there are as many jobs as levels. Entries
    that go while the scan runs are left out. An empty folder gives no rows,
    a missing one is an error.
    """
    top = local_path(root)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=COLUMNS, dtype=object)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for folder in pdf.path:
                rows = []
                with os.scandir(os.path.join(top, folder)) as entries:
                    for e in entries:
                        try:
                            rows.append(entry_row(top, os.path.join(folder, e.name)))
                        except FileNotFoundError:
                            continue
                        if len(rows) == BATCH:
                            yield frame(rows)
                            rows = []
                yield frame(rows)

    most = parallel or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders, n, out = spark.createDataFrame([("",)], "path string"), 1, None
    while n:
        level = materialise(folders.repartition(min(n, most), "path").mapInPandas(listed, SCHEMA), "tree")
        out = level if out is None else out.unionAll(level)
        folders = level.where("kind = 'dir'").select("path")
        n = folders.count()
    return out


def with_payload(tree: DataFrame, root: str) -> DataFrame:
    """Add ``payload``, the bytes of files below ``root``; null for other entries."""
    top = local_path(root)

    def read(*row) -> Iterator[tuple]:
        one = dict(zip(names, row, strict=True))
        data = None
        if one["kind"] == "file":
            with open(os.path.join(top, one["path"]), "rb") as f:
                data = f.read()
        yield (*row, data)

    names = tree.columns
    return map_rows(tree, read, StructType([*tree.schema.fields, StructField("payload", BinaryType())]))


def read_payloads(entries: Iterable[dict], top: str) -> Iterator[dict]:
    """Entries of a tree with the bytes of files below the mounted folder ``top``, each read when it is asked for."""
    for e in entries:
        if e["kind"] == "file":
            with open(os.path.join(top, e["path"]), "rb") as f:
                e["payload"] = f.read()
        yield e


def tree_entries(tree: DataFrame, archive: str = "archive") -> DataFrame:
    """Entries to pack: a tree with ``archive`` (the first folder of the path) and ``idx`` (counted by path), links beside the entry they name.

    A link is given its target's index, so that both come into one volume;
    targets are taken relative to the link's folder. Links whose target is
    not in the tree are left out: an archive cannot hold them.
    """
    from ..operators.catalog import assign_index

    own = tree.where("kind IN ('file', 'dir')").withColumn(archive, F.substring_index("path", "/", 1))
    own = assign_index(own.withColumn("id", F.xxhash64("path")), archive, "id").drop("id")

    def resolved(path: pd.Series, target: pd.Series) -> pd.Series:
        return pd.Series([None if t.startswith("/") else os.path.normpath(os.path.join(os.path.dirname(p), t)) for p, t in zip(path, target, strict=True)], dtype=object)

    resolved.__annotations__ = {"path": pd.Series, "target": pd.Series, "return": pd.Series}
    links = tree.where("kind = 'symlink'").withColumn("target", F.pandas_udf(resolved, "string")("path", "target"))
    named = own.select(F.col("path").alias("target"), archive, "idx")
    return own.unionByName(links.join(named, "target").select(*own.columns))
