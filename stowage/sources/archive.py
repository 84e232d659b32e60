"""Archives as Spark tables and sinks.

``ArchiveSource`` is a Python data source over files that executors can open
and seek (a mounted or shared path). The driver sees names and sizes of
archives only: content is planned as equal stretches of each archive, and a
task reads the end of its archive and the runs of blocks that begin in its
stretch, pruned by the options. Options: ``path`` (a file or a folder of
``*.arc``), ``table`` (eof, files, dirs, content), ``private_keys`` and
``data_keys`` (hex, comma-separated), ``file`` (one path inside), ``first`` and
``last`` (a raw byte range), ``blocks`` (disk blocks of a stretch and, at most,
of a row of content). The sink takes rows with ``path`` and ``payload`` and, if
there, the other columns of an entry (:data:`ENTRY_COLUMNS`).

``archives_from_binary`` parses archives that any Spark file system holds.
"""

from __future__ import annotations

import glob
import hashlib
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.rows import map_partition, map_rows
from . import archive_format as fmt

SCHEMAS = {
    "eof": "archive string, version int, raw_file_size long, disk_file_size long, disk_hash_sha256 string, toc_len long, encryption_len long, n_packets int",
    "files": "archive string, idx long, readable boolean, path string, raw_size long, file_start long, file_end long, compressed boolean, encrypted boolean, block_scale long, index_list array<long>, sha256 string, md5 string, metadata string, uid long, gid long, mode long, mtime long, symlinks array<string>",
    "dirs": "archive string, idx long, readable boolean, path string, metadata string, symlinks array<string>",
    "content": "archive string, idx long, path string, raw_offset long, bytes binary",
}

#: Rows of volumes, and of what :func:`extraction` yields.
VOLUMES = "archive string, source string, volume long, slice long, content binary"
EXTRACTED = "n_files long"


def _hex(b: bytes | None) -> str | None:
    return None if b is None else b.hex()


def file_row(archive: str, idx: int, h: dict | None) -> tuple:
    if h is None:
        return (archive, idx, False, *[None] * 16)
    info, hashes = h["file_info"] or {}, h["hashes"] or {}
    return (archive, idx, True, h["file_path"], h["raw_size"], h["file_start"], h["file_end"], h["compressed"], h["encrypted"], h["block_scale"], h["index_list"], _hex(hashes.get("sha256")), _hex(hashes.get("md5")), h["metadata"], info.get("uid"), info.get("gid"), info.get("mode"), info.get("mtime"), [s["file_path"] for s in h["symlinks"] or []])


def dir_row(archive: str, idx: int, h: dict | None) -> tuple:
    return (archive, idx, False, None, None, None) if h is None else (archive, idx, True, h["file_path"], h["metadata"], [s["file_path"] for s in h["symlinks"] or []])


def eof_row(archive: str, footer: dict) -> tuple:
    e = footer["eof"]
    return (archive, e["version"], e["raw_file_size"], e["disk_file_size"], e["disk_hash_sha256"].hex(), e["toc_len"], e["encryption_len"], len(footer["packets"]))


def tail_footer(path: str, private: list[bytes], data: list[bytes]) -> dict:
    """The footer of an archive file: one read of its end, another if the footer is longer."""
    with open(path, "rb") as f:
        size = f.seek(0, 2)
        f.seek(max(0, size - fmt.TAIL))
        tail = f.read()
        need = fmt.footer_size(fmt.read_trailer(tail))
        if need > len(tail):
            f.seek(size - need)
            tail = f.read()
    return fmt.read_footer(tail, private, data)


@dataclass
class Part(InputPartition):
    path: str
    low: int = 0
    high: int = 1 << 62


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.table = options.get("table", "files")
        keys = lambda name: [bytes.fromhex(x) for x in options.get(name, "").split(",") if x]
        self.private, self.data = keys("private_keys"), keys("data_keys")

    def _paths(self) -> list[str]:
        path = self.options["path"].removeprefix("file://")
        return sorted(glob.glob(f"{path}/*.arc")) if os.path.isdir(path) else [path]

    def partitions(self) -> list[InputPartition]:
        if self.table != "content":
            return [Part(p) for p in self._paths()]
        step = int(self.options.get("blocks", 1024)) * fmt.BLOCK
        return [Part(p, at, at + step) for p in self._paths() for at in range(0, max(1, os.path.getsize(p)), step)]

    def _runs(self, h: dict) -> Iterator[tuple[int, int]]:
        """The raw ranges of a file's runs of blocks, as far as they are asked for."""
        first, last = int(self.options.get("first", 0)), int(self.options.get("last", 1 << 62))
        step, size, at = int(self.options.get("blocks", 1024)), fmt.BLOCK * h["block_scale"], 0
        raw = h["index_list"] if h["compressed"] else [min(size, h["raw_size"] - k) for k in range(0, h["raw_size"], size)]
        raw = raw or [h["raw_size"]]
        for k in range(0, len(raw), step):
            end = at + sum(raw[k : k + step])
            if max(first, at) < min(last, end):
                yield max(first, at), min(last, end)
            at = end

    def read(self, partition: Part) -> Iterator[tuple]:
        name = os.path.basename(partition.path)
        footer = tail_footer(partition.path, self.private, self.data)
        if self.table == "eof":
            yield eof_row(name, footer)
        elif self.table == "files":
            yield from (file_row(name, n, h) for n, h in enumerate(footer["files"]))
        elif self.table == "dirs":
            yield from (dir_row(name, n, h) for n, h in enumerate(footer["directories"]))
        else:
            yield from self._content(partition, name, footer)

    def _content(self, part: Part, name: str, footer: dict) -> Iterator[tuple]:
        keys = self.data + [k for k, _, _ in footer["keys"]]
        with open(part.path, "rb") as f:
            for idx, h in enumerate(footer["files"]):
                if h is None or h["file_start"] >= part.high or h["file_end"] <= part.low or self.options.get("file", h["file_path"]) != h["file_path"]:
                    continue
                for low, high in self._runs(h):
                    d0, d1, skip, keep = fmt.plan_range(h, low, high)
                    if part.low <= h["file_start"] + d0 < part.high:
                        f.seek(h["file_start"] + d0)
                        raw = fmt.unpack_payload(f.read(d1 - d0), keys, h["compressed"], h["encrypted"], h["block_scale"])
                        yield (name, idx, h["file_path"], low, raw[skip : skip + keep])


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class ArchiveWriter(DataSourceWriter):
    """One archive per task, put in place when all tasks have succeeded."""

    def __init__(self, options: dict[str, str], names: list[str]):
        self.options, self.names = options, names
        self.folder = options["path"].removeprefix("file://")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        key = bytes.fromhex(self.options["data_key"]) if self.options.get("data_key") else None
        compress = self.options.get("compress", "false") == "true"
        entries = (entry_of(dict(zip(self.names, r, strict=True)), key, key, compress) for r in rows)
        os.makedirs(self.folder, exist_ok=True)
        final = os.path.join(self.folder, f"part-{TaskContext.get().partitionId():05d}.arc")
        temporary = f"{final}.{uuid.uuid4().hex}.tmp"
        readers = [bytes.fromhex(x) for x in self.options.get("readers", "").split(",") if x]
        with open(temporary, "wb") as f:
            fmt.write_archive(f, entries, readers)
        return Written(temporary, final)

    def commit(self, messages: list) -> None:
        for m in messages:
            if m is not None:
                os.replace(m.temporary, m.final)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.temporary):
                os.remove(m.temporary)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stowage_archive"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "files")]

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ArchiveWriter(dict(self.options), schema.fieldNames())


def footer_of(content, private: list[bytes], data: list[bytes]) -> dict:
    """The footer of an archive held in memory; only its own bytes are copied."""
    need = fmt.footer_size(fmt.read_trailer(bytes(content[-fmt.TRAILER :])))
    return fmt.read_footer(bytes(content[-need:]), private, data)


def payload_of(content, h: dict, keys: list[bytes]) -> bytes:
    """The raw payload of one file of an archive held in memory."""
    return fmt.unpack_payload(bytes(content[h["file_start"] : h["file_end"]]), keys, h["compressed"], h["encrypted"], h["block_scale"])


def table_of(table: str = "files", private_keys: list[bytes] = (), data_keys: list[bytes] = ()) -> Callable[..., Iterator[tuple]]:
    """A function that yields the rows of a table, under ``SCHEMAS[table]``, of an archive's name and its bytes or a view on them."""
    private, known = list(private_keys), list(data_keys)

    def parsed(name: str, content) -> Iterator[tuple]:
        footer = footer_of(content, private, known)
        if table == "eof":
            yield eof_row(name, footer)
        elif table == "dirs":
            yield from (dir_row(name, n, h) for n, h in enumerate(footer["directories"]))
        elif table == "files":
            yield from (file_row(name, n, h) for n, h in enumerate(footer["files"]))
        else:
            keys = known + [k for k, _, _ in footer["keys"]]
            yield from ((name, n, h["file_path"], 0, payload_of(content, h, keys)) for n, h in enumerate(footer["files"]) if h)

    return parsed


def archives_from_binary(archives: DataFrame, table: str = "files", private_keys: list[bytes] = (), data_keys: list[bytes] = ()) -> DataFrame:
    """A table of archives given as rows (archive string, content binary)."""
    return map_rows(archives.select("archive", "content"), table_of(table, private_keys, data_keys), SCHEMAS[table], views=True)


def extraction(folder: str, private_keys: list[bytes] = (), data_keys: list[bytes] = ()) -> Callable[..., Iterator[tuple]]:
    """A function that writes the files of an archive, given by name and bytes or a view on them, below ``folder`` and yields their number; see :func:`extract_archives`."""
    private, data = list(private_keys), list(data_keys)

    def put(name: str, content) -> Iterator[tuple]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        made: set[str] = set()

        def make(at: str) -> None:
            if at not in made:
                store.create_dir(at, recursive=True)
                made.add(at)

        footer, n = footer_of(content, private, data), 0
        keys = data + [k for k, _, _ in footer["keys"]]
        for h in footer["directories"]:
            if h is not None:
                make(f"{top}/{inside(h['file_path'])}")
        for h in footer["files"]:
            if h is None:
                continue
            target = f"{top}/{inside(h['file_path'])}"
            make(target.rpartition("/")[0])
            temporary = f"{target}.{uuid.uuid4().hex}.tmp"
            with store.open_output_stream(temporary) as f:
                f.write(payload_of(content, h, keys))
            store.move(temporary, target)
            n += 1
        yield (n,)

    return put


def extract_archives(archives: DataFrame | Callable[..., DataFrame], folder: str, private_keys: list[bytes] = (), data_keys: list[bytes] = ()) -> None:
    """Write the files of archives, given as rows (archive string, content binary), below ``folder``.

    ``folder`` is a path or URI that all executors reach. Folders of the table
    of contents are made too, empty ones included; a file takes its name when
    its bytes are complete, so a task that runs again leaves the same tree.
    Entries that no key opens are left out. Paths that lead out of ``folder``
    are an error. A function in the place of ``archives`` is given ``then``
    and ``schema`` for :func:`pack_volumes`, which extracts each archive in
    the worker that packed it.
    """
    put = extraction(folder, private_keys, data_keys)
    done = archives(then=put, schema=EXTRACTED) if callable(archives) else map_rows(archives.select("archive", "content"), put, EXTRACTED, views=True)
    done.write.format("noop").mode("overwrite").save()


def inside(path: str) -> str:
    """The path without leading slashes; an error if it leads out of the folder it is put in."""
    out = path.strip("/")
    if not out or ".." in out.split("/"):
        raise ValueError(f"no path to extract to: {path}")
    return out


def pack_volumes(files: DataFrame, build, per_volume: int = 256, max_bytes: int = 256 << 20, size: Column | None = None, then: Callable[..., Iterator[tuple]] | None = None, schema: str = VOLUMES) -> DataFrame:
    """Build archives from rows with archive, idx, path, payload and any columns of an entry.

    A volume holds the files of ``per_volume`` consecutive indexes. One of
    more than ``max_bytes`` is cut into slices of files that begin within the
    same stretch of that length, so a slice is longer by its last file at
    most, and no group grows with the data. ``build`` makes the bytes of an
    archive of the rows of one slice, which :func:`entries_of` reads in order
    and one at a time, so a worker holds a batch, a payload and the archive.
    ``size``: the bytes of a row's payload, where ``build`` brings it itself.
    ``then`` takes the name and the bytes of each archive in the same worker,
    and yields rows under ``schema``; without it the archives are the rows.
    Cutting takes one shuffle and one sort.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    length = F.octet_length("payload").cast("long") if size is None else size
    before = Window.partitionBy("archive", "volume").orderBy("idx", "path").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.sum(length).over(before), F.lit(0))
    cut = files.withColumn("volume", F.floor(F.col("idx") / per_volume).cast("long")).withColumn("slice", F.floor(begins / max_bytes).cast("long"))
    cut = cut.sortWithinPartitions("archive", "volume", "idx", "path")
    names = cut.columns
    key = itemgetter(*(names.index(c) for c in ("archive", "volume", "slice")))

    def packed(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (source, volume, part), own in groupby(rows, key):
            name = f"{source}-{volume}" + (f"-{part}" if part else "")
            content = build(name, Rows(names, own))
            if then is None:
                yield name, source, volume, part, content
            else:
                yield from then(name, content)
            del content

    return map_partition(cut, packed, schema)


@dataclass
class Rows:
    """Rows of one group, in order, as they come: to be read once."""

    columns: list[str]
    values: Iterator[tuple]


#: Columns of an entry beside path and payload; each may be missing or null.
ENTRY_COLUMNS = ("kind", "target", "uid", "gid", "mode", "mtime", "metadata", "data_key", "meta_key")


def entry_of(row: dict, data_key: bytes | None = None, meta_key: bytes | None = None, compress: bool = False) -> dict:
    """The entry of a row; keys of the row go before those given for all."""
    row = {k: v for k, v in row.items() if v is not None and v is not pd.NA and v == v}
    info = {k: int(row[k]) if k in row else None for k in ("uid", "gid", "mode", "mtime")}
    keys = {k: bytes(row[k]) if k in row else default for k, default in (("data_key", data_key), ("meta_key", meta_key))}
    out = {"kind": row.get("kind", "file"), "path": row["path"], "info": info if any(x is not None for x in info.values()) else None, "metadata": row.get("metadata"), "compress": compress, **keys}
    return out | ({"target": row["target"]} if out["kind"] == "symlink" else {"payload": bytes(row.get("payload", b""))})


def entries_of(rows: Rows | pd.DataFrame, data_key=None, meta_key=None, compress: bool = False) -> Iterator[dict]:
    """The entries of rows or of a data frame, one at a time."""
    at = [(n, c) for n, c in enumerate(rows.columns) if c in ("path", "payload", *ENTRY_COLUMNS)]
    for r in rows.values if isinstance(rows, Rows) else rows.itertuples(index=False, name=None):
        yield entry_of({c: r[n] for n, c in at}, data_key, meta_key, compress)


def key_of(label: str) -> bytes:
    """A key derived from a label, for tests and reproducible queries only."""
    return hashlib.sha256(label.encode()).digest()
