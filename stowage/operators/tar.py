"""TAR export and import of volumes."""

from __future__ import annotations

import hashlib
import io
import tarfile
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame

from ..functions.rows import map_rows
from ..sources.archive import Rows, entries_of
from .catalog import DEFAULT_GID, DEFAULT_MODE, DEFAULT_UID


def tar_entry(e: dict) -> tarfile.TarInfo:
    """The header of an entry: kind, path, target and info; what is not given takes the defaults."""
    t, info = tarfile.TarInfo(e["path"].lstrip("/")), e.get("info") or {}
    t.size = len(e.get("payload") or b"")
    for name, default in (("uid", DEFAULT_UID), ("gid", DEFAULT_GID), ("mode", DEFAULT_MODE), ("mtime", 0)):
        value = info.get(name)
        setattr(t, name, default if value is None else value)
    if e["kind"] == "dir":
        t.type = tarfile.DIRTYPE
    elif e["kind"] == "symlink":
        t.type, t.linkname = tarfile.SYMTYPE, e["target"]
    return t


def write_tar(entries: Iterable[dict]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.GNU_FORMAT) as tar:
        for e in entries:
            tar.addfile(tar_entry(e), io.BytesIO(e.get("payload") or b""))
    return out.getvalue()


def tar_volume(name: str, rows: Rows) -> bytes:
    return write_tar(entries_of(rows))


def tar_members(volumes: DataFrame) -> DataFrame:
    """Paths, digests and sizes of the files in TAR volumes (column content), compressed or not."""

    def members(c: bytes) -> Iterator[tuple]:
        with tarfile.open(fileobj=io.BytesIO(c), mode="r:*") as tar:
            yield from ((m.name, hashlib.md5(tar.extractfile(m).read()).hexdigest(), m.size) for m in tar if m.isfile())

    return map_rows(volumes.select("content"), members, "path string, md5 string, raw_size long")


def tar_listing(volumes: DataFrame) -> DataFrame:
    """Path, kind, size, link target, owner and mode of every entry of TAR volumes (column content), compressed or not."""

    def members(c: bytes) -> Iterator[tuple]:
        with tarfile.open(fileobj=io.BytesIO(c), mode="r:*") as tar:
            yield from ((m.name, "dir" if m.isdir() else "symlink" if m.issym() else "file", m.size, m.linkname or None, m.uid, m.gid, m.mode) for m in tar)

    return map_rows(volumes.select("content"), members, "path string, kind string, raw_size long, target string, uid long, gid long, mode long")
