"""Command line for single archives: ``python -m stowage COMMAND``.

create, info, list, data, extract, create-keypair and add-reader work on one
archive with one payload in memory at a time; sets of archives go through the
``stowage_archive`` data source.
"""

from __future__ import annotations

import argparse
import os
import sys
import uuid
from collections.abc import Iterator

from .functions.crypto import x25519
from .sources import archive as arc
from .sources import archive_format as fmt
from .sources import crypt4gh
from .sources.tree import entry_row


def key_file(path: str) -> bytes:
    """A key from a file: PEM, Crypt4GH without a phrase, 64 hexadecimal digits, or 32 bytes."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) == 32:
        return data
    text = data.decode().strip()
    if "CRYPT4GH PRIVATE" in text:
        return crypt4gh.read_key(text)
    return crypt4gh.read_pem(text) if text.startswith("-----") else bytes.fromhex(text)


def walk(paths: list[str]) -> Iterator[tuple[str, str]]:
    """Root and relative path of the inputs and all that lies below them, in order."""
    for given in paths:
        root, name = os.path.split(os.path.abspath(given))
        yield root, name
        if os.path.isdir(given) and not os.path.islink(given):
            for folder, folders, names in os.walk(given):
                folders.sort()
                for x in sorted(folders + names):
                    yield root, os.path.relpath(os.path.join(os.path.abspath(folder), x), root)


def entries(args: argparse.Namespace, key: bytes | None) -> Iterator[dict]:
    for root, path in walk(args.files):
        full = os.path.join(root, path)
        names = ("path", "kind", "raw_size", "uid", "gid", "mode", "mtime", "target")
        row = dict(zip(names, entry_row(root, path), strict=True))
        if row["kind"] == "other" or args.metadata and path.endswith(".meta"):
            continue
        if row["kind"] == "symlink":
            row["target"] = os.path.normpath(os.path.join(os.path.dirname(path), row["target"]))
        if row["kind"] == "file":
            with open(full, "rb") as f:
                row["payload"] = f.read()
        if args.metadata and os.path.exists(f"{full}.meta"):
            with open(f"{full}.meta", encoding="utf-8") as f:
                row["metadata"] = f.read()
        yield arc.entry_of(row, key, key, args.compress)


def create(args: argparse.Namespace) -> None:
    readers = [key_file(p) for p in args.reader_public_key]
    write(args.output, lambda f: fmt.write_archive(f, entries(args, fmt.new_key() if readers else None), readers))


def write(path: str, put) -> None:
    """Write a file that takes its name when it is complete."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with open(temporary, "wb") as f:
            put(f)
        os.replace(temporary, path)
    finally:
        if os.path.exists(temporary):
            os.remove(temporary)


def private(args: argparse.Namespace) -> list[bytes]:
    return [key_file(p) for p in args.private_key]


def info(args: argparse.Namespace) -> None:
    with open(args.file, "rb") as f:
        f.seek(-fmt.TRAILER, 2)
        eof = fmt.read_trailer(f.read())
    for name, value in eof.items():
        print(f"{name}: {value.hex() if isinstance(value, bytes) else value}")


def listing(args: argparse.Namespace) -> None:
    footer = arc.tail_footer(args.file, private(args), [])
    for kind, rows in (("dir", footer["directories"]), ("file", footer["files"])):
        for n, h in enumerate(rows):
            print(f"{kind} {n:05d} " + ("(encrypted)" if h is None else f"{h.get('raw_size', 0):10d} {h['file_path']}"))
            for link in (h or {}).get("symlinks") or []:
                print(f"link {n:05d} {0:10d} {link['file_path']} -> {h['file_path']}")


def payloads(args: argparse.Namespace) -> Iterator[tuple[dict, bytes]]:
    footer = arc.tail_footer(args.file, private(args), [])
    keys = [k for k, _, _ in footer["keys"]]
    with open(args.file, "rb") as f:
        for h in footer["files"]:
            if h is not None:
                f.seek(h["file_start"])
                yield h, fmt.unpack_payload(f.read(h["file_end"] - h["file_start"]), keys, h["compressed"], h["encrypted"], h["block_scale"])


def data(args: argparse.Namespace) -> None:
    out = sys.stdout.buffer
    for h, raw in payloads(args):
        if args.path in (None, h["file_path"]):
            out.write(raw)
    out.flush()


def extract(args: argparse.Namespace) -> None:
    footer = arc.tail_footer(args.file, private(args), [])
    at = lambda path: os.path.join(args.output, arc.inside(path))
    for h in footer["directories"]:
        if h is not None:
            os.makedirs(at(h["file_path"]), exist_ok=True)
    for h, raw in payloads(args):
        os.makedirs(os.path.dirname(at(h["file_path"])), exist_ok=True)
        write(at(h["file_path"]), lambda f, raw=raw: f.write(raw))
    for h in footer["directories"] + footer["files"]:
        for link in (h or {}).get("symlinks") or []:
            os.makedirs(os.path.dirname(at(link["file_path"])), exist_ok=True)
            if not os.path.lexists(at(link["file_path"])):
                os.symlink(os.path.relpath(at(h["file_path"]), os.path.dirname(at(link["file_path"]))), at(link["file_path"]))


def create_keypair(args: argparse.Namespace) -> None:
    if args.format == "crypt4gh":
        secret, public = crypt4gh.new_key_pair(raw=True)
        pair = (crypt4gh.write_key(secret).encode(), public.hex().encode())
    else:
        pair = crypt4gh.new_key_pair(raw=args.format == "raw")
        pair = pair if args.format == "raw" else tuple(x.encode() for x in pair)
    for name, value, mode in ((args.output, pair[0], 0o600), (f"{args.output}.pub", pair[1], 0o644)):
        with os.fdopen(os.open(name, os.O_WRONLY | os.O_CREAT | os.O_EXCL, mode), "wb") as f:
            f.write(value)


def add_reader(args: argparse.Namespace) -> None:
    with open(args.file, "rb") as f:
        more = fmt.add_readers(f.read(), [key_file(p) for p in args.reader_public_key], private(args))
    write(args.output or args.file, lambda f: f.write(more))


def public_key(args: argparse.Namespace) -> None:
    print(x25519(key_file(args.file)).hex())


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="stowage", description="Archives of many files, compressed and encrypted.")
    commands = top.add_subparsers(required=True)

    def command(name: str, run, about: str, file: bool = True) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=about)
        p.set_defaults(run=run)
        p.add_argument("--private-key", action="append", default=[])
        if file:
            p.add_argument("file")
        return p

    p = command("create", create, "make an archive of files and folders", file=False)
    p.add_argument("files", nargs="+")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--compress", action="store_true")
    p.add_argument("--metadata", action="store_true", help="take the metadata of a file from FILE.meta")
    p.add_argument("--reader-public-key", action="append", default=[])
    command("info", info, "print the trailer")
    command("list", listing, "print the table of contents")
    command("data", data, "write payloads to standard output").add_argument("--path")
    command("extract", extract, "write the files to a folder").add_argument("-o", "--output", required=True)
    p = command("create-keypair", create_keypair, "make a key pair", file=False)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--format", choices=("pem", "crypt4gh", "raw"), default="pem")
    p = command("add-reader", add_reader, "let another key open the archive")
    p.add_argument("--reader-public-key", action="append", required=True)
    p.add_argument("-o", "--output")
    command("public-key", public_key, "print the public key of a private one")
    return top


def main(given: list[str] | None = None) -> None:
    args = parser().parse_args(given)
    args.run(args)


if __name__ == "__main__":
    main()
