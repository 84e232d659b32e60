"""The archive format: payloads in blocks, then table of contents, key packets and trailer.

Everything here works on bytes and dictionaries; the Spark side is in
:mod:`stowage.sources.archive`.
"""

from __future__ import annotations

import hashlib
import io
import os
from collections.abc import Callable, Iterable
from typing import BinaryIO

from ..functions import borsh
from ..functions.binary import EOF_MAGIC, PACKETS_MAGIC, TOC_MAGIC
from ..functions.codecs import padding_frame, zstd_unpack
from ..functions.crypto import NONCE, TAG, decrypt_block, encrypt_block, open_sealed, seal, seal_for, unseal

BLOCK = 65_536
TRAILER = 73
#: Enough of an archive's end for the footers of most.
TAIL = 128 << 10

INFO = ("struct", [("uid", ("option", "u64")), ("gid", ("option", "u64")), ("mode", ("option", "u32")), ("mtime", ("option", "u64"))])
HASHES = ("struct", [("sha256", ("option", ("fixed", 32))), ("md5", ("option", ("fixed", 16)))])
LINK = ("struct", [("file_path", "string"), ("file_info", ("option", INFO))])
RANGE = ("struct", [("tag", "string"), ("start", "u64"), ("end", "u64")])
FILE = (
    "struct",
    [
        ("file_path", "string"), ("raw_size", "u64"), ("file_start", "u64"), ("file_end", "u64"), ("compressed", "bool"), ("encrypted", "bool"), ("block_scale", "u32"),
        ("index_list", ("option", ("list", "u32"))), ("file_info", ("option", INFO)), ("hashes", ("option", HASHES)), ("metadata", ("option", "string")),
        ("symlinks", ("option", ("list", LINK))), ("custom_ranges", ("option", ("list", RANGE))),
    ],
)
FOLDER = ("struct", [("file_path", "string"), ("file_info", ("option", INFO)), ("symlinks", ("option", ("list", LINK))), ("metadata", ("option", "string"))])
FOLDER_ENTRY = ("enum", [("clear", FOLDER), ("encrypted", "bytes")])
FILE_ENTRY = ("enum", [("clear", FILE), ("encrypted", "bytes")])
TOC = ("struct", [("magic", ("fixed", 4)), ("len", "u32"), ("directories", ("list", FOLDER_ENTRY)), ("files", ("list", FILE_ENTRY))])
PACKET = ("struct", [("pubkey", ("fixed", 32)), ("nonce", ("fixed", NONCE)), ("keys", "bytes"), ("mac", ("fixed", TAG))])
PACKETS = ("struct", [("magic", ("fixed", 4)), ("len", "u32"), ("packets", ("list", PACKET))])
LAST_USE = ("enum", [("file", "u64"), ("dir", "u64")])
KEYS = ("list", ("struct", [("key", ("fixed", 32)), ("last", LAST_USE)]))
EOF = ("struct", [("magic", ("fixed", 4)), ("len", "u32"), ("version", "u8"), ("raw_file_size", "u64"), ("disk_file_size", "u64"), ("disk_hash_sha256", ("fixed", 32)), ("toc_len", "u64"), ("encryption_len", "u64")])


def pack_payload(data: bytes, key: bytes | None = None, compress: bool = False, scale: int = 1, level: int = 3, nonces: Callable[[int], bytes] = os.urandom) -> tuple[bytes, list[int] | None]:
    """A payload's bytes on disk, and the raw sizes of its blocks if compressed.

    Compressed blocks take as much raw data as fits, and are padded to the
    block size but for the last, so block n begins where arithmetic says.
    """
    size, blocks, index = BLOCK * scale, [], None
    if compress:
        import zstandard

        press, index, at, guess = zstandard.ZstdCompressor(level=level), [], 0, size - size // 128 - 512
        while at < len(data):
            part = data[at : at + guess]
            out = press.compress(part)
            while len(out) > size or size >= len(out) > size - 8 and at + len(part) < len(data):
                part = part[: max(1, len(part) * (size - 1024) // max(len(out), size))]
                out = press.compress(part)
            index.append(len(part))
            at += len(part)
            guess = max(size - size // 128 - 512, min(64 * size, len(part) * size * 15 // (16 * max(1, len(out)))))
            blocks.append(out if at >= len(data) or len(out) == size else out + padding_frame(size - len(out)))
    else:
        blocks = [data[k : k + size] for k in range(0, len(data), size)]
    if key is not None:
        blocks = [encrypt_block(key, b, nonces=nonces) for b in blocks]
    return b"".join(blocks), index


def unpack_payload(data: bytes, keys: list[bytes], compressed: bool, encrypted: bool, scale: int = 1) -> bytes:
    """The raw payload of whole blocks; ValueError if no key fits a block."""
    if encrypted:
        size, out = BLOCK * scale + NONCE + TAG, []
        for k in range(0, len(data), size):
            plain = next((x for key in keys if (x := decrypt_block(key, data[k : k + size])) is not None), None)
            if plain is None:
                raise ValueError("no key opens a block")
            out.append(plain)
        data = b"".join(out)
    return zstd_unpack(data) if compressed else data


def plan_range(header: dict, first: int, last: int) -> tuple[int, int, int, int]:
    """Bytes on disk to read (from, to), relative to the file, and raw bytes to discard and keep."""
    first, last = min(first, header["raw_size"]), min(last, header["raw_size"])
    size = BLOCK * header["block_scale"]
    unit = size + (NONCE + TAG if header["encrypted"] else 0)
    total = header["file_end"] - header["file_start"]
    if first >= last:
        return 0, 0, 0, 0
    if not header["compressed"]:
        low, high, before = first // size, -(-last // size), first // size * size
    else:
        sizes, end, low, high, before = header["index_list"] or [header["raw_size"]], 0, None, 0, 0
        for n, s in enumerate(sizes):
            if low is None and end + s > first:
                low, before = n, end
            end += s
            if end >= last:
                high = n + 1
                break
    return low * unit, min(high * unit, total) if header["index_list"] or not header["compressed"] else total, first - before, last - first


def seal_entry(kind, entry: tuple, key: bytes | None, nonces: Callable[[int], bytes] = os.urandom) -> tuple:
    """A table-of-contents entry under its key; without one it stays readable."""
    if key is None:
        return entry
    nonce = nonces(NONCE)
    return ("encrypted", nonce + seal(key, nonce, borsh.encode(kind, entry)))


def open_entry(kind, entry: tuple, keys: list[bytes]) -> tuple | None:
    """The readable entry, or None if no key opens it."""
    if entry[0] == "clear":
        return entry
    for key in keys:
        plain = unseal(key, entry[1][:NONCE], entry[1][NONCE:])
        if plain is not None:
            return borsh.decode(kind, plain)[0]
    return None


def make_packet(reader_public: bytes, keys: list[tuple[bytes, str, int]], writer_private: bytes | None = None, nonces: Callable[[int], bytes] = os.urandom) -> dict:
    """The packet of one reader: its keys with their kind and last use."""
    payload = borsh.encode(KEYS, [{"key": k, "last": (kind, n)} for k, kind, n in keys])
    public, nonce, data = seal_for(reader_public, payload, writer_private, nonces)
    return {"pubkey": public, "nonce": nonce, "keys": data[:-TAG], "mac": data[-TAG:]}


def open_packet(packet: dict, reader_private: bytes) -> list[tuple[bytes, str, int]] | None:
    """The keys of a packet, or None if it is another reader's."""
    plain = open_sealed(reader_private, packet["pubkey"], packet["nonce"], packet["keys"] + packet["mac"])
    return None if plain is None else [(x["key"], *x["last"]) for x in borsh.decode(KEYS, plain)[0]]


def packet_size(packet: dict) -> int:
    return 32 + NONCE + len(packet["keys"]) + TAG


def make_footer(directories: list[tuple], files: list[tuple], packets: list[dict], raw_size: int, data_size: int, digest) -> bytes:
    """Table of contents, packets and trailer. ``digest``: a SHA-256 over the data before it, which is continued.

    The trailer's hash covers all bytes before it and the trailer itself with
    its hash field zero.
    """
    toc = borsh.encode(TOC, {"magic": TOC_MAGIC, "len": 0, "directories": directories, "files": files})
    toc = toc[:4] + (len(toc) - 8).to_bytes(4, "little") + toc[8:]
    return finish(toc, packets, raw_size, data_size, digest)


def finish(toc: bytes, packets: list[dict], raw_size: int, data_size: int, digest) -> bytes:
    sealed = borsh.encode(PACKETS, {"magic": PACKETS_MAGIC, "len": sum(map(packet_size, packets)), "packets": packets}) if packets else b""
    eof = {"magic": EOF_MAGIC, "len": TRAILER, "version": 1, "raw_file_size": raw_size, "disk_file_size": data_size + len(toc) + len(sealed) + TRAILER, "disk_hash_sha256": bytes(32), "toc_len": len(toc), "encryption_len": len(sealed)}
    digest.update(toc + sealed + borsh.encode(EOF, eof))
    return toc + sealed + borsh.encode(EOF, eof | {"disk_hash_sha256": digest.digest()})


def read_trailer(end: bytes) -> dict:
    """The trailer at the end of these bytes; ValueError if there is none."""
    if len(end) < TRAILER or end[-TRAILER:][:4] != EOF_MAGIC:
        raise ValueError("no trailer")
    eof = borsh.decode(EOF, end[-TRAILER:])[0]
    if eof["version"] != 1 or eof["len"] != TRAILER:
        raise ValueError("a trailer of another version")
    return eof


def footer_size(eof: dict) -> int:
    return eof["toc_len"] + eof["encryption_len"] + TRAILER


def read_footer(tail: bytes, private_keys: list[bytes] = (), data_keys: list[bytes] = ()) -> dict:
    """The footer in the last bytes of an archive: eof, packets, keys, directories, files (None: not readable), raw toc.

    An archive with encrypted entries of which the keys open none is an
    error; entries that other keys open are None.
    """
    eof = read_trailer(tail)
    if footer_size(eof) > len(tail):
        raise ValueError(f"the footer needs {footer_size(eof)} bytes")
    start = len(tail) - footer_size(eof)
    raw = tail[start : start + eof["toc_len"]]
    packets = borsh.decode(PACKETS, tail, start + eof["toc_len"])[0]["packets"] if eof["encryption_len"] else []
    toc = borsh.decode(TOC, raw)[0]
    keys = [(k, "both", 1 << 62) for k in data_keys]
    for packet in packets:
        for private in private_keys:
            keys += open_packet(packet, private) or []
    usable = lambda kind, n: [k for k, what, last in keys if what in (kind, "both") and n <= last]
    folders = [open_entry(FOLDER_ENTRY, e, usable("dir", n)) for n, e in enumerate(toc["directories"])]
    files = [open_entry(FILE_ENTRY, e, usable("file", n)) for n, e in enumerate(toc["files"])]
    if any(e is None for e in folders + files) and not keys:
        raise ValueError("no key opens this archive's entries")
    clear = lambda x: None if x is None else x[1]
    return {"eof": eof, "packets": packets, "keys": keys, "directories": list(map(clear, folders)), "files": list(map(clear, files)), "toc": raw}


def locate_footer(data: bytes, start: int = 0) -> tuple[int, int, dict]:
    """The last footer in passing bytes from ``start`` on, whatever follows it: where it begins and ends, and its trailer; ValueError if there is none.

    A trailer counts when the table of contents is where it says, and when
    its hash fits if the whole archive is there.
    """
    at = len(data)
    while (at := data.rfind(EOF_MAGIC, start, at + len(EOF_MAGIC) - 1 if at < len(data) else at)) >= 0:
        end = at + TRAILER
        try:
            eof = read_trailer(data[at:end])
        except ValueError:
            continue
        first = end - footer_size(eof)
        if first < start or data[first : first + len(TOC_MAGIC)] != TOC_MAGIC:
            continue
        whole = end - eof["disk_file_size"]
        if whole < start or check_hash(data[whole:end]):
            return first, end, eof
    raise ValueError("no trailer")


def build_archive(entries: Iterable[dict], readers: list[bytes] = (), writer_private: bytes | None = None, nonces: Callable[[int], bytes] = os.urandom) -> bytes:
    """A whole archive of entries in order, as bytes."""
    out = io.BytesIO()
    write_archive(out, entries, readers, writer_private, nonces)
    return out.getvalue()


def write_archive(out: BinaryIO, entries: Iterable[dict], readers: list[bytes] = (), writer_private: bytes | None = None, nonces: Callable[[int], bytes] = os.urandom) -> None:
    """Write an archive of entries in order, holding one payload at a time.

    An entry: kind (file, dir, symlink), path, and for files payload,
    compress, scale, data_key, meta_key, info, metadata, ranges, expected
    digests; for symlinks target. Links whose target is missing are an error.
    """
    files, folders, links = [], [], []
    at = raw = 0
    digest = hashlib.sha256()
    uses: dict[tuple[bytes, str], int] = {}
    for e in entries:
        if e["kind"] == "file":
            data = e["payload"]
            seen = {"sha256": hashlib.sha256(data).digest(), "md5": hashlib.md5(data).digest()}
            for name, want in (e.get("expected") or {}).items():
                if want is not None and want != seen[name]:
                    raise ValueError(f"the {name} of {e['path']} differs")
            disk, index = pack_payload(data, e.get("data_key"), e.get("compress", False), e.get("scale", 1), nonces=nonces)
            digest.update(disk)
            out.write(disk)
            header = {"file_path": e["path"], "raw_size": len(data), "file_start": at, "file_end": at + len(disk), "compressed": e.get("compress", False), "encrypted": e.get("data_key") is not None, "block_scale": e.get("scale", 1), "index_list": index, "file_info": e.get("info"), "hashes": seen, "metadata": e.get("metadata"), "symlinks": None, "custom_ranges": e.get("ranges")}
            at, raw = at + len(disk), raw + len(data)
            for key in (e.get("data_key"), e.get("meta_key")):
                if key is not None:
                    uses[key, "file"] = len(files)
            files.append((header, e.get("meta_key")))
        elif e["kind"] == "dir":
            if e.get("meta_key") is not None:
                uses[e["meta_key"], "dir"] = len(folders)
            folders.append(({"file_path": e["path"], "file_info": e.get("info"), "symlinks": None, "metadata": e.get("metadata")}, e.get("meta_key")))
        else:
            links.append(e)
    known = {h["file_path"]: h for h, _ in folders + files}
    for e in links:
        if e["target"] not in known:
            raise ValueError(f"the target of {e['path']} is missing")
        owner = known[e["target"]]
        owner["symlinks"] = (owner["symlinks"] or []) + [{"file_path": e["path"], "file_info": e.get("info")}]
    keys = [(k, kind, n) for (k, kind), n in uses.items()]
    packets = [make_packet(r, keys, writer_private, nonces) for r in readers] if keys else []
    out.write(make_footer([seal_entry(FOLDER_ENTRY, ("clear", h), k, nonces) for h, k in folders], [seal_entry(FILE_ENTRY, ("clear", h), k, nonces) for h, k in files], packets, raw, at, digest))


def add_readers(archive: bytes, readers: list[bytes], private_keys: list[bytes], writer_private: bytes | None = None, nonces: Callable[[int], bytes] = os.urandom) -> bytes:
    """The archive with packets for further readers; payloads and entries keep their bytes."""
    footer = read_footer(archive, private_keys)
    if not footer["keys"]:
        raise ValueError("no packet opens with these keys")
    data = archive[: len(archive) - footer_size(footer["eof"])]
    packets = footer["packets"] + [make_packet(r, footer["keys"], writer_private, nonces) for r in readers]
    return data + finish(footer["toc"], packets, footer["eof"]["raw_file_size"], len(data), hashlib.sha256(data))


def new_key() -> bytes:
    """A random key of an archive."""
    return os.urandom(32)


def check_hash(archive: bytes) -> bool:
    """Whether the trailer's hash fits."""
    eof = read_trailer(archive)
    blank = borsh.encode(EOF, eof | {"disk_hash_sha256": bytes(32)})
    return hashlib.sha256(archive[:-TRAILER] + blank).digest() == eof["disk_hash_sha256"]
