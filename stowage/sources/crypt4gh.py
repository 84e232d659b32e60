"""Key files and Crypt4GH headers (public GA4GH specification, version 1)."""

from __future__ import annotations

import base64
import os
import struct

from ..functions.crypto import NONCE, scrypt_key, seal, session_keys, unseal, x25519

#: Fixed values of the specification and of X25519 keys in PKCS#8.
MAGIC, VERSION = b"crypt4gh", 1
KEY_MAGIC = b"c4gh-v1"
PKCS8 = bytes.fromhex("302e020100300506032b656e04220420")
SPKI = bytes.fromhex("302a300506032b656e032100")


def _pem(kind: str, data: bytes) -> str:
    return f"-----BEGIN {kind}-----\n{base64.b64encode(data).decode()}\n-----END {kind}-----\n"


def _body(text: str) -> bytes:
    lines = [x.strip() for x in text.strip().splitlines()]
    if len(lines) < 3 or not lines[0].startswith("-----BEGIN") or not lines[-1].startswith("-----END"):
        raise ValueError("not a key file")
    return base64.b64decode("".join(lines[1:-1]), validate=True)


def write_pem(private: bytes) -> str:
    return _pem("PRIVATE KEY", PKCS8 + private)


def new_key_pair(raw: bool = False) -> tuple[str, str] | tuple[bytes, bytes]:
    """A random X25519 key pair, private and public: PEM texts, or 32 bytes each."""
    private = os.urandom(32)
    public = x25519(private)
    return (private, public) if raw else (write_pem(private), _pem("PUBLIC KEY", SPKI + public))


def read_pem(text: str) -> bytes:
    """The 32 bytes of an X25519 key, private or public."""
    data = _body(text)
    if len(data) < 32:
        raise ValueError("the key is too short")
    return data[-32:]


def _field(data: bytes) -> bytes:
    return struct.pack(">H", len(data)) + data


def write_key(private: bytes, phrase: bytes = b"", salt: bytes | None = None) -> str:
    if not phrase:
        return _pem("CRYPT4GH PRIVATE KEY", KEY_MAGIC + _field(b"none") + _field(b"none") + _field(private))
    salt = salt or os.urandom(16)
    nonce = os.urandom(NONCE)
    blob = nonce + seal(scrypt_key(phrase, salt), nonce, private)
    return _pem("CRYPT4GH PRIVATE KEY", KEY_MAGIC + _field(b"scrypt") + _field(bytes(4) + salt) + _field(b"chacha20_poly1305") + _field(blob))


def read_key(text: str, phrase: bytes = b"") -> bytes:
    """The private key of a key file; ValueError for a wrong phrase."""
    data = _body(text)
    if not data.startswith(KEY_MAGIC):
        raise ValueError("not a Crypt4GH key")
    at, fields = len(KEY_MAGIC), []

    def field() -> bytes:
        nonlocal at
        (n,) = struct.unpack_from(">H", data, at)
        at += 2 + n
        return data[at - n : at]

    kdf = field()
    if kdf != b"none":
        fields.append(field())
    cipher, blob = field(), field()
    if kdf == b"none":
        return blob
    if kdf != b"scrypt" or cipher != b"chacha20_poly1305":
        raise ValueError("an unknown way of locking")
    out = unseal(scrypt_key(phrase, fields[0][4:]), blob[:NONCE], blob[NONCE:])
    if out is None:
        raise ValueError("the phrase does not open the key")
    return out


def write_header(data_key: bytes, readers: list[bytes], writer_private: bytes, edits: list[int] | None = None) -> bytes:
    """A header with a packet for each reader, and one more each for an edit list."""
    public = x25519(writer_private)
    bodies = [struct.pack("<II", 0, 0) + data_key]
    if edits is not None:
        bodies.append(struct.pack("<II", 1, len(edits)) + struct.pack(f"<{len(edits)}Q", *edits))
    packets = []
    for reader in readers:
        _, key = session_keys(writer_private, public, reader, client=False)
        for body in bodies:
            nonce = os.urandom(NONCE)
            sealed = struct.pack("<I", 0) + public + nonce + seal(key, nonce, body)
            packets.append(struct.pack("<I", len(sealed) + 4) + sealed)
    return MAGIC + struct.pack("<II", VERSION, len(packets)) + b"".join(packets)


def read_header(data: bytes) -> tuple[int, list[bytes], int]:
    """Version, sealed packets, and where the data begins."""
    if data[:8] != MAGIC:
        raise ValueError("not a Crypt4GH header")
    version, n = struct.unpack_from("<II", data, 8)
    if version != VERSION:
        raise ValueError(f"a header of version {version}")
    packets, at = [], 16
    for _ in range(n):
        (size,) = struct.unpack_from("<I", data, at)
        if size < 4 or at + size > len(data):
            raise ValueError("the header is cut short")
        packets.append(data[at + 4 : at + size])
        at += size
    return version, packets, at


def open_packets(data: bytes, private: bytes) -> tuple[list[bytes], list[int] | None]:
    """The data keys in the packets that a private key opens, and the edit list if there is one."""
    out, edits, public = [], None, x25519(private)
    for packet in read_header(data)[1]:
        writer, nonce, body = packet[4:36], packet[36 : 36 + NONCE], packet[36 + NONCE :]
        key, _ = session_keys(private, public, writer, client=True)
        plain = unseal(key, nonce, body)
        if plain is None:
            continue
        (kind,) = struct.unpack_from("<I", plain)
        if kind == 0:
            out.append(plain[8:])
        elif kind == 1:
            if edits is not None:
                raise ValueError("more than one edit list")
            edits = list(struct.unpack_from(f"<{struct.unpack_from('<I', plain, 4)[0]}Q", plain, 8))
        else:
            raise ValueError(f"a packet of unknown kind {kind}")
    return out, edits


def open_header(data: bytes, private: bytes) -> list[bytes]:
    """The data keys in the packets that a private key opens."""
    return open_packets(data, private)[0]
