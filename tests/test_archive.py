"""The archive format, codecs and cipher, against published vectors and round trips."""

import hashlib
import os
import random
import tarfile
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stowage.functions import borsh, codecs, crypto
from stowage.operators.tar import write_tar
from stowage.sources import archive_format as fmt
from stowage.sources import crypt4gh

TEXT = b"This is a very very important test"


def test_aead_vector_with_and_without_the_library(monkeypatch):
    key, nonce = bytes(range(0x80, 0xA0)), bytes.fromhex("070000004041424344454647")
    aad = bytes.fromhex("50515253c0c1c2c3c4c5c6c7")
    plain = b"Ladies and Gentlemen of the class of '99: If I could offer you only one tip for the future, sunscreen would be it."
    for library in (crypto._library, lambda: None):
        monkeypatch.setattr(crypto, "_library", library)
        out = crypto.seal(key, nonce, plain, aad)
        assert out[-16:].hex() == "1ae10b594f09e26a7e902ecbd0600691"
        assert crypto.unseal(key, nonce, out, aad) == plain
        assert crypto.unseal(key, nonce, out[:-1] + bytes([out[-1] ^ 1]), aad) is None


def test_x25519_vector():
    scalar = bytes.fromhex("a546e36bf0527c9d3b16154b82465edd62144c0ac1fc5a18506a2244ba449ac4")
    point = bytes.fromhex("e6db6867583030db3594c1a424b15f7c726624ec26b3353b10a903a6d0ab1c4c")
    assert crypto.x25519(scalar, point).hex() == "c3da55379de9c6908e94ea4df28d084f32eccf03491c71f754b4075577a28552"


@pytest.mark.parametrize("pad", range(12))
def test_padded_blocks(pad):
    key = os.urandom(32)
    assert crypto.decrypt_block(key, crypto.encrypt_block(key, TEXT, crypto.padding(pad))) == TEXT


def test_blocks_and_parts():
    keys, data = [os.urandom(32) for _ in range(3)], os.urandom(200_001)
    out = crypto.encrypt(keys[1], data)
    assert len(out) == len(data) + 28 * 4
    assert crypto.decrypt(keys, out) == data
    assert crypto.decrypt(keys[:1], out) is None
    assert crypto.decrypt(keys, out[:-1]) is None
    parts = [crypto.encrypt(keys[0], data[:90_000]), crypto.encrypt(keys[0], data[90_000:])]
    assert crypto.decrypt(keys, b"".join(parts), [len(p) for p in parts]) == data


def test_zstd_vectors():
    frame = bytes.fromhex("28b52ffd00582900003132333435")
    assert codecs.zstd_unpack(frame) == b"12345"
    assert codecs.zstd_unpack(frame + codecs.padding_frame(65_522)) == b"12345"
    assert codecs.padding_frame(8).hex() == "5f2a4d1800000000"
    data = os.urandom(300_000) + b"a" * 300_000
    packed = codecs.zstd_pack(data, frame=100_000)
    assert codecs.zstd_unpack(packed) == data
    with pytest.raises(ValueError, match="cut short"):
        codecs.zstd_unpack(frame[:-1])
    assert codecs.worth_compressing(b"a" * 8192) and not codecs.worth_compressing(os.urandom(8192))


def entries(key=None, meta=None):
    rnd = random.Random(5)
    payloads = [TEXT, rnd.randbytes(200_000), b"abc def ghi " * 60_000, b"", b"x" * 65_536]
    out = [{"kind": "dir", "path": "d", "meta_key": meta, "info": {"uid": 1, "gid": None, "mode": 0o755, "mtime": None}}]
    out += [{"kind": "file", "path": f"d/{n}-{c}", "payload": p, "compress": c, "data_key": key, "meta_key": meta, "metadata": "{}", "ranges": [{"tag": "t", "start": 0, "end": 3}]} for n, p in enumerate(payloads) for c in (False, True)]
    return out + [{"kind": "symlink", "path": "link", "target": "d/0-True"}]


@pytest.mark.parametrize("policy", ["none", "same", "data_only", "individual"])
def test_archives(policy):
    key, meta = (None if policy == "none" else os.urandom(32)), None
    if policy != "none" and policy != "data_only":
        meta = key if policy == "same" else os.urandom(32)
    private, second = os.urandom(32), os.urandom(32)
    given_ = entries(key, meta)
    data = fmt.build_archive(given_, [crypto.x25519(private)])
    assert fmt.check_hash(data) and not fmt.check_hash(bytes([data[0] ^ 1]) + data[1:])
    footer = fmt.read_footer(data[-fmt.footer_size(fmt.read_trailer(data)) :], [private])
    keys = [k for k, _, _ in footer["keys"]]
    for e, h in zip([e for e in given_ if e["kind"] == "file"], footer["files"], strict=True):
        disk = data[h["file_start"] : h["file_end"]]
        assert fmt.unpack_payload(disk, keys, h["compressed"], h["encrypted"]) == e["payload"]
        assert h["hashes"]["sha256"] == hashlib.sha256(e["payload"]).digest()
        assert h["index_list"] is None or sum(h["index_list"]) == len(e["payload"])
        for first, last in ((0, 3), (100, 1000), (65_530, 65_540), (70_000, 190_000), (0, 1 << 40), (5, 5)):
            a, b, skip, keep = fmt.plan_range(h, first, last)
            assert fmt.unpack_payload(disk[a:b], keys, h["compressed"], h["encrypted"])[skip : skip + keep] == e["payload"][first:last]
    assert [s["file_path"] for h in footer["files"] for s in h["symlinks"] or []] == ["link"]
    if policy == "none":
        return
    more = fmt.add_readers(data, [crypto.x25519(second)], [private])
    assert fmt.check_hash(more) and fmt.read_footer(more, [second])["files"] == footer["files"]
    assert more[: len(data) // 2] == data[: len(data) // 2]
    if meta is not None:
        with pytest.raises(ValueError, match="no key"):
            fmt.read_footer(data, [second])
    with pytest.raises(ValueError, match="no key"):
        fmt.unpack_payload(data[: 34 + 28], [second], False, True)


def test_archive_errors():
    with pytest.raises(ValueError, match="missing"):
        fmt.build_archive([{"kind": "symlink", "path": "l", "target": "nowhere"}])
    with pytest.raises(ValueError, match="differs"):
        fmt.build_archive([{"kind": "file", "path": "f", "payload": b"", "expected": {"md5": bytes(16), "sha256": None}}])
    with pytest.raises(ValueError, match="no trailer"):
        fmt.read_footer(b"x" * 100)
    assert fmt.read_footer(fmt.build_archive([]))["files"] == []


def test_compressed_and_encrypted_range_vector():
    h = {"raw_size": 123_505, "block_scale": 1, "encrypted": True, "compressed": True, "file_start": 0, "file_end": 2 * 65_564, "index_list": [50, 123_455]}
    assert fmt.plan_range(h, 100, 1000) == (65_564, 131_128, 50, 900)
    plain = {"raw_size": 100, "block_scale": 1, "encrypted": False, "compressed": False, "file_start": 0, "file_end": 65_536, "index_list": None}
    assert fmt.plan_range(plain, 0, 100) == (0, 65_536, 0, 100)


LEAF = st.one_of(st.none(), st.integers(0, 2**64 - 1))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=5), LEAF), max_size=4), st.binary(max_size=9))
def test_borsh_round_trip(items, data):
    kind = ("struct", [("items", ("list", ("struct", [("s", "string"), ("n", ("option", "u64"))]))), ("b", "bytes"), ("e", ("enum", [("one", None), ("two", "bool")]))])
    value = {"items": [{"s": s, "n": n} for s, n in items], "b": data, "e": ("two", True)}
    raw = borsh.encode(kind, value)
    assert borsh.decode(kind, raw) == (value, len(raw))
    with pytest.raises(ValueError):
        borsh.decode(kind, raw[:-1])


def test_tar():
    data = write_tar([{"kind": "dir", "path": "/d"}, {"kind": "file", "path": "d/f", "payload": b"x" * 512}, {"kind": "symlink", "path": "l", "target": "d/f"}])
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        a, b, c = tar.getmembers()
        assert (a.isdir(), b.size, b.mode, b.uid, c.linkname) == (True, 512, 0o644, 1000, "d/f")


def test_keys():
    key = os.urandom(32)
    assert crypt4gh.read_pem(crypt4gh.write_pem(key)) == key
    assert crypt4gh.read_key(crypt4gh.write_key(key, b"phrase"), b"phrase") == key
    with pytest.raises(ValueError, match="phrase"):
        crypt4gh.read_key(crypt4gh.write_key(key, b"phrase"), b"other")
    readers = [os.urandom(32) for _ in range(3)]
    head = crypt4gh.write_header(key, [crypto.x25519(r) for r in readers[:2]], os.urandom(32), [1, 2])
    assert [crypt4gh.open_header(head + b"data", r) for r in readers] == [[key], [key], []]
    assert crypt4gh.read_header(head)[2] == len(head)


def test_footers_in_passing_bytes():
    key = b"k" * 32
    one = fmt.build_archive([{"kind": "file", "path": "a", "payload": b"x" * 9}], [])
    two = fmt.build_archive([{"kind": "file", "path": "b", "payload": fmt.EOF_MAGIC * 50, "data_key": key, "meta_key": key}], [])
    for data, path in ((b"before" + one + b"after", "a"), (one + two + b"\0" * 500, "b"), (two + fmt.EOF_MAGIC * 30, "b"), (two + one[:-1], "b")):
        at, end, _ = fmt.locate_footer(data)
        assert [h["file_path"] for h in fmt.read_footer(data[at:end], [], [key])["files"]] == [path]
    for data in (b"", b"nothing here", one[:-1], fmt.EOF_MAGIC * 40):
        with pytest.raises(ValueError, match="no trailer"):
            fmt.locate_footer(data)
    with pytest.raises(ValueError, match="no trailer"):
        fmt.locate_footer(one + b"after", len(one))


def test_key_pairs_and_headers():
    private, public = crypt4gh.new_key_pair()
    assert crypto.x25519(crypt4gh.read_pem(private)) == crypt4gh.read_pem(public)
    raw = crypt4gh.new_key_pair(raw=True)
    assert crypto.x25519(raw[0]) == raw[1] != crypt4gh.read_pem(public) and len(fmt.new_key()) == 32
    head = crypt4gh.write_header(b"d" * 32, [raw[1]], b"w" * 32, edits=[5, 10, 7])
    assert crypt4gh.open_packets(head, raw[0]) == ([b"d" * 32], [5, 10, 7])
    with pytest.raises(ValueError, match="version"):
        crypt4gh.read_header(head[:8] + b"\2" + head[9:])
