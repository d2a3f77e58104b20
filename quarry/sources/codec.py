"""Compressed payloads: blocks with a 9-byte header each."""

from __future__ import annotations

import lzma
import zlib

import pyarrow as pa
import xxhash
import zstandard

# Fixed values of the format: the tag of each algorithm and the byte after it (deflate's number, none, the libraries' major versions).
TAGS = {"zlib": b"ZL\x08", "lzma": b"XZ\x00", "lz4": b"L4\x01", "zstd": b"ZS\x01"}
MOST = (1 << 24) - 1


def _raw_lz4():
    return pa.Codec("lz4_raw")


def _pack(kind: str, level: int, data: bytes) -> bytes:
    if kind == "zlib":
        return zlib.compress(data, level)
    if kind == "lzma":
        return lzma.compress(data, preset=level)
    if kind == "zstd":
        return zstandard.ZstdCompressor(level=level).compress(data)
    body = _raw_lz4().compress(data, asbytes=True)
    return xxhash.xxh64(body).digest() + body


def _unpack(tag: bytes, body: bytes, size: int) -> bytes:
    if tag == b"ZL":
        return zlib.decompress(body)
    if tag == b"XZ":
        return lzma.decompress(body)
    if tag == b"ZS":
        return zstandard.ZstdDecompressor().decompress(body, max_output_size=size)
    if tag == b"L4":
        if xxhash.xxh64(body[8:]).digest() != body[:8]:
            raise ValueError("checksum of an lz4 block differs")
        return _raw_lz4().decompress(body[8:], decompressed_size=size, asbytes=True)
    raise ValueError(f"unknown compression {tag!r}")


def compress(data: bytes, kind: str | None, level: int = 1) -> bytes:
    """Blocks of under 2^24 bytes; the data itself where that isn't smaller, or for kind None or level 0."""
    if not kind or not level:
        return data
    if kind not in TAGS:
        raise ValueError(f"unknown compression {kind!r}")
    out, size = [], max(1, -(-len(data) // max(1, -(-len(data) // MOST))))  # even parts
    for at in range(0, len(data), size):
        part = data[at : at + size]
        body = _pack(kind, level, part)
        if len(body) + 9 >= len(part) or len(body) > MOST:
            return data
        out.append(TAGS[kind] + len(body).to_bytes(3, "little") + len(part).to_bytes(3, "little") + body)
    return b"".join(out)


def decompress(data: bytes, size: int) -> bytes:
    """What compress() was given; size: its length, which is checked."""
    if len(data) == size:
        return data
    out, at = [], 0
    while at < len(data):
        n, whole = int.from_bytes(data[at + 3 : at + 6], "little"), int.from_bytes(data[at + 6 : at + 9], "little")
        part = _unpack(data[at : at + 2], data[at + 9 : at + 9 + n], whole)
        if len(part) != whole:
            raise ValueError("a block's length differs")
        out.append(part)
        at += 9 + n
    got = b"".join(out)
    if len(got) != size:
        raise ValueError(f"{len(got)} bytes where {size} were to be")
    return got
