"""Token-id files by bit-plane shuffling.

A file holds the ids of one ascending doc_id range. Ids are cut into blocks of
a fixed size; a block is transposed into bit planes (or byte planes), and each
plane is compressed with zstandard (planes all zero take no bytes). Layout,
little-endian:

    magic "QPLANES1"
    planes of block 0, block 1, ...
    documents: doc_id int64 each, a null flag byte each, n_tokens int64 each, compressed together
    chunk index: for each block n_ids uint32 and 32 (or 4) plane lengths uint32, compressed
    footer: offset of documents, of the index, number of documents, blocks, block size (uint64 each), planes (uint64), magic
"""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import zstandard
from pyarrow import fs as afs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, id_ranges, new_path, range_of, stored
from quarry.llm.tokens import encoder

MAGIC, BLOCK = b"QPLANES1", 1 << 16
_FOOT = struct.Struct("<6Q8s")


def to_planes(ids: np.ndarray, planes: int = 32) -> list[bytes]:
    """The bit (32) or byte (4) planes of one block, lowest first."""
    if planes == 4:
        return [p.tobytes() for p in ids.astype("<u4").view(np.uint8).reshape(-1, 4).T]
    top = int(ids.max()).bit_length() if len(ids) else 0
    out = []
    for byte in ids.astype("<u4").view(np.uint8).reshape(-1, 4).T[: (top + 7) // 8]:
        own = np.ascontiguousarray(byte)
        out += [np.packbits(own & np.uint8(1 << k)).tobytes() for k in range(8)]
    return out[:top] + [b""] * (planes - top)


def from_planes(parts: list[bytes], n: int) -> np.ndarray:
    if len(parts) == 4:
        return np.ascontiguousarray(np.array([np.frombuffer(p, np.uint8) for p in parts]).T).view("<u4").ravel() if n else np.zeros(0, "<u4")
    out = np.zeros(n, "<u4")
    for k, p in enumerate(parts):
        if p:
            out |= np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype("<u4") << np.uint32(k)
    return out


class PlaneWriter:
    """Writes one file; holds one block of ids and the list of documents."""

    def __init__(self, out, block: int = BLOCK, planes: int = 32):
        self.out, self.block, self.planes, self.at = out, block, planes, 0
        self.pend: list[bytes] = []
        self.n_pend, self.docs, self.index, self.press = 0, [], [], zstandard.ZstdCompressor(level=1)
        self._put(MAGIC)

    def _put(self, data: bytes):
        self.out.write(data)
        self.at += len(data)

    def _flush(self, ids: np.ndarray):
        sizes = []
        for p in to_planes(ids, self.planes):
            got = self.press.compress(p) if p.strip(b"\0") else b""
            self._put(got)
            sizes.append(len(got))
        self.index.append([len(ids), *sizes])

    def add(self, doc_id, ids: bytes):
        """ids: little-endian unsigned 32-bit bytes of one document."""
        self.docs.append((doc_id, len(ids) // 4))
        self.pend.append(ids)
        self.n_pend += len(ids) // 4
        if self.n_pend >= self.block:
            found = np.frombuffer(b"".join(self.pend), "<u4")
            while len(found) >= self.block:
                self._flush(found[: self.block])
                found = found[self.block :]
            self.pend, self.n_pend = [found.tobytes()], len(found)

    def close(self):
        if self.n_pend:
            self._flush(np.frombuffer(b"".join(self.pend), "<u4"))
        docs_at = self.at
        raw = np.array([d or 0 for d, _ in self.docs], "<i8").tobytes() + np.array([d is None for d, _ in self.docs], "u1").tobytes() + np.array([n for _, n in self.docs], "<i8").tobytes()
        self._put(self.press.compress(raw))
        index_at = self.at
        self._put(self.press.compress(np.array(self.index, "<u4").tobytes()))
        self._put(_FOOT.pack(docs_at, index_at, len(self.docs), len(self.index), self.block, self.planes, MAGIC))


class PlaneReader:
    """Reads one file; block(i) reads and decodes only that block."""

    def __init__(self, f):
        self.f, self.size = f, f.seek(0, io.SEEK_END) or f.tell()
        docs_at, index_at, n, blocks, self.block_size, self.planes, magic = _FOOT.unpack(self._at(self.size - _FOOT.size, _FOOT.size))
        if magic != MAGIC or self._at(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a plane file")
        self.open = zstandard.ZstdDecompressor()
        raw = self.open.decompress(self._at(docs_at, index_at - docs_at)) if n else b""
        null = np.frombuffer(raw, "u1", n, 8 * n).astype(bool)
        self.doc_ids = [None if z else int(d) for d, z in zip(np.frombuffer(raw, "<i8", n), null, strict=True)]
        self.counts = np.frombuffer(raw, "<i8", n, 9 * n)
        own = self.open.decompress(self._at(index_at, self.size - _FOOT.size - index_at)) if blocks else b""
        self.index = np.frombuffer(own, "<u4").reshape(blocks, 1 + self.planes)
        self.starts = len(MAGIC) + np.concatenate(([0], np.cumsum(self.index[:, 1:].sum(1, dtype=np.int64))))

    def _at(self, at: int, n: int) -> bytes:
        self.f.seek(int(at))
        return self.f.read(int(n))

    def block(self, i: int) -> np.ndarray:
        n, *sizes = self.index[i].tolist()
        raw, at, parts = self._at(self.starts[i], sum(sizes)), 0, []
        empty = b"" if self.planes > 4 else bytes(n)
        for s in sizes:
            parts.append(self.open.decompress(raw[at : at + s]) if s else empty)
            at += s
        return from_planes(parts, n)

    def documents(self):
        """(doc_id, ids) in order, one block in memory at a time beside the current document."""
        have, left, i = [np.zeros(0, "<u4")], 0, 0
        for doc_id, n in zip(self.doc_ids, self.counts.tolist(), strict=True):
            while left < n:
                have.append(self.block(i))
                left, i = left + len(have[-1]), i + 1
            found = np.concatenate(have) if len(have) != 1 else have[0]
            yield doc_id, found[:n]
            have, left = [found[n:]], left - n


def write_ids(docs: DataFrame, path: str, end_id: int | None, folder: str, parts: int, block: int = BLOCK, planes: int = 32) -> DataFrame:
    """Encodes whole texts and writes one file for each doc_id range to folder (a URI of a shared store).

    Gives the manifest (bucket, file, n_docs, n_ids). Rows go in ascending
    doc_id order, null first; rows that repeat a doc_id are ordered by text. A
    file is written under another name and then moved, so a repeated task
    does no harm. Null or empty texts have only the end id.
    """
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    bounds = id_ranges(docs, "doc_id", parts)
    dealt = docs.select("doc_id", "text", range_of("doc_id", bounds).alias("bucket")).repartition(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", "doc_id", "text")

    def run(batches):
        own, now, out = encoder(path), None, None
        store, root = afs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)

        def done():
            out.close()
            name = f"{root}/part-{now:06d}.qpl"
            out.out.close()
            store.move(temp, name)
            return {"bucket": [now], "file": [f"{folder}/part-{now:06d}.qpl"], "n_docs": [len(out.docs)], "n_ids": [sum(n for _, n in out.docs)]}

        for b in batches:
            for bucket, doc_id, text in zip(b["bucket"], b["doc_id"], b["text"], strict=True):
                if bucket != now:
                    if out:
                        yield done()
                    import uuid

                    now, temp = bucket, f"{root}/.{bucket}-{uuid.uuid4().hex}"
                    out = PlaneWriter(store.open_output_stream(temp), block, planes)
                out.add(doc_id, own(text) + end)
        if out:
            yield done()

    return stored(arrow_map(dealt.select("bucket", "doc_id", "text"), run, "bucket int, file string, n_docs bigint, n_ids bigint", keeps="encoder"), "planes-manifest")


def read_ids(manifest: DataFrame, what: str = "crc32") -> DataFrame:
    """Reads all files: doc_id, start (ids of all documents before), n_tokens, and ids_crc32 or ids array<int>.

    A row of the manifest is a file and a task's work; the running sum is over
    files, not documents.
    """
    before = F.sum("n_ids").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    files = manifest.select("bucket", "file", F.coalesce(before, F.lit(0)).alias("base")).repartition(max(1, manifest.count()), "bucket")
    kind = "ids_crc32 bigint" if what == "crc32" else "ids array<int>"

    def run(batches):
        for b in batches:
            for name, at in zip(b["file"], b["base"], strict=True):
                store, p = afs.FileSystem.from_uri(name)
                out = {"doc_id": [], "start": [], "n_tokens": [], kind.split()[0]: []}
                with store.open_input_file(p) as f:
                    for doc_id, ids in PlaneReader(f).documents():
                        out["doc_id"].append(doc_id)
                        out["start"].append(at)
                        out["n_tokens"].append(len(ids))
                        out[kind.split()[0]].append(zlib.crc32(ids.astype("<u4").tobytes()) if what == "crc32" else ids.astype(np.int32))
                        at += len(ids)
                        if len(out["start"]) == 4096:
                            yield out
                            out = {k: [] for k in out}
                if out["start"]:
                    yield out

    return arrow_map(files, run, f"doc_id bigint, start bigint, n_tokens bigint, {kind}")


def round_trip(docs: DataFrame, path: str, end_id: int, parts: int, folder: str | None = None) -> DataFrame:
    """Writes all files, then gives per document what they hold."""
    return read_ids(write_ids(docs, path, end_id, folder or new_path(docs.sparkSession, "planes"), parts))
