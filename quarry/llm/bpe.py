"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame

from quarry.llm.common import arrow_map, worker_cache

#: Before such a space, after a character that is no white space, every match of the splitting pattern ends.
SAFE = re.compile(r"(?<=\S)(?=[ \t\n\r])")
LONG = 100_000


class RankCodec:
    """Encodes and decodes by a rank file; texts over LONG characters go in parts cut at safe boundaries."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def parts(self, text: str, limit: int = LONG):
        at = 0
        while len(text) - at > limit:
            cut = SAFE.search(text, at + limit)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= LONG:
            return self.library.encode_ordinary(text)
        return [i for part in self.parts(text) for i in self.library.encode_ordinary(part)]

    def decode(self, ids) -> bytes:
        """The raw bytes: ids may end inside a character."""
        return self.library.decode_bytes(ids)


@worker_cache
def codec(path: str, pattern: str) -> RankCodec:
    return RankCodec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int> of each whole text; a null or empty text has none."""

    def run(batches):
        own = codec(path, pattern)
        for b in batches:
            yield {"doc_id": b["doc_id"], "ids": [own.encode(t) for t in b["text"]]}

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id bigint, ids array<int>", keeps="codec")


def decode(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes binary of ids(doc_id, ids)."""

    def run(batches):
        own = codec(path, pattern)
        for b in batches:
            yield {"doc_id": b["doc_id"], "bytes": [own.decode(x or []) for x in b["ids"]]}

    return arrow_map(ids.select("doc_id", "ids"), run, "doc_id bigint, bytes binary", keeps="codec")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and digests of the ids and of the bytes decoded from them.

    One pass: ids and decoded bytes never leave the task. A null text counts
    as empty; repeated rows give repeated rows; other columns are ignored.
    """

    def run(batches):
        own = codec(path, pattern)
        for b in batches:
            out = {"doc_id": b["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in b["text"]:
                ids = own.encode(text)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield out

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", keeps="codec")
