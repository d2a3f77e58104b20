"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A document goes, whole,
to the window that it fits best; when none fits, the fullest is emitted. What
is open at the end of a partition is merged over all partitions by prefix
sums: no task and not the driver gathers it.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, stored
from quarry.llm.tokens import encoder

SIZE, OPEN, LEAST_PIECE = 2048, 32, 16
PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
_MERGED = 1 << 62


class Windows:
    """The open windows of one partition.

    A document of a window's size or more fills whole windows first. When a
    rest fits nowhere and all windows are open, the fullest is emitted, after
    it was filled up with the first part of the rest if the gap is at least
    LEAST_PIECE; so padding stays under LEAST_PIECE a sequence.
    """

    def __init__(self, first_id: int, size: int = SIZE, most: int = OPEN, least_piece: int = LEAST_PIECE):
        self.size, self.most, self.least_piece, self.next_id = size, most, least_piece, first_id
        self.free: list[tuple[int, int]] = []  # (free tokens, window), ascending
        self.held: dict[int, list[tuple]] = {}

    def open(self) -> int:
        self.next_id += 1
        self.held[self.next_id - 1] = []
        return self.next_id - 1

    def put(self, window: int, free: int, piece: tuple):
        """piece: doc_id, start, ids as bytes, tokens of its document. Gives the window's pieces once it is full."""
        self.held[window].append((*piece, window, self.size - free))
        free -= len(piece[2]) // 4
        if free:
            insort(self.free, (free, window))
            return []
        return self.held.pop(window)

    def add(self, doc_id, ids: bytes):
        """Places one document; gives the pieces of all windows that this closes."""
        n, at, out = len(ids) // 4, 0, []
        while n - at >= self.size:
            out += self.put(self.open(), self.size, (doc_id, at, ids[4 * at : 4 * (at + self.size)], n))
            at += self.size
        while at < n:
            fits = bisect_left(self.free, (n - at, -1))
            if fits < len(self.free):
                free, window = self.free.pop(fits)
                out += self.put(window, free, (doc_id, at, ids[4 * at :], n))
                at = n
            elif len(self.free) < self.most:
                out += self.put(self.open(), self.size, (doc_id, at, ids[4 * at :], n))
                at = n
            else:
                free, window = self.free.pop(0)
                if free >= self.least_piece:
                    out += self.put(window, free, (doc_id, at, ids[4 * at : 4 * (at + free)], n))
                    at += free
                else:
                    out += self.held.pop(window)
        return out

    def leftovers(self):
        """The pieces in windows that are still open, fullest first."""
        return [p for _, window in self.free for p in self.held[window]]


def _rows(pieces: list[tuple], keep: bool) -> dict:
    """Columns of placed pieces; keep: with their ids."""
    cols = list(zip(*pieces, strict=True)) if pieces else [[]] * 6
    return {
        "doc_id": cols[0], "start": cols[1], "length": [len(x) // 4 for x in cols[2]], "ids_crc32": [zlib.crc32(x) for x in cols[2]],
        "doc_tokens": cols[3], "sequence_id": cols[4], "offset": cols[5], "ids": cols[2] if keep else [None] * len(pieces),
    }


def pack(docs: DataFrame, encode: Callable[[], Callable[[str | None], bytes]], end_id: int | None, size: int = SIZE, open_windows: int = OPEN, with_ids: bool = False) -> DataFrame:
    """Packs all whole texts of docs(doc_id, text) into sequences of at most size tokens.

    encode(): the encoder of a worker, text -> ids as little-endian unsigned
    32-bit bytes; end_id follows each document. One row per piece: doc_id,
    start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (null
    unless with_ids). A document without tokens (a null text and no end_id)
    has no piece. Repeated rows are packed each on their own. Only the last
    sequence of all can be short by more than LEAST_PIECE.
    """
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches):
        part, own = TaskContext.get().partitionId(), encode()
        windows, sent = Windows(part << 32, size, open_windows), 0
        for b in batches:
            closed = [p for doc_id, text in zip(b["doc_id"], b["text"], strict=True) for p in windows.add(doc_id, own(text) + end)]
            yield _rows(closed, with_ids) | {"part": [None] * len(closed), "pos": [None] * len(closed)}
        rest = windows.leftovers()
        for p in rest:  # one row a batch: as many tokens as the open windows hold, at most
            yield _rows([p], True) | {"part": [part], "pos": [sent]}
            sent += len(p[2]) // 4

    placed = stored(arrow_map(docs.select("doc_id", "text"), run, f"{PIECE}, part int, pos bigint", keeps="encoder"), "packing")
    closed, open_ = placed.where("part IS NULL").drop("part", "pos"), placed.where("part IS NOT NULL")
    totals = open_.groupBy("part").agg(F.sum("length").alias("n"))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # a row a partition
    base = totals.select(F.col("part").alias("of"), F.coalesce(before, F.lit(0)).alias("base"))
    merged = open_.join(F.broadcast(base), F.col("part") == F.col("of")).select("doc_id", "start", "doc_tokens", "ids", (F.col("base") + F.col("pos")).alias("at"))

    def cut(batches):
        for b in batches:
            out = []
            for doc_id, start, n, ids, at in zip(b["doc_id"], b["start"], b["doc_tokens"], b["ids"], b["at"], strict=True):
                done = 0
                while done < len(ids) // 4:
                    window, offset = divmod(at + done, size)
                    take = ids[4 * done : 4 * (done + size - offset)]
                    out.append((doc_id, start + done, take, n, _MERGED + window, offset))
                    done += len(take) // 4
            yield _rows(out, with_ids)

    return closed.unionByName(arrow_map(merged, cut, PIECE))


def pack_texts(docs: DataFrame, path: str, end_id: int | None, pieces: int | None = None, **options) -> DataFrame:
    """pack() by a vocabulary file of the tokenizers library; pieces: kept by a worker's encoder (see Encoder)."""
    return pack(docs, lambda: encoder(path, pieces), end_id, **options)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids array<int> of pieces with ids; a group is one sequence, so its size is bounded."""

    def run(batches):
        for b in batches:
            yield {"sequence_id": b["sequence_id"], "ids": [np.frombuffer(b"".join(x), "<u4").astype(np.int32) for x in b["parts"]]}

    parts = pieces.groupBy("sequence_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"]).alias("parts"))
    return arrow_map(parts, run, "sequence_id bigint, ids array<int>")
