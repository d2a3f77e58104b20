"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs at line ends, and long lines further at clause
ends. Each paragraph's digest, numbered among its repeats, enters one cell of
each of three subtables (count, xor of digests, sum of checks). The sketches
of two versions subtract cell by cell; peeling the difference recovers the
digests on either side. Where it fails, both are sketched again four times
larger. A fingerprint is the smallest sketch and the paragraph count.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, id_ranges, range_of

HASHES, CELLS, GROWTH = 3, 24, 4
#: A paragraph ends with a line; in lines, a clause does too.
UNIT = re.compile(r"[^\n.!?,;:]+[.!?,;:]*|[\n.!?,;:]+")
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_CHECK = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray, seed) -> np.ndarray:
    """A 64-bit mixer of digests."""
    x = (x ^ seed) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


def digests(text: str) -> np.ndarray:
    """The paragraph digests of a text; the n-th repeat of a paragraph has a digest of its own."""
    units = [u.strip() for u in UNIT.findall(text)]
    units = [u for u in units if u]
    out = np.array([xxhash.xxh64_intdigest(u) for u in units], dtype=np.uint64)
    if len(set(units)) < len(units):
        seen: Counter = Counter()
        for i, u in enumerate(units):
            if seen[u]:
                out[i] = xxhash.xxh64_intdigest(u, seen[u])
            seen[u] += 1
    return out


class Sketches:
    """Sketches of the same size of many documents at once, as rows of cells."""

    def __init__(self, rows: int, cells: int):
        self.per = -(-cells // HASHES)
        self.rows, self.cells = rows, self.per * HASHES
        self.count = np.zeros(rows * self.cells, np.int64)
        self.keys = np.zeros(rows * self.cells, np.uint64)
        self.checks = np.zeros(rows * self.cells, np.uint64)

    def at(self, row: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
        return row * self.cells + k * self.per + (mix(x, _SEEDS[k]) % np.uint64(self.per)).astype(np.int64)

    def add(self, row: np.ndarray, x: np.ndarray, sign: np.ndarray | int) -> None:
        """Puts digests into rows' sketches, or with sign -1 takes them out."""
        check, sign = mix(x, _CHECK), np.broadcast_to(np.asarray(sign, np.int64), x.shape)
        signed = np.where(sign > 0, check, np.uint64(0) - check)
        for k in range(HASHES):
            at = self.at(row, x, k)
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.keys, at, x)
            np.add.at(self.checks, at, signed)

    def pure(self, at: np.ndarray) -> np.ndarray:
        """Of the given cells, those that hold one digest."""
        at = at[np.abs(self.count[at]) == 1]
        check = mix(self.keys[at], _CHECK)
        return at[self.checks[at] == np.where(self.count[at] > 0, check, np.uint64(0) - check)]

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Empties the sketches: rows, digests, signs recovered, and which rows came out empty."""
        rows, found, signs = [], [], []
        look = np.flatnonzero(self.count)
        while len(look):
            at = self.pure(look)
            if not len(at):
                break
            row, x, sign = at // self.cells, self.keys[at], self.count[at]
            both = np.unique(np.rec.fromarrays((row, x)), return_index=True)[1]
            row, x, sign = row[both], x[both], sign[both]
            self.add(row, x, -sign)
            rows.append(row)
            found.append(x)
            signs.append(sign)
            look = np.unique(np.concatenate([self.at(row, x, k) for k in range(HASHES)]))
        left = (self.count.reshape(self.rows, -1) != 0).any(1) | (self.keys.reshape(self.rows, -1) != 0).any(1)
        join = lambda a, kind: np.concatenate(a) if a else np.zeros(0, kind)
        return join(rows, np.int64), join(found, np.uint64), join(signs, np.int64), ~left


def flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def fingerprints(sets: list[np.ndarray], cells: int = CELLS) -> tuple[list[str], Sketches]:
    """Each document's smallest sketch as text (paragraphs, then its cells), and the sketches."""
    s = Sketches(len(sets), cells)
    s.add(*flat(sets), 1)
    packed = np.empty((s.rows, s.cells), [("n", "<i4"), ("key", "<u8"), ("check", "<u4")])
    packed["n"], packed["key"], packed["check"] = (a.reshape(s.rows, -1) for a in (s.count, s.keys, s.checks & np.uint64(0xFFFFFFFF)))
    return [f"{len(x)}:{base64.b85encode(packed[i].tobytes()).decode()}" for i, x in enumerate(sets)], s


def differences(old: list[np.ndarray], new: list[np.ndarray], sketches: tuple[Sketches, Sketches] | None = None, cells: int = CELLS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per pair the digests only in old and those only in new, by subtracting and peeling sketches.

    Pairs whose sketch doesn't empty are sketched again GROWTH times larger,
    until all do. sketches: those of the smallest size, if made already.
    """
    only: tuple[list, list] = ([np.zeros(0, np.uint64)] * len(old), [np.zeros(0, np.uint64)] * len(old))
    left = np.arange(len(old))
    while len(left):
        s = Sketches(len(left), cells)
        if sketches:
            s.count, s.keys, s.checks = sketches[0].count - sketches[1].count, sketches[0].keys ^ sketches[1].keys, sketches[0].checks - sketches[1].checks
            sketches = None
        else:
            s.add(*flat([old[i] for i in left]), 1)
            s.add(*flat([new[i] for i in left]), -1)
        rows, found, signs, done = s.peel()
        order = np.argsort(rows, kind="stable")
        rows, found, signs = rows[order], found[order], signs[order]
        edges = np.searchsorted(rows, np.arange(len(left) + 1))
        for r in np.flatnonzero(done):
            a, b = edges[r], edges[r + 1]
            only[0][left[r]], only[1][left[r]] = found[a:b][signs[a:b] > 0], found[a:b][signs[a:b] < 0]
        left, cells = left[~done], cells * GROWTH
    return only


def likeness(old: list[np.ndarray], new: list[np.ndarray], sketches=None, cells: int = CELLS) -> list[float]:
    """Shared paragraphs over all paragraphs of both (Jaccard, repeats counted); 1 for two empty texts."""
    out = []
    for a, b, x, y in zip(old, new, *differences(old, new, sketches, cells), strict=True):
        whole = len(a) + len(y)
        out.append((len(a) - len(x)) / whole if whole else 1.0)
    return out


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the first as many characters (or all) of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _follow(docs: DataFrame, parts: int) -> DataFrame:
    """Rows dealt by doc_id ranges, each range closed by a copy of the first row of the next one (guard)."""
    bounds = id_ranges(docs, "doc_id", parts)
    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), range_of("doc_id", bounds).alias("bucket"))
    first = dealt.groupBy("bucket").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.col("doc_id"))).alias("m")).select("bucket", "m.doc_id").orderBy("bucket").collect()  # a row a range
    if not first:
        return dealt.select("doc_id", "text", "bucket", F.lit(False).alias("guard"))
    before = [Row(first_id=r.doc_id, own=r.bucket, bucket_before=first[i - 1].bucket) for i, r in enumerate(first)]
    sends = F.broadcast(docs.sparkSession.createDataFrame(before, "first_id bigint, own int, bucket_before int"))
    guards = dealt.join(sends, dealt["doc_id"].eqNullSafe(F.col("first_id")) & (dealt["bucket"] == F.col("own")))
    guards = guards.select("doc_id", "text", F.col("bucket_before").alias("bucket"), F.lit(True).alias("guard"))
    both = dealt.select("doc_id", "text", "bucket", F.lit(False).alias("guard")).union(guards)
    return both.repartition(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", "guard", "doc_id", "text")


def compare_with_edits(docs: DataFrame, parts: int, cells: int = CELLS, rows: int = 256) -> DataFrame:
    """Fingerprints every whole text and its edited text, and compares by the sketches.

    Gives doc_id, n_chars (code points), edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. The next document is by
    ascending doc_id (null first, equal ids by text), after the last the
    first. Null texts are empty; an empty text equals any other empty one; a
    single document follows itself.
    """

    def run(batches):
        def texts():
            held = None
            for b in batches:
                for doc_id, text, bucket, guard in zip(b["doc_id"], b["text"], b["bucket"], b["guard"], strict=True):
                    if held and held[2] == bucket:
                        yield held[0], held[1], text
                    held = None if guard else (doc_id, text, bucket)

        def work(todo):
            ids, old, following = zip(*todo, strict=True)
            new = [edited(a, b) for a, b in zip(old, following, strict=True)]
            sets = [digests(t) for t in old]
            # the next document of a row is, as a rule, the next row
            nexts = [sets[i + 1] if i + 1 < len(old) and following[i] is old[i + 1] else digests(t) for i, t in enumerate(following)]
            news = [digests(t) for t in new]
            prints, a = fingerprints(sets, cells)
            new_prints, b = fingerprints(news, cells)
            _, c = fingerprints(nexts, cells)
            return {
                "doc_id": ids, "n_chars": [len(t) for t in old], "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in new],
                "fingerprint": prints, "edited_fingerprint": new_prints, "near_edited": likeness(sets, news, (a, b), cells), "near_next": likeness(sets, nexts, (a, c), cells),
            }

        todo, size = [], 0
        for x in texts():
            todo.append(x)
            size += len(x[1])
            if len(todo) == rows or size > 1 << 21:
                yield work(todo)
                todo, size = [], 0
        if todo:
            yield work(todo)

    return arrow_map(_follow(docs, parts), run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
