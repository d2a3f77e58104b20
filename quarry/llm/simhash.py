"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 2-bit segments. The
Manhattan distance of two such vectors never exceeds the Hamming distance of
the fingerprints. Fingerprints within 5 bits have a half (16 segments) within
2; two grid points of Manhattan distance 2 share a grid point within 1 of
both. So every pair meets at a grid point within 1 of a half of both, and the
exact distance is checked there. Of what is near each other at a grid point
only a forest comes out, a link a row at most: the same components, in space
that grows with the rows and not with their pairs.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BROADCAST_ROWS, arrow_map, bits, stored
from quarry.llm.graph import components, roots

#: Most differing bits of a link, and the most for which halves within 2 find every pair.
BITS, MOST_BITS = 4, 5
_BLOCK = 1 << 15
#: Rows of a grid point that meet in one task; of one with more, each two shards meet.
SHARD = 1 << 16
#: Cells are counted by so many hash values first; each only where that doesn't bound them.
HASHED = 1 << 18
#: Rows that a task holds before it links them; groups of so many are compared all at once.
HELD, SMALL = 1 << 17, 64


def fingerprint(text: str | None, words: int = 4) -> int:
    """SimHash of a whole text: ASCII lower case, ASCII white space, repeated shingles count.

    Fewer words than a shingle's: the whole sequence is the shingle; none: 0.
    """
    found = (text or "").encode().lower().split()  # of bytes: ASCII only
    n = len(found)
    if not n:
        return 0
    whole = b" ".join(found)
    if n <= words:
        return xxhash.xxh64_intdigest(whole, 42)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - words])).tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    h, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _BLOCK):
        got = np.array([h(whole[a:b], 42) for a, b in zip(starts[at : at + _BLOCK], stops[at : at + _BLOCK], strict=True)], dtype="<u8")
        votes += np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp bigint (the fingerprint's bits) of every whole text; null counts as empty."""

    def run(batches):
        for b in batches:
            yield {"doc_id": b["doc_id"], "fp": [bits(fingerprint(t, words)) for t in b["text"]]}

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id bigint, fp bigint")


def grid_cells(prints: DataFrame) -> DataFrame:
    """(cell, fp) for each grid point within 1 of either half of a fingerprint's embedding."""
    halves = F.expr(
        """transform(array(fp & 4294967295L, shiftrightunsigned(fp, 32)), (x, h) ->
             named_struct('e', (x & 1431655765L) + (shiftright(x, 1) & 1431655765L), 'h', shiftleft(cast(h as bigint), 32)))"""
    )
    near = F.expr(
        """concat(array(0L),
             transform(filter(sequence(0, 15), i -> (shiftright(half.e, 2 * i) & 3) < 2), i -> shiftleft(1L, 2 * i)),
             transform(filter(sequence(0, 15), i -> (shiftright(half.e, 2 * i) & 3) > 0), i -> -shiftleft(1L, 2 * i)))"""
    )
    at = prints.select("fp", F.explode(halves).alias("half"))
    at = at.select("fp", "half", F.explode(near).alias("step"))
    return at.select((F.col("half.e") + F.col("step") + F.col("half.h")).alias("cell"), "fp")


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of each run of equal keys."""
    new = np.ones(len(keys[0]) + 1, bool)
    new[1:-1] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    edges = np.flatnonzero(new)
    return edges[:-1], np.diff(edges)


def _small(fp: np.ndarray, at: np.ndarray, place: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs in many small groups: at has their row numbers, group after group, place the number of a row in its group."""
    a, b, left = [], [], np.arange(len(at))
    for d in range(1, int(place.max(initial=0)) + 1):
        left = left[place[left] >= d]
        x, y = at[left - d], at[left]
        near = np.bitwise_count(fp[x] ^ fp[y]) <= most
        a.append(x[near])
        b.append(y[near])
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _grow(fp: np.ndarray, at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the near pairs of one group: a row takes all near it that none has taken yet, then these do the same."""
    a, b = [], []
    while len(at):
        queue, at = [at[:1]], at[1:]
        while queue:
            for x in queue.pop():
                if not len(at):
                    break
                near = np.bitwise_count(fp[at] ^ fp[x]) <= most
                if near.any():
                    found, at = at[near], at[~near]
                    a.append(np.full(len(found), x))
                    b.append(found)
                    queue.append(found)
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _links_of(group: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows whose groups follow each other: links that join what near pairs of a group join, a row at most.

    Groups over SMALL are cut by each of most + 1 exact blocks of bits: two
    fingerprints within most bits agree in one of them.
    """
    starts, sizes = _runs(group)
    place = np.arange(len(fp)) - np.repeat(starts, sizes)
    few = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    parts = [_small(fp, few, place[few], most)]
    many = np.flatnonzero(np.repeat(sizes > SMALL, sizes))
    number = np.repeat(np.arange(len(sizes)), sizes)[many]
    cuts = [64 * k // (most + 1) for k in range(most + 2)]
    for lo, hi in zip(cuts, cuts[1:], strict=False) if len(many) else []:
        block = fp[many] >> np.uint64(lo) & np.uint64((1 << hi - lo) - 1)
        order = np.lexsort((block, number))
        at = many[order]
        begin, n = _runs(number[order], block[order])
        own = np.flatnonzero(np.repeat(n <= SMALL, n))
        parts.append(_small(fp, at[own], (np.arange(len(at)) - np.repeat(begin, n))[own], most))
        parts += [_grow(fp, at[x : x + k], most) for x, k in zip(begin[n > SMALL].tolist(), n[n > SMALL].tolist(), strict=True)]
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    first = roots(len(fp), a, b)
    own = np.flatnonzero(first != np.arange(len(fp)))
    return fp[own], fp[first[own]]


def _dealt(cells: DataFrame) -> DataFrame:
    """cells with the columns a, b: rows of the same cell, a and b meet. Each two shards of a cell of more than SHARD rows do."""
    counted = cells.groupBy(F.pmod(F.xxhash64("cell"), F.lit(HASHED))).count().agg(F.max("count")).first()[0] or 0
    if counted <= SHARD:  # so no cell has more
        return cells.withColumns({"a": F.lit(0), "b": F.lit(0)})
    sizes = stored(cells.groupBy("cell").count().where(F.col("count") > SHARD).select(F.col("cell").alias("hot"), F.ceil(F.col("count") / SHARD).cast("int").alias("shards")), "simhash-hot")
    n, zero = sizes.count(), F.lit(0)
    if not n:
        return cells.withColumns({"a": zero, "b": zero})
    joined = cells.join(F.broadcast(sizes) if n <= BROADCAST_ROWS else sizes, F.col("cell") == F.col("hot"), "left")
    joined = joined.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int"))
    others = F.filter(F.sequence(zero, F.col("shards") - 1), lambda k: k != F.col("own"))
    other = joined.select("cell", "fp", "own", F.explode(F.coalesce(others, F.array(F.lit(-1)))).alias("other"))
    return other.select("cell", "fp", F.coalesce(F.least("own", "other"), zero).alias("a"), F.coalesce(F.greatest("own", "other"), zero).alias("b"))


def links(prints: DataFrame, most: int = BITS) -> DataFrame:
    """(src, dst) over distinct prints(fp): what pairs at 1 to most differing bits join, these links join, and nothing else.

    A link names two fingerprints of one component, not always a near pair; a
    fingerprint has at most one at each of its grid points.
    """
    if not 1 <= most <= MOST_BITS:
        raise ValueError(f"the grid finds every pair within 1 to {MOST_BITS} bits, not {most}")
    key = ["cell", "a", "b"]
    dealt = _dealt(grid_cells(prints)).repartition(*key).sortWithinPartitions(*key, "fp")

    def run(batches):
        held, size = [], 0

        def give(whole: bool):
            """Links of all held groups; the last one stays held unless whole."""
            cols = {k: np.concatenate([b[k] for b in held]) for k in held[0]}
            new = np.any([np.diff(cols[k]) != 0 for k in key], axis=0)
            end = len(cols["fp"]) if whole else int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
            number = np.concatenate(([0], np.cumsum(new[: end - 1]))) if end else np.zeros(0, int)
            found = np.stack(_links_of(number, cols["fp"][:end].view(np.uint64), most)).view(np.int64) if end else np.zeros((2, 0), np.int64)
            once = np.unique(found, axis=1)
            return {"src": once[0], "dst": once[1]}, {k: v[end:] for k, v in cols.items()}

        for b in batches:
            held.append(b)
            size += len(b["fp"])
            if size >= HELD:
                out, rest = give(False)
                held, size = [rest], len(rest["fp"])
                yield out
        if held:
            yield give(True)[0]

    return arrow_map(dealt, run, "src bigint, dst bigint", arrays=True)


def near_groups(docs: DataFrame, words: int = 4, most: int = BITS) -> DataFrame:
    """Per document: doc_id, fp, component_id, the smallest doc_id reachable over links of at most so many bits.

    Texts with equal fingerprints form a class; classes are linked on the
    grid by their fingerprints. Rows that repeat a doc_id keep their own
    fingerprint; a null doc_id is a document as any other, which links but
    names no component, so a component of such documents alone has none.
    """
    prints = stored(fingerprints(docs, words), "simhash")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    found = components(stored(links(classes.select("fp"), most).distinct(), "simhash-links"))
    linked = classes.join(found, F.col("fp") == F.col("node")).select("node", "component", "rep")
    least = linked.groupBy(F.col("component").alias("of")).agg(F.min("rep").alias("least"))
    linked = linked.join(least, F.col("component") == F.col("of")).select("node", "least")
    named = classes.join(linked, F.col("fp") == F.col("node"), "left").select("fp", F.when(F.col("node").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
