"""Line dedup by an exact set-similarity join.

A line is the set of its words (or another unit with sets: see neardup). Later
lines of the same set go first, by a key; sets of under four words are similar
to equal ones only. The others order their words by rarity over the corpus and
post those of their prefix (the commonest words in pairs with the next ones,
so that no word's list is a share of the corpus). Postings of a word meet in
one task, where the length, positional and bitmap filters, all of them upper
bounds, leave candidates, and the Jaccard similarity of these is computed
exactly. A line goes if an earlier line (by doc_id, then line number) is
similar.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import BROADCAST_ROWS, ROW, added, arrow_map, fresh, identified, stored
from quarry.llm.words import chunks, words

#: Lines of fewer words, the blank ones, stay; similarity from which a later line goes, as a fraction.
LEAST_WORDS, NUM, DEN = 1, 4, 5
#: Sets of fewer words have no similar ones but their equals: n words of n + 1 are NUM / DEN from here on.
LEAST_SET = NUM // (DEN - NUM)
#: The rarity sketch: 2^18 counters (2 MB) whatever the corpus.
SKETCH_BITS, SKETCH_BLOCK = 18, 1 << 13
#: Candidates that a posted line names at first; only a line none of whose candidates hold, and that has more, is looked at again.
FIRST = 8
#: Words of up to so many postings are compared all at once.
SMALL = 64
#: Sets of more words have no marks: those would differ too little against the room, and zeros take no space when compressed.
MARKED = 256
#: Words counted more often than this, and than this share (a power of two) of all words, are posted in pairs.
HOT_WORD, HOT_WORD_SHARE = 1 << 17, 11
#: Postings that a task holds before it sends them, postings a bucket, buckets a task, most tasks that compare them.
HELD, BUCKET, BUCKETS_A_TASK, MOST_PARTS = 1 << 18, 1 << 16, 8, 100_000
#: Words that a second look may name to all tasks (16 MB).
MOST_ASKED = 1 << 21
PAIR = ("old_doc", "old_line", "doc", "line_no", "more")
#: A line's copies are hot from 1 / (HOT_SHARE * shuffle partitions) of all lines on: at most that many keys are broadcast.
HOT_SHARE = 8
_NULL = -(1 << 63)
_BLOCK = 256
#: 48 bits name a word in postings and keys.
_NAME = np.uint64((1 << 48) - 1)


def _distinct(own: np.ndarray, names: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """Each line's names of 48 bits once, ascending; own: the lines' numbers, as unsigned 64-bit."""
    if lines <= 1 << 16:
        both = np.sort(own << np.uint64(48) | names)
        new = np.ones(len(both), bool)
        new[1:] = both[1:] != both[:-1]
        both = both[new]
        return both >> np.uint64(48), both & _NAME
    order = np.lexsort((names, own))
    own, names = own[order], names[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (names[1:] != names[:-1])
    return own[new], names[new]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


class Lines:
    """Of all lines with enough words in some texts: number of the text, number of the line in it, word hashes with edges."""

    #: Columns of a posting.
    columns = {"word": "<i8", "doc": "<i8", "line_no": "<i4", "n": "<i4", "place": "<i4", "marks": "<i8", "marks2": "<i8"}

    def __init__(self, texts: list, least: int):
        w = words(texts)
        raw = np.frombuffer(w.raw, np.uint8)
        breaks = np.flatnonzero(raw == 10)  # every text ends with one, too
        n = np.diff(np.searchsorted(w.starts, breaks), prepend=0)
        enough = n >= least
        keep = np.flatnonzero(enough)
        text = np.searchsorted(w.text_ends, breaks, side="right")
        first = np.searchsorted(breaks, np.concatenate(([0], w.text_ends[:-1])))
        self.text, self.line = text[keep], keep - first[text[keep]]
        self.h = w.hashes if (n[~enough] == 0).all() else w.hashes[np.repeat(enough, n)]
        self.edges = np.concatenate(([0], np.cumsum(n[keep])))

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.text), dtype=np.uint64), np.diff(self.edges))

    def keys(self) -> np.ndarray:
        """A 64-bit name of the set of words of each line."""
        if not len(self.text):
            return np.zeros(0, np.int64)
        own, names = _distinct(self.owners(), self.h & _NAME, len(self.text))
        return np.add.reduceat(_mixed(names), np.searchsorted(own, np.arange(len(self.text), dtype=np.uint64))).view(np.int64)

    def take(self, rows: np.ndarray) -> None:
        """Keeps only these lines."""
        own = np.zeros(len(self.text), bool)
        own[rows] = True
        n = np.diff(self.edges)
        self.h = self.h[np.repeat(own, n)]
        self.text, self.line, self.edges = self.text[own], self.line[own], np.concatenate(([0], np.cumsum(n[own])))

    def distinct(self, ranks: np.ndarray | None = None) -> None:
        """Each line's words once, ascending by hash, or by rarity and then hash.

        By rarity, 48 bits name a word: the rank of its counter, then 30 bits of its hash.
        """
        own = self.owners()
        if ranks is None:
            order = np.lexsort((self.h, own))
            own, h = own[order], self.h[order]
            new = np.ones(len(h), bool)
            new[1:] = (own[1:] != own[:-1]) | (h[1:] != h[:-1])
            own, self.h = own[new], h[new]
        else:
            own, self.h = _distinct(own, ranks[(self.h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] << np.uint64(30) | self.h & np.uint64((1 << 30) - 1), len(self.text))
        self.edges = np.concatenate(([0], np.cumsum(np.bincount(own.astype(np.int64), minlength=len(self.text)))))


def _id(doc_id) -> int:
    return _NULL if doc_id is None else doc_id


def survey(docs: DataFrame, least: int = LEAST_WORDS, unit: type = Lines) -> tuple[DataFrame, np.ndarray]:
    """The table of lines (doc, line_no, key), and how often words occur in them, counted by the first bits of their hash.

    doc is doc_id, the least long for null. Any fixed order of words gives
    the same pairs; rarity makes short lists. Tasks' counts are added in two
    steps, so that no group grows with the tasks; the driver gets 32 rows of 64 kB.
    """

    def run(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            for ids, texts in chunks(b["doc_id"], b["text"]):
                lines = unit(texts, least)
                total += np.bincount((lines.h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
                ids = np.array([_id(i) for i in ids], np.int64)
                none = [None] * len(lines.text)
                yield {"doc": ids[lines.text], "line_no": lines.line, "key": lines.keys(), "block": none, "counts": none}
        blocks = total.reshape(-1, SKETCH_BLOCK)
        none = [None] * len(blocks)
        yield {"doc": none, "line_no": none, "key": none, "block": np.arange(len(blocks)), "counts": [x.tobytes() for x in blocks]}

    def add(pdf):
        import pandas as pd

        total = sum((np.frombuffer(x, "<i8") for x in pdf["counts"]), np.zeros(SKETCH_BLOCK, np.int64))
        return pd.DataFrame({"block": pdf["block"][:1].to_numpy(), "counts": [total.tobytes()]})

    both = stored(arrow_map(docs.select("doc_id", "text"), run, "doc bigint, line_no int, key bigint, block int, counts binary"), "lines")
    rows = added(both.where("block IS NOT NULL").select("block", "counts"), add, "block int, counts binary").collect()
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in rows:
        counts[r.block * SKETCH_BLOCK : (r.block + 1) * SKETCH_BLOCK] = np.frombuffer(r.counts, "<i8")
    return both.where("block IS NULL").select("doc", "line_no", "key"), counts


def _by_doc(lines: DataFrame, label: str) -> tuple[DataFrame, int]:
    """(doc, lines) of distinct lines(doc, line_no), stored, and how many lines there are."""
    out = stored(lines.groupBy("doc").agg(F.array_sort(F.collect_set("line_no")).alias("lines")), label)
    return out, out.agg(F.coalesce(F.sum(F.size("lines") + 2), F.lit(0))).first()[0]


def _with_lines(docs: DataFrame, lines: DataFrame, size: int, how: str) -> DataFrame:
    """doc_id, text, lines of docs joined to (doc, lines); broadcast only up to a size."""
    side = F.broadcast(lines) if size <= 4 * BROADCAST_ROWS else lines
    own = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(_NULL)).alias("own"))
    return own.join(side, F.col("own") == F.col("doc"), how).select("doc_id", "text", "lines")


def _rows_of(lines: Lines, wanted: list, inside: bool) -> np.ndarray:
    """Rows of the lines whose number is in wanted (a list or None for each text), or is not."""
    sizes = np.fromiter((len(x or ()) for x in wanted), np.int64, len(wanted))
    flat = np.fromiter((k for x in wanted for k in x or ()), np.int64, int(sizes.sum()))
    names = np.repeat(np.arange(len(wanted)), sizes) << 32 | flat
    return np.flatnonzero(np.isin((lines.text.astype(np.int64) << 32) | lines.line, names) == inside)


def buckets_of(counts: np.ndarray) -> int:
    """So many buckets of words that one holds about BUCKET postings."""
    return max(64, int(counts.sum()) // (5 * BUCKET))


def _packed(held: list[dict], buckets: int, columns: dict) -> dict:
    """A row for each bucket: its postings' columns, one after the other, compressed."""
    cols = {k: np.concatenate([x[k] for x in held]).astype(t) for k, t in columns.items()}
    bucket = (cols["word"] & ((1 << 30) - 1)) % buckets
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    bucket = bucket[order]
    cols = [v[order] for v in cols.values()]
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    press = zstandard.ZstdCompressor(level=1)
    return {"bucket": bucket[edges[:-1]], "posts": [press.compress(b"".join(v[x:y].tobytes() for v in cols)) for x, y in zip(edges.tolist(), edges[1:].tolist(), strict=False)]}


def _unpacked(rows: list[bytes], columns: dict) -> tuple[dict, list[int]]:
    """The columns of all postings in some rows' bytes, and how many each row has."""
    out, sizes, open_ = {k: [] for k in columns}, [], zstandard.ZstdDecompressor()
    width = sum(np.dtype(t).itemsize for t in columns.values())
    for p in map(open_.decompress, rows):
        n, at = len(p) // width, 0
        for k, t in columns.items():
            out[k].append(np.frombuffer(p, t, n, at))
            at += n * np.dtype(t).itemsize
        sizes.append(n)
    return {"line_no": np.zeros(sum(sizes), np.int32)} | {k: np.concatenate(v) for k, v in out.items()}, sizes


def _paired(rows: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of these words with each of so many that follow it in its line: row of the first, and the pair's name."""
    first = np.repeat(rows, n)
    second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
    return first, _mixed(h[first] * np.uint64(3) + _mixed(h[second])) & _NAME


def postings(docs: DataFrame, counts: np.ndarray, least: int = LEAST_WORDS, inside: bool = False, unit: type = Lines) -> DataFrame:
    """(bucket, posts): the prefix words of each line of docs(doc_id, text, lines) that isn't in lines, or that is.

    The prefix of a set of n words has n - ceil(0.8 n) + 1 words. Two similar
    sets share their first common word in both prefixes, and the second in
    prefixes longer by one; so a word that is hot by its count goes in pairs
    with those after it. place: the word's place in the ordered set. marks:
    128 bits, each the parity of the number of words that hash to it; two sets
    differ in at least as many words as bits; sets of more than MARKED words
    have none. Postings travel by bucket of their word, many to a row.
    """
    order = np.argsort(counts, kind="stable")
    ranks = np.empty(len(counts), np.uint64)
    ranks[order] = np.arange(len(counts), dtype=np.uint64)
    hot = np.uint64(np.searchsorted(counts[order], max(HOT_WORD, int(counts.sum()) >> HOT_WORD_SHARE), side="right"))
    shared, buckets = docs.sparkSession.sparkContext.broadcast(ranks), buckets_of(counts)

    def run(batches):
        held, size = [], 0
        for b in batches:
            for at, texts in chunks(range(len(b["text"])), b["text"]):
                lines = unit(texts, least)
                lines.take(_rows_of(lines, [b["lines"][i] for i in at], inside))
                if not len(lines.text):
                    continue
                lines.distinct(shared.value)
                n = np.diff(lines.edges)
                prefix = np.where(n >= LEAST_SET, n - (NUM * n + DEN - 1) // DEN + 1, 0)
                row = np.repeat(np.arange(len(n)), prefix)  # of each word that is in a prefix
                take = np.arange(len(row)) + np.repeat(lines.edges[:-1] - np.cumsum(prefix) + prefix, prefix)
                place = take - lines.edges[row]
                common = lines.h[take] >> np.uint64(30) >= hot
                first, pairs = _paired(take[common], lines.h, (prefix[row] - place)[common])
                again = np.repeat(np.flatnonzero(common), (prefix[row] - place)[common])
                order = np.concatenate((np.flatnonzero(~common), again))
                take, row, place = take[order], row[order], place[order]
                ids = np.array([_id(b["doc_id"][i]) for i in at], np.int64)
                cols = {"word": np.concatenate((lines.h[take[: len(take) - len(first)]], pairs)).view(np.int64), "doc": ids[lines.text][row], "line_no": lines.line[row], "n": n[row], "place": place}
                if "marks" in unit.columns:
                    bit = np.uint64(1) << (lines.h & np.uint64(63))
                    low = (lines.h >> np.uint64(6) & np.uint64(1)).astype(bool)
                    cols |= {k: (np.bitwise_xor.reduceat(np.where(x, bit, np.uint64(0)), lines.edges[:-1]).view(np.int64) * (n <= MARKED))[row] for k, x in (("marks", low), ("marks2", ~low))}
                if len(row):
                    held.append(cols)
                size += len(row)
                if size >= HELD:
                    yield _packed(held, buckets, unit.columns)
                    held, size = [], 0
        if size:
            yield _packed(held, buckets, unit.columns)

    return arrow_map(docs, run, "bucket bigint, posts binary")


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of so many words can be similar."""
    return (DEN * a >= NUM * b) & (DEN * b >= NUM * a)


def _least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of similar sets of so many words at least so many are in both prefixes.

    Where the prefix that ends first ends, all common words so far are in
    both prefixes, and what is left of that set has ceil(0.8 n) - 1 words.
    """
    need = -(-NUM * (a + b) // (NUM + DEN))
    return need + 1 - np.maximum(-(-NUM * a // DEN), -(-NUM * b // DEN))


def _close(cols: dict, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Which pairs of rows, of fitting lengths, the positional filter and the marks leave."""
    a, b, p, q = cols["n"][old], cols["n"][new], cols["place"][old], cols["place"][new]
    need = -(-NUM * (a + b) // (NUM + DEN))
    good = np.flatnonzero(np.minimum(a - p, b - q) + np.minimum(p, q) >= need)
    if "marks" not in cols:
        return good
    room = (a + b - 2 * need)[good]
    old, new = old[good], new[good]
    ones = lambda k: np.bitwise_count((cols[k][old] ^ cols[k][new]).view(np.uint64)).astype(np.int32)
    return good[(np.maximum(a[good], b[good]) > MARKED) | (ones("marks") + ones("marks2") <= room)]


def _ranks(ids: np.ndarray) -> np.ndarray:
    """The place of each of these ascending numbers among its equals."""
    edges = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True])))
    return np.arange(len(ids)) - np.repeat(edges[:-1], np.diff(edges)) if len(ids) else np.zeros(0, int)


def _run_pairs(cols: dict, first: int | None, again: np.ndarray | None):
    """Candidates within one word's postings, in line order: (old, new) row numbers, and rows that have more than first."""
    n, out, more = len(cols["n"]), [], []
    for at in range(0, n, _BLOCK):
        rows = np.arange(at, min(at + _BLOCK, n))
        if again is not None:
            rows = rows[again[rows]]
        if not len(rows):
            continue
        count = np.zeros(len(rows), np.int64)
        for lo in range(0, int(rows[-1]), 8192):
            old = np.arange(lo, min(lo + 8192, n))
            i, j = np.nonzero(_lengths(cols["n"][old][None], cols["n"][rows][:, None]) & (old[None] < rows[:, None]))
            good = _close(cols, j + lo, rows[i])
            i, j = i[good], j[good]
            if first is not None:
                rank = _ranks(i) + count[i]
                count += np.bincount(i, minlength=len(rows))
                i, j = i[rank < first], j[rank < first]
            out.append((j + lo, rows[i]))
        if first is not None:
            more.append(rows[count > first])
    old, new = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int))
    return old, new, np.concatenate(more) if more else np.zeros(0, int)


def _small_pairs(cols: dict, place: np.ndarray, first: int | None, again: np.ndarray | None):
    """The same for many words of few postings at once; place: each row's place among its word's."""
    out, rows = [], np.arange(len(place))
    if again is not None:
        rows = rows[again]
    for d in range(1, int(place.max(initial=0)) + 1):
        rows = rows[place[rows] >= d]
        new = rows[_lengths(cols["n"][rows - d], cols["n"][rows])]
        new = new[_close(cols, new - d, new)]
        out.append((new - d, new))
    old, new = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int))
    if first is None or not len(new):
        return old, new, np.zeros(0, int)
    order = np.lexsort((old, new))
    old, new = old[order], new[order]
    rank = _ranks(new)
    return old[rank < first], new[rank < first], np.unique(new[rank >= first])


def _of_bucket(cols: dict, again: np.ndarray | None, first: int | None):
    """Candidates among the postings of one bucket."""
    rows = np.argsort(cols["word"])
    same = np.diff(cols["word"][rows]) == 0
    rows = rows[np.concatenate((same, [False])) | np.concatenate(([False], same))]  # a word posted once is in no pair
    if not len(rows):
        return
    last = np.zeros(len(rows), bool) if again is None else again[rows]
    rows = rows[np.lexsort((last, cols["line_no"][rows], cols["doc"][rows], cols["word"][rows]))]
    cols = {k: v[rows] for k, v in cols.items()}
    again = None if again is None else again[rows]
    word = cols["word"]
    edges = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1], [True])))
    size = np.diff(edges)
    few = np.flatnonzero(np.repeat(size <= SMALL, size))
    place = (np.arange(len(word)) - np.repeat(edges[:-1], size))[few]
    x, y, z = _small_pairs({k: v[few] for k, v in cols.items()}, place, first, None if again is None else again[few])
    old, new, more = [few[x]], [few[y]], [few[z]]
    for at, n in zip(edges[:-1][size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        part = slice(at, at + n)
        x, y, z = _run_pairs({k: v[part] for k, v in cols.items()}, first, None if again is None else again[part])
        old.append(x + at)
        new.append(y + at)
        more.append(z + at)
    o, w = np.concatenate(old), np.concatenate(new)
    flag = np.zeros(len(word), bool)
    flag[np.concatenate(more)] = True
    other = (cols["doc"][o] != cols["doc"][w]) | (cols["line_no"][o] != cols["line_no"][w])
    o, w = o[other], w[other]
    if len(o):
        yield {"old_doc": cols["doc"][o], "old_line": cols["line_no"][o], "doc": cols["doc"][w], "line_no": cols["line_no"][w], "more": flag[w], "least": _least(cols["n"][o], cols["n"][w])}


def candidates(posts: DataFrame, first: int | None = FIRST, parts: int | None = None, unit: type = Lines) -> DataFrame:
    """(old_doc, old_line, doc, line_no, more) of lines that share posted words and pass the filters.

    Lines have to share as many words of their prefixes as similar ones do;
    one fewer is let pass, as of words posted in pairs the last one may be
    missing, and so are lines of which some word named only the first old
    ones. posts may have a column again: then only postings where it is true
    look for earlier ones, for all of them. A bucket's postings are one
    task's work, in blocks; parts: tasks.
    """
    second = "again" in posts.columns
    first = None if second else first
    posts = posts if second else posts.withColumn("again", F.lit(False))
    dealt = (posts.repartition(parts, "bucket") if parts else posts.repartition("bucket")).sortWithinPartitions("bucket")

    def run(batches):
        bucket, held, flags = None, [], []

        def work():
            cols, sizes = _unpacked(held, unit.columns)
            return _of_bucket(cols, np.repeat(np.array(flags, bool), sizes) if second else None, first)

        for b in batches:
            for at, posted, flag in zip(b["bucket"], b["posts"], b["again"], strict=True):
                if at != bucket and held:
                    yield from work()
                    held, flags = [], []
                bucket = at
                held.append(posted)
                flags.append(flag)
        if held:
            yield from work()

    found = arrow_map(dealt, run, "old_doc bigint, old_line int, doc bigint, line_no int, more boolean, least int")
    found = found.repartition("doc", "line_no")  # both what follows is by these
    pairs = found.groupBy("doc", "line_no", "old_doc", "old_line").agg(F.max("more").alias("more"), F.max("least").alias("least"), F.count("*").alias("shared"))
    cut_off = F.max("more").over(W.partitionBy("doc", "line_no"))  # as many rows as a line has candidates
    return pairs.withColumn("cut_off", cut_off).where("cut_off OR shared + 1 >= least").select(*PAIR)


def _named(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, text, lines of the lines that pairs name."""
    named = pairs.select("doc", "line_no").union(pairs.select("old_doc", "old_line"))
    wanted, size = _by_doc(named, "lines-named")
    return _with_lines(docs, wanted, size, "inner")


def _counts(lines: Lines) -> list[bytes | None]:
    """Of each line's distinct words the number in each of 2^k buckets, n / 4 or more, as bytes; None where one has over 255."""
    n = np.diff(lines.edges)
    size = 1 << np.ceil(np.log2(np.maximum(n / 4, 8))).astype(np.int64)
    at = np.concatenate(([0], np.cumsum(size)))
    own = np.repeat(np.arange(len(n)), n)
    total = np.bincount(at[own] + ((lines.h >> np.uint64(20)).astype(np.int64) & (size[own] - 1)), minlength=int(at[-1]))
    raw = np.minimum(total, 255).astype(np.uint8).tobytes()
    most = np.maximum.reduceat(total, at[:-1]) if len(n) else total
    return [raw[x:y] if m < 256 else None for x, y, m in zip(at.tolist(), at[1:].tolist(), most.tolist(), strict=False)]


def most_shared(x: bytes, y: bytes) -> int:
    """At most so many words are in both sets: the smaller count of each bucket, the longer one folded to the other's length."""
    a, b = (np.frombuffer(v, np.uint8).astype(np.int32) for v in (x, y))
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        a = a[: len(a) // 2] + a[len(a) // 2 :]
    return int(np.minimum(a, b).sum())


def likely(docs: DataFrame, pairs: DataFrame, least: int, unit: type) -> DataFrame:
    """Of candidate pairs those that counts of words by bucket, a bound of what two sets share, leave. For large sets: the counts are a thirtieth of them."""

    def counts(batches):
        for b in batches:
            for at, texts in chunks(range(len(b["text"])), b["text"]):
                lines = unit(texts, least)
                lines.take(_rows_of(lines, [b["lines"][i] for i in at], True))
                lines.distinct()
                ids = np.array([_id(b["doc_id"][i]) for i in at], np.int64)
                yield {"doc": ids[lines.text], "line_no": lines.line, "n": np.diff(lines.edges), "counts": _counts(lines)}

    table = stored(arrow_map(_named(docs, pairs), counts, "doc bigint, line_no int, n int, counts binary"), "line-counts")
    old = table.select(F.col("doc").alias("old_doc"), F.col("line_no").alias("old_line"), F.col("n").alias("m"), F.col("counts").alias("old_counts"))
    both = pairs.join(old, ["old_doc", "old_line"]).join(table, ["doc", "line_no"])

    def run(batches):
        for b in batches:
            good = [
                i for i, (m, n, x, y) in enumerate(zip(b["m"], b["n"], b["old_counts"], b["counts"], strict=True))
                if x is None or y is None or (NUM + DEN) * most_shared(x, y) >= NUM * (m + n)
            ]
            yield {k: [b[k][i] for i in good] for k in PAIR}

    return arrow_map(both.select(*PAIR, "m", "n", "old_counts", "counts"), run, "old_doc bigint, old_line int, doc bigint, line_no int, more boolean")


def similar(docs: DataFrame, pairs: DataFrame, least: int = LEAST_WORDS, unit: type = Lines) -> DataFrame:
    """Of candidate pairs the lines (doc, line_no) that have an earlier line of similarity 0.8 or more, each once.

    Only the lines that the pairs name are read again; of units without marks
    only those of likely() pairs as whole sets.
    """
    if "marks" not in unit.columns:
        pairs = stored(likely(docs, pairs, least, unit), "line-pairs-likely")

    def sets(batches):
        for b in batches:
            for at, texts in chunks(range(len(b["text"])), b["text"]):
                lines = unit(texts, least)
                lines.take(_rows_of(lines, [b["lines"][i] for i in at], True))
                lines.distinct()
                raw, cut = lines.h.astype("<u8").tobytes(), (lines.edges * 8).tolist()
                ids = np.array([_id(b["doc_id"][i]) for i in at], np.int64)
                yield {"doc": ids[lines.text], "line_no": lines.line, "words": [raw[x:y] for x, y in zip(cut, cut[1:], strict=False)]}

    table = stored(arrow_map(_named(docs, pairs), sets, "doc bigint, line_no int, words binary"), "line-sets")
    old = table.select(F.col("doc").alias("old_doc"), F.col("line_no").alias("old_line"), F.col("words").alias("x"))
    both = pairs.join(old, ["old_doc", "old_line"]).join(table, ["doc", "line_no"])

    def run(batches):
        for b in batches:
            good = []
            for i, (x, y) in enumerate(zip(b["x"], b["words"], strict=True)):
                if x == y:
                    good.append(i)
                    continue
                p, q = set(np.frombuffer(x, "<u8").tolist()), np.frombuffer(y, "<u8").tolist()
                shared = sum(w in p for w in q)
                if DEN * shared >= NUM * (len(p) + len(q) - shared):
                    good.append(i)
            yield {"doc": [b["doc"][i] for i in good], "line_no": [b["line_no"][i] for i in good]}

    return arrow_map(both.select("doc", "line_no", "x", "words"), run, "doc bigint, line_no int").distinct()


def _repeats(table: DataFrame) -> DataFrame:
    """(doc, line_no) of the lines whose key an earlier line of table(doc, line_no, key) has.

    Keys of more than a share of all lines are so few, whatever the input,
    that they are broadcast; only the others travel to the join.
    """
    spark = table.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = table.groupBy("key").agg(F.min(F.struct("doc", "line_no")).alias("f"), F.count("*").alias("c")).where("c > 1").select(F.col("key").alias("k"), "f", "c")
    first = stored(first, "line-firsts")
    most = max(1, table.count() // (HOT_SHARE * parts))
    hot, cold = first.where(F.col("c") > most), first.where(F.col("c") <= most)
    late = (F.col("doc") != F.col("f.doc")) | (F.col("line_no") != F.col("f.line_no"))
    of_hot = table.join(F.broadcast(hot), F.col("key") == F.col("k"))
    of_cold = table.join(F.broadcast(hot.select("k")), F.col("key") == F.col("k"), "left_anti").join(cold, F.col("key") == F.col("k"))
    return of_hot.where(late).select("doc", "line_no").union(of_cold.where(late).select("doc", "line_no"))


def _asked(posts: DataFrame, again: DataFrame, unit: type) -> DataFrame:
    """Of posts the postings of the words that again has; of more than MOST_ASKED words all postings of their buckets."""

    def words_of(batches):
        for b in batches:
            yield {"word": np.unique(_unpacked(b["posts"], unit.columns)[0]["word"])}

    asked = stored(arrow_map(again.select("posts"), words_of, "word bigint").distinct(), "words-asked")
    if asked.count() > MOST_ASKED:
        buckets = again.select(F.col("bucket").alias("asked")).distinct()
        return posts.join(buckets, F.col("bucket") == F.col("asked"), "left_semi")
    sent = posts.sparkSession.sparkContext.broadcast(np.sort(asked.toPandas()["word"].to_numpy()))

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            out = {"bucket": [], "posts": []}
            for bucket, posted in zip(b["bucket"], b["posts"], strict=True):
                cols = _unpacked([posted], unit.columns)[0]
                at = np.minimum(np.searchsorted(sent.value, cols["word"]), len(sent.value) - 1)
                good = sent.value[at] == cols["word"]
                if good.any():
                    out["bucket"].append(bucket)
                    out["posts"].append(press.compress(b"".join(cols[k][good].tobytes() for k in unit.columns)))
            yield out

    return arrow_map(posts.select("bucket", "posts"), run, "bucket bigint, posts binary")


def dropped_lines(docs: DataFrame, least: int = LEAST_WORDS, unit: type = Lines, named: DataFrame | None = None) -> DataFrame:
    """doc_id, lines: the numbers of the lines that go, ascending, of documents that lose any.

    Lines of fewer than least words always stay. Null texts have no lines.
    doc_id must tell the rows apart (see identified); one null comes first.
    unit: what makes sets of texts. named: more candidates, as of candidates().
    """
    table, counts = survey(docs, least, unit)
    copies = _repeats(table)
    copies, n = _by_doc(copies, "line-copies")
    posts = stored(postings(_with_lines(docs, copies, n, "left"), counts, least, unit=unit), "line-postings")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(buckets_of(counts) // BUCKETS_A_TASK, MOST_PARTS))
    pairs = stored(candidates(posts, parts=parts, unit=unit), "line-pairs")
    late = stored(similar(docs, pairs if named is None else pairs.unionByName(named), least, unit), "line-later")
    open_ = pairs.groupBy("doc", "line_no").agg(F.max("more").alias("more")).where("more").select("doc", "line_no").join(late, ["doc", "line_no"], "left_anti")
    open_, n = _by_doc(open_, "lines-open")
    if n:
        again = stored(postings(_with_lines(docs, open_, n, "inner"), counts, least, inside=True, unit=unit), "line-postings-again")
        flagged = _asked(posts, again, unit).withColumn("again", F.lit(False)).union(again.withColumn("again", F.lit(True)))
        late = late.union(similar(docs, stored(candidates(flagged, parts=parts, unit=unit), "line-pairs-again"), least, unit))
    lost = copies.select("doc", F.explode("lines").alias("line_no")).union(late)
    lost = lost.groupBy("doc").agg(F.array_sort(F.collect_set("line_no")).alias("lines"))
    return lost.select(F.when(F.col("doc") != _NULL, F.col("doc")).alias("doc_id"), "lines")


def dedup(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """docs, all columns, without the lines that go; n_lines and n_removed are added.

    A text that loses nothing is unchanged, null included. Rows are told apart
    by an identity of their own: those that share a doc_id, or have none, are
    documents of their own, whose order among each other is any fixed one.
    """
    own = identified(docs)
    of, lost_lines = fresh(own, "lines_of"), fresh(own, "lost_lines")
    gone = dropped_lines(own.select(F.col(ROW).alias("doc_id"), "text"), least)
    lost = stored(gone.select(F.col("doc_id").alias(of), F.col("lines").alias(lost_lines)), "lines-lost")
    n = lost.agg(F.sum(F.size(lost_lines) + 2)).first()[0] or 0
    side = F.broadcast(lost) if n <= 4 * BROADCAST_ROWS else lost
    joined = own.join(side, F.col(of) == own[ROW], "left")
    lines = F.split(F.col("text"), "\n")
    breaks = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col(lost_lines), i)), "\n")
    joined = joined.withColumns({
        "n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(breaks + 1).cast("long"),
        "n_removed": F.when(F.col(lost_lines).isNull(), F.lit(0)).otherwise(F.size(lost_lines)).cast("long"),
    })
    out = joined.withColumn("text", F.when(F.col(lost_lines).isNull(), F.col("text")).otherwise(kept)).drop(of, lost_lines)
    return out if ROW in docs.columns else out.drop(ROW)
