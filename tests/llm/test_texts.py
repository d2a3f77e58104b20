"""Operators on texts, against plain versions that look at everything."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import bpe, iblt, langid, linededup, packing, planes, simhash
from quarry.llm.graph import roots
from quarry.llm.tokens import Encoder
from quarry.llm.words import words
from tests.llm.cases import rows, table

SF = "/root/testdata/sf0.001"
TEXTS = [r[1] for r in rows()]


def docs_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_matches_library(spark, name):
    own, lib = Encoder(P.path(name)), library(name)
    more = [r.text for r in docs_of(spark).select("text").collect()]
    odd = ["", " ", "a ", " a", "a  b", "a \n b", "\n\n a", "x" * 3000, "don't 'S", "ǅ ß ẞ", "a b c", "１２ ½ ²", "a-b_c d", "é ́ a", "ΑΣ Σ"]
    for t in [t or "" for t in TEXTS] + odd + more:
        assert np.frombuffer(own(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t[:80]


def test_encoder_cache_is_bounded(monkeypatch):
    from quarry.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_PIECES", 3)
    own, lib = Encoder(P.path("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    text = " ".join(f"w{i % 7}" for i in range(60))
    assert np.frombuffer(own(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids
    assert len(own.rest) <= 3 and len(own.rest.old) <= 3


def test_bpe_round_trip(spark, monkeypatch):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.round_trip(table(spark), path, P.PATTERN).collect()
    want = [(r[0], lib.encode_ordinary(r[1] or ""), r[1] or "") for r in rows()]
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == Counter(
        (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, ids, t in want
    )
    monkeypatch.setattr(bpe, "LONG", 40)
    own = bpe.RankCodec(path, P.PATTERN)
    for t in filter(None, TEXTS):
        assert [i for p in own.parts(t, 40) for i in own.library.encode_ordinary(p)] == lib.encode_ordinary(t)
    assert bpe.round_trip(table(spark, True), path, P.PATTERN).count() == 0
    ids = bpe.encode(table(spark), path, P.PATTERN)
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(ids, path, P.PATTERN).collect()}
    assert back[7] == TEXTS[7].encode() and back[3] == b""


def check_packing(got, want, size):
    """want: list of (doc_id, ids)."""
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    for doc_id, ids in {d: i for d, i in want}.items():
        n = sum(d == doc_id for d, _ in want)
        own = sorted(by_doc[doc_id], key=lambda r: r.start)
        assert sum(r.length for r in own) == n * len(ids)
        for r in own:
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append(r)
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    total = sum(len(i) for _, i in want)
    assert len(seqs) * size <= total * 1.01 + size


def test_packing(spark):
    lib = library("byte_bpe_50k.json")
    ids = lambda t: lib.encode(t or "", add_special_tokens=False).ids + [1]
    docs = docs_of(spark)
    got = packing.pack_texts(docs.repartition(3), P.path("byte_bpe_50k.json"), 1).collect()
    check_packing(got, [(r.doc_id, ids(r.text)) for r in docs.collect()], 2048)
    hard = packing.pack_texts(table(spark), P.path("byte_bpe_50k.json"), 1, size=64, open_windows=2, with_ids=True)
    check_packing(hard.collect(), [(r[0], ids(r[1])) for r in rows()], 64)
    seqs = packing.sequences(hard).collect()
    assert sum(len(r.ids) for r in seqs) == sum(len(ids(r[1])) for r in rows()) and max(len(r.ids) for r in seqs) <= 64
    assert packing.pack_texts(table(spark, True), P.path("byte_bpe_50k.json"), 1).count() == 0


def test_planes(spark, tmp_path):
    lib = library("word_bpe_49k.json")
    for parts in (1, 3):
        got = planes.round_trip(table(spark), P.path("word_bpe_49k.json"), 2, parts).collect()
        want, at = [], 0
        for r in sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
            ids = lib.encode(r[1] or "", add_special_tokens=False).ids + [2]
            want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        assert Counter(want) == Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got)
    assert planes.round_trip(table(spark, True), P.path("word_bpe_49k.json"), 2, 3).count() == 0
    for n_planes in (4, 32):
        name = tmp_path / f"{n_planes}.qpl"
        with open(name, "wb") as f:
            out = planes.PlaneWriter(f, 100, n_planes)
            sent = [(i, np.arange(n, dtype="<u4") * 70001) for i, n in enumerate((0, 1, 99, 100, 101, 950, 0))]
            for i, ids in sent:
                out.add(i, ids.tobytes())
            out.close()
        with open(name, "rb") as f:
            back = list(planes.PlaneReader(f).documents())
        assert [(i, x.tolist()) for i, x in back] == [(i, x.tolist()) for i, x in sent]
        with open(name, "r+b") as f:
            f.seek(-3, 2)
            f.write(b"zzz")
            with pytest.raises(ValueError):
                planes.PlaneReader(f)


def plain_fingerprint(text, k):
    found = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(found[i : i + k]) for i in range(max(1, len(found) - k + 1))] if found else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    ids, root = [i for i, _ in prints], {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in itertools.combinations(prints, 2):
        if bin(a ^ b).count("1") <= 4:
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark):
    docs = docs_of(spark).select("doc_id", "text").union(table(spark).where("doc_id IS NOT NULL").selectExpr("doc_id + 100000", "text")).distinct()
    prints = [(r.doc_id, plain_fingerprint(r.text, 4)) for r in docs.collect()]
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_groups(docs).collect()}
    assert {i: fp for i, (fp, _) in got.items()} == dict(prints)
    assert {i: c for i, (_, c) in got.items()} == plain_components(prints)
    assert simhash.near_groups(table(spark, True)).count() == 0
    assert simhash.near_groups(table(spark)).count() == len(rows())


def plain_roots(fps, most):
    """The least fingerprint that each reaches over pairs of at most so many bits."""
    x, left, out = np.array(fps, np.uint64), set(range(len(fps))), {}
    while left:
        todo, own = [left.pop()], []
        while todo:
            i = todo.pop()
            own.append(i)
            new = left & set(np.flatnonzero(np.bitwise_count(x ^ x[i]) <= most).tolist())
            left -= new
            todo += new
        out |= dict.fromkeys((fps[i] for i in own), min(fps[i] for i in own))
    return out


def linked_roots(spark, fps, most):
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), most).toPandas()
    number = {f: i for i, f in enumerate(sorted(fps))}
    ends = [np.array([number[int(v) & (1 << 64) - 1] for v in got[c]], int) for c in ("src", "dst")]
    least = roots(len(fps), *ends)
    return {f: sorted(fps)[least[number[f]]] for f in fps}, len(got)


@pytest.mark.parametrize("most,shard", [(4, 1 << 16), (5, 1 << 16), (4, 7)])
def test_simhash_links_join_every_pair(spark, monkeypatch, most, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)) for b in base for n in (1, 2, 3, 4, 5, 5, 5, 6)]
    fps = list(dict.fromkeys([*map(int, base), *near, 0, 1, (1 << 64) - 1]))
    assert linked_roots(spark, fps, most)[0] == plain_roots(fps, most)


def test_simhash_dense_group(spark):
    rng = np.random.default_rng(6)
    fps = list(dict.fromkeys(int(0x0123456789ABCDEF) ^ sum(1 << int(k) for k in rng.choice(64, 3, replace=False)) for _ in range(40_000)))
    fps = fps[:20_000] + rng.integers(0, 1 << 63, 500).tolist()
    got, n = linked_roots(spark, fps, 4)
    assert got == plain_roots(fps, 4) and n <= 50 * len(fps)


def test_simhash_links_rows_without_an_id(spark):
    own = [(None, "a b c d e f"), (7, "a b c d e f"), (None, "only here, without an id"), (None, None), (9, "")]
    prints = [simhash.fingerprint(t) for _, t in own]
    got = Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_groups(spark.createDataFrame(own, "doc_id bigint, text string")).collect())
    assert got == Counter(zip((None, 7, None, None, 9), prints, (7, 7, None, 9, 9), strict=True))


def test_words():
    w = words(TEXTS)
    want = [(i, x) for i, t in enumerate(TEXTS) for x in (t or "").encode().lower().split()]
    got = [(int(o), w.raw[a:b]) for o, a, b in zip(w.owner, w.starts, w.ends, strict=True)]
    assert got == want
    names = defaultdict(set)
    for h, (_, x) in zip(w.hashes.tolist(), want, strict=True):
        names[h].add(x)
    assert all(len(x) == 1 for x in names.values()) and len(names) == len({x for _, x in want})


def test_counts_bound_what_sets_share():
    rng = random.Random(3)
    for _ in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((1, 3, 9, 40, 700)))]
        other = base[: rng.randrange(len(base) + 1)] + [f"v{rng.randrange(10**6)}" for _ in range(rng.choice((1, 8, 300)))]
        x, y = (linededup.Lines([" ".join(t)], 1) for t in (base, other))
        x.distinct(), y.distinct()
        assert linededup.most_shared(linededup._counts(x)[0], linededup._counts(y)[0]) >= len(set(base) & set(other))
        assert linededup.most_shared(linededup._counts(x)[0], linededup._counts(x)[0]) == len(set(base))


def test_iblt_differences():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    old = [pool[:0], pool[:5], pool[:900], pool[:30], pool[:3]]
    new = [pool[:0], pool[:5], pool[500:3000], pool[1000:1040], pool[:0]]
    for (a, b), x, y in zip(zip(old, new, strict=True), *iblt.differences(old, new), strict=True):
        assert set(x.tolist()) == set(a.tolist()) - set(b.tolist())
        assert set(y.tolist()) == set(b.tolist()) - set(a.tolist())


def test_iblt(spark):
    for docs in (docs_of(spark), table(spark)):
        own = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        for parts in (1, 5):
            got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in iblt.compare_with_edits(docs, parts).collect())
            want = Counter()
            for i, (doc_id, text) in enumerate(own):
                text, following = text or "", own[(i + 1) % len(own)][1] or ""
                n = len(text) // 4
                changed = text[: len(text) - n] + following[:n]
                jac = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
                sets = [set(iblt.digests(t).tolist()) for t in (text, changed, following)]
                want[(doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), iblt.fingerprints([iblt.digests(text)])[0][0], round(jac(sets[0], sets[1]), 9), round(jac(sets[0], sets[2]), 9))] += 1
            assert got == want
    assert iblt.compare_with_edits(table(spark, True), 3).count() == 0


def test_langid(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where("doc_id % 3 <> 0"))
    got = langid.predict(docs.where("doc_id % 3 = 0"), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    hard = {r.doc_id: r.lang_pred for r in langid.predict(table(spark), model).collect()}
    assert [hard[i] for i in (3, 4, 5, 6)] == ["und"] * 4 and hard[0] == "en" and hard[18] in model.langs
    odd = spark.createDataFrame([(1, "½ ² 12 Ⅻ"), (2, "½ ² 12 é"), (3, None)], "doc_id bigint, text string")
    assert {r.doc_id: r.lang_pred == "und" for r in langid.predict(odd, model).collect()} == {1: True, 2: False, 3: True}
    none = langid.fit(table(spark, True))
    assert {r.lang_pred for r in langid.predict(table(spark), none).collect()} == {"und"}
    for n in (1, 2, 3, 4, 7, 30):
        codes = langid.codewords(n)
        assert len({tuple(c) for c in codes.tolist()}) == n


def test_langid_flags_what_lies_between(spark):
    text = {"aa": "ba be bi bo bu " * 30, "bb": "xq xz xv xw xk " * 30}
    rows = [(i, f"{text[g]}{i}", g) for i in range(20) for g in text]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    own = spark.createDataFrame([(1, text["aa"]), (2, text["bb"]), (3, "lmno lmno")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in langid.predict(own, model).collect()}
    assert (got[1].lang_pred, got[2].lang_pred) == ("aa", "bb") and not got[1].ambiguous and not got[2].ambiguous and got[3].score < got[1].score
    flat = langid.Model(["aa", "bb"], langid.codewords(2), np.zeros((langid.DIM + 1, 1), np.float32))
    assert all(r.ambiguous for r in langid.predict(own, flat).collect())


def test_langid_learns_whole_texts_of_every_language(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda g, k: letters[g % 26] + letters[g // 26] + letters[k % 5]
    rows = [(f"{'12 ' * 1500}{' '.join(word(g, k + i) for k in range(40))}", f"l{g:03d}") for g in range(250) for i in range(2)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.langs) == 250
    own = spark.createDataFrame([(g, " ".join(word(g, k) for k in range(30))) for g in range(250)], "doc_id bigint, text string")
    got = langid.predict(own, model).collect()
    assert sum(r.lang_pred == f"l{r.doc_id:03d}" for r in got) >= 225


def plain_line_dedup(docs, least=linededup.LEAST_WORDS):
    lines = [(i, k, x) for i, t in docs for k, x in enumerate((t or "").split("\n"))]
    lines.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    seen, gone = [], defaultdict(list)
    for i, k, x in lines:
        found = x.encode().lower().split()
        own = set(found)
        if len(found) < least:
            continue
        if any(5 * len(own & s) >= 4 * len(own | s) for s in seen):
            gone[i].append(k)
        seen.append(own)
    return dict(gone)


@pytest.mark.parametrize("hot", [1 << 17, 0])
def test_line_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(linededup, "HOT_WORD", hot)
    monkeypatch.setattr(linededup, "HOT_WORD_SHARE", 11 if hot else 60)  # 0: every word is posted in pairs
    docs = docs_of(spark).select("doc_id", "text").where("length(text) < 4000")
    base = [f"w{i}" for i in range(40)]
    near = [(200000 + i, " ".join(base[:i] + [f"new{i}"] + base[i + 1 :]) + f"\nplain line number {i} of five words") for i in range(40)]
    docs = docs.union(spark.createDataFrame(near, "doc_id bigint, text string"))
    want = plain_line_dedup([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: r.lines for r in linededup.dropped_lines(docs).collect()} == want
    # the second look names every similar pair
    _, counts = linededup.survey(docs)
    posts = linededup.postings(docs.select("doc_id", "text", F.expr("cast(null as array<int>)").alias("lines")), counts).withColumn("again", F.lit(True))
    got = {((r.old_doc, r.old_line), (r.doc, r.line_no)) for r in linededup.candidates(posts).collect()}
    sets = {(r.doc_id, k): set(x.encode().lower().split()) for r in docs.collect() for k, x in enumerate(r.text.split("\n")) if x.strip()}
    assert {(x, y) for x, y in itertools.combinations(sorted(sets), 2) if 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]) and len(sets[x]) >= linededup.LEAST_SET} <= got
    hard = linededup.dedup(table(spark).dropDuplicates(["doc_id"]))
    assert hard.columns[: len(table(spark).columns)] == table(spark).columns
    own = {r.doc_id: r for r in hard.collect()}
    assert own[3].text is None and own[4].text == "" and own[0].text == TEXTS[0] and own[1].text == "" and own[10].text.startswith("short")
    assert linededup.dedup(table(spark, True)).count() == 0
