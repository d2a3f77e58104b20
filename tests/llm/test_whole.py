"""Whole jobs: what earlier versions left out."""

import random

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from quarry.llm import grulm, langid, linededup, packing
from quarry.llm.tokens import Encoder

PIPE_DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sentence(i):
    return " ".join(f"word{i}x{k}" for k in range(12))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], PIPE_DDL)


def run_stages(spark, docs, upto):
    for _, stage in corpus_pipeline.STAGES[:upto]:
        docs = corpus_pipeline.stored(stage(spark, docs, ""), "whole")
    return docs


def test_rows_without_an_id_of_their_own(spark):
    own = [(None, sentence(1), "en"), (None, None, "en"), (None, "123 !", "en"), (None, sentence(2), "en"), (7, sentence(3), "en"), (7, "?? 4", "en")]
    copies = [(7, sentence(3), "en"), (None, sentence(2), "en"), (8, sentence(4), "en")]
    left = run_stages(spark, documents(spark, own), 1).collect()
    assert sorted(r.text for r in left) == [sentence(1), sentence(2), sentence(3)]
    stages = documents(spark, own + copies)
    left = run_stages(spark, stages, 3).collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == [(0, sentence(1)), (0, sentence(2)), (7, sentence(3)), (8, sentence(4))]
    near = corpus_pipeline.near(spark, stages.where("text LIKE 'word%'"), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in near) == [(0, sentence(1)), (0, sentence(2)), (7, sentence(3)), (8, sentence(4))]


def test_line_dedup_of_repeated_ids(spark):
    rows = [(None, f"{sentence(1)}\n{sentence(2)}", "en"), (None, f"{sentence(3)}\n{sentence(1)}", "en"), (5, sentence(4), "en"), (5, sentence(4), "en")]
    got = linededup.dedup(documents(spark, rows)).collect()
    assert sum(r.n_removed for r in got) == 2
    assert sorted(x for r in got for x in r.text.split("\n") if x) == sorted(sentence(i) for i in (1, 2, 3, 4))


def shingles(text, k=5):
    found = text.encode().lower().split()
    return {tuple(found[i : i + k]) for i in range(max(1, len(found) - k + 1))} if found else set()


def test_near_dedup_finds_every_pair_of_similarity(spark):
    rng, rows = random.Random(4), []
    for i in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((1, 3, 5, 12, 60, 150, 400)))]
        rows.append(" ".join(base))
        for _ in range(3):
            other = list(base)
            for _ in range(rng.randrange(1 + len(base) // 30)):
                other[rng.randrange(len(other))] = f"new{rng.randrange(10**6)}"
            rows.append(" ".join(other[: len(other) - rng.randrange(1 + len(base) // 10)]))
    docs = documents(spark, [(i, t, "en") for i, t in enumerate(rows)]).union(
        spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").where("text IS NOT NULL").withColumn("doc_id", F.expr("doc_id + 1000"))
    )
    seen, want = [], set()
    for i, t in sorted((r.doc_id, r.text) for r in docs.collect()):
        own = shingles(t)
        like = [s for s in seen if own and 5 * len(own & s) >= 4 * len(own | s)]
        seen.append(own)
        if not like:
            want.add(i)
    got = {r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()}
    assert got == want and len(want) < len(seen) - 60


def test_pipeline_gives_the_packed_ids(spark):
    docs = documents(spark, [(i, " ".join(map(sentence, range(i, 9 * i))), "en") for i in range(1, 9)])
    own = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: np.append(np.frombuffer(own(r.text), "<u4"), 1).tolist() for r in docs.collect()}
    got = {}
    for r in sorted(corpus_pipeline.pack(spark, docs, "").collect(), key=lambda r: r.start):
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got == want


def test_language_stage_without_labels(spark):
    docs = documents(spark, [(1, sentence(1), None), (2, "12 !?", None), (3, sentence(2), None), (4, None, None)])
    left = corpus_pipeline.language(spark, docs, "").collect()
    assert sorted((r.doc_id, r.lang) for r in left) == [(1, None), (3, None)]


def test_language_decision_takes_effect(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text IS NOT NULL AND lang IS NOT NULL")
    docs = docs.select("doc_id", "text", F.expr("if(doc_id % 4 = 0, null, lang)").alias("lang"), "source", "n_chars", F.col("lang").alias("truth"))
    pairs = corpus_pipeline.language(spark, docs.drop("truth"), "").join(docs.select("doc_id", "truth"), "doc_id").where("doc_id % 4 = 0").collect()
    assert pairs and sum(r.lang == r.truth for r in pairs) >= 0.9 * len(pairs)
    codes = langid.codewords(2)
    none = langid.Model(["en", "fr"], codes, np.zeros((langid.DIM + 1, codes.shape[1]), np.float32))
    monkeypatch.setattr(langid, "fit", lambda docs: none)  # to it every text is ambiguous, and en the best
    left = corpus_pipeline.language(spark, documents(spark, [(1, "a text", None), (2, "a text", "en"), (3, "a text", "fr")]), "")
    assert [(r.doc_id, r.lang) for r in left.collect()] == [(2, "en")]


def test_short_lines_and_lines_without_blanks(spark):
    chinese = "这是一个没有空格的段落，它在两个文档里重复出现。"
    rows = [(1, f"Read more\n{chinese}\n\none two three four", "en"), (2, f"{chinese}\n\nread  MORE\nx", "en"), (3, "one two three four five\nx\n\n", "en")]
    got = {r.doc_id: r for r in linededup.dedup(documents(spark, rows)).collect()}
    assert [got[i].text for i in (1, 2, 3)] == [rows[0][1], "\nx", "\n"]
    assert [got[i].n_removed for i in (1, 2, 3)] == [0, 2, 2]


def test_lm_learns_from_all_documents_whole(spark):
    rng, cycle = random.Random(1), [f"c{k}" for k in range(10)]
    texts = [" ".join([f"a{rng.randrange(10)}" for _ in range(700)] + cycle * 70) for _ in range(120)]
    scorer, _ = grulm.fit(documents(spark, [(i, t, "en") for i, t in enumerate(texts)]), F.lit(True), sample=2)
    tail = scorer.entries([" ".join(cycle * 70)])[0]
    assert scorer.gru.score([tail])[0] / len(tail) > -0.5  # a word of its cycle is one of twenty without learning, -1.3


def test_packing_keeps_few_pieces(spark, monkeypatch):
    texts = [" ".join(f"Name{chr(97 + i % 26)}{chr(97 + k % 26)}{chr(97 + k // 26)} {sentence(i * k)}" for k in range(60)) for i in range(6)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    few, many = Encoder(path, 50), Encoder(path)
    assert [few(t) for t in texts] == [many(t) for t in texts] == [many.whole(t) for t in texts]
    assert max(len(x) for c in (few.heads, few.rest) for x in (c, c.old)) <= 50 < len(many.rest)
    asked = []
    monkeypatch.setattr(packing, "pack_texts", lambda docs, *a, **options: asked.append(options["pieces"]))
    corpus_pipeline.pack(spark, None, "")
    assert asked == [corpus_pipeline.PIECES] and corpus_pipeline.PIECES <= 1 << 16


def test_near_copies_go_whole(spark, tmp_path):
    text = [sentence(i) for i in range(20)]
    rows = [(1, "\n".join(text)), (2, "\n".join([*text[:9], sentence(90), *text[10:]])), (3, "\n".join([*text[:4], *map(sentence, range(40, 60))])), (4, sentence(91))]
    for name, own in (("once", rows), ("repeated", [(i if i == 4 else None if i == 1 else 7, t) for i, t in rows])):
        docs = documents(spark, [(i, t, "en") for i, t in own])
        docs.coalesce(1).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        packed = corpus_pipeline.run(spark, f"{tmp_path}/{name}").where("start = 0").collect()
        tokens = {len(Encoder(public_tokenizers.path("byte_bpe_50k.json"))(t)) // 4 + 1 for t in (rows[0][1], "\n".join(map(sentence, range(40, 60))), rows[3][1])}
        assert {r.doc_tokens for r in packed} == tokens and len(packed) == 3
    left = spark.read.parquet(f"{tmp_path}/once/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        left = corpus_pipeline.stored(stage(spark, left, f"{tmp_path}/once"), "stage")
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 4]
