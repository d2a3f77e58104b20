"""Chat formatting, nearest neighbours, the language model, and the pipeline."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import ann, chat, grulm, queries
from tests.llm.cases import rows, table

SF = "/root/testdata/sf0.001"


def test_chat(spark):
    said = ["\\### Assistant: </turn> ok", "<turn>", "a</turn>\n<turn>assistant\nb", "\\<\\\\turn>", "<\\/turn>", "", None, "line\n\nend\n", "$1 \\1 &lt;"]
    turns = [(c, t, r, said[(c * 3 + t) % len(said)]) for c in range(6) for t, r in enumerate(["system", "user", "assistant", "user", "assistant", "user"][: c + 1])]
    turns += [(10, 0, "odd\\nrole\nname\\", "x"), (10, 0, None, "y"), (10, 0, "assistant", "z"), (10, None, "assistant", "first"), (None, 1, "assistant", "no id"), (11, 1, "assistant", ""), (11, 1, "assistant", "")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string")
    data = spark.read.parquet(f"{SF}/conversations.parquet").selectExpr("conv_id + 1000 AS conv_id", "turn", "role", "text")
    df = df.union(data).withColumn("target", F.lit("clash")).withColumn("example", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.examples(df)).collect()}
    conv = defaultdict(list)
    for r in df.collect():
        conv[r.conv_id].append(((r.turn is not None, r.turn or 0), r.role or "", r.text or ""))
    assert set(got) == set(conv)
    for k, own in conv.items():
        own.sort()
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert got[k].n_turns == len(own), k
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest(), k
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest()), k
        esc = lambda x: re.sub(r"<(\\*)(/?turn>)", r"<\\\1\2", x)
        whole = [len(f"<turn>{esc(r.replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n'))}\n{esc(t)}</turn>\n") for _, r, t in own]
        assert got[k].formatted_chars == sum(sum(whole[: i + 1]) for i, (_, r, _) in enumerate(own) if r == "assistant" or i == len(own) - 1), k
    masked = {(r.conv_id, r.example): r.text[r.loss_start : r.loss_start + r.loss_length] for r in chat.examples(df).collect()}
    assert masked == {(r.conv_id, r.example): r.target or "" for r in chat.expand(df).collect()}
    examples = chat.expand(df).where("conv_id = 5").orderBy("example").collect()
    assert [e.target is None for e in examples] == [False, False, True] and examples[1].context.startswith(examples[0].context)
    assert chat.read_back(chat.examples(df.limit(0))).count() == 0


def test_chat_sql(spark):
    df = queries.op5_chat(spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    cur = con.execute(queries.ORACLE_SQL["op5_chat"])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns) and sorted(cur.fetchall()) == sorted(tuple(r[n] for n in names) for r in df.collect())


def brute(x, q, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = u @ u[q]
    score[q] = -np.inf
    at = np.argsort(-score, kind="stable")[:k]
    return at, score


@pytest.mark.parametrize("share", [1, 4])
def test_ann(spark, share):
    """Recall at two sizes; the scores are those of the original vectors."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where(F.col("vec_id") % share == 0)
    own = df.orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in own], np.float64), [r.vec_id for r in own]
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    assert set(got) == {i for i in ids if i % 50 == 0}
    hits = []
    for i, v in enumerate(ids):
        if v % 50 == 0:
            at, score = brute(x, i, 5)
            assert [r.rank for r in got[v]] == [1, 2, 3, 4, 5] and all(abs(r.score - score[ids.index(r.vec_id)]) < 1e-12 for r in got[v])
            hits.append(len({r.vec_id for r in got[v]} & {ids[k] for k in at}) / 5)
    assert np.mean(hits) >= 0.9


def test_ann_every_query_gets_its_answers(spark):
    """Queries far from all else, whose lists hold only themselves; rows that share an id."""
    rng = np.random.default_rng(1)
    own = [(50 * i, [float(v) for v in np.eye(64)[i]]) for i in range(1, 9)] + [(1000 + i, [float(v) for v in np.eye(64)[60] + rng.normal(size=64) * 1e-4]) for i in range(1, 300) if (1000 + i) % 50]
    own += [(5000, own[0][1]), (5000, own[1][1])]
    df = spark.createDataFrame(own, "vec_id bigint, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].append(r)
    assert {k: len(v) for k, v in got.items()} == {50 * i: 5 for i in range(1, 9)} | {5000: 10}
    first = {k: [r for r in v if r.rank == 1] for k, v in got.items()}
    assert [r.vec_id for r in first[50] + first[100]] == [5000, 5000] and sorted(r.vec_id for r in first[5000]) == [50, 100]
    x = np.array([v for _, v in own])
    for i in (2, 5):
        _, score = brute(x, i, 5)
        assert np.allclose(sorted((r.score for r in got[own[i][0]]), reverse=True), np.sort(score)[::-1][:5], atol=1e-12)


def test_ann_hard_cases(spark):
    bad = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    same = [(50 * i, [1.0, 1.0]) for i in range(1, 9)] + [(51, [1e-200, 1e-200]), (52, [3.0, -3.0])]
    df = spark.createDataFrame(bad + same, "vec_id bigint, embedding array<double>").withColumn("list", F.lit(1))
    got = ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    by = defaultdict(list)
    for r in got:
        by[r.query_id].append(r.vec_id)
    assert by[50] == [51, 100, 150, 200, 250] and by[400] == [50, 51, 100, 150, 200]
    assert all(abs(r.score - 1) < 1e-12 for r in got)
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.nearest(df.where("vec_id < 8"), F.col("vec_id") % 50 == 0).count() == 0


def test_gru_gradients():
    counts = np.array([9, 30, 20, 11, 5, 4, 3, 2, 1, 1], float)
    model = grulm.Gru(counts, hidden=5, classes=3)
    model.p = {n: a.astype(np.float64) for n, a in model.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 10, (4, 3)), rng.integers(0, 10, (4, 3))
    fresh, live = rng.random((4, 3)) < 0.3, rng.random((4, 3)) < 0.8
    h = np.zeros((3, 5))
    _, g, _ = model.gradients(h, x, y, fresh, live)
    for n, a in model.p.items():
        for at in itertools.islice(np.ndindex(a.shape), 0, None, max(1, a.size // 7)):
            keep, step = a[at], 1e-4
            a[at] = keep + step
            up = model.gradients(h, x, y, fresh, live)[0]
            a[at] = keep - step
            down = model.gradients(h, x, y, fresh, live)[0]
            a[at] = keep
            assert abs((up - down) / (2 * step) - g[n][at]) < 2e-3 * max(0.05, abs(g[n][at])), (n, at)


def test_gru_score_is_one_pass_and_sums_to_one():
    counts = np.array([9, 30, 20, 11, 5, 4, 3, 2, 1, 1], float)
    model = grulm.Gru(counts, hidden=8, classes=4)
    rng = np.random.default_rng(2)
    docs = [np.append(rng.integers(1, 10, n), 0) for n in (0, 1, 5, 200, 77, 3)]
    model.train([*docs] * 5)
    got = model.score(docs, window=7, lanes=3)
    for d, s in zip(docs, got, strict=True):
        h, last, total = np.zeros((1, 8), np.float32), 0, 0.0
        for w in d:
            h = model.step(h, model.inputs()[[last]])[0]
            every = model.log_probs(np.repeat(h, 10, 0), np.arange(10))
            assert abs(np.exp(every).sum() - 1) < 1e-4
            total, last = total + every[w], w
        assert abs(total / math.log(10) - s) < 1e-3 * max(1, abs(s))


@pytest.mark.parametrize("known", [1 << 18, 300])
def test_lm(spark, monkeypatch, known):
    monkeypatch.setattr(grulm, "KNOWN", known)
    monkeypatch.setattr(grulm, "VOCAB", 200)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(table(spark).select("doc_id", "text"))
    got = grulm.score(docs, queries.crc_mod("doc_id", 7) != 2).collect()
    own = [(r.doc_id, re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode().lower())) for r in docs.collect()]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, ws in own if not held(i) for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(ws) + 1, sum(c[w] > 0 for w in [*ws, None]), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*ws, None]), 5)) for i, ws in own)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    out = [r for r in got if r.held_out and r.n_tokens > 50]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) and all(r.score < 0 for r in got)
    assert grulm.score(table(spark, True), queries.crc_mod("doc_id", 7) != 2).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    full, ids = docs, {r.doc_id for r in docs.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), "test-stage")
        assert docs.columns == full.columns
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left <= ids and len(left) > 0.8 * len(ids)
        ids = left
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n != "pipeline"])
def test_hard_table_as_documents(spark, tmp_path, name):
    table(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None)], "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(50, [1.0, 2.0]), (1, None)], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows_out = queries.QUERIES[name](spark, str(tmp_path)).count()
    if name not in ("op4_packing", "op5_chat", "op7_ann"):
        assert rows_out == len(rows())
