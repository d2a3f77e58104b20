"""A gated recurrent language model in numpy, scoring whole documents.

Words that are frequent in the training documents are the model's
vocabulary; all others share one entry and are told apart by their corpus
counts. The output softmax is factored: first a class of words of like
frequency, then the word in its class. The state runs through a document from
its first word to its end, window after window.
"""

from __future__ import annotations

import copy
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import added, arrow_map, stored
from quarry.llm.words import chunks, words

#: Model: vocabulary, hidden numbers, classes. Words whose counts every task gets (16 bytes each), as a bound.
VOCAB, HIDDEN, CLASSES, KNOWN = 4096, 16, 32, 1 << 18
#: Training of the weights: documents of the start (one a slot of hashed texts), window, lanes, epochs of the start, rate.
SAMPLE, WINDOW, LANES, EPOCHS, RATE = 2000, 16, 64, 2, 6e-3
#: The pass over all documents: most lanes, steps that few entries are cut into, entries that a task takes at once, weights in a row of what tasks send.
PASS_LANES, PASS_STEPS, PASS_ENTRIES, PASS_BLOCK = 512, 200, 1 << 20, 1 << 13
#: Counts that a task holds before it sends them.
HELD_WORDS = 1 << 20
#: Tokens that are scored side by side: enough lanes beside one long document.
SCORED = 1 << 21
END, RARE = 0, 1


#: Logits are kept within these, so that sums of their exponentials stay finite and above zero in single precision.
LOGIT = 80


def _sigmoid(x):
    """In place."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _softened(a):
    """Exponentials of clipped logits, in place, and the sums of rows."""
    np.clip(a, -LOGIT, LOGIT, out=a)
    np.exp(a, out=a)
    return a, a @ np.ones(a.shape[1], a.dtype)


class Gru:
    """Weights and the passes over one window of lanes. Entry 0 ends a document, entry 1 stands for all rare words."""

    def __init__(self, counts: np.ndarray, hidden: int = HIDDEN, classes: int = CLASSES, seed: int = 3):
        rng, v = np.random.default_rng(seed), len(counts)
        order = np.argsort(-counts, kind="stable")
        weight = np.sqrt(counts[order] + 1.0)
        of = np.minimum((np.cumsum(weight) - weight / 2) / weight.sum() * classes, classes - 1).astype(int)
        self.cls = np.zeros(v, int)
        self.cls[order] = np.unique(of, return_inverse=True)[1]
        self.n_classes = int(self.cls.max()) + 1
        # outputs are laid out class after class
        place = np.argsort(self.cls, kind="stable")
        self.slot = np.empty(v, int)
        self.slot[place] = np.arange(v)
        self.edges = np.searchsorted(self.cls[place], np.arange(self.n_classes + 1))
        self.cls = self.cls.astype(np.int16)
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        logp = np.log(counts + 1.0)
        per = np.log(np.add.reduceat(counts[place] + 1.0, self.edges[:-1]))
        self.p = {
            "E": (rng.standard_normal((v, hidden)) * 0.1).astype(np.float32), "W": init(hidden, 3 * hidden), "U": init(hidden, 3 * hidden), "b": np.zeros(3 * hidden, np.float32),
            "C": init(hidden, self.n_classes) * 0.1, "c": (per - np.log(np.exp(per - per.max()).sum()) - per.max()).astype(np.float32),
            "O": (rng.standard_normal((v, hidden)) * 0.01).astype(np.float32), "o": (logp - per[self.cls])[place].astype(np.float32),
        }
        self.hidden = hidden

    def inputs(self) -> np.ndarray:
        """What each entry adds to the gates."""
        return self.p["E"] @ self.p["W"] + self.p["b"]

    def step(self, h, gx):
        k, u = self.hidden, self.p["U"]
        both = h @ u[:, : 2 * k]
        both += gx[:, : 2 * k]
        _sigmoid(both)
        z, r = both[:, :k], both[:, k:]
        n = (r * h) @ u[:, 2 * k :]
        n += gx[:, 2 * k :]
        np.tanh(n, out=n)
        return h + z * (n - h), z, r, n

    def _by_class(self, h, target):
        """Rows in the order of their targets' classes: that order, states, slots of targets, classes, and (class, its rows, its slots) where it has rows and a choice."""
        cls = self.cls[target]
        order = np.argsort(cls, kind="stable")
        cls = cls[order]
        at = np.searchsorted(cls, np.arange(self.n_classes + 1))
        parts = [(slice(at[c], at[c + 1]), slice(self.edges[c], self.edges[c + 1])) for c in np.flatnonzero(np.diff(at)) if self.edges[c + 1] - self.edges[c] > 1]
        return order, h[order], self.slot[target[order]], cls, parts

    def log_probs(self, h, target):
        """Natural log probability of each target after state h."""
        order, h, slot, cls, parts = self._by_class(h, target)
        a, rows = h @ self.p["C"] + self.p["c"], np.arange(len(h))
        out = np.clip(a[rows, cls], -LOGIT, LOGIT)
        out -= np.log(_softened(a)[1])
        for own, words_ in parts:
            b = h[own] @ self.p["O"][words_].T
            b += self.p["o"][words_]
            out[own] += np.clip(b[rows[: len(b)], slot[own] - words_.start], -LOGIT, LOGIT)
            out[own] -= np.log(_softened(b)[1])
        back = np.empty_like(out)
        back[order] = out
        return back

    def gradients(self, h0, x, y, fresh, live):
        """Backpropagation through one window, truncated at its start. Shapes (time, lanes); fresh: a document begins."""
        t_n, k, p = len(x), self.hidden, self.p
        xf = x.ravel()
        gates, hs, keep, h = (p["E"][xf] @ p["W"] + p["b"]).reshape(*x.shape, 3 * k), [], [], h0
        for t in range(t_n):
            if fresh[t].any():
                h = np.where(fresh[t][:, None], h.dtype.type(0), h)
            new, z, r, n = self.step(h, gates[t])
            keep.append((h, z, r, n))
            hs.append(new)
            h = new
        g = {name: np.zeros_like(a) for name, a in p.items()}
        order, hf, slot, cls, parts = self._by_class(np.concatenate(hs), y.ravel())
        wf = (live.ravel()[order] / max(1, live.sum())).astype(hf.dtype)
        rows = np.arange(len(hf))
        a, total = _softened(hf @ p["C"] + p["c"])
        loss = -(wf * np.log(a[rows, cls] / total)).sum()
        a *= (wf / total)[:, None]
        a[rows, cls] -= wf
        g["C"], g["c"], dh_own = hf.T @ a, a.sum(0), a @ p["C"].T
        for own, words_ in parts:
            b = hf[own] @ p["O"][words_].T
            b += p["o"][words_]
            b, total = _softened(b)
            w, i, j = wf[own], rows[: len(b)], slot[own] - words_.start
            loss -= (w * np.log(b[i, j] / total)).sum()
            b *= (w / total)[:, None]
            b[i, j] -= w
            g["O"][words_], g["o"][words_] = b.T @ hf[own], b.sum(0)
            dh_own[own] += b @ p["O"][words_]
        dh_out = np.empty_like(dh_own)
        dh_out[order] = dh_own
        dh_out, dh, u = dh_out.reshape(t_n, -1, k), np.zeros_like(h0), p["U"]
        dgx = np.zeros((t_n, len(h0), 3 * k), hf.dtype)
        for t in reversed(range(t_n)):
            h, z, r, n = keep[t]
            dh = dh + dh_out[t]
            dn = dh * z
            dz = dn * (n - h)
            dz *= 1 - z
            dn *= 1 - n * n
            drh = dn @ u[:, 2 * k :].T
            dr = drh * h
            dr *= r
            dr *= 1 - r
            d = dgx[t]
            d[:, :k], d[:, k : 2 * k], d[:, 2 * k :] = dz, dr, dn
            g["U"][:, : 2 * k] += h.T @ d[:, : 2 * k]
            g["U"][:, 2 * k :] += (r * h).T @ dn
            dh = dh * (1 - z) + drh * r + d[:, : 2 * k] @ u[:, : 2 * k].T
            if fresh[t].any():
                dh[fresh[t]] = 0
        flat = dgx.reshape(-1, 3 * k)
        g["W"], g["b"] = p["E"][xf].T @ flat, flat.sum(0)
        by = np.argsort(xf, kind="stable")
        first = np.flatnonzero(np.diff(xf[by], prepend=-1))
        g["E"][xf[by][first]] = np.add.reduceat((flat @ p["W"].T)[by], first)
        return loss, g, hs[-1]

    def train(self, docs: list[np.ndarray], epochs: int = EPOCHS, rate: float = RATE, window: int = WINDOW, lanes: int = LANES) -> list[float]:
        """Adam over windows of lanes of documents laid end to end; the state runs on from window to window."""
        docs = [d for d in docs if len(d)]
        if not docs:
            return []
        m = {n: np.zeros_like(a) for n, a in self.p.items()}
        v = {n: np.zeros_like(a) for n, a in self.p.items()}
        losses, step = [], 0
        for epoch in range(epochs):
            order = np.random.default_rng(epoch).permutation(len(docs))
            y = np.concatenate([docs[i] for i in order])
            x = np.concatenate([np.concatenate(([END], docs[i][:-1])) for i in order])
            fresh = np.zeros(len(y), bool)
            fresh[np.cumsum([0, *(len(docs[i]) for i in order)])[:-1]] = True
            own = min(lanes, max(1, len(y) // window))
            per = -(-len(y) // own)
            per += -per % window
            lay = lambda a, fill: np.concatenate((a, np.full(own * per - len(a), fill, a.dtype))).reshape(own, per).T
            x, live, fresh, y = (np.ascontiguousarray(a) for a in (lay(x, END), lay(np.ones(len(y), bool), False), lay(fresh, True), lay(y, END)))
            h, total = np.zeros((own, self.hidden), np.float32), 0.0
            for t in range(0, per, window):
                s = slice(t, t + window)
                loss, g, h = self.gradients(h, x[s], y[s], fresh[s], live[s])
                total += loss
                size = math.sqrt(sum(float((a * a).sum()) for a in g.values()))
                step += 1
                lr = rate * min(1, step / 20) * (0.3 if epoch == epochs - 1 else 1)
                scale, lr = min(1, 1 / (size + 1e-9)), lr * math.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                for n, a in g.items():
                    a *= 0.1 * scale
                    m[n] *= 0.9
                    m[n] += a
                    a *= a
                    v[n] *= 0.99
                    v[n] += a  # the square of a tenth is the hundredth that is due
                    np.sqrt(v[n], out=a)
                    a += 1e-8
                    np.divide(m[n], a, out=a)
                    a *= lr
                    self.p[n] -= a
            losses.append(total / (per // window))
        return losses

    def score(self, docs: list[np.ndarray], window: int = 32, lanes: int = 512) -> np.ndarray:
        """log10 probability of each whole document (entries ending with END), many side by side in lanes."""
        out = np.zeros(len(docs))
        sizes = np.array([len(d) for d in docs])
        if not len(docs):
            return out
        own = int(np.clip(sizes.sum() // max(1, sizes.max()), 1, lanes))
        queue: list[list[int]] = [[] for _ in range(own)]
        load = np.zeros(own, np.int64)
        for i in np.argsort(-sizes, kind="stable"):
            k = int(load.argmin())
            queue[k].append(int(i))
            load[k] += sizes[i]
        order = np.argsort(-load, kind="stable")
        queue, load = [queue[k] for k in order], load[order]
        most = int(load.max())
        y, who = np.zeros((own, most), np.int32), np.full((own, most), -1, np.int32)
        fresh = np.zeros((own, most), bool)
        for k, q in enumerate(queue):
            at = 0
            for i in q:
                y[k, at : at + sizes[i]], who[k, at : at + sizes[i]], fresh[k, at] = docs[i], i, True
                at += sizes[i]
        x = np.zeros_like(y)
        x[:, 1:] = y[:, :-1]
        x[fresh] = END
        x, y, who, fresh = (np.ascontiguousarray(a.T) for a in (x, y, who, fresh))
        gates, h = self.inputs(), np.zeros((own, self.hidden), np.float32)
        for t in range(0, most, window):
            n = int((load > t).sum())
            h = h[:n]
            hs = []
            for s in range(t, min(t + window, most)):
                if fresh[s, :n].any():
                    h = np.where(fresh[s, :n, None], np.float32(0), h)
                h = self.step(h, gates[x[s, :n]])[0]
                hs.append(h)
            w = who[t : t + len(hs), :n].ravel()
            live = w >= 0
            got = self.log_probs(np.concatenate(hs)[live], y[t : t + len(hs), :n].ravel()[live])
            out += np.bincount(w[live], got.astype(np.float64), minlength=len(docs))
        return out / math.log(10)


def word_counts(docs: DataFrame) -> DataFrame:
    """h (a word's 64-bit hash), c over all whole texts; each task counts first, in bounded memory."""

    def run(batches):
        held, size = [], 0

        def give():
            h, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return {"h": h.view(np.int64), "c": np.bincount(at, np.concatenate([c for _, c in held])).astype(np.int64)}

        for b in batches:
            for _, texts in chunks(b["text"], b["text"], 1 << 22):
                held.append(np.unique(words(texts).hashes, return_counts=True))
                size += len(held[-1][0])
                if size > HELD_WORDS:
                    yield give()
                    held, size = [], 0
        if size:
            yield give()

    return arrow_map(docs.select("text"), run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


class Scorer:
    """The model, the counts of the most frequent words, and the totals; of bounded size."""

    def __init__(self, known: np.ndarray, counts: np.ndarray, n_docs: int, total: int, distinct: int, vocab: int = VOCAB):
        """known, counts: hashes and counts of the most frequent words, most frequent first."""
        order = np.argsort(known)
        self.known, self.counts = known[order], counts[order]
        in_model = min(vocab, len(known))
        entry = np.full(len(known), RARE, np.int32)
        entry[:in_model] = np.arange(2, 2 + in_model)
        self.entry = entry[order]
        self.train_tokens, self.vocabulary = total + n_docs, distinct + (n_docs > 0)
        self.end_count = n_docs
        self.rare_total, self.rare_distinct = total - int(counts[:in_model].sum()), distinct - in_model
        self.gru = Gru(np.concatenate(([n_docs, self.rare_total], counts[:in_model])).astype(np.float64))

    def look_up(self, hashes: np.ndarray):
        """Entry and count of each word; count -1 where it isn't among the most frequent."""
        if not len(self.known):
            return np.full(len(hashes), RARE, np.int32), np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        hit = self.known[at] == hashes
        return np.where(hit, self.entry[at], RARE).astype(np.int32), np.where(hit, self.counts[at], -1)

    def base(self, c):
        return np.log10((c + 1.0) / (self.train_tokens + self.vocabulary + 1))

    def rare(self, c):
        """log10 probability of a word of count c among the rare ones; an unknown one counts 0."""
        return np.log10((c + 1.0) / (self.rare_total + self.rare_distinct + 1))

    def entries(self, texts: list) -> list[np.ndarray]:
        w = words(texts)
        entry, _ = self.look_up(w.hashes)
        edges = np.searchsorted(w.owner, np.arange(len(texts) + 1))
        return [np.append(entry[a:b], END) for a, b in zip(edges, edges[1:], strict=False)]


def learn_all(scorer: Scorer, docs: DataFrame) -> None:
    """Trains the weights on every whole text of docs(text): each task on its own from the same start, then their mean by entries read.

    What the driver gets, and what a task holds, doesn't depend on the input.
    """
    held, names = docs.sparkSession.sparkContext.broadcast(scorer), sorted(scorer.gru.p)

    def run(batches):
        s, total = held.value, 0
        gru = copy.copy(s.gru)
        gru.p = {n: a.copy() for n, a in s.gru.p.items()}
        waiting, size = [], 0

        def learn():
            gru.train(waiting, 1, lanes=int(np.clip(size // (WINDOW * PASS_STEPS), 1, PASS_LANES)))

        for b in batches:
            for _, texts in chunks(b["text"], b["text"], 1 << 22):
                for d in s.entries(texts):
                    waiting.append(d)
                    size += len(d)
                    if size >= PASS_ENTRIES:
                        learn()
                        total, waiting, size = total + size, [], 0
        if size:
            learn()
            total += size
        if total:
            flat = np.concatenate([gru.p[n].ravel() for n in names]).astype("<f4")
            blocks = [flat[at : at + PASS_BLOCK].tobytes() for at in range(0, len(flat), PASS_BLOCK)]
            yield {"block": np.arange(len(blocks)), "n": [total] * len(blocks), "weights": blocks}

    def mean(pdf):
        import pandas as pd

        total = sum(n * np.frombuffer(w, "<f4").astype(np.float64) for n, w in zip(pdf["n"], pdf["weights"], strict=True))
        return pd.DataFrame({"block": pdf["block"][:1].to_numpy(), "n": [pdf["n"].sum()], "weights": [(total / pdf["n"].sum()).astype("<f4").tobytes()]})

    schema = "block int, n bigint, weights binary"
    sent = stored(arrow_map(docs.select("text"), run, schema), "lm-weights")
    got = sorted((r.block, r.weights) for r in added(sent, mean, schema).collect())
    at, flat = 0, np.frombuffer(b"".join(w for _, w in got), "<f4")
    for n in names if len(flat) else []:
        a = scorer.gru.p[n]
        scorer.gru.p[n] = flat[at : at + a.size].reshape(a.shape).astype(np.float32)
        at += a.size


def fit(docs: DataFrame, training: Column, sample: int = SAMPLE) -> tuple[Scorer, DataFrame]:
    """The scorer, and the table of all counts.

    Counts, totals, the vocabulary and the weights are over all training
    documents, whole. The weights start from at most sample documents (of each
    slot of hashed texts the one of the least hash); then learn_all() reads
    every document once.
    """
    own = docs.where(F.coalesce(training, F.lit(False)))
    table = stored(word_counts(own), "lm-counts")
    n_docs = own.count()
    total, distinct = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # counts in steps of an eighth of a power of two; the driver gets a row a step
    step = F.floor(F.log2("c") * 8).cast("int")
    steps = sorted(table.groupBy(step.alias("s")).count().collect(), reverse=True)
    least, have = None, 0
    for s, n in steps:
        if have + n > KNOWN:
            break
        least, have = s, have + n
    top = table.where(step >= least).orderBy(F.desc("c"), "h").select("h", "c").toPandas() if least is not None else None
    h = top["h"].to_numpy().astype(np.int64).view(np.uint64) if top is not None else np.zeros(0, np.uint64)
    c = top["c"].to_numpy().astype(np.int64) if top is not None else np.zeros(0, np.int64)
    scorer = Scorer(h, c, n_docs, total, distinct)
    hashed = own.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    slots = hashed.groupBy(F.pmod("h", F.lit(sample)).alias("slot")).agg(F.min_by("text", "h").alias("text"))
    texts = [r.text for r in slots.orderBy("slot").collect()]
    scorer.gru.train(scorer.entries(texts))
    learn_all(scorer, own)
    return scorer, table


def score(docs: DataFrame, training: Column) -> DataFrame:
    """Scores every whole text of docs(doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null text is empty: only its end is scored. Words beyond the bounded
    table that all tasks hold are looked up by a join over all counts. Rows
    are told apart by position, so a repeated doc_id gives repeated rows.
    """
    scorer, table = fit(docs, training)
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        s = sent.value
        from pyspark import TaskContext

        row, held, size = TaskContext.get().partitionId() << 40, [], 0

        def give():
            lm = s.gru.score([d for x in held for d in x.pop("entries")])
            cols = {k: [v for x in held for v in x[k]] for k in held[0]}
            return cols | {"score": lm + cols["score"], "row": range(row, row + len(lm))}

        for b in batches:
            for at, texts in chunks(range(len(b["text"])), b["text"], 1 << 22):
                w = words(texts)
                entry, c = s.look_up(w.hashes)
                edges = np.searchsorted(w.owner, np.arange(len(texts) + 1))
                hit = c >= 0
                inside = hit & (entry == RARE)
                away = np.flatnonzero(~hit)
                cut = np.searchsorted(w.owner[away], np.arange(len(texts) + 1))
                away = w.hashes[away].view(np.int64)
                held.append({
                    "entries": [np.append(entry[x:y], np.int32(END)).astype(np.int16) for x, y in zip(edges, edges[1:], strict=False)],
                    "doc_id": [b["doc_id"][i] for i in at], "held_out": [b["held_out"][i] for i in at], "n_tokens": np.diff(edges) + 1,
                    "n_known": np.bincount(w.owner[hit], minlength=len(texts)) + (s.end_count > 0),
                    "base_score": np.bincount(w.owner[hit], s.base(c[hit]), minlength=len(texts)) + s.base(s.end_count),
                    "score": np.bincount(w.owner[inside], s.rare(c[inside]), minlength=len(texts)),
                    "left": [away[x:y] for x, y in zip(cut, cut[1:], strict=False)],
                })
                size += len(entry)
                if size >= SCORED:
                    yield give()
                    row, held, size = row + sum(len(x["doc_id"]) for x in held), [], 0
        if held:
            yield give()

    schema = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, left array<bigint>"
    first = stored(arrow_map(docs.select("doc_id", (~F.coalesce(training, F.lit(False))).alias("held_out"), "text"), run, schema), "lm-scores")
    each = first.select("row", F.explode("left").alias("h"))
    found = each.join(table, "h", "left").select("row", F.coalesce("c", F.lit(0)).alias("c"))
    base = F.log10((F.col("c") + 1.0) / F.lit(float(scorer.train_tokens + scorer.vocabulary + 1)))
    rare = F.log10((F.col("c") + 1.0) / F.lit(float(scorer.rare_total + scorer.rare_distinct + 1)))
    rest = found.groupBy(F.col("row").alias("r")).agg(F.sum(F.when(F.col("c") > 0, 1).otherwise(0)).alias("more"), F.sum(base).alias("b"), F.sum(rare).alias("s"))
    out = first.drop("left").join(rest, F.col("row") == F.col("r"), "left")
    plus = lambda x, y: F.col(x) + F.coalesce(y, F.lit(0))
    return out.select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "more").cast("long").alias("n_known"), F.lit(scorer.train_tokens).cast("long").alias("train_tokens"),
        plus("base_score", "b").alias("base_score"), plus("score", "s").alias("score"),
    )
