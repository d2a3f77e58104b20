"""Language identification by error-correcting output codes.

Each language has a binary codeword. One linear classifier over hashed byte
n-grams learns each bit; a text gets the language whose codeword has the
least loss against the classifiers' outputs, and is flagged as ambiguous if
the next one is almost as near.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.llm.common import arrow_map

DIM, UND, GAP = 4096, "und", 0.05
#: Documents a language to learn from, and about how many at most of all languages (one a language, if there are more).
SAMPLE, MOST_SAMPLE = 400, 8192
LETTER = r"\p{L}"
_CHUNK = 1 << 20


def codewords(n: int) -> np.ndarray:
    """n distinct rows of -1 and 1: all splits into two sides up to 7 languages, else dense random ones far apart."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        cols = [c for c in itertools.product((-1, 1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(cols, np.int8).T
    rng = np.random.default_rng(7)
    tries = [rng.choice(np.array([-1, 1], np.int8), (n, int(np.ceil(10 * np.log2(n))))) for _ in range(50)]
    least = lambda m: (m.shape[1] - (m.astype(int) @ m.T - 2 * m.shape[1] * np.eye(n, dtype=int)).max()) // 2
    return max(tries, key=least)


def features(text: str) -> np.ndarray:
    """Hashed counts of the byte 1- to 3-grams of a whole lower-cased text, damped and of length 1."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    total = np.zeros(DIM, np.float64)
    for at in range(0, len(raw), _CHUNK):
        b = raw[at : at + _CHUNK + 2].astype(np.uint32)
        total += np.bincount(b[: _CHUNK] & 255, minlength=DIM)
        two = b[:-1] << 8 | b[1:]
        total += np.bincount((two[:_CHUNK] * np.uint32(2654435761)) >> np.uint32(20), minlength=DIM)
        three = two[:-1] << 8 | b[2:]
        total += np.bincount((three[:_CHUNK] * np.uint32(2246822519)) >> np.uint32(20), minlength=DIM)
    out = np.sqrt(total)
    size = np.sqrt((out * out).sum())
    return (out / size if size else out).astype(np.float32)


class Model:
    def __init__(self, langs: list[str], codes: np.ndarray, weights: np.ndarray):
        self.langs, self.codes, self.weights = langs, codes, weights

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language's number, its score from 0 to 1, and the flag of ambiguity, for rows of features.

        The loss of a bit is log(1 + exp(-codeword bit * output)).
        """
        out = x @ self.weights[:-1] + self.weights[-1]
        loss = np.logaddexp(0, -out[:, None, :] * self.codes[None]).mean(2)
        like = np.exp(-(loss - loss.min(1, keepdims=True)) * self.codes.shape[1] / 2)
        like /= like.sum(1, keepdims=True)
        order = np.sort(like, 1)
        gap = order[:, -1] - order[:, -2] if like.shape[1] > 1 else np.ones(len(x))
        return like.argmax(1), order[:, -1], gap < GAP


def train(x: np.ndarray, labels: list[str], rounds: int = 300, step: float = 4.0) -> Model:
    """Logistic regression on rows of features for each bit, all bits at once, by full gradient with momentum."""
    langs, own = np.unique(labels, return_inverse=True) if labels else ([], np.zeros(0, int))
    codes = codewords(len(langs))
    weights = np.zeros((DIM + 1, codes.shape[1]), np.float32)
    if len(labels):
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        y = (codes[own] > 0).astype(np.float32)
        share = 1 / np.bincount(own, minlength=len(langs))[own]
        share = (share / share.sum()).astype(np.float32)[:, None]
        speed = np.zeros_like(weights)
        for _ in range(rounds):
            grad = x.T @ (share * (1 / (1 + np.exp(-(x @ weights))) - y)) + 1e-5 * weights
            speed = 0.9 * speed - step * grad
            weights += speed
    return Model([str(n) for n in langs], codes, weights)


def fit(docs: DataFrame, sample: int = SAMPLE, most: int = MOST_SAMPLE) -> Model:
    """Learns every language from the whole texts of at most sample documents of it.

    They are those of the least hash in each of so many slots of hashed texts;
    of more than most / sample languages fewer each are taken, at least one.
    Rows with a null text or language, or without letters, teach nothing. The
    sample's size doesn't depend on the input's; only this fitting is on a
    sample. Hashes are picked first, so that only picked texts are shuffled,
    and the driver gets their features.
    """
    own = docs.where("text IS NOT NULL AND lang IS NOT NULL").where(F.col("text").rlike(LETTER)).select("lang", "text", F.xxhash64("text").alias("h"))
    n_langs = own.agg(F.count_distinct("lang")).first()[0]
    each = max(1, min(sample, most // max(1, n_langs)))
    picks = own.groupBy("lang", F.pmod("h", F.lit(each)).alias("slot")).agg(F.min("h").alias("h")).select("lang", "h")
    picked = own.join(F.broadcast(picks), ["lang", "h"]).dropDuplicates(["lang", "h"])

    def run(batches):
        for b in batches:
            yield {"lang": b["lang"], "h": b["h"], "x": [features(t).tobytes() for t in b["text"]]}

    got = sorted(arrow_map(picked.select("lang", "h", "text"), run, "lang string, h bigint, x binary").collect(), key=lambda r: (r.lang, r.h))
    x = np.frombuffer(b"".join(r.x for r in got), np.float32).reshape(-1, DIM)
    return train(x, [r.lang for r in got])


def label(docs: DataFrame, model: Model) -> DataFrame:
    """docs, all columns, with lang_pred, score, ambiguous, and whether the whole text has a letter.

    A text that is null or has no letter (of Unicode's category L; numerals
    are none) is ``und`` with score 0; so is every text if nothing was
    learned. Each row is decided on its own, equal texts alike. docs may have
    no column of these names.
    """

    def run(batches):
        for b in batches:
            n = len(b["text"])
            out = b | {"lang_pred": [UND] * n, "score": [0.0] * n, "ambiguous": [False] * n}
            todo = [i for i in range(n) if b["has_letter"][i]] if model.langs else []
            for at in range(0, len(todo), 512):
                part = todo[at : at + 512]
                best, score, unsure = model.decode(np.stack([features(b["text"][i]) for i in part]))
                for i, k, s, u in zip(part, best.tolist(), score.tolist(), unsure.tolist(), strict=True):
                    out["lang_pred"][i], out["score"][i], out["ambiguous"][i] = model.langs[k], min(1.0, s), u
            yield out

    own = docs.withColumn("has_letter", F.coalesce(F.col("text").rlike(LETTER), F.lit(False)))
    added = StructType.fromDDL("lang_pred string, score double, ambiguous boolean")
    return arrow_map(own, run, StructType([*own.schema.fields, *added.fields]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every whole text of docs(doc_id, text), as label() gives them.

    Repeated rows give repeated rows.
    """
    return label(docs.select("doc_id", "text"), model).select("doc_id", "lang_pred", "score", "ambiguous")
