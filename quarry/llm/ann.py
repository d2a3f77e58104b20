"""Approximate nearest neighbours by balanced posting lists.

Centroids come from balanced bisection of a bounded sample. Every vector goes
to its nearest list and, if it lies near a boundary, to further ones. A
search walks an in-memory graph of the centroids, keeps the lists whose
centroid is within a ratio of the nearest one's distance, and scans them.
Lists and their queries are cut into shards of bounded size. The number of
lists grows with the square root of the vectors; a query that the lists found
give too few answers is put to all of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import ROW, arrow_map, identified, stored

#: Lists, as a multiple of the square root of the vectors, and at most; vectors to fit on for each.
LISTS, MOST_LISTS, LEAF = 4, 4096, 32
#: Boundary copies a vector and their distance ratio; lists a search (a share of all, and at least) and theirs.
COPIES, COPY_RATIO, PROBE_SHARE, PROBES, PROBE_RATIO = 2, 1.10, 0.25, 48, 1.5
SHARD, QUERY_SHARD, DEGREE, BEAM = 4096, 1024, 24, 32


def usable(vec: Column) -> Column:
    """True of vectors that are not null or empty, have finite components only, and aren't all zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vec) > 0) & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def unit(rows) -> np.ndarray:
    """Rows in double precision, of length 1; scaled first, so that no square over- or underflows."""
    x = np.asarray(rows, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def bisect(x: np.ndarray, leaf: int, seed: int = 0) -> list[np.ndarray]:
    """Cuts rows into groups of at most leaf, halving each at the median between two far means."""
    rng, todo, out = np.random.default_rng(seed), [np.arange(len(x))], []
    while todo:
        own = todo.pop()
        if len(own) <= leaf:
            out.append(own)
            continue
        part = x[own]
        a, b = part[rng.choice(len(own), 2, replace=False)]
        for _ in range(4):
            side = part @ (a - b)
            low = side < np.median(side)
            if low.all() or not low.any():
                break
            b, a = part[low].mean(0), part[~low].mean(0)
        order = np.argsort(part @ (a - b), kind="stable")
        todo += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    return out


class CentroidGraph:
    """Centroids and their neighbour graph; searches many queries in step."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids.astype(np.float32)
        self.half = (self.c * self.c).sum(1)
        k = len(self.c)
        near = []
        for at in range(0, k, 1024):
            d = self.half[None] - 2 * self.c[at : at + 1024] @ self.c.T
            near.append(np.argsort(d, 1, kind="stable")[:, 1 : DEGREE + 1])
        near = np.vstack(near) if near else np.zeros((0, 0), int)
        rng = np.random.default_rng(1)
        far = rng.integers(0, k, (k, 4))  # long links keep the graph in one piece
        self.links = np.hstack([near, far]).astype(np.int32)
        self.entries = rng.choice(k, min(k, 32), replace=False)

    def distances(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared Euclidean distance of each row of q, of length 1, to its row of centroids."""
        return np.maximum(1 + self.half[at] - 2 * np.einsum("bd,bkd->bk", q, self.c[at]), 0)

    def search(self, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The most nearest centroids found for each query, with distances, ascending: best-first with a beam."""
        q, beam = q.astype(np.float32), min(max(BEAM, 2 * most), len(self.c))
        n, rows = len(q), np.arange(len(q))
        best = np.tile(self.entries, (n, 1))
        dist = self.distances(q, best)
        seen = np.zeros((n, len(self.c)), bool)
        seen[rows[:, None], best] = True
        open_ = np.ones(best.shape, bool)
        for _ in range(4 * beam):
            pick = np.where(open_, dist, np.inf).argmin(1)
            if not open_[rows, pick].any():
                break
            from_ = best[rows, pick]
            open_[rows, pick] = False
            new = self.links[from_]
            fresh = ~seen[rows[:, None], new] & ~(np.tril(new[:, :, None] == new[:, None, :], -1).any(2))
            seen[rows[:, None], new] = True
            d = np.where(fresh, self.distances(q, new), np.inf)
            best, dist, open_ = np.hstack([best, new]), np.hstack([dist, d]), np.hstack([open_, fresh])
            if best.shape[1] > beam:
                keep = np.argpartition(dist, beam - 1, 1)[:, :beam]
                best, dist, open_ = (np.take_along_axis(a, keep, 1) for a in (best, dist, open_))
        order = np.argsort(dist, 1, kind="stable")[:, :most]
        return np.take_along_axis(best, order, 1), np.sqrt(np.take_along_axis(dist, order, 1))


def fit(vectors: DataFrame, n: int) -> CentroidGraph | None:
    """Centroids for n vectors, from at most LEAF of them a list (of each slot of hashed ids the first); None if there are none.

    There are at most MOST_LISTS, whatever the table's size, so both the
    sample and the graph that is sent to all tasks are bounded (131,072
    vectors, 4096 centroids: 1 MB of 64 numbers each).
    """
    lists = max(1, min(MOST_LISTS, round(LISTS * n**0.5), 2 * n // LEAF))
    slots = vectors.groupBy(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(lists * LEAF)).alias("slot")).agg(F.min_by("embedding", ROW).alias("embedding"))
    rows = slots.orderBy("slot").select("embedding").toPandas()["embedding"].tolist()
    if not rows:
        return None
    x = np.unique(unit(rows), axis=0)
    return CentroidGraph(np.array([x[g].mean(0) for g in bisect(x, max(1, -(-len(x) // lists)))]))


def _lists(rows: DataFrame, graph: CentroidGraph, most: int, ratio: float) -> DataFrame:
    """A row for each list that a vector goes to: list, row, vec_id, embedding."""
    held = rows.sparkSession.sparkContext.broadcast(graph)

    def run(batches):
        for b in batches:
            for at in range(0, len(b["row"]), 512):
                part = {k: v[at : at + 512] for k, v in b.items()}
                best, dist = held.value.search(unit(part["embedding"]), most)
                near = np.isfinite(dist) & (dist <= ratio * dist[:, :1] + 1e-6)
                row, col = np.nonzero(near)
                yield {"list": best[row, col]} | {k: [v[i] for i in row] for k, v in part.items()}

    return arrow_map(rows, run, "list int, row bigint, vec_id bigint, embedding array<double>")


def _best(q_rows, q, m_rows, m_ids, m, k: int) -> pd.DataFrame:
    """Each query's k best members of one shard but itself; ties to smaller ids. Sums are per row, so equal vectors score alike."""
    out = []
    rough = q @ m.T
    for i, near in enumerate(rough):
        near = np.where(m_rows == q_rows[i], -np.inf, near)
        at = np.flatnonzero(near > -np.inf)
        if len(at) > k:
            at = at[near[at] >= np.partition(near[at], -k)[-k] - 1e-9]
        score = (m[at] * q[i]).sum(1)
        order = np.lexsort((m_rows[at], m_ids[at], -score))[:k]
        out.append((np.full(len(order), q_rows[i]), m_rows[at][order], m_ids[at][order], score[order]))
    return pd.DataFrame(dict(zip(("of", "row", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def _scan(posts: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(of, row, vec_id, score): what asked rows find in their lists, k a shard at most. Shards of lists meet shards of queries."""
    sizes = posts.groupBy("list").count().select("list", F.ceil(F.col("count") / SHARD).cast("int").alias("shards"))
    q_sizes = asked.groupBy("list").count().select(F.col("list").alias("l"), F.ceil(F.col("count") / QUERY_SHARD).cast("int").alias("q_shards"))
    plan = F.broadcast(sizes.join(q_sizes, F.col("list") == F.col("l")).select("l", "shards", "q_shards"))  # at most as many rows as lists
    slot = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = posts.join(plan, F.col("list") == F.col("l")).withColumn("m", slot("shards", 1)).withColumn("q", every("q_shards")).select("list", "m", "q", "row", "vec_id", "embedding")
    seekers = asked.join(plan, F.col("list") == F.col("l")).withColumn("q", slot("q_shards", 2)).withColumn("m", every("shards")).select("list", "m", "q", "row", "embedding")

    def scan(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(m):
            return pd.DataFrame({"of": [], "row": [], "vec_id": [], "score": []})
        return _best(q["row"].to_numpy(), unit(q["embedding"].tolist()), m["row"].to_numpy(), m["vec_id"].to_numpy(), unit(m["embedding"].tolist()), k)

    key = ["list", "m", "q"]
    return seekers.groupBy(*key).cogroup(members.groupBy(*key)).applyInPandas(scan, "of bigint, row bigint, vec_id bigint, score double")


def nearest(vectors: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """For each row of vectors(vec_id, embedding) where queries holds: query_id, rank, vec_id, score of the k nearest found.

    Nearness is the cosine, in double precision, of the original vectors.
    Vectors that are null, empty or zero, or hold null or non-finite
    components, take no part, nor do those of another length than most, whose
    cosine isn't defined, and those without an id. Rows are told apart by an
    identity of their own: those that share a vec_id are queries and
    candidates of their own; a row isn't its own. Every query gets k answers,
    or as many as there are other rows.
    """
    spark = vectors.sparkSession
    own = identified(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(queries, F.lit(False)).alias("asked")).where("vec_id IS NOT NULL"), "vec_id")
    good = own.where(usable(F.col("embedding")))
    dims = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    good = good.where(F.size("embedding") == dims["n"]) if dims else good
    graph = fit(good, dims["count"]) if dims else None
    if graph is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    seek = good.where("asked").select(F.col(ROW).alias("row"), "vec_id", "embedding")
    posts = stored(_lists(good.select(F.col(ROW).alias("row"), "vec_id", "embedding"), graph, COPIES, COPY_RATIO), "ann-lists")
    asked = stored(_lists(seek, graph, max(PROBES, round(PROBE_SHARE * len(graph.c))), PROBE_RATIO), "ann-queries")
    found = stored(_scan(posts, asked, k), "ann-found")
    enough = found.groupBy("of").agg(F.count_distinct("row").alias("n")).where(F.col("n") >= min(k, dims["count"] - 1))
    short = stored(seek.join(enough, F.col("row") == F.col("of"), "left_anti"), "ann-short")
    if not short.isEmpty():
        every = short.select(F.explode(F.sequence(F.lit(0), F.lit(len(graph.c) - 1))).alias("list"), "row", "vec_id", "embedding")
        found = found.union(_scan(posts, every, k))
    once = found.groupBy("of", "row").agg(F.max("vec_id").alias("vec_id"), F.max("score").alias("score"))
    order = W.partitionBy("of").orderBy(F.desc("score"), "vec_id", "row")
    best = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ids = seek.select(F.col("row").alias("own"), F.col("vec_id").alias("query_id"))
    return best.join(ids, F.col("of") == F.col("own")).select("query_id", "rank", "vec_id", "score")
