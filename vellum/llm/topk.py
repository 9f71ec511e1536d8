"""Exact top-k inner-product search over an impact-ordered index, score at a time.

Vectors are dealt to shards, and each shard's index is built once and written. In a shard every
dimension has postings ordered by value and cut into segments of equal size; a segment's quantised
value is the range of values in it. For a query, a segment's impact is the most that one of its
vectors can gain there. Segments are taken in rounds of descending impact down to a threshold t, so
a vector not yet met in m dimensions can still gain at most m * t: its bound is what it gathered plus
m * t. Exact scores of the most promising vectors give a score that k vectors reach. Once few
bounds reach it (the proof that all others are out), those few are rescored exactly. Every shard
returns its k best for each query, and the best of these are the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.tables import written

#: Segments of a dimension; most rows of a shard and queries of a slice, on average; least shards.
SEGMENTS, SHARD_ROWS, SLICE_ROWS, LEAST_SHARDS = 96, 50_000, 8_192, 8
#: Part of the postings taken by the first round and by each later one.
FIRST, STEP = 0.4, 0.08


class ImpactIndex:
    """Postings of integer vectors by dimension and ascending value, in segments of equal size.

    It takes a number of rows and segments, not of values, so its size doesn't grow with their range.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, postings: np.ndarray | None = None):
        if postings is None:
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            postings = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)
        self.ids, self.x, self.postings = ids, x, np.ascontiguousarray(postings)
        n, dims = x.shape
        self.starts = np.linspace(0, n, min(n, SEGMENTS) + 1).astype(np.int64)
        self.sizes = np.diff(self.starts)
        rows = np.arange(dims)[:, None]
        self.least = x[postings[:, self.starts[:-1]], rows].astype(np.float64)
        self.most = x[postings[:, self.starts[1:] - 1], rows].astype(np.float64)

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best vectors other than ``own``, ties to the smaller id."""
        n, dims = self.x.shape
        q = query.astype(np.float64)[:, None]
        impact = np.maximum(q * self.least, q * self.most)
        order = np.argsort(-impact, axis=None, kind="stable")
        share = np.cumsum(np.broadcast_to(self.sizes, impact.shape).ravel()[order]) / (n * dims)
        last = len(self.sizes)
        slack = 1e-12 * np.abs(impact).max(axis=1).sum()  # more than rounding can take from a sum
        up = query >= 0  # then impact rises with the segment, else it falls
        gathered, met = np.zeros(n), np.zeros(n, np.int64)
        done = np.zeros(dims, np.int64)
        reached, least = FIRST, -np.inf
        alive = self.ids != own
        while True:
            at = min(np.searchsorted(share, reached), len(order) - 1)
            t = impact.ravel()[order[at]] if reached < 1.0 else impact.min()
            now = (impact >= t).sum(axis=1)  # segments of each dimension with that impact or more
            rows, gains = [], []
            for d in np.flatnonzero(now > done):
                lo, hi = (last - now[d], last - done[d]) if up[d] else (done[d], now[d])
                rows.append(self.postings[d, self.starts[lo] : self.starts[hi]])
                gains.append(np.repeat(impact[d, lo:hi], self.sizes[lo:hi]))
            done = now
            if rows:
                rows = np.concatenate(rows)
                gathered += np.bincount(rows, weights=np.concatenate(gains), minlength=n)
                met += np.bincount(rows, minlength=n)
            bound = np.where(alive, gathered + (dims - met) * t + slack, -np.inf)
            try_ = np.argpartition(-bound, min(4 * k, n) - 1)[: 4 * k]
            try_ = try_[alive[try_]]
            if len(try_) >= k:
                scores = self.x[try_] @ query
                least = max(least, np.partition(scores, len(scores) - k)[len(scores) - k])
            left = np.flatnonzero((bound >= least) & alive)
            if len(left) <= max(16 * k, n // 64) or reached >= 1.0:  # every posting was met
                break
            reached = min(1.0, share[at] + STEP)
        scores = self.x[left] @ query
        best = np.lexsort((self.ids[left], -scores))[:k]
        return self.ids[left][best], scores[best]


def _matrix(lists: pd.Series) -> np.ndarray:
    return np.array(lists.tolist(), np.int64).reshape(len(lists), -1)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    index = ImpactIndex(pdf["vec_id"].to_numpy(), _matrix(pdf["x"]))
    return pd.DataFrame(
        {"dim": [index.x.shape[1]], "shard": [int(pdf["shard"].iloc[0])], "ids": [index.ids.tobytes()], "x": [index.x.tobytes()], "postings": [index.postings.tobytes()]}
    )


def _search(k: int):
    def run(indexes: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(indexes) and len(queries):
            row = indexes.iloc[0]
            ids = np.frombuffer(row["ids"], np.int64)
            x = np.frombuffer(row["x"], np.int64).reshape(len(ids), -1)
            index = ImpactIndex(ids, x, np.frombuffer(row["postings"], np.int32).reshape(x.shape[1], -1))
            for q, key, v in zip(queries["query_id"].to_numpy(), queries["query"].to_numpy(), _matrix(queries["x"]), strict=True):
                ids, scores = index.search(v, q, k)
                out.append(pd.DataFrame({"query_id": q, "query": key, "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "query": [], "vec_id": [], "score": []}, dtype="int64")

    return run


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """``vec_id, x``: floor(scale * component); without vectors or ids that are null, empty, or hold
    null or non-finite components."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), bad.alias("bad"))
    return rows.where("not bad and size(v) > 0 and vec_id is not null").select("vec_id", F.transform("v", lambda e: F.floor(e * scale)).alias("x"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k vectors of highest inner product for every query, exactly.

    ``vectors`` and ``queries`` have ``vec_id long, x array<long>``. A query is compared with every
    vector of its length but those with its own id; ties go to the smaller vec_id; all come back
    where there are fewer than k. Returns ``query_id, rank, vec_id, score``. Rows that repeat an id
    are separate vectors, each in its own right; queries that share an id but not the vector are ranked
    apart, equal ones count once. Empty inputs give no rows. Scores must fit 64 bits.
    """
    vectors = written(vectors.withColumn("dim", F.size("x")), "vectors")
    queries = written(queries.select(F.col("vec_id").alias("query_id"), F.xxhash64("x").alias("query"), "x", F.size("x").alias("dim")).distinct(), "queries")
    shards, slices = max(LEAST_SHARDS, -(-vectors.count() // SHARD_ROWS)), max(1, -(-queries.count() // SLICE_ROWS))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    shard = F.pmod(F.xxhash64("vec_id", "x"), F.lit(shards)).cast("int").alias("shard")
    indexes = vectors.select("dim", shard, "vec_id", "x").groupBy("dim", "shard").applyInPandas(_build, "dim int, shard int, ids binary, x binary, postings binary")
    indexes = written(indexes, "indexes").withColumn("slice", upto(slices))
    part = F.pmod(F.xxhash64("query_id", "query"), F.lit(slices)).cast("int").alias("slice")
    asked = queries.select("dim", "query_id", "query", "x", part, upto(shards).alias("shard"))
    key = ["dim", "shard", "slice"]
    found = indexes.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(_search(k), "query_id long, query long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
