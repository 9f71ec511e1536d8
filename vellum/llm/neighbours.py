"""Approximate nearest neighbours by inner product: stable projections, kd-trees, a chi-square stop.

A vector x gains the component sqrt(M^2 - |x|^2), with M the largest norm of its shard, and a query
q gains 0; then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the largest inner product is the smallest distance.
Vectors are projected on DIMS directions of independent normal (2-stable) components, after which
a squared projected distance is the true one times a chi-square variable of DIMS degrees of freedom.

Every shard has a kd-tree of its projections, built once and written. A query takes projected
neighbours in ascending order: leaves by the distance of their boxes, points once no unopened box is
nearer. Each is verified by its exact inner product. The search of a shard ends when a vector as
near as the k-th best so far would have been met by now with probability CONFIDENCE. Shards are
searched in rounds of growing number, and later rounds start from the k-th best of earlier ones.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.tables import discard, written
from vellum.llm.vectors import usable_vectors

#: Projected dimensions (an even number), and the probability of the stopping test.
DIMS, CONFIDENCE = 12, 0.97
#: Most rows of a shard and of a slice of queries, on average; least shards; points of a leaf.
SHARD_ROWS, SLICE_ROWS, LEAST_SHARDS, LEAF = 50_000, 8_192, 8, 48
#: Shards searched by the end of a round, as a multiple of those before it.
GROWTH = 16


def chi_square_quantile(p: float, dims: int = DIMS) -> float:
    """The value below which a chi-square variable lies with probability ``p``; ``dims`` is even."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
    lo, hi = 0.0, 4.0 * dims + 200
    for _ in range(80):
        lo, hi = ((lo + hi) / 2, hi) if below((lo + hi) / 2) < p else (lo, (lo + hi) / 2)
    return hi


def directions(dim: int) -> np.ndarray:
    """The same for all shards and tasks."""
    return np.random.default_rng(dim).standard_normal((dim + 1, DIMS))


def inner_products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Components added in turn: equal vectors have equal scores, wherever they stand."""
    return np.cumsum(x * q, axis=1)[:, -1]


class ProjectedTree:
    """A kd-tree of projections: points in leaf order, boxes of the leaves."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, stored: tuple | None = None):
        self.ids, self.x = ids, x
        if stored is None:
            self.scale = float(np.abs(x).max()) or 1.0
            unit = x / self.scale  # squares neither overflow nor vanish
            squares = np.einsum("ij,ij->i", unit, unit)
            self.most = float(squares.max())
            self.points = np.column_stack([unit, np.sqrt(self.most - squares)]) @ directions(x.shape[1])
            order, self.starts = self._split()
            self.ids, self.x, self.points = ids[order], x[order], self.points[order]
        else:
            self.scale, self.most, self.points, self.starts = stored
        self.low = np.minimum.reduceat(self.points, self.starts[:-1])
        self.high = np.maximum.reduceat(self.points, self.starts[:-1])

    def _split(self) -> tuple[np.ndarray, np.ndarray]:
        """Halves at the median of the widest dimension, down to LEAF points."""
        todo, order, starts = [np.argsort(self.ids, kind="stable")], [], [0]
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                order.append(rows)
                starts.append(starts[-1] + len(rows))
                continue
            p = self.points[rows]
            widest = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
            at = np.argpartition(p[:, widest], len(rows) // 2)
            todo += [rows[at[len(rows) // 2 :]], rows[at[: len(rows) // 2]]]
        return np.concatenate(order), np.array(starts)

    def box_distances(self, projected: np.ndarray) -> np.ndarray:
        out = np.zeros((len(projected), len(self.low)))
        for d in range(self.points.shape[1]):
            p = projected[:, d : d + 1]
            out += np.maximum(np.maximum(self.low[:, d] - p, p - self.high[:, d]), 0) ** 2
        return out

    def search(self, queries: np.ndarray, own: np.ndarray, floors: np.ndarray, k: int, confidence: float = CONFIDENCE):
        """For each query its place, and ids and scores of its k best of those found, best first.

        A floor is a score that k vectors elsewhere reach, or -inf.
        """
        limit = chi_square_quantile(confidence, self.points.shape[1])
        size = np.maximum(np.abs(queries).max(axis=1), 1e-300)
        unit = queries / size[:, None]
        lengths = np.einsum("ij,ij->i", unit, unit)
        projected = unit @ directions(self.x.shape[1])[:-1]
        # lengths differ by query: scale so that the query's norm is that of the longest vector
        ratio = np.sqrt(self.most / lengths) if self.most else np.ones(len(lengths))
        projected *= ratio[:, None]
        for lo in range(0, len(queries), 256):
            boxes = self.box_distances(projected[lo : lo + 256])
            ranked = np.argsort(boxes, axis=1)
            for i in range(lo, min(lo + 256, len(queries))):
                # of the scaled vectors: |q'|^2 + M^2 - 2 q'.x' with |q'| = M
                per_score = ratio[i] / size[i] / self.scale
                far = lambda score: max(2 * self.most - 2 * score * per_score, 0.0)  # noqa: B023,E731
                yield i, *self._one(queries[i], projected[i], boxes[i - lo], ranked[i - lo], own[i], floors[i], k, limit, far)

    def _one(self, q, projected, boxes, ranked, own, floor, k, limit, far):
        kth, opened, step = floor, 0, max(4, len(ranked) // 16)
        ids, scores = np.empty(0, np.int64), np.empty(0)
        rows, near = np.empty(0, np.int64), np.empty(0)
        while True:
            leaves = ranked[opened : opened + step]
            opened, step = opened + len(leaves), 2 * step
            radius = boxes[ranked[opened]] if opened < len(ranked) else np.inf
            many = self.starts[leaves + 1] - self.starts[leaves]
            upto = np.cumsum(many)
            new = np.repeat(self.starts[leaves] - upto + many, many) + np.arange(upto[-1])
            away = self.points[new] - projected
            rows, near = np.concatenate([rows, new]), np.concatenate([near, np.einsum("ij,ij->i", away, away)])
            reach = limit * far(kth) if kth > -np.inf else np.inf
            ready = near <= min(radius, reach)
            if ready.any():
                met = rows[ready]
                met = met[self.ids[met] != own]
                ids, scores = np.concatenate([ids, met]), np.concatenate([scores, self.x[met] @ q])
                if len(scores) > k:
                    best = np.partition(scores, len(scores) - k)[len(scores) - k]
                    keep = scores >= best - 1e-9 * abs(best)  # with those that rounding may have put behind
                    ids, scores = ids[keep], scores[keep]
                    kth = max(kth, best)
                elif len(scores) == k:
                    kth = max(kth, scores.min())
                rows, near = rows[~ready], near[~ready]
            if radius == np.inf or (kth > -np.inf and radius >= limit * far(kth)):
                break
        if kth > -np.inf and len(rows):  # what was opened but lay beyond the last radius
            met = rows[near <= limit * far(kth)]
            ids = np.concatenate([ids, met[self.ids[met] != own]])
        exact = inner_products(self.x[ids], q)
        best = np.lexsort((self.ids[ids], -exact))[:k]
        best = best[exact[best] >= floor]
        return self.ids[ids][best], exact[best]


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    tree = ProjectedTree(pdf["id"].to_numpy(), np.array(pdf["v"].tolist(), np.float64).reshape(len(pdf), -1))
    arrays = {"ids": tree.ids, "x": tree.x, "points": tree.points, "starts": tree.starts}
    key = {"dim": [tree.x.shape[1]], "shard": [int(pdf["shard"].iloc[0])], "scale": [tree.scale], "most": [tree.most]}
    return pd.DataFrame(key | {name: [np.ascontiguousarray(a).tobytes()] for name, a in arrays.items()})


_TREES = "dim int, shard int, scale double, most double, ids binary, x binary, points binary, starts binary"
_FOUND = "query_id long, query long, vec_id long, score double"


def _search(k: int, confidence: float):
    def run(trees: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = [[], [], [], []]
        if len(trees) and len(queries):
            t = trees.iloc[0]
            ids = np.frombuffer(t["ids"], np.int64)
            points, starts = np.frombuffer(t["points"]).reshape(len(ids), -1), np.frombuffer(t["starts"], np.int64)
            tree = ProjectedTree(ids, np.frombuffer(t["x"]).reshape(len(ids), -1), (t["scale"], t["most"], points, starts))
            q = np.array(queries["v"].tolist(), np.float64).reshape(len(queries), -1)
            own, key = queries["query_id"].to_numpy(), queries["query"].to_numpy()
            for i, found, scores in tree.search(q, own, queries["floor"].to_numpy(), k, confidence):
                for column, x in zip(out, (np.full(len(found), own[i]), np.full(len(found), key[i]), found, scores), strict=True):
                    column.append(x)
        kinds = (np.int64, np.int64, np.int64, np.float64)
        names = [c.split()[0] for c in _FOUND.split(", ")]
        return pd.DataFrame({c: np.concatenate([np.empty(0, kind), *x]) for c, kind, x in zip(names, kinds, out, strict=True)})

    return run


def nearest(table: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", confidence: float = CONFIDENCE) -> DataFrame:
    """The k vectors of largest inner product found for each query: ``query_id, rank, vec_id, score``.

    ``table`` and ``queries`` have the same columns; a query is compared with the vectors of its
    length except those with its own id. Scores are exact, ties go to the smaller vec_id. Vectors
    that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an id. All candidates
    come back where there are k or fewer. Queries that share an id but not the vector are ranked
    apart; equal ones count once. Of equal vectors only the k + 1 smallest ids can be among the k
    best, so the others aren't indexed. A neighbour as far as the k-th is missed with a probability
    of 1 - ``confidence`` in a shard, nearer ones with less. Scores beyond the range of doubles are infinite.
    """
    copy = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    rows = usable_vectors(table, id_col, vec_col).where("ok").withColumn("copy", copy).where(F.col("copy") <= k + 1)
    rows = written(rows.select(F.size("v").alias("dim"), "id", "v"), "vectors")
    asked = usable_vectors(queries, id_col, vec_col).where("ok").select(F.size("v").alias("dim"), F.col("id").alias("query_id"), F.xxhash64("v").alias("query"), "v")
    asked = written(asked.distinct(), "queries")
    shards, slices = max(LEAST_SHARDS, -(-rows.count() // SHARD_ROWS)), max(1, -(-asked.count() // SLICE_ROWS))
    shard = F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int")
    trees = written(rows.withColumn("shard", shard).groupBy("dim", "shard").applyInPandas(_build, _TREES), "trees")
    discard(rows)
    upto = lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b - 1)))
    indexed = trees.withColumn("slice", upto(0, slices))
    part = F.pmod(F.xxhash64("query_id", "query"), F.lit(slices)).cast("int").alias("slice")
    key = ["dim", "shard", "slice"]
    order = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    best, done = None, 0
    while done < shards:
        upper = min(shards, max(1, done * GROWTH))
        if best is None:
            open_ = asked.withColumn("floor", F.lit(float("-inf")))
        else:
            floors = best.where(F.col("rank") == k).select("query_id", "query", F.col("score").alias("floor"))
            open_ = asked.join(floors, ["query_id", "query"], "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        spread = F.pmod(F.xxhash64("query", "query_id") + F.col("turn"), F.lit(shards)).cast("int")  # each query begins with another shard
        dealt = open_.withColumn("slice", part).withColumn("turn", upto(done, upper)).withColumn("shard", spread)
        found = indexed.groupBy(*key).cogroup(dealt.select(*key, "query_id", "query", "v", "floor").groupBy(*key)).applyInPandas(_search(k, confidence), _FOUND)
        both = found if best is None else found.unionByName(best.drop("rank"))
        best = written(both.withColumn("rank", order).where(F.col("rank") <= k), "best")
        done = upper
    return best.select("query_id", "rank", "vec_id", "score")
