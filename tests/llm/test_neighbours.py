"""Approximate nearest neighbours against brute force."""

import math
from itertools import groupby

import numpy as np
import pytest

from vellum.llm import neighbours
from vellum.llm.neighbours import ProjectedTree, chi_square_quantile, nearest

SCHEMA = "vec_id long, embedding array<double>, shard int, score string"


def _true(rows, k, every):
    """(query, vec_id) of the true k best of each query."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(e is not None and math.isfinite(e) for e in v) and any(v)]
    out = {}
    for i, q in good:
        if i % every == 0:
            scores = [(-np.cumsum(q * v)[-1], j) for j, v in good if j != i and len(v) == len(q)]
            out[i] = [(j, -s) for s, j in sorted(scores)[:k]]
    return out


def _got(found):
    rows = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect())
    return {q: [(j, s) for _, _, j, s in part] for q, part in groupby(rows, key=lambda r: r[0])}


def test_quantile():
    draws = np.random.default_rng(0).chisquare(12, 200_000)
    assert abs((draws < chi_square_quantile(0.9, 12)).mean() - 0.9) < 0.005


@pytest.mark.parametrize("kind", ["sphere", "clusters", "norms"])
def test_recall(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 32))
    if kind == "clusters":
        x = rng.standard_normal((30, 32))[rng.integers(0, 30, 3000)] + 0.2 * x
    if kind == "norms":
        x *= rng.lognormal(0, 1, 3000)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    table = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA)
    got, want = _got(nearest(table, table.where("vec_id % 20 = 0"))), _true(rows, 20, 20)
    assert all(len(got[q]) == 20 and [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True) for q in want)
    assert np.mean([len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 20 for q in want]) >= 0.97
    exact = dict(rows)
    assert all(s == np.cumsum(np.array(exact[q]) * np.array(exact[j]))[-1] for q in got for j, s in got[q])


def test_without_chance(spark):
    """With a confidence of almost 1 the result is that of brute force, ties, copies and lengths included."""
    rng = np.random.default_rng(6)
    base = rng.integers(-3, 4, (40, 6)).astype(float)
    rows = [(i, base[rng.integers(40)].tolist()) for i in range(600)] + [(i, rng.standard_normal(3).tolist()) for i in range(600, 640)]
    rows += [(640, None), (641, []), (642, [0.0] * 6), (643, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (644, [math.nan] * 6), (660, [math.inf] * 6), (None, [1.0] * 6), (680, [1.0, 2.0])]
    rows += [(700 + i, [1.0, 1.0, 0.0, 0.0, 0.0, 3.0]) for i in range(300)]  # a large group of copies
    table = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA)
    got, want = _got(nearest(table, table.where("vec_id % 20 = 0"), confidence=1 - 1e-12)), _true(rows, 20, 20)
    want = {q: w for q, w in want.items() if w}  # 680 is alone of its length
    assert got == want


def test_few_and_none(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nearest(empty, empty).count() == 0
    few = spark.createDataFrame([(20, [1.0, 0.0], 0, ""), (20, [0.0, 2.0], 0, ""), (20, [0.0, 2.0], 0, ""), (3, [1.0, 1.0], 0, ""), (4, [-1.0, 5.0], 0, "")], SCHEMA)
    got = sorted((r.rank, r.vec_id, r.score) for r in nearest(few, few.where("vec_id = 20")).collect())
    assert got == [(1, 3, 1.0), (1, 4, 10.0), (2, 3, 2.0), (2, 4, -1.0)]  # two queries with one id


def test_extreme_lengths(spark):
    rows = [(i, [s * math.cos(i), s * math.sin(i)]) for i, s in enumerate([1e150, 1e-150, 1.0, 3e149, 2e-160, 5.0] * 20)]
    table = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA)
    got, want = _got(nearest(table, table.where("vec_id % 20 = 0"), confidence=1 - 1e-12)), _true(rows, 20, 20)
    assert {q: [j for j, _ in w][:5] for q, w in got.items()} == {q: [j for j, _ in w][:5] for q, w in want.items()}


def test_points_are_visited_in_order():
    """Whatever the tree, confidence 1 finds all; a floor leaves out what is below it."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((500, 8))
    tree = ProjectedTree(np.arange(500), x)
    assert sorted(tree.ids.tolist()) == list(range(500)) and (np.diff(tree.starts) <= neighbours.LEAF).all()
    for i, ids, scores in tree.search(x[:20], np.arange(20), np.full(20, 2.0), 5, 1 - 1e-12):
        true = x @ x[i]
        true[i] = -np.inf
        best = [j for j in np.argsort(-true)[:5] if true[j] >= 2.0]
        assert ids.tolist() == best and np.allclose(scores, true[best])
