"""Masks worked out in their rows, in batches of any sizes, and the masks drawn for them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import plain_detection as N
from tests.test_contours import _turned, as_array
from vellum.functions import geometry as G
from vellum.functions import stacks as P
from vellum.operators import detection as S
from vellum.plans import contour_queries as Q

MASKS = "id long, mask array<double>, width int, height int, image_width double, image_height double"


def _masks(spark):
    """Masks of several sizes mixed, some without an edge, of the wrong size, empty or null."""
    rng = np.random.default_rng(11)
    sizes = [(1, 1), (1, 9), (9, 1), (2, 2), (7, 5), (40, 30), (30, 40), (40, 30), (120, 90), (700, 600)]
    plain = {}
    for i, (w, h) in enumerate(sizes):
        y, x = np.mgrid[:h, :w]
        inside = (x > w * 0.2 + y * 0.1) & (x < w * 0.8) & (y > h * 0.2) & (y < h * 0.8 - x * 0.1)
        plain[i] = np.clip(np.where(inside, 0.96, 0.04) + rng.normal(0, 0.05, (h, w)), 0, 1)
    plain[len(sizes)] = np.zeros((30, 40))
    rows = [(i, m.ravel().tolist(), m.shape[1], m.shape[0], 640.0, 480.0) for i, m in plain.items()]
    odd = [(100, [1.0, 1.0], 40, 30, 640.0, 480.0), (101, [], 0, 0, 640.0, 480.0), (102, None, 40, 30, 640.0, 480.0), (103, [0.5], None, 1, 640.0, 480.0)]
    return plain, spark.createDataFrame(rows + odd, MASKS).coalesce(1)


def test_batches_of_mixed_sizes(spark):
    plain, masks = _masks(spark)
    gray = {i: np.clip(np.rint(m * 255), 0, 255) for i, m in plain.items()}
    refined = {i: N.smoothed(N.refined(g), (1, 4, 6, 4, 1)) for i, g in gray.items()}
    got = {(r.id, r.x, r.y) for r in S.edge_pixels(masks, "id").collect()}
    assert got == {(i, int(x), int(y)) for i, g in refined.items() for y, x in zip(*np.nonzero(N.edges(g)))}
    largest = {r.id: (_turned(as_array(r.points).astype(int).tolist()), r.area) for r in S.largest_contours(masks, "id").collect()}
    assert largest == {i: (_turned([list(map(int, p)) for p in c]), N.area(c)) for i, g in gray.items() if (c := N.largest_contour(g)) is not None}
    assert len(largest) >= 5
    best = {r.id: r.score for r in S.best_quads(masks, "id").collect()}
    for i, m in plain.items():
        tried = [q for t in S.STILL if min(m.shape) > 2 and (q := N.quad_at(m, t, (640.0, 480.0))) is not None and ((q >= 0) & (q <= (640, 480))).all()]
        scores = [s for q in tried if (s := N.score(q, m)) > 0]
        assert (best.get(i) == pytest.approx(max(scores), abs=1e-9)) if scores else i not in best
    assert len(best) >= 4


def test_nothing_but_quads_is_shuffled(spark):
    """Edges and borders took rounds of joins over all images, each with plans and files of its own."""
    _, masks = _masks(spark)
    jobs = spark.sparkContext.statusTracker()
    before = set(jobs.getJobIdsForGroup())
    plans = [f(masks, "id")._jdf.queryExecution().executedPlan().toString() for f in (S.edge_pixels, S.largest_contours, S.best_quads)]
    assert set(jobs.getJobIdsForGroup()) == before
    assert [p.count("Exchange ") for p in plans] == [0, 0, 1] and not any("Join" in p for p in plans)


def test_folds_run_once(spark):
    """Sides and corners are folds over a border; a filter on their outcome must not repeat them."""
    _, masks = _masks(spark)
    plan = S.best_quads(masks, "id")._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter")]
    assert filters and not any("aggregate(" in line for line in filters)


def test_long_weak_crests(spark):
    """A weak crest of any length stays if one of its pixels is above HIGH, and goes if none is."""
    crest = np.zeros((2, 60, 61), np.int64)
    for y in range(0, 60, 4):  # a meander
        crest[:, y, :60], crest[:, y + 1 : y + 4, 59 if y % 8 == 0 else 0] = 1, 1
    crest[0, 0, 0] = 2
    rows = spark.createDataFrame([(i, c.ravel().tolist(), 61, 60) for i, c in enumerate(crest)], "id long, crest array<int>, w int, h int")
    got = [len(r.at) for r in rows.select("id", P.places(F.col("crest"), F.col("w"), F.col("h"), P.kept).alias("at")).orderBy("id").collect()]
    assert got == [int((crest[0] > 0).sum()), 0]


def test_drawn_masks(spark, tmp_path):
    """By pixel: inside the convex quad or on its border, shaken by the embedding; a null shake gives 1."""
    shakes = {1: [0.5, -0.25, None], 2: [-9.0, 9.0], 3: [0.0], 4: None, 5: []}
    spark.createDataFrame(list(shakes.items()), "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    got = {r.s_suppkey: r for r in Q.drawn_masks(spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2, 3]
    for key, r in got.items():
        ring = np.array([tuple(r.q[c]) for c in G.CORNERS])
        for i, p in enumerate(r.mask):
            x, y = i % 48, i // 48
            turns = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for a, b in zip(ring, np.roll(ring, -1, axis=0))]
            shake = shakes[key][i * 7 % len(shakes[key])]
            value = 0.96 if min(turns) >= 0 or max(turns) <= 0 else 0.04
            assert p == (1.0 if shake is None else max(0.0, min(1.0, value + shake / 8)))
