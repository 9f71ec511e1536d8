"""Detection in Spark against plain numpy versions, and on drawn documents of known corners."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import plain_detection as N
from vellum.functions import contour as K
from vellum.functions import geometry as G
from vellum.operators import borders as B
from vellum.operators import detection as S
from vellum.operators.boxes import min_area_rects
from vellum.plans import QUERIES, SQL
from vellum.plans import contour_queries as Q
from vellum.sources import tables as T

SF = "/root/testdata/sf0.001"
POINTS = "id long, points array<struct<x:double,y:double>>"


def ring(corners, n=60):
    c = np.array(corners, float)
    return np.concatenate([c[i] + (c[(i + 1) % len(c)] - c[i]) * np.arange(n)[:, None] / n for i in range(len(c))])


def frame(spark, rings):
    return spark.createDataFrame([(i, [(float(x), float(y)) for x, y in r]) for i, r in enumerate(rings)], POINTS)


def as_array(points):
    return None if points is None else np.array([(p.x, p.y) for p in points]).reshape(-1, 2)


@pytest.mark.parametrize("corners", [[(10, 10), (200, 20), (190, 150), (5, 140)], [(50, 0), (120, 60), (60, 130), (0, 70)]])
def test_quad(spark, corners):
    got = as_array(frame(spark, [np.round(ring(corners))]).select(K.quad_of_contour(F.col("points")).alias("q")).first().q)
    assert got is not None and all(np.abs(got - c).sum(axis=1).min() < 4 for c in np.array(corners))


def test_no_quad(spark):
    t = np.linspace(0, 2 * np.pi, 200, endpoint=False)
    rings = [np.round(ring([(0, 0), (100, 0), (50, 90)])), np.stack([np.cos(t), np.sin(t)], 1)[:10], np.zeros((40, 2)), np.empty((0, 2))]
    rows = frame(spark, rings).unionByName(spark.createDataFrame([(9, None)], POINTS))
    assert [r.q for r in rows.select(K.quad_of_contour(F.col("points")).alias("q")).collect()] == [None] * 5


def test_sides_against_plain(spark):
    """Runs, merged runs, dominant sides and corners of many shaken polygons."""
    rng = np.random.default_rng(2)
    rings = []
    for _ in range(60):
        k = rng.integers(3, 8)
        turns = np.sort(rng.random(k)) * 2 * np.pi
        rings.append(np.round(ring(np.stack([300 + 250 * np.cos(turns), 300 + 250 * np.sin(turns)], 1), int(rng.integers(8, 50))) + rng.normal(0, 0.3)))
    p, a = F.col("points"), K.smoothed_angles(F.col("points"))
    runs = G.let(a, lambda x: K.straight_runs(p, x))
    rows = frame(spark, rings).select("id", "points", a.alias("a"), runs.alias("runs"), K.merged_runs(runs).alias("merged"), K.sides_of_contour(p).alias("sides"), K.quad_of_contour(p).alias("q"))
    quads = 0
    for r in rows.collect():
        z = as_array(r.points) @ np.array([1, 1j])
        way = N.directions(z)
        assert np.allclose(np.exp(1j * np.array(r.a)), way)
        straight = N.straight_runs(z, way, N.LEAST_PART * np.abs(np.diff(z)).sum())
        same = lambda got, want: [(x.start, x.end) for x in got] == [x[:2] for x in want] and np.allclose([x.length for x in got], [x[3] for x in want])
        assert same(r.runs, straight) and same(r.merged, N.merged(straight)) and same(r.sides, N.dominant(N.merged(straight)))
        want = N.quad_of_contour(as_array(r.points))
        assert (r.q is None) == (want is None) and (want is None or np.allclose(as_array(r.q), want, atol=1e-6))
        quads += want is not None
    assert quads > 10


def test_hull(spark):
    rng = np.random.default_rng(1)
    sets = [np.concatenate([rng.random((50, 2)), [(-1, -1), (2, -1), (2, 2), (-1, 2)], [(-1, -1)]]), np.ones((2, 2)), np.empty((0, 2))]
    sets += [rng.integers(0, 6, (n, 2)).astype(float) for n in (1, 2, 3, 4, 5, 9, 30)] + [np.stack([np.arange(9.0), 2 * np.arange(9.0)], 1)]
    got = [as_array(r.h) for r in frame(spark, sets).select("id", K.convex_hull(F.col("points")).alias("h")).orderBy("id").collect()]
    assert got[0].tolist() == [[-1, -1], [2, -1], [2, 2], [-1, 2]] and len(got[1]) == 1 and len(got[2]) == 0
    assert all(np.array_equal(g, N.convex_hull(s)) for g, s in zip(got, sets, strict=True) if len(s))


def test_drawn_quads_are_found(spark):
    """Of shapes with four sides and enough points, the corners drawn."""
    rows = QUERIES["h7_quads_from_contours"](spark, SF).toPandas()
    drawn = {r.c_custkey: as_array(r.points) for r in T.contours(spark, SF).where("c_custkey % 5 = 0").collect()}
    assert rows["c_custkey"].isin(drawn).any() and not (rows["c_custkey"] % 5 == 4).any()
    for key, part in rows[rows["c_custkey"].isin(drawn)].groupby("c_custkey"):
        found = part[["x", "y"]].to_numpy()
        assert all(np.hypot(*(found - corner).T).min() < 4 for corner in drawn[key][::48])


def _borders(spark, masks):
    rows = [(i, int(x), int(y)) for i, m in enumerate(masks) for y, x in zip(*np.nonzero(m))]
    found = B.borders(spark.createDataFrame(rows, "id long, x int, y int"), ["id"]).withColumn("area", B.ring_area(F.col("points"))).collect()
    return [[(as_array(r.points).astype(int).tolist(), r.area) for r in found if r.id == i] for i in range(len(masks))]


def _turned(points):
    """A ring from its least point on, whichever it begins with."""
    n, least = len(points), min(points)
    return min([points[i:] + points[:i] for i in range(n) if points[i] == least])


def test_borders(spark):
    mask = np.zeros((12, 14), np.uint8)
    mask[2:9, 3:11] = 255
    mask[4:6, 5:7] = 0
    mask[10, 12] = 255
    rng = np.random.default_rng(3)
    masks = [mask, np.ones((1, 1)), np.ones((1, 7)), *((rng.random((15, 18)) < share).astype(np.uint8) for share in (0.1, 0.3, 0.5, 0.7, 0.9))]
    for plain, found in zip(masks, _borders(spark, masks), strict=True):
        want = N.contours(plain)
        known = {tuple(map(tuple, _turned(p))): a for p, a in found}
        for border in want:
            border = [list(map(int, p)) for p in border]
            assert known[tuple(map(tuple, _turned(border)))] == N.area(np.array(border))
        assert max(a for _, a in found) == max(map(N.area, want))
    assert sorted(len(p) for p, _ in _borders(spark, masks[:1])[0]) == [1, 8, 26]


def test_polygon_mask(spark):
    square = np.array([(1.0, 1.0), (6.0, 1.0), (6.0, 4.0), (1.0, 4.0)])
    want = np.zeros((7, 9), bool)
    want[1:5, 1:7] = True
    assert (N.polygon_mask(square, 9, 7) == want).all()
    rng = np.random.default_rng(4)
    for points in (square, np.array([(2.9, 0.2), (8.0, 3.5), (5.1, 6.9), (0.0, 4.4)]), square / 6):
        mask = rng.random((7, 9))
        row = spark.createDataFrame([(0, [(float(x), float(y)) for x, y in points], mask.ravel().tolist())], f"{POINTS}, mask array<double>")
        assert row.select(S.quad_score(F.col("mask"), F.lit(9), F.col("points")).alias("s")).first().s == pytest.approx(N.score(points, mask))


def test_edges(spark):
    mask = np.zeros((30, 40), np.int64)
    mask[8:20, 10:31] = 255
    found = N.edges(N.smoothed(mask, (1, 4, 6, 4, 1)))
    y, x = np.nonzero(found)
    away = np.maximum(np.maximum(8 - y, y - 19), np.maximum(10 - x, x - 30))  # 0 on the border's pixels
    assert len(x) and set(away.tolist()) <= {-1, 0, 1} and not N.edges(np.full((9, 9), 77)).any()
    step = np.zeros((30, 40), np.int64)
    step[:, 20:] = 30  # its gradient, 4 * 30, lies between the thresholds
    joined = step.copy()
    joined[:4, 20:] = 200
    rng = np.random.default_rng(5)
    images = [mask, step, joined, np.full((30, 40), 77), *(N.smoothed(rng.integers(0, 256, (30, 40)), (1, 4, 6, 4, 1)) for _ in range(4))]
    rows = spark.createDataFrame([(i, m.ravel().tolist(), 40, 30) for i, m in enumerate(images)], "id long, gray array<int>, width int, height int")
    got = {(r.id, r.x, r.y) for r in B.edge_pixels(B.with_crests(rows, "gray", *S.sides()), ["id"], F.col("width")).collect()}
    want = {(i, int(x), int(y)) for i, m in enumerate(images) for y, x in zip(*np.nonzero(N.edges(m)))}
    assert got == want and any(i == 2 for i, *_ in got) and not any(i == 1 for i, *_ in got)


def test_connected_lines(spark):
    """Long lines, a spiral among them, hang together in a few rounds."""
    spiral = [(0, 0)]
    for k in range(1, 24):
        dx, dy = ((1, 0), (0, 1), (-1, 0), (0, -1))[k % 4]
        for _ in range(2 * (k // 2 + 1)):
            spiral.append((spiral[-1][0] + dx, spiral[-1][1] + dy))
    rows = [(1, x + 100, y + 100) for x, y in spiral] + [(2, x, 5) for x in range(300)] + [(2, x, 7) for x in range(0, 300, 2)]
    found = B.connected(spark.createDataFrame(rows, "id long, x int, y int").distinct(), ["id"]).groupBy("id", "label").count().collect()
    assert sorted((r.id, r["count"]) for r in found) == sorted([(1, len(set(spiral))), (2, 300), *[(2, 1)] * 150])


def test_masks_against_plain(spark):
    """Edges, largest borders and best quads of drawn masks, among them ones without a quad."""
    masks = Q.drawn_masks(spark, SF)
    plain = {r.s_suppkey: np.array(r.mask).reshape(r.height, r.width) for r in masks.collect()}
    gray = {i: np.clip(np.rint(m * 255), 0, 255) for i, m in plain.items()}
    edges = {(r.s_suppkey, r.x, r.y) for r in S.edge_pixels(masks, "s_suppkey").collect()}
    assert edges == {(i, int(x), int(y)) for i, g in gray.items() for y, x in zip(*np.nonzero(N.edges(N.smoothed(N.refined(g), (1, 4, 6, 4, 1)))))}
    largest = {r.s_suppkey: (_turned(as_array(r.points).astype(int).tolist()), r.area) for r in S.largest_contours(masks, "s_suppkey").collect()}
    assert largest == {i: (_turned([list(map(int, p)) for p in c]), N.area(c)) for i, g in gray.items() if (c := N.largest_contour(g)) is not None}
    got = {r.s_suppkey: r for r in S.best_quads(masks, "s_suppkey").collect()}
    for i, m in plain.items():
        tried = [q for t in S.STILL if (q := N.quad_at(m, t, (640.0, 480.0))) is not None and ((q >= 0) & (q <= (640, 480))).all()]
        scores = [N.score(q, m) for q in tried]
        assert (i in got) == any(s > 0 for s in scores)
        if i in got:
            assert got[i].score == pytest.approx(max(scores), abs=1e-9)


def test_drawn_documents(spark):
    drawn = {r.s_suppkey: r.q for r in Q.drawn_masks(spark, SF).select("s_suppkey", "q").collect()}
    for name in ("h1_document_quads", "h1_live_quads"):
        rows = QUERIES[name](spark, SF).collect()
        assert len(rows) == len(drawn)
        errors = [max(abs(r[f"{c}_{a}"] - drawn[r.s_suppkey][c][a]) for c in ("topLeft", "topRight", "bottomRight", "bottomLeft") for a in "xy") for r in rows if r.topLeft_x is not None]
        assert len(errors) >= 0.9 * len(drawn) and np.median(errors) < 3, (len(errors), np.quantile(errors, [0.5, 0.9, 1]))
    odd = spark.createDataFrame([(1, [0.0] * 100, 10, 10), (2, [1.0, 1.0], 10, 10), (3, None, 10, 10)], "id long, mask array<double>, width int, height int")
    odd = odd.selectExpr("*", "100.0D image_width", "100.0D image_height")
    assert [(r.id, r.q) for r in S.document_quads(odd, "id").orderBy("id").collect()] == [(1, None), (2, None), (3, None)]


def test_boxes(spark):
    """The same box from a list of points and from an array of them; few points give none."""
    rows = T.keyed_quads(spark, SF).limit(50)
    listed = min_area_rects(rows, ["o_orderkey"], G.corners(F.col("q")), T.WIDTH, T.HEIGHT)
    arrays = min_area_rects(rows, ["o_orderkey"], F.array(*G.corners(F.col("q"))), T.WIDTH, T.HEIGHT)
    assert sorted(map(str, listed.collect())) == sorted(map(str, arrays.collect())) and listed.count() == 50
    assert min_area_rects(frame(spark, [np.zeros((2, 2)), np.empty((0, 2))]), ["id"], F.col("points")).count() == 0


def test_contours_are_dealt_to_all_cores(spark):
    """The folds are long work on a small file, which is one row group."""
    rows = T.contours(spark, SF)
    assert rows.rdd.getNumPartitions() > 4
    assert rows.select("c_custkey").distinct().count() == T.table(spark, SF, "customer").count()


def test_boxes_are_found_in_their_rows(spark):
    """No row for each degree, and nothing sorted or shuffled: those filled disks."""
    rows = T.keyed_quads(spark, SF)
    for points in (G.corners(F.col("q")), F.array(*G.corners(F.col("q")))):
        plan = min_area_rects(rows, ["o_orderkey"], points, T.WIDTH, T.HEIGHT)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Generate", "Sort", "Exchange", "Aggregate"))


def test_hulls_as_in_sql(spark, tmp_path):
    """Products in single precision, triangles in turning order, lines, lone points, ids that come twice, nulls."""
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(7)
    near = np.float32(rng.integers(1, 60, 4000) / np.float32(60))
    near = np.concatenate([near, np.nextafter(near, np.float32(0))])
    odd = near[np.floor(near * np.float32(60)) != np.floor(near.astype(np.float64) * 60)]
    assert len(odd)
    rows = [(1, [float(odd[0]), 0.0, 0.0, 0.0, 0.0, 1.0, 0.2, 0.9, -0.3, 0.1]), (2, [0.5] * 64), (3, [0.0, 0.0, 0.1, 0.9, 0.8, 0.1]), (4, [0.0, 0.0, 0.5, 0.5, 1.0, 1.0]), (5, [0.1, 0.1]), (5, [0.9, 0.2, 0.3, 0.8]), (6, [0.1, None, 0.5, 0.5, 0.2, 0.9, 0.8, 0.8])]
    rows += [(10 + i, [float(v) for v in rng.standard_normal(12).astype(np.float32)]) for i in range(20)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["f21_convex_hull"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(SQL["f21_convex_hull"]).fetchall())


def test_masks_are_dealt_to_all_cores(spark):
    assert Q.drawn_masks(spark, SF).rdd.getNumPartitions() > 4
