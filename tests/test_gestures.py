"""Gestures, loupes and enclosing boxes against plain Python; frames read as a stream."""

import math

from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import names as N
from vellum.operators.boxes import min_area_rects
from vellum.sources import tables as T
from vellum.streaming import stabilizer as S

SF = "/root/testdata/sf0.001"
UNIT = [(0.2, 0.2), (0.8, 0.2), (0.8, 0.8), (0.2, 0.8)]


def _convex(q):
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0])
    return all(turn(q[i], q[(i + 1) % 4], q[(i + 2) % 4]) > 0 for i in range(4))


def test_drag(spark):
    steps = {0: [(0.1, 0.1), (0.7, 0.7), (-2.0, -2.0)], 2: [(0.5, 0.5), (-0.9, -0.9), (0.001, 0.0)], 4: [(0.3, 0.3)]}
    rows = spark.createDataFrame([(k, [dict(dx=a, dy=b) for a, b in s]) for k, s in steps.items()], "k int, steps array<struct<dx:double,dy:double>>")
    quad = G.quad(*(G.point(F.lit(x), F.lit(y)) for x, y in UNIT))
    got = {r.k: r.q for r in rows.select("k", G.dragged(quad, F.col("k"), F.col("steps"), F.col("k") == 4, F.col("k") == 2).alias("q")).collect()}
    for k, all_ in steps.items():
        q = list(UNIT)
        for dx, dy in () if k == 4 else all_[:-1] if k == 2 else all_:
            moved = list(q)
            moved[k] = tuple(min(1.0, max(0.0, v + d)) for v, d in zip(q[k], (dx, dy), strict=True))
            q = moved if _convex(moved) else q
        assert [(round(p.x, 9), round(p.y, 9)) for p in got[k]] == [(round(x, 9), round(y, 9)) for x, y in q]


def test_min_area_rect(spark):
    points = [(100 + 80 * math.cos(a) * (1 + 0.3 * (i % 2)), 200 + 30 * math.sin(a)) for i, a in enumerate(x * 0.7 for x in range(9))]
    turned = [(x * math.cos(0.5) - y * math.sin(0.5) + 300, x * math.sin(0.5) + y * math.cos(0.5)) for x, y in points]
    rows = spark.createDataFrame([([dict(x=x, y=y) for x, y in turned],), ([dict(x=1.0, y=1.0)] * 2,)], "p array<struct<x:double,y:double>>")
    (got,) = min_area_rects(rows.withColumn("id", F.monotonically_increasing_id()), ["id"], F.col("p")).collect()  # none for two points
    best = None
    for d in range(90):
        c, s = math.cos(math.radians(d)), math.sin(math.radians(d))
        xs, ys = [x * c - y * s for x, y in turned], [x * s + y * c for x, y in turned]
        area = (max(xs) - min(xs)) * (max(ys) - min(ys))
        if best is None or area < best[0]:
            best = area, d, [(x * c + y * s, y * c - x * s) for x, y in ((min(xs), min(ys)), (max(xs), min(ys)), (max(xs), max(ys)), (min(xs), max(ys)))]
    assert got.degree == best[1] and abs(got.area - best[0]) < 1e-6
    assert all(abs(p.x - x) < 1e-6 and abs(p.y - y) < 1e-6 for p, (x, y) in zip(got.corners, best[2], strict=True))


def test_language_tags(spark):
    codes = ["eng", "deu", "kat_old", "chi_tra", "uzb_cyrl", "frm"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in codes], "c string").select(N.language_tag(F.col("c"))).collect()]
    assert got == ["eng", "de", "kat", "zh-TW", "uz-Cyrl", "frm"]


def test_frame_source(spark, tmp_path):
    frames = T.frames(spark, SF).select("session", "ts", "seq", "q")
    frames.repartition(3).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = S.camera_frames(spark, str(tmp_path / "in")).writeStream.foreachBatch(lambda batch, _: seen.append((batch.count(), S.latest_only(batch).count())))
    stream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert len(seen) == 3 and sum(n for n, _ in seen) == frames.count() and all(0 < last <= n for n, last in seen)
