"""Frame-stream queries: runs of stable quads, gates, resets, latest frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.plans.registry import register
from vellum.plans.views import sql
from vellum.sources import tables as T
from vellum.streaming import stabilizer as S


def _runs(reset: str) -> str:
    return f""", l AS (SELECT *, lag(dx) OVER w AS before FROM frames WINDOW w AS (PARTITION BY session ORDER BY ts, seq)),
i AS (SELECT *, sum(CASE WHEN dx IS NULL OR before IS NULL OR NOT (abs(dx - before)::FLOAT < 20::FLOAT) OR {reset} THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ts, seq) AS island FROM l),
c AS (SELECT session, seq, CASE WHEN dx IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY session, island ORDER BY ts, seq) END::INTEGER AS "count" FROM i)
SELECT session, seq, "count", "count" >= 3 AS stable FROM c"""


@register("j1_stable_quads", sql("frames", _runs("false")))
def j1(spark, d):
    return S.run_lengths(T.frames(spark, d)).select("session", "seq", "count", "stable")


@register("j4_stable_quads_reset", sql("frames", _runs("event_type = 'signup'")))
def j4(spark, d):
    return S.run_lengths(T.frames(spark, d), "event_type = 'signup'").select("session", "seq", "count", "stable")


@register("j2_frame_gate", sql("frames", "SELECT session, seq FROM frames WHERE event_type NOT IN ('purchase', 'signup')"))
def j2(spark, d):
    """Frames that come while neither capture nor import runs."""
    return T.frames(spark, d).where(~F.col("event_type").isin("purchase", "signup")).select("session", "seq")


@register("j3_latest_frames", sql("frames", "SELECT session, arg_max(seq, (ts, seq)) AS seq FROM frames GROUP BY session"))
def j3(spark, d):
    return S.latest_only(T.frames(spark, d)).select("session", "seq")


@register("f16_max_corner_distance", sql("frames", "SELECT session, seq, round(abs(dx - lag(dx) OVER (PARTITION BY session ORDER BY ts, seq))::DOUBLE, 2) AS distance FROM frames"))
def f16(spark, d):
    before = F.lag("q").over(Window.partitionBy("session").orderBy("ts", "seq"))
    return T.frames(spark, d).select("session", "seq", F.round(G.max_corner_distance(F.col("q"), before).cast("double"), 2).alias("distance"))


@register("f26_wiggle_rollback", sql("frames", """, p AS (SELECT session, seq, dx, lag(dx) OVER w AS before, epoch_ms(ts) - epoch_ms(lag(ts) OVER w) AS ms FROM frames WINDOW w AS (PARTITION BY session ORDER BY ts, seq))
SELECT session, seq, round(CASE WHEN ms <= 70000000 AND round(abs(dx - before), 6) <= 5 THEN before ELSE dx END, 4) AS dx FROM p"""))
def f26(spark, d):
    """A last small, quick step of a drag is taken back (time scaled to these sparse frames)."""
    w = Window.partitionBy("session").orderBy("ts", "seq")
    dx = F.col("q.topLeft.x") - 10.0
    ms = F.unix_millis(F.col("ts").cast("timestamp")) - F.lag(F.unix_millis(F.col("ts").cast("timestamp"))).over(w)
    rows = T.frames(spark, d).select("session", "seq", dx.alias("dx"), F.lag(dx).over(w).alias("before"), ms.alias("ms"))
    undo = (F.col("ms") <= 70_000_000) & (F.round(F.abs(F.col("dx") - F.col("before")), 6) <= 5)
    return rows.select("session", "seq", F.round(F.when(undo, F.col("before")).otherwise(F.col("dx")), 4).alias("dx"))


@register("i2_circular_smoothing", sql("frames", """, r AS (SELECT session, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY session) AS n, dx FROM frames WHERE dx IS NOT NULL WINDOW w AS (PARTITION BY session ORDER BY ts, seq)),
k AS (SELECT * FROM r WHERE n >= 11), p AS (SELECT session, i, n, dx FROM k UNION ALL SELECT session, i - n, n, dx FROM k WHERE i >= n - 5 UNION ALL SELECT session, i + n, n, dx FROM k WHERE i < 5),
s AS (SELECT session, i, n, atan2(sum(sin(dx)) OVER v, sum(cos(dx)) OVER v) AS a FROM p WINDOW v AS (PARTITION BY session ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))
SELECT session, i, round(a, 4) AS angle FROM s WHERE i BETWEEN 0 AND n - 1"""))
def i2(spark, d):
    """Angles averaged with five neighbours on each side, around the end of a closed sequence."""
    w = Window.partitionBy("session")
    rows = T.frames(spark, d).where("q is not null").withColumn("dx", F.col("q.topLeft.x") - 10.0)
    rows = rows.select("session", "dx", (F.row_number().over(w.orderBy("ts", "seq")) - 1).alias("i"), F.count("*").over(w).alias("n")).where("n >= 11")
    ends = F.array(F.lit(0), F.when(F.col("i") >= F.col("n") - 5, -1), F.when(F.col("i") < 5, 1))
    padded = rows.withColumn("k", F.explode(F.filter(ends, lambda k: k.isNotNull()))).withColumn("j", F.col("i") + F.col("k") * F.col("n"))
    v = w.orderBy("j").rowsBetween(-5, 5)
    angle = F.atan2(F.sum(F.sin("dx")).over(v), F.sum(F.cos("dx")).over(v))
    return padded.withColumn("angle", F.round(angle, 4)).where("k = 0").select("session", "i", "angle")


@register("j5_import_progress", sql("frames", """SELECT session, seq, count(*) OVER w AS done, count(*) OVER (PARTITION BY session) AS total, count(*) FILTER (event_type <> 'error') OVER w AS imported
FROM frames WINDOW w AS (PARTITION BY session ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)"""))
def j5(spark, d):
    """Progress of an import, item by item: those that fail count as done and are skipped."""
    w = Window.partitionBy("session")
    upto = w.orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return T.frames(spark, d).select("session", "seq", F.count("*").over(upto).alias("done"), F.count("*").over(w).alias("total"), F.count_if(F.col("event_type") != "error").over(upto).alias("imported"))


@register("j8_corner_drag", sql("frames", """, steps AS (SELECT session, session % 5 AS k, row_number() OVER w AS s, count(*) OVER (PARTITION BY session) AS n, (seq % 21 - 10) / 200.0::DOUBLE AS dx, (seq % 17 - 8) / 200.0::DOUBLE AS dy
  FROM frames WINDOW w AS (PARTITION BY session ORDER BY ts, seq)),
ends AS (SELECT session, n - CASE WHEN sqrt(dx * dx + dy * dy) <= 0.02 THEN 1 ELSE 0 END AS kept FROM steps WHERE s = n),
drag AS (
  SELECT session, 0::BIGINT AS s, [0.2::DOUBLE, 0.8, 0.8, 0.2] AS x, [0.2::DOUBLE, 0.2, 0.8, 0.8] AS y FROM ends
  UNION ALL
  SELECT session, s, CASE WHEN convex THEN nx ELSE x END, CASE WHEN convex THEN ny ELSE y END FROM (SELECT *, len(list_filter(range(4), lambda i:
      (nx[(i + 1) % 4 + 1] - nx[i + 1]) * (ny[(i + 2) % 4 + 1] - ny[(i + 1) % 4 + 1]) - (ny[(i + 1) % 4 + 1] - ny[i + 1]) * (nx[(i + 2) % 4 + 1] - nx[(i + 1) % 4 + 1]) <= 0)) = 0 AS convex
    FROM (SELECT p.session, p.s, d.x, d.y, list_transform(range(4), lambda i: CASE WHEN i = p.k THEN greatest(0, least(1, d.x[i + 1] + p.dx)) ELSE d.x[i + 1] END) AS nx,
        list_transform(range(4), lambda i: CASE WHEN i = p.k THEN greatest(0, least(1, d.y[i + 1] + p.dy)) ELSE d.y[i + 1] END) AS ny
      FROM drag d JOIN steps p ON p.session = d.session AND p.s = d.s + 1)))
SELECT session, """ + ", ".join(f'round({a}[{i}], 6) AS "{c}_{a}"' for i, c in enumerate(G.CORNERS, 1) for a in "xy") + " FROM drag JOIN ends USING (session) WHERE s = kept").replace("WITH ", "WITH RECURSIVE ", 1))
def j8(spark, d):
    """Gestures on the unit quad: a session's frames move one corner, and a last small, quick step is taken back."""
    key = F.col("session")
    step = F.struct(F.col("ts"), F.col("seq"), ((F.col("seq") % 21 - 10) / 200.0).alias("dx"), ((F.col("seq") % 17 - 8) / 200.0).alias("dy"))
    gestures = T.frames(spark, d).groupBy("session").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    at = lambda x, y: G.point(F.lit(x), F.lit(y))
    quad = G.quad(at(0.2, 0.2), at(0.8, 0.2), at(0.8, 0.8), at(0.2, 0.8))
    last = F.element_at("steps", -1)
    small = F.hypot(last["dx"], last["dy"]) <= 0.02
    moved = G.dragged(quad, (key % 5).cast("int"), F.col("steps"), key % 5 == 4, small)
    return gestures.select("session", moved.alias("q")).select("session", *(F.round(F.col("q")[c][a], 6).alias(f"{c}_{a}") for c in G.CORNERS for a in "xy"))
