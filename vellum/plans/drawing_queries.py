"""Polygons, overlays, thumbnails, perspective and reports over tiles, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.operators import drawing as D
from vellum.plans.registry import register
from vellum.plans.views import sql
from vellum.sources import tables as T

KEY = "vec_id, x, y"


def tile_quad():
    """A quad in each tile, as a Column of vec_id."""
    v = F.col("vec_id")
    p = lambda x, y: G.point(x.cast("double"), y.cast("double"))
    return G.quad(p(1 + v % 2, F.lit(0)), p(F.lit(6), 1 + v % 3), p(F.lit(7), F.lit(6)), p(F.lit(0), 7 - v % 2))


X = ["(1 + vec_id % 2)", "6", "7", "0"]
Y = ["0", "(1 + vec_id % 3)", "6", "(7 - vec_id % 2)"]
SIDES = [(X[i], Y[i], X[(i + 1) % 4], Y[(i + 1) % 4]) for i in range(4)]
TURNS = "[" + ", ".join(f"({c} - {a}) * (y - {b}) - ({d} - {b}) * (x - {a})" for a, b, c, d in SIDES) + "]"
#: Squared distances from the corners, and from the sides by the place of the nearest point.
TO_CORNER = "least(" + ", ".join(f"(x - {a}) ** 2 + (y - {b}) ** 2" for a, b, _, _ in SIDES) + ")"


def _to_side(a: str, b: str, c: str, d: str) -> str:
    t = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((x - {a}) * ({c} - {a}) + (y - {b}) * ({d} - {b}))::DOUBLE / (({c} - {a}) ** 2 + ({d} - {b}) ** 2)))"
    return f"(x - {a} - {t} * ({c} - {a})) ** 2 + (y - {b} - {t} * ({d} - {b})) ** 2"


TO_SIDE = "least(" + ", ".join(_to_side(*s) for s in SIDES) + ")"


@register("g13_polygon_mask", sql("pixels", f"SELECT {KEY}, list_min({TURNS}) >= 0 OR list_max({TURNS}) <= 0 AS inside FROM pixels"))
def g13(spark, d):
    return T.pixels(spark, d).select("vec_id", "x", "y", D.in_polygon(F.col("x"), F.col("y"), tile_quad()).alias("inside"))


@register("g27_draw_polygon", sql("pixels", f"""SELECT {KEY}, CASE WHEN c THEN 0 WHEN s THEN 255 ELSE b END AS b, CASE WHEN c THEN 255 WHEN s THEN 0 ELSE g END AS g, CASE WHEN c THEN 255 WHEN s THEN 0 ELSE r END AS r
FROM (SELECT *, {TO_CORNER} <= 1.44 AS c, {TO_SIDE} <= 0.49 AS s FROM pixels)"""))
def g27(spark, d):
    return D.with_polygon(T.pixels(spark, d), tile_quad(), width=1.4, radius=1.2).select("vec_id", "x", "y", "b", "g", "r")


@register("g26_overlay_mask", sql("pixels", f"""SELECT {KEY}, abs(b - 80) AS b, CASE WHEN hi > lo AND round((m - lo) * 255 / (hi - lo)::DOUBLE) > 0 THEN least(255, abs(g - 80) + 153) ELSE abs(g - 80) END AS g, abs(r - 80) AS r
FROM (SELECT *, min(m) OVER (PARTITION BY vec_id) AS lo, max(m) OVER (PARTITION BY vec_id) AS hi FROM (SELECT *, greatest(b - 120, 0) AS m FROM pixels))"""))
def g26(spark, d):
    rows = T.pixels(spark, d).withColumn("m", F.greatest(F.col("b") - 120, F.lit(0)))
    return D.with_overlay(rows, "m").select("vec_id", "x", "y", "b", "g", "r")


PLACE = "greatest(0, least(7, (d + 0.5::DOUBLE) * 1.6::DOUBLE - 0.5::DOUBLE))"


@register("g25_thumbnail", sql("pixels", f""", t AS (SELECT d::INTEGER AS d, {PLACE} AS s FROM range(5) r(d))
SELECT vec_id, tx.d AS x, ty.d AS y, round(round(sum(b * (1 - abs(tx.s - x)) * (1 - abs(ty.s - y))), 9), 4) AS v FROM pixels JOIN t tx ON abs(tx.s - x) < 1 JOIN t ty ON abs(ty.s - y) < 1 GROUP BY ALL"""))
def g25(spark, d):
    return D.resized(T.pixels(spark, d), "b", (8, 8), D.thumbnail_size(8, 8, 5)).select("vec_id", "x", "y", F.round(F.round("v", 9), 4).alias("v"))


@register("g22_perspective_warp", sql("pixels", f""", q AS (SELECT DISTINCT vec_id, {', '.join(f'{v}::DOUBLE AS {k}{i}' for k, vs in (('x', X), ('y', Y)) for i, v in enumerate(vs))} FROM pixels),
e AS (SELECT *, (x1 - x2) * (y3 - y2) - (x3 - x2) * (y1 - y2) AS det, x0 - x1 + x2 - x3 AS sx, y0 - y1 + y2 - y3 AS sy FROM q),
h AS (SELECT *, (sx * (y3 - y2) - (x3 - x2) * sy) / det AS g, ((x1 - x2) * sy - sx * (y1 - y2)) / det AS h FROM e WHERE det <> 0),
o AS (SELECT *, tx / 6.0::DOUBLE AS u, ty / 7.0::DOUBLE AS w FROM h, (SELECT a::INTEGER AS tx FROM range(6) r(a)), (SELECT c::INTEGER AS ty FROM range(7) s(c))),
s AS (SELECT vec_id, tx, ty, ((x1 - x0 + g * x1) * u + (x3 - x0 + h * x3) * w + x0) / (g * u + h * w + 1) AS px, ((y1 - y0 + g * y1) * u + (y3 - y0 + h * y3) * w + y0) / (g * u + h * w + 1) AS py FROM o)
SELECT s.vec_id, tx AS x, ty AS y, floor(coalesce(sum(b * (1 - abs(px - p.x)) * (1 - abs(py - p.y))), 0) * 1000 + 1e-6::DOUBLE)::BIGINT AS thousandths FROM s LEFT JOIN pixels p ON p.vec_id = s.vec_id AND abs(px - p.x) < 1 AND abs(py - p.y) < 1 GROUP BY ALL"""))
def g22(spark, d):
    """Values in thousandths, rounded down past noise of their sums."""
    tiles = T.table(spark, d, "embeddings").select("vec_id", tile_quad().alias("q"))
    return D.warped(T.pixels(spark, d), tiles, "b", 6, 7).select("vec_id", "x", "y", F.floor(F.col("v") * 1000 + 1e-6).alias("thousandths"))


@register("b9_report_entries", sql("images docs", """SELECT img AS name, '<div class="entry"><h2>' || img || '</h2><p>expected ' || coalesce(colored::VARCHAR, 'unknown') || ', detected ' || detected::VARCHAR || '</p></div>' AS html
FROM images LEFT JOIN last_docs USING (doc_id)"""))
def b9(spark, d):
    known = T.newest_first(T.evaluation_documents(spark, d), ["doc_id"], ["row"]).select("doc_id", "colored")
    rows = T.evaluation_images(spark, d).join(known, "doc_id", "left")
    said = F.concat(F.lit("</h2><p>expected "), F.coalesce(F.col("colored").cast("string"), F.lit("unknown")), F.lit(", detected "), F.col("detected").cast("string"))
    return rows.select(F.col("img").alias("name"), F.concat(F.lit('<div class="entry"><h2>'), D.escaped(F.col("img")), said, F.lit("</p></div>")).alias("html"))
