"""Raster kernels in long pixel form, as joins, windows and aggregations over 8 x 8 tiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.operators import drawing as D
from vellum.operators import pixels as X
from vellum.operators import rasters as R
from vellum.plans.drawing_queries import TURNS, tile_quad
from vellum.plans.registry import register
from vellum.plans.views import sql
from vellum.sources import tables as T

KEY = "vec_id, x, y"


def _px(spark, d):
    return T.pixels(spark, d)


@register("g2_binarize", sql("pixels", f"SELECT {KEY}, CASE WHEN p >= 0.5 THEN 255 ELSE 0 END AS v FROM pixels"))
def g2(spark, d):
    return _px(spark, d).select("vec_id", "x", "y", F.when(F.col("p") >= 0.5, 255).otherwise(0).alias("v"))


@register("g3_grey", sql("pixels", f"SELECT {KEY}, trunc(p * 255)::INTEGER AS v FROM pixels"))
def g3(spark, d):
    return _px(spark, d).select("vec_id", "x", "y", (F.col("p") * 255).cast("int").alias("v"))


@register("g4_threshold", sql("pixels", f"SELECT {KEY}, CASE WHEN b > 128 THEN 255 ELSE 0 END AS v FROM pixels"))
def g4(spark, d):
    return _px(spark, d).select("vec_id", "x", "y", F.when(F.col("b") > 128, 255).otherwise(0).alias("v"))


@register("g5_in_range", sql("pixels", f"SELECT {KEY}, b BETWEEN 100 AND 150 AS inside FROM pixels"))
def g5(spark, d):
    return _px(spark, d).select("vec_id", "x", "y", F.col("b").between(100, 150).alias("inside"))


@register("g6_mask_and_count", sql("pixels", "SELECT vec_id, sum((b > 120 AND g > 120)::INTEGER)::BIGINT AS n FROM pixels GROUP BY vec_id"))
def g6(spark, d):
    return _px(spark, d).groupBy("vec_id").agg(F.count_if((F.col("b") > 120) & (F.col("g") > 120)).alias("n"))


MIRROR = "CASE WHEN {0} < 0 THEN -{0} WHEN {0} > 7 THEN 14 - {0} ELSE {0} END"


def _neighbours(r: int) -> str:
    return f"""SELECT a.vec_id, a.x, a.y, n.b, ox, oy FROM pixels a, range(-{r}, {r + 1}) s(ox), range(-{r}, {r + 1}) t(oy)
  JOIN pixels n ON n.vec_id = a.vec_id AND n.x = {MIRROR.format('(a.x + ox)')} AND n.y = {MIRROR.format('(a.y + oy)')}"""


def _long(images, column, digits=None):
    rows = R.as_pixels(images, "vec_id", 8, column)
    return rows.select("vec_id", "x", "y", (F.round(column, digits) if digits else F.col(column).cast("int")).alias("v"))


@register("g7_gaussian_3x3", sql("pixels", f"SELECT {KEY}, round(sum(b * (CASE ox WHEN 0 THEN 2 ELSE 1 END) * (CASE oy WHEN 0 THEN 2 ELSE 1 END)) / 16.0::DOUBLE, 4) AS v FROM ({_neighbours(1)}) GROUP BY ALL"))
def g7(spark, d):
    return _long(R.gaussian(T.tiles(spark, d), "b", 3, 8, 8), "b", 4)


@register("g7_gaussian_5x5", sql("pixels", f"SELECT {KEY}, round(sum(b * [1, 4, 6, 4, 1][ox + 3] * [1, 4, 6, 4, 1][oy + 3]) / 256.0::DOUBLE, 4) AS v FROM ({_neighbours(2)}) GROUP BY ALL"))
def g7_5(spark, d):
    return _long(R.gaussian(T.tiles(spark, d), "b", 5, 8, 8), "b", 4)


@register("g8_box_filter", sql("pixels", f"SELECT {KEY}, round(avg(b), 4) AS v FROM ({_neighbours(1)}) GROUP BY ALL"))
def g8(spark, d):
    return _long(R.box(T.tiles(spark, d), "b", 3, 8, 8), "b", 4)


@register("g8_box_real_size", sql("pixels", f"SELECT {KEY}, round(avg(b), 4) AS v FROM ({_neighbours(2)}) WHERE ox < 2 AND oy < 2 GROUP BY ALL"))
def g8_real(spark, d):
    """A side of 4.6 pixels is cut to 4: two before the pixel and one behind it."""
    return _long(R.box(T.tiles(spark, d), "b", 4.6, 8, 8), "b", 4)


@register("g9_erode_cross", sql("pixels", """SELECT a.vec_id, a.x, a.y, min(n.b) AS v FROM pixels a JOIN pixels n ON n.vec_id = a.vec_id AND abs(n.x - a.x) + abs(n.y - a.y) <= 1 GROUP BY ALL"""))
def g9(spark, d):
    return _long(R.eroded(T.tiles(spark, d), "b", R.ellipse(3), 8, 8), "b")


def _morphed(pick: str, source: str) -> str:
    """A pass over the 5 x 5 ellipse, beyond whose border is nothing."""
    return f"""SELECT a.vec_id, a.x, a.y, {pick}(n.v) AS v FROM {source} a JOIN {source} n ON n.vec_id = a.vec_id
  AND abs(n.y - a.y) <= 2 AND abs(n.x - a.x) <= CASE abs(n.y - a.y) WHEN 2 THEN 0 ELSE 2 END GROUP BY ALL"""


@register("g9_close_open", sql("pixels", f""", a0 AS MATERIALIZED (SELECT {KEY}, b AS v FROM pixels), a1 AS MATERIALIZED ({_morphed('max', 'a0')}), a2 AS MATERIALIZED ({_morphed('min', 'a1')}), b1 AS MATERIALIZED ({_morphed('min', 'a0')}), b2 AS MATERIALIZED ({_morphed('max', 'b1')})
SELECT vec_id, x, y, a2.v AS closed, b2.v AS opened FROM a2 JOIN b2 USING (vec_id, x, y)"""))
def g9_close_open(spark, d):
    rows = T.tiles(spark, d).select("vec_id", F.col("b").alias("closed"), F.col("b").alias("opened"))
    rows = R.opened(R.closed(rows, "closed", R.ellipse(5), 8, 8), "opened", R.ellipse(5), 8, 8)
    return R.as_pixels(rows, "vec_id", 8, "closed", "opened")


@register("h8_refine_mask", sql("pixels", f""", a0 AS MATERIALIZED (SELECT {KEY}, CASE WHEN b > 128 THEN 255 ELSE 0 END AS v FROM pixels), a1 AS MATERIALIZED ({_morphed('max', 'a0')}), a2 AS MATERIALIZED ({_morphed('min', 'a1')}),
a3 AS MATERIALIZED ({_morphed('min', 'a2')}), a4 AS MATERIALIZED ({_morphed('max', 'a3')}) SELECT * FROM a4"""))
def h8(spark, d):
    return _long(R.refined_mask(T.tiles(spark, d), "b", 8, 8), "b")


def _lab(source: str) -> str:
    """Expressions over channels b, g, r: CIE Lab in 8 bits."""
    return f"""(SELECT * EXCLUDE (s, wx, wy, wz, fx, fy, fz), greatest(0, least(255, round((CASE WHEN wy > 0.008856 THEN 116 * fy - 16 ELSE 903.3 * wy END) * 255 / 100)))::INTEGER AS lab_l,
  greatest(0, least(255, round(500 * (fx - fy) + 128)))::INTEGER AS lab_a, greatest(0, least(255, round(200 * (fy - fz) + 128)))::INTEGER AS lab_b
FROM (SELECT *, CASE WHEN wx > 0.008856 THEN wx ** (1 / 3.0::DOUBLE) ELSE 7.787 * wx + 16 / 116.0::DOUBLE END AS fx, CASE WHEN wy > 0.008856 THEN wy ** (1 / 3.0::DOUBLE) ELSE 7.787 * wy + 16 / 116.0::DOUBLE END AS fy,
  CASE WHEN wz > 0.008856 THEN wz ** (1 / 3.0::DOUBLE) ELSE 7.787 * wz + 16 / 116.0::DOUBLE END AS fz
FROM (SELECT *, (0.412453 * s[1] + 0.357580 * s[2] + 0.180423 * s[3])::DOUBLE / 0.950456 AS wx, (0.212671 * s[1] + 0.715160 * s[2] + 0.072169 * s[3])::DOUBLE AS wy, (0.019334 * s[1] + 0.119193 * s[2] + 0.950227 * s[3])::DOUBLE / 1.088754 AS wz
FROM (SELECT *, list_transform([r, g, b], lambda c: CASE WHEN c / 255.0::DOUBLE <= 0.04045 THEN c / 255.0::DOUBLE / 12.92 ELSE ((c / 255.0::DOUBLE + 0.055) / 1.055) ** 2.4 END) AS s FROM {source}))))"""


@register("g14_lab", sql("pixels", f"SELECT {KEY}, lab_l, lab_a, lab_b FROM {_lab('pixels')}"))
def g14_lab(spark, d):
    return X.with_lab(_px(spark, d)).select("vec_id", "x", "y", "lab_l", "lab_a", "lab_b")


@register("g15_chroma", sql("pixels", f"SELECT {KEY}, round(sqrt((lab_a - 128) ** 2 + (lab_b - 128) ** 2), 4) AS chroma FROM {_lab('pixels')}"))
def g15(spark, d):
    return X.with_lab(_px(spark, d)).select("vec_id", "x", "y", F.round(F.hypot(F.col("lab_a") - 128, F.col("lab_b") - 128), 4).alias("chroma"))


@register("g14_lab_lightness", sql("pixels", f""", l AS (SELECT vec_id, x, y, list_transform([r, g, b], lambda c: CASE WHEN c / 255.0::DOUBLE <= 0.04045 THEN c / 255.0::DOUBLE / 12.92 ELSE ((c / 255.0::DOUBLE + 0.055) / 1.055) ** 2.4 END) AS s FROM pixels),
m AS (SELECT {KEY}, 0.212671 * s[1] + 0.715160 * s[2] + 0.072169 * s[3] AS v FROM l)
SELECT {KEY}, round(CASE WHEN v > 0.008856 THEN 116 * v ** (1 / 3.0::DOUBLE) - 16 ELSE 903.3 * v END, 3) AS lightness FROM m"""))
def g14(spark, d):
    return _px(spark, d).select("vec_id", "x", "y", F.round(X.lightness(F.col("b"), F.col("g"), F.col("r")), 3).alias("lightness"))


@register("g17_gray_world", sql("pixels", f""", m AS (SELECT vec_id, greatest(avg(b), 1e-6) AS mb, greatest(avg(g), 1e-6) AS mg, greatest(avg(r), 1e-6) AS mr FROM pixels WHERE p >= 0.5 GROUP BY vec_id)
SELECT {KEY}, CASE WHEN p >= 0.5 THEN least(255, round(b * ((mb + mg + mr) / 3) / mb)) ELSE b END::INTEGER AS b, CASE WHEN p >= 0.5 THEN least(255, round(g * ((mb + mg + mr) / 3) / mg)) ELSE g END::INTEGER AS g,
  CASE WHEN p >= 0.5 THEN least(255, round(r * ((mb + mg + mr) / 3) / mr)) ELSE r END::INTEGER AS r FROM pixels LEFT JOIN m USING (vec_id)"""))
def g17(spark, d):
    return X.gray_world(_px(spark, d), F.col("p") >= 0.5).select("vec_id", "x", "y", "b", "g", "r")


@register("g23_rotate_pixels", sql("pixels", "SELECT vec_id, (CASE vec_id % 4 WHEN 0 THEN x WHEN 1 THEN 7 - y WHEN 2 THEN 7 - x ELSE y END)::INTEGER AS x, (CASE vec_id % 4 WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN 7 - y ELSE 7 - x END)::INTEGER AS y, b FROM pixels"))
def g23(spark, d):
    return X.rotated(_px(spark, d), (F.col("vec_id") % 4) * 90, 8, 8).select("vec_id", "x", "y", "b")


@register("g28_replace_color", sql("pixels", f"SELECT {KEY}, CASE WHEN b = 127 THEN 255 ELSE b END AS b FROM pixels"))
def g28(spark, d):
    return _px(spark, d).select("vec_id", "x", "y", F.when(F.col("b") == 127, 255).otherwise(F.col("b")).alias("b"))


def _mode(source: str, mask: str, share: float) -> str:
    return f"""SELECT vec_id, CASE WHEN count(*) FILTER ({mask} AND sqrt((lab_a-128)**2+(lab_b-128)**2) > 17.5 AND lab_l BETWEEN 40 AND 180)::DOUBLE / nullif(count(*) FILTER ({mask}), 0) > {share}
  THEN 'COLOR' ELSE 'GRAYSCALE' END AS mode FROM {source} GROUP BY vec_id"""


@register("e3_color_mode", sql("pixels", _mode(_lab("pixels"), "p >= 0.5", 0.0003)))
def e3(spark, d):
    return X.color_modes(_px(spark, d), F.col("p") >= 0.5)


@register("g18_auto_color_mode", sql("pixels", f""", d AS MATERIALIZED (SELECT *, p >= 0.5 AND (list_min({TURNS}) >= 0 OR list_max({TURNS}) <= 0) AS doc FROM pixels),
m AS (SELECT vec_id, greatest(avg(b), 1e-6) AS mb, greatest(avg(g), 1e-6) AS mg, greatest(avg(r), 1e-6) AS mr FROM d WHERE doc GROUP BY vec_id),
w AS MATERIALIZED (SELECT d.vec_id, x, y, doc, CASE WHEN doc THEN least(255, round(b * ((mb + mg + mr) / 3) / mb)) ELSE b END::INTEGER AS b, CASE WHEN doc THEN least(255, round(g * ((mb + mg + mr) / 3) / mg)) ELSE g END::INTEGER AS g,
  CASE WHEN doc THEN least(255, round(r * ((mb + mg + mr) / 3) / mr)) ELSE r END::INTEGER AS r FROM d LEFT JOIN m USING (vec_id))
""" + _mode(_lab("w"), "doc", 0.8)))
def g18(spark, d):
    """Masked pixels within the quad, whose grey mean is balanced first; tiles are colourful, so the share asked for is large."""
    doc = (F.col("p") >= 0.5) & D.in_polygon(F.col("x"), F.col("y"), tile_quad())
    rows = _px(spark, d).withColumn("doc", doc)
    return X.color_modes(X.gray_world(rows, F.col("doc")), F.col("doc"), share=0.8)


@register("e4_masked_means", sql("pixels", "SELECT vec_id, round(greatest(avg(b), 1e-6), 6) AS b, round(greatest(avg(g), 1e-6), 6) AS g, round(greatest(avg(r), 1e-6), 6) AS r FROM pixels WHERE p >= 0.5 GROUP BY vec_id"))
def e4(spark, d):
    return _px(spark, d).where("p >= 0.5").groupBy("vec_id").agg(*(F.round(F.greatest(F.avg(c), F.lit(1e-6)), 6).alias(c) for c in "bgr"))


@register("e5_histogram", sql("pixels", "SELECT vec_id, b AS bin, count(*) AS n FROM pixels GROUP BY ALL"))
def e5(spark, d):
    return X.histogram(_px(spark, d), "b")


@register("e6_histogram_percentile", sql("pixels", ", h AS (SELECT vec_id, b, count(*) AS n FROM pixels GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY vec_id ORDER BY b) AS s FROM h) SELECT vec_id, coalesce(min(CASE WHEN s / 64.0::DOUBLE >= 0.9 THEN b END), 255)::INTEGER AS v FROM c GROUP BY vec_id"))
def e6(spark, d):
    return X.histogram_percentile(X.histogram(_px(spark, d), "b"), 0.9)


@register("i3_cumulative_histogram", sql("pixels", ", h AS (SELECT vec_id, b AS bin, count(*) AS n FROM pixels GROUP BY ALL) SELECT vec_id, bin, sum(n) OVER (PARTITION BY vec_id ORDER BY bin)::BIGINT AS upto FROM h"))
def i3(spark, d):
    return X.histogram(_px(spark, d), "b").select("vec_id", "bin", F.sum("n").over(Window.partitionBy("vec_id").orderBy("bin")).alias("upto"))


@register("e7_order_statistic", sql("pixels", "SELECT vec_id, round(p, 7) AS v FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p) - 1 AS k FROM pixels) WHERE k = floor(64 * 0.99)"))
def e7(spark, d):
    return X.order_statistic(_px(spark, d), "p", 0.99).select("vec_id", F.round("v", 7).alias("v"))


@register("e8_mode_bright", sql("pixels", ", h AS (SELECT vec_id, b, count(*) AS n FROM pixels WHERE b BETWEEN 180 AND 255 GROUP BY ALL), m AS (SELECT vec_id, arg_max(b, (n, -b)) AS v FROM h GROUP BY vec_id) SELECT i.vec_id, coalesce(v, 220)::INTEGER AS v FROM (SELECT DISTINCT vec_id FROM pixels) i LEFT JOIN m USING (vec_id)"))
def e8(spark, d):
    return X.bright_mode(X.histogram(_px(spark, d), "b"))


@register("e9_min_max_normalize", sql("pixels", f"SELECT {KEY}, round(CASE WHEN hi - lo > 1e-6 THEN (p - lo) / (hi - lo) ELSE p END, 6) AS v FROM (SELECT *, min(p) OVER (PARTITION BY vec_id) AS lo, max(p) OVER (PARTITION BY vec_id) AS hi FROM pixels)"))
def e9(spark, d):
    return X.normalized(_px(spark, d), "p").select("vec_id", "x", "y", F.round("v", 6).alias("v"))


def _insets():
    """Three quads in each tile: its own, and that one with its corners one and two pixels further in."""
    v = F.col("vec_id")
    p = lambda x, y: G.point(x.cast("double"), y.cast("double"))
    return F.array(*(G.quad(p(1 + v % 2 + k, F.lit(k)), p(F.lit(6 - k), 1 + v % 3 + k), p(F.lit(7 - k), F.lit(6 - k)), p(F.lit(k), 7 - v % 2 - k)) for k in range(3)))


CORNERS = list(zip(("(1 + vec_id % 2 + k)", "(6 - k)", "(7 - k)", "k"), ("k", "(1 + vec_id % 3 + k)", "(6 - k)", "(7 - vec_id % 2 - k)"), strict=True))
INSET = "[" + ", ".join(f"({c} - {a}) * (y - {b}) - ({e} - {b}) * (x - {a})" for (a, b), (c, e) in zip(CORNERS, [*CORNERS[1:], CORNERS[0]], strict=True)) + "]"
SCORES = f"""SELECT vec_id, k::INTEGER AS k, CASE WHEN n / 64.0::DOUBLE < 0.02 THEN 0 ELSE m * (0.7 + 0.3 * n / 64.0::DOUBLE) END AS score
FROM (SELECT vec_id, k, count(*) FILTER (inside) AS n, avg(p) FILTER (inside) AS m FROM (SELECT *, list_min({INSET}) >= 0 OR list_max({INSET}) <= 0 AS inside FROM pixels, range(3) t(k)) GROUP BY vec_id, k)"""


@register("e10_quad_score", sql("pixels", f"SELECT vec_id, k, round(score, 6) AS score FROM ({SCORES})"))
def e10(spark, d):
    return X.quad_scores(_px(spark, d), _insets()).select("vec_id", "k", F.round("score", 6).alias("score"))


@register("e11_best_candidate", sql("pixels", f"SELECT vec_id, arg_max(k, (round(score, 9), -k)) AS k FROM ({SCORES}) WHERE score > 0 GROUP BY vec_id"))
def e11(spark, d):
    return X.quad_scores(_px(spark, d), _insets()).where("score > 0").groupBy("vec_id").agg(F.max_by("k", F.struct(F.round("score", 9), -F.col("k"))).alias("k"))


@register("d9_mask_and_quad", sql("pixels", f"SELECT {KEY}, p >= 0.5 AND (list_min({TURNS}) >= 0 OR list_max({TURNS}) <= 0) AS inside FROM pixels"))
def d9(spark, d):
    inside = (F.col("p") >= 0.5) & D.in_polygon(F.col("x"), F.col("y"), tile_quad())
    return _px(spark, d).select("vec_id", "x", "y", inside.alias("inside"))
