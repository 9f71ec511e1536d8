"""Window means, resampling, the edge-keeping filter and Lab back to colours, with their SQL, on tiles of 8 x 8 pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import pixels as X
from vellum.operators import resample as R
from vellum.plans.pixel_queries import _lab
from vellum.plans.registry import register
from vellum.plans.views import sql
from vellum.sources import tables as T

KEYS = ["vec_id"]
MIRROR = "CASE WHEN {c} < 0 THEN -({c}) WHEN {c} > 7 THEN 14 - ({c}) ELSE {c} END"


def _sizes(spark, d, **more):
    return T.table(spark, d, "embeddings").select("vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), *(c.alias(n) for n, c in more.items()))


@register("g20_box_means", sql("pixels", f"""SELECT a.vec_id, a.x, a.y, round(avg(n.b), 4) AS v FROM (SELECT vec_id, x, y, 3 + 2 * (vec_id % 3) AS k FROM pixels) a, range(-3, 4) s(dx), range(-3, 4) t(dy), pixels n
WHERE abs(dx) <= k // 2 AND abs(dy) <= k // 2 AND n.vec_id = a.vec_id AND n.x = {MIRROR.format(c='a.x + dx')} AND n.y = {MIRROR.format(c='a.y + dy')} GROUP BY ALL"""))
def g20_means(spark, d):
    """Means over squares of 3, 5 or 7 pixels, by running sums."""
    key = F.col("vec_id")
    found = R.box_means(T.pixels(spark, d), _sizes(spark, d, k=3 + 2 * (key % 3)), KEYS, "b", F.col("k"))
    return found.select("vec_id", "x", "y", F.round("b", 4).alias("v"))


@register("g20_retinex", sql("pixels", f""", near AS (SELECT a.vec_id, a.x, a.y, avg(ln(n.b + 1.0::DOUBLE)) FILTER (abs(dx) <= 1 AND abs(dy) <= 1) AS m3, avg(ln(n.b + 1.0::DOUBLE)) AS m5 FROM pixels a, range(-2, 3) s(dx), range(-2, 3) t(dy), pixels n
  WHERE n.vec_id = a.vec_id AND n.x = {MIRROR.format(c='a.x + dx')} AND n.y = {MIRROR.format(c='a.y + dy')} GROUP BY ALL),
even AS (SELECT vec_id, x, y, ln(b + 1.0::DOUBLE) - (2 * m3 + m5) / 3 AS e FROM pixels JOIN near USING (vec_id, x, y))
SELECT vec_id, x, y, round((e - min(e) OVER w) / (max(e) OVER w - min(e) OVER w) + 0.00123, 4) AS v FROM even WINDOW w AS (PARTITION BY vec_id)"""))
def g20_retinex(spark, d):
    """Lighting made even over windows of an 80th, a 10th and half of the side, 3 pixels at least."""
    windows = R.retinex_windows(F.col("width"), F.col("height"))
    found = R.retinex(T.pixels(spark, d), _sizes(spark, d), KEYS, "b", windows)
    return found.select("vec_id", "x", "y", F.round(F.col("b") + 0.00123, 4).alias("v"))


AREA = """, sizes AS (SELECT vec_id, 3 + vec_id % 5 AS w, 2 + vec_id % 4 AS h FROM embeddings),
wx AS (SELECT vec_id, j, i, greatest(0, least((j + 1) * 8 / w::DOUBLE, i + 1) - greatest(j * 8 / w::DOUBLE, i)) * w / 8.0::DOUBLE AS p FROM sizes, range(7) a(j), range(8) b(i) WHERE j < w),
wy AS (SELECT vec_id, j, i, greatest(0, least((j + 1) * 8 / h::DOUBLE, i + 1) - greatest(j * 8 / h::DOUBLE, i)) * h / 8.0::DOUBLE AS p FROM sizes, range(5) a(j), range(8) b(i) WHERE j < h)
"""
CUBIC = """, sizes AS (SELECT vec_id, 9 + vec_id % 4 AS w, 11 AS h FROM embeddings),
taps AS (SELECT vec_id, w, h, j, k, (j + 0.5::DOUBLE) * 8 / w - 0.5::DOUBLE AS mx, (j + 0.5::DOUBLE) * 8 / h - 0.5::DOUBLE AS my FROM sizes, range(12) a(j), range(-1, 3) b(k)),
tx AS (SELECT vec_id, j, greatest(0, least(7, floor(mx) + k))::INTEGER AS i, abs(mx - floor(mx) - k) AS t FROM taps WHERE j < w),
ty AS (SELECT vec_id, j, greatest(0, least(7, floor(my) + k))::INTEGER AS i, abs(my - floor(my) - k) AS t FROM taps WHERE j < h),
wx AS (SELECT vec_id, j, i, sum(CASE WHEN t <= 1 THEN 1.25 * t ** 3 - 2.25 * t ** 2 + 1 ELSE -0.75 * t ** 3 + 3.75 * t ** 2 - 6 * t + 3 END) AS p FROM tx GROUP BY ALL),
wy AS (SELECT vec_id, j, i, sum(CASE WHEN t <= 1 THEN 1.25 * t ** 3 - 2.25 * t ** 2 + 1 ELSE -0.75 * t ** 3 + 3.75 * t ** 2 - 6 * t + 3 END) AS p FROM ty GROUP BY ALL)
"""
PRODUCT = """SELECT vec_id, wx.j::INTEGER AS x, wy.j::INTEGER AS y, round(sum(wx.p * wy.p * b) + 0.00123, 3) AS b, round(sum(wx.p * wy.p * r) + 0.00123, 3) AS r
FROM pixels JOIN wx USING (vec_id) JOIN wy USING (vec_id) WHERE wx.i = pixels.x AND wy.i = pixels.y GROUP BY ALL"""


def _sampled(spark, d, weights, **sizes):
    found = R.resampled(T.pixels(spark, d), _sizes(spark, d, **sizes), KEYS, ["b", "r"], weights)
    return found.select("vec_id", "x", "y", *(F.round(F.col(c) + 0.00123, 3).alias(c) for c in "br"))


@register("g19_area_resampling", sql("pixels", AREA + PRODUCT))
def g19_area(spark, d):
    """Tiles shrunk to sizes of their own, each new pixel the mean of what it covers."""
    key = F.col("vec_id")
    return _sampled(spark, d, R.area_weights, new_width=(3 + key % 5).cast("int"), new_height=(2 + key % 4).cast("int"))


@register("g25_cubic_resampling", sql("pixels", CUBIC + PRODUCT))
def g25_cubic(spark, d):
    return _sampled(spark, d, R.cubic_weights, new_width=(9 + F.col("vec_id") % 4).cast("int"), new_height=F.lit(11))


@register("g21_edge_keeping", sql("pixels", f"""SELECT a.vec_id, a.x, a.y, round(sum(n.b * w) / sum(w), 4) AS v FROM (SELECT p.vec_id, p.x, p.y, n.b, exp(-(dx * dx + dy * dy) / 200.0::DOUBLE - (n.b - p.b) ** 2 / 800.0::DOUBLE) AS w
  FROM pixels p, range(-4, 5) s(dx), range(-4, 5) t(dy), pixels n WHERE dx * dx + dy * dy <= 16 AND n.vec_id = p.vec_id AND n.x = {MIRROR.format(c='p.x + dx')} AND n.y = {MIRROR.format(c='p.y + dy')}) n
JOIN pixels a ON a.vec_id = n.vec_id AND a.x = n.x AND a.y = n.y GROUP BY a.vec_id, a.x, a.y"""))
def g21_filter(spark, d):
    rows = T.tiles(spark, d).select("vec_id", F.posexplode(R.edge_keeping(F.col("b"), 8, 8)).alias("i", "v"))
    return rows.select("vec_id", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), F.round("v", 4).alias("v"))


@register("g14_bgr_of_lab", sql("pixels", f"""SELECT vec_id, x, y, {', '.join(f"floor(255 * CASE WHEN {c} <= 0.0031308 THEN 12.92 * {c} ELSE 1.055 * {c} ** (1 / 2.4::DOUBLE) - 0.055 END + 0.5)::INTEGER AS {c[-1]}" for c in ('lin_b', 'lin_g', 'lin_r'))}
FROM (SELECT vec_id, x, y, greatest(0, least(1, 0.055648 * cx - 0.204043 * cy + 1.057311 * cz)) AS lin_b, greatest(0, least(1, -0.969256 * cx + 1.875991 * cy + 0.041556 * cz)) AS lin_g,
  greatest(0, least(1, 3.240479 * cx - 1.537150 * cy - 0.498535 * cz)) AS lin_r
FROM (SELECT *, 0.950456 * CASE WHEN fx > 0.206893 THEN fx ** 3 ELSE (fx - 16 / 116.0::DOUBLE) / 7.787 END AS cx, CASE WHEN l <= 8 THEN l / 903.3 ELSE fy ** 3 END AS cy,
  1.088754 * CASE WHEN fz > 0.206893 THEN fz ** 3 ELSE (fz - 16 / 116.0::DOUBLE) / 7.787 END AS cz
FROM (SELECT *, fy + (lab_a - 128) / 500.0::DOUBLE AS fx, fy - (lab_b - 128) / 200.0::DOUBLE AS fz
FROM (SELECT *, CASE WHEN l <= 8 THEN 7.787 * l / 903.3 + 16 / 116.0::DOUBLE ELSE (l + 16) / 116 END AS fy FROM (SELECT vec_id, x, y, lab_a, lab_b, lab_l / 2.55::DOUBLE AS l FROM {_lab('pixels')})))))"""))
def g14_back(spark, d):
    """The colours of 8-bit Lab values, which lie near those that they were made of."""
    rows = X.with_lab(T.pixels(spark, d)).withColumn("c", R.bgr_of_lab(F.col("lab_l"), F.col("lab_a"), F.col("lab_b")))
    return rows.select("vec_id", "x", "y", "c.b", "c.g", "c.r")
