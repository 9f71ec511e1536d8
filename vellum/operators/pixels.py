"""Raster operators on images in long form: rows ``vec_id, x, y`` and channel columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.drawing import in_polygon


def rotated(pixels: DataFrame, degrees: Column, width: int, height: int) -> DataFrame:
    """Quarter turns clockwise; other angles leave no pixels."""
    d = F.pmod(degrees, F.lit(360))
    x, y = F.col("x"), F.col("y")
    nx = F.when(d == 0, x).when(d == 90, height - 1 - y).when(d == 180, width - 1 - x).when(d == 270, y)
    ny = F.when(d == 0, y).when(d == 90, x).when(d == 180, height - 1 - y).when(d == 270, width - 1 - x)
    return pixels.withColumns({"x": nx.cast("int"), "y": ny.cast("int")}).where("x is not null")


def lightness(b: Column, g: Column, r: Column) -> Column:
    """CIE L* of 8-bit sRGB."""
    linear = lambda c: F.when(c / 255 <= 0.04045, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4)))
    y = 0.212671 * linear(r) + 0.715160 * linear(g) + 0.072169 * linear(b)
    return F.when(y > 0.008856, 116 * F.pow(y, F.lit(1 / 3)) - 16).otherwise(903.3 * y)


def with_lab(pixels: DataFrame) -> DataFrame:
    """Adds ``lab_l, lab_a, lab_b``: CIE Lab of 8-bit sRGB, stored in 8 bits as L* 255 / 100, a* + 128, b* + 128."""
    linear = lambda c: F.when(F.col(c) / 255 <= 0.04045, F.col(c) / 255 / 12.92).otherwise(F.pow((F.col(c) / 255 + 0.055) / 1.055, F.lit(2.4)))
    rows = pixels.withColumns({f"lin_{c}": linear(c) for c in "bgr"})
    mixed = lambda r, g, b, white: (r * F.col("lin_r") + g * F.col("lin_g") + b * F.col("lin_b")) / white
    rows = rows.withColumns({"xyz_x": mixed(0.412453, 0.357580, 0.180423, 0.950456), "xyz_y": mixed(0.212671, 0.715160, 0.072169, 1.0), "xyz_z": mixed(0.019334, 0.119193, 0.950227, 1.088754)})
    root = lambda c: F.when(F.col(c) > 0.008856, F.pow(F.col(c), F.lit(1 / 3))).otherwise(7.787 * F.col(c) + 16 / 116)
    rows = rows.withColumns({f"root_{c}": root(f"xyz_{c}") for c in "xyz"})
    light = F.when(F.col("xyz_y") > 0.008856, 116 * F.col("root_y") - 16).otherwise(903.3 * F.col("xyz_y"))
    byte = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.round(v))).cast("int")
    lab = {"lab_l": byte(light * 255 / 100), "lab_a": byte(500 * (F.col("root_x") - F.col("root_y")) + 128), "lab_b": byte(200 * (F.col("root_y") - F.col("root_z")) + 128)}
    return rows.withColumns(lab).select(*pixels.columns, *lab)


def color_modes(pixels: DataFrame, mask: Column, chroma: float = 17.5, share: float = 0.0003, darkest: int = 40, brightest: int = 180) -> DataFrame:
    """``vec_id, mode``: COLOR where enough masked pixels, neither dark nor bright, have chroma."""
    colored = mask & (F.hypot(F.col("lab_a") - 128, F.col("lab_b") - 128) > chroma) & F.col("lab_l").between(darkest, brightest)
    part = F.try_divide(F.count_if(colored), F.count_if(mask))
    return with_lab(pixels).groupBy("vec_id").agg(F.when(part > share, "COLOR").otherwise("GRAYSCALE").alias("mode"))


def gray_world(pixels: DataFrame, mask: Column) -> DataFrame:
    """Scale each channel within the mask so that the masked means become grey, saturating at 255."""
    means = pixels.where(mask).groupBy("vec_id").agg(*(F.greatest(F.avg(c), F.lit(1e-6)).alias(f"m{c}") for c in "bgr"))
    gray = (F.col("mb") + F.col("mg") + F.col("mr")) / 3
    out = pixels.join(means, "vec_id", "left")
    scaled = lambda c: F.least(F.lit(255), F.round(F.col(c) * gray / F.col(f"m{c}"))).cast("int")
    return out.withColumns({c: F.when(mask & F.col("mb").isNotNull(), scaled(c)).otherwise(F.col(c)) for c in "bgr"}).drop("mb", "mg", "mr")


def histogram(pixels: DataFrame, channel: str) -> DataFrame:
    return pixels.groupBy("vec_id", F.col(channel).alias("bin")).agg(F.count("*").alias("n"))


def histogram_percentile(bins: DataFrame, p: float) -> DataFrame:
    """Smallest bin whose cumulative share reaches p, else 255: ``vec_id, v``."""
    w = Window.partitionBy("vec_id")
    share = F.sum("n").over(w.orderBy("bin")) / F.sum("n").over(w)
    rows = bins.withColumn("share", share)
    return rows.groupBy("vec_id").agg(F.coalesce(F.min(F.when(F.col("share") >= p, F.col("bin"))), F.lit(255)).cast("int").alias("v"))


def order_statistic(pixels: DataFrame, channel: str, p: float) -> DataFrame:
    """The value at place floor(n p) in ascending order, without interpolation: ``vec_id, v``."""
    w = Window.partitionBy("vec_id")
    rows = pixels.withColumns({"k": F.row_number().over(w.orderBy(channel)) - 1, "size": F.count("*").over(w)})
    return rows.where(F.col("k") == F.floor(F.col("size") * p)).select("vec_id", F.col(channel).alias("v"))


def bright_mode(bins: DataFrame) -> DataFrame:
    """Most frequent bin from 180 to 255, the smaller of equals; 220 without any: ``vec_id, v``."""
    bright = F.col("bin").between(180, 255)
    best = F.max(F.when(bright, F.struct("n", (-F.col("bin")).alias("minus"))))
    return bins.groupBy("vec_id").agg(best.alias("b")).select("vec_id", F.coalesce(-F.col("b.minus"), F.lit(220)).cast("int").alias("v"))


def normalized(pixels: DataFrame, channel: str) -> DataFrame:
    """Values scaled to [0, 1] by each image's range; left alone where that is next to nothing."""
    w = Window.partitionBy("vec_id")
    lo, hi = F.min(channel).over(w), F.max(channel).over(w)
    return pixels.withColumns({"lo": lo, "hi": hi}).withColumn("v", F.when(F.col("hi") - F.col("lo") > 1e-6, (F.col(channel) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.col(channel)))


def quad_scores(pixels: DataFrame, candidates: Column, least: float = 0.02) -> DataFrame:
    """``vec_id, k, score`` of each quad in the array ``candidates``: mean probability, favouring area; none if tiny.

    The array is exploded where the pixels are read, and its sums are combined before the shuffle.
    """
    rows = pixels.select("vec_id", "x", "y", "p", F.posexplode(candidates).alias("k", "q"))
    rows = rows.withColumn("inside", in_polygon(F.col("x"), F.col("y"), F.col("q")))
    sums = rows.groupBy("vec_id", "k").agg(F.count_if("inside").alias("n"), F.avg(F.when(F.col("inside"), F.col("p"))).alias("m"), F.count("*").alias("all"))
    share = F.col("n") / F.col("all")
    return sums.select("vec_id", "k", F.when(share < least, 0.0).otherwise(F.col("m") * (0.7 + 0.3 * share)).alias("score"))
