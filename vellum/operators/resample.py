"""Window means and resampling of images in long form, and the filter that keeps edges.

A pixel is a row ``keys, x, y, value``; ``sizes`` has ``keys, width, height`` of each image, which
need not be alike. Window means come from running sums, so their cost doesn't grow with the window.
Resampling is a sparse matrix product along x and then along y: weights are rows too, joined on the
old place and summed by the new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.geometry import let
from vellum.operators.rasters import each_pixel

#: Diameter, colour and space deviations of the edge-keeping filter; the cubic kernel's constant.
DIAMETER, COLOR_SIGMA, SPACE_SIGMA, CUBIC = 9, 20.0, 10.0, -0.75


def _line_means(rows: DataFrame, keys: list[str], value: str, along: str, across: str, n: Column, k: Column) -> DataFrame:
    """Means over ``k`` places along a line of ``n``, which goes on mirrored; one shuffle."""
    at, before = F.col(along), F.floor(k / 2).cast("int")
    after = k - 1 - before
    mirrored = F.array(at, F.when(at.between(1, before), -at), F.when(at.between(n - 1 - after, n - 2), 2 * (n - 1) - at))
    wide = rows.select(*keys, across, n.alias("n"), k.alias("k"), F.explode(F.filter(mirrored, lambda p: p.isNotNull())).alias("p"), value)
    line = Window.partitionBy(*keys, across).orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    sums = wide.withColumn("sum", F.sum(F.col(value).cast("double")).over(line)).groupBy(*keys, across).agg(
        F.max("n").alias("n"), F.max("k").alias("k"), F.transform(F.array_sort(F.collect_list(F.struct("p", "sum"))), lambda s: s["sum"]).alias("sums")
    )
    means = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (F.get("sums", i + F.col("k") - 1) - F.coalesce(F.get("sums", i - 1), F.lit(0.0))) / F.col("k"))
    return sums.select(*keys, across, F.posexplode(means).alias(along, value))


def box_means(pixels: DataFrame, sizes: DataFrame, keys: list[str], value: str, window: Column) -> DataFrame:
    """``keys, x, y, value``: the mean over a square about each pixel, with mirrored borders.

    ``window`` is made of columns of ``sizes``; it is cut to a whole number, counts as 1 below that, and as a side where it is wider.
    """
    side = lambda n: F.greatest(F.lit(1), F.least(F.floor("window").cast("int"), F.col(n)))
    told = sizes.select(*keys, "width", "height", window.alias("window"))
    rows = _line_means(pixels.select(*keys, "x", "y", value).join(told, keys), keys, value, "x", "y", F.col("width"), side("width"))
    return _line_means(rows.join(told, keys), keys, value, "y", "x", F.col("height"), side("height")).select(*keys, "x", "y", value)


def retinex_windows(width: Column, height: Column, parts: tuple[int, ...] = (80, 10, 2)) -> list[Column]:
    """Odd window sizes, 3 or more, as parts of the longer side."""
    return [F.greatest(F.floor(F.greatest(width, height) / part).cast("int"), F.lit(3)).bitwiseOR(F.lit(1)) for part in parts]


def retinex(pixels: DataFrame, sizes: DataFrame, keys: list[str], value: str, windows: list[Column]) -> DataFrame:
    """``keys, x, y, value``: even lighting, from 0 to 1 in each image.

    Mean, over the windows, of the logarithm of a pixel less that about it; an image without
    contrast is 0 throughout.
    """
    place = [*keys, "x", "y"]
    rows = pixels.select(*place, F.log(F.col(value) + 1.0).alias("log")).withColumn("even", F.lit(0.0))
    for window in windows:
        about = box_means(rows, sizes, keys, "log", window).withColumnRenamed("log", "about")
        rows = rows.join(about, place).select(*place, "log", (F.col("even") + (F.col("log") - F.col("about")) / len(windows)).alias("even"))
    ends = rows.groupBy(*keys).agg(F.min("even").alias("low"), F.max("even").alias("high"))
    span = F.col("high") - F.col("low")
    return rows.join(ends, keys).select(*place, F.when(span > 1e-6, (F.col("even") - F.col("low")) / span).otherwise(F.col("even") - F.col("low")).alias(value))


def area_weights(sizes: DataFrame, keys: list[str], old: str, new: str) -> DataFrame:
    """``keys, at, to, weight``: the parts of old places that each new, wider place covers."""
    scale = F.col(old) / F.col(new)
    rows = sizes.select(*keys, scale.alias("scale"), F.explode(F.sequence(F.lit(0), F.col(new) - 1)).alias("to"))
    first, end = F.col("to") * F.col("scale"), (F.col("to") + 1) * F.col("scale")
    rows = rows.withColumn("at", F.explode(F.sequence(F.floor(first).cast("int"), F.greatest(F.floor(first), F.ceil(end - 1e-9) - 1).cast("int"))))
    covered = F.least(end, F.col("at") + 1) - F.greatest(first, F.col("at"))
    return rows.select(*keys, "at", "to", (F.greatest(covered, F.lit(0.0)) / F.col("scale")).alias("weight"))


def cubic_weights(sizes: DataFrame, keys: list[str], old: str, new: str) -> DataFrame:
    """``keys, at, to, weight``: of the four old places about each new one; beyond the border the last one counts."""
    middle = (F.col("to") + 0.5) * F.col(old) / F.col(new) - 0.5
    rows = sizes.select(*keys, old, new, F.explode(F.sequence(F.lit(0), F.col(new) - 1)).alias("to"))
    rows = rows.withColumn("middle", middle).withColumn("k", F.explode(F.sequence(F.lit(-1), F.lit(2))))
    t, a = F.abs(F.col("middle") - F.floor("middle") - F.col("k")), CUBIC
    weight = F.when(t <= 1, (a + 2) * t * t * t - (a + 3) * t * t + 1).otherwise(a * t * t * t - 5 * a * t * t + 8 * a * t - 4 * a)
    at = F.greatest(F.lit(0), F.least(F.col(old) - 1, F.floor("middle") + F.col("k"))).cast("int")
    return rows.select(*keys, at.alias("at"), "to", weight.alias("weight"))


def resampled(pixels: DataFrame, sizes: DataFrame, keys: list[str], values: list[str], weights=area_weights) -> DataFrame:
    """``keys, x, y, values`` of images of the new size; ``sizes`` has ``width, height, new_width, new_height``."""
    rows = pixels.select(*keys, "x", "y", *values)
    for axis, other, old, new in (("x", "y", "width", "new_width"), ("y", "x", "height", "new_height")):
        w = weights(sizes, keys, old, new).withColumnRenamed("at", axis)
        rows = rows.join(w, [*keys, axis]).groupBy(*keys, other, F.col("to").alias(axis)).agg(*(F.sum(F.col("weight") * F.col(v)).alias(v) for v in values))
    return rows.select(*keys, "x", "y", *values)


def within_budget(width: Column, height: Column, most: Column) -> tuple[Column, Column]:
    """Whole sizes of the same shape, of at most about ``most`` pixels; sizes within it stay."""
    scale = F.least(F.lit(1.0), F.sqrt(most / (width * height)))
    return tuple(F.greatest(F.lit(1), F.floor(n * scale + 1e-9).cast("int")) for n in (width, height))


def edge_keeping(v: Column, width, height) -> Column:
    """An image in a row smoothed: means over a disc, weighted by nearness in place and value, with mirrored
    borders. Both sides must be longer than the disc's radius."""
    r = DIAMETER // 2
    mirror = lambda at, n: F.abs(F.when(at > n - 1, 2 * (n - 1) - at).otherwise(at))
    offsets = [(dx, dy) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dx * dx + dy * dy <= r * r]
    disc = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(-(dx * dx + dy * dy) / (2 * SPACE_SIGMA**2)).alias("near")) for dx, dy in offsets))

    def pixel(x: Column, y: Column, place: Column) -> Column:
        def of(own: Column) -> Column:
            there = lambda d: F.get(v, mirror(y + d["dy"], height) * width + mirror(x + d["dx"], width))
            weigh = lambda d: let(there(d), lambda e: F.struct(e.cast("double").alias("v"), F.exp(d["near"] - (e - own) * (e - own) / (2 * COLOR_SIGMA**2)).alias("w")))
            add = lambda s, p: F.struct((s["t"] + p["v"] * p["w"]).alias("t"), (s["w"] + p["w"]).alias("w"))
            return F.aggregate(F.transform(disc, weigh), F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("w")), add, lambda s: s["t"] / s["w"])

        return let(F.get(v, place), of)

    return each_pixel(width, height, pixel)


def bgr_of_lab(light: Column, a: Column, b: Column) -> Column:
    """struct<b, g, r> in 8 bits of 8-bit CIE Lab."""

    def channels(c: Column) -> Column:
        cube = lambda f: F.when(f > 0.206893, f * f * f).otherwise((f - 16 / 116) / 7.787)
        x, z = cube(c["fy"] + c["a"] / 500) * 0.950456, cube(c["fy"] - c["b"] / 200) * 1.088754
        y = F.when(c["low"], c["l"] / 903.3).otherwise(c["fy"] * c["fy"] * c["fy"])
        # fixed values: XYZ to linear sRGB
        linear = {"r": 3.240479 * x - 1.537150 * y - 0.498535 * z, "g": -0.969256 * x + 1.875991 * y + 0.041556 * z, "b": 0.055648 * x - 0.204043 * y + 1.057311 * z}
        curve = lambda e: F.when(e <= 0.0031308, 12.92 * e).otherwise(1.055 * F.pow(e, F.lit(1 / 2.4)) - 0.055)
        byte = lambda e: let(F.greatest(F.lit(0.0), F.least(F.lit(1.0), e)), lambda t: F.floor(255 * curve(t) + 0.5).cast("int"))
        return F.struct(*(byte(linear[n]).alias(n) for n in "bgr"))

    lightness = light / 2.55
    low = lightness <= 8.0
    fy = F.when(low, 7.787 * lightness / 903.3 + 16 / 116).otherwise((lightness + 16) / 116)
    return let(F.struct(lightness.alias("l"), low.alias("low"), fy.alias("fy"), (a - 128.0).alias("a"), (b - 128.0).alias("b")), channels)
