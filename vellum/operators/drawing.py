"""Polygons, overlays, resizing and perspective on images in long form, and HTML reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import geometry as G

IMAGE = "vec_id"


def _sides(q: Column) -> list[tuple[Column, Column]]:
    c = G.corners(q)
    return list(zip(c, [*c[1:], c[0]], strict=True))


def in_polygon(x: Column, y: Column, q: Column) -> Column:
    """Whether a pixel lies in a convex quad of either orientation, its border included."""
    turns = [(b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"]) for a, b in _sides(q)]
    return reduce(lambda s, t: s & t, (t >= 0 for t in turns)) | reduce(lambda s, t: s & t, (t <= 0 for t in turns))


def _from_segment(x: Column, y: Column, a: Column, b: Column) -> Column:
    """Squared distance of a pixel from a segment; one without length is a point."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    t = F.coalesce(F.try_divide((x - a["x"]) * dx + (y - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    ex, ey = x - a["x"] - t * dx, y - a["y"] - t * dy
    return ex * ex + ey * ey


def with_polygon(pixels: DataFrame, q: Column, width: float = 3, radius: float = 6) -> DataFrame:
    """The quad's sides in blue, and over them its corners as filled yellow circles."""
    x, y = F.col("x"), F.col("y")
    corner = F.least(*((x - c["x"]) * (x - c["x"]) + (y - c["y"]) * (y - c["y"]) for c in G.corners(q))) <= radius**2
    side = F.least(*(_from_segment(x, y, a, b) for a, b in _sides(q))) <= width**2 / 4
    paint = lambda c, at_corner, at_side: F.when(corner, at_corner).when(side, at_side).otherwise(F.col(c))
    return pixels.withColumns({"b": paint("b", 0, 255), "g": paint("g", 255, 0), "r": paint("r", 255, 0)})


def with_overlay(pixels: DataFrame, mask: str, down: int = 80, green: int = 153) -> DataFrame:
    """Darkened pixels, green where the mask, stretched over its image's range, isn't 0.

    A mask of one value shows nothing. Darkening takes the absolute difference.
    """
    span = pixels.groupBy(IMAGE).agg(F.min(mask).alias("lo"), F.max(mask).alias("hi"))
    shown = F.coalesce(F.round(F.try_divide((F.col(mask) - F.col("lo")) * 255, F.col("hi") - F.col("lo"))), F.lit(0)) > 0
    dark = {c: F.abs(F.col(c) - down) for c in "bgr"}
    dark["g"] = F.when(shown, F.least(F.lit(255), dark["g"] + green)).otherwise(dark["g"])
    return pixels.join(span, IMAGE).withColumns(dark).drop("lo", "hi")


def _targets(at: Column, size: int, new: int) -> Column:
    """Places on a resized axis that a pixel has a part in, with its weight there."""
    scale = size / new
    low = F.when(at == 0, 0).otherwise(F.greatest(F.lit(0), F.floor((at - 0.5) / scale - 0.5)))
    high = F.when(at == size - 1, new - 1).otherwise(F.least(F.lit(new - 1), F.ceil((at + 1.5) / scale - 0.5)))
    place = lambda d: F.greatest(F.lit(0.0), F.least(F.lit(float(size - 1)), (d + 0.5) * scale - 0.5))
    ends = F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(ends, lambda d: F.struct(d.alias("at"), (1 - F.abs(place(d) - at)).alias("w"))), lambda t: t["w"] > 0)


def resized(pixels: DataFrame, channel: str, size: tuple[int, int], new: tuple[int, int]) -> DataFrame:
    """Bilinear resize, pixel centres aligned: ``vec_id, x, y, v``. One aggregation, no join."""
    rows = pixels.select(IMAGE, channel, "y", F.explode(_targets(F.col("x"), size[0], new[0])).alias("tx"))
    rows = rows.select(IMAGE, channel, "tx", F.explode(_targets(F.col("y"), size[1], new[1])).alias("ty"))
    return rows.groupBy(IMAGE, F.col("tx.at").alias("x"), F.col("ty.at").alias("y")).agg(F.sum(F.col(channel) * F.col("tx.w") * F.col("ty.w")).alias("v"))


def thumbnail_size(width: int, height: int, most: int) -> tuple[int, int]:
    """Size within a square of ``most`` pixels, proportions kept; small images grow."""
    ratio = min(most / width, most / height)
    return int(width * ratio), int(height * ratio)


def warped(pixels: DataFrame, quads: DataFrame, channel: str, width: int, height: int) -> DataFrame:
    """The quad of each image drawn out to a rectangle, bilinear, 0 beyond the image.

    ``quads`` has ``vec_id, q``. Returns ``vec_id, x, y, v``. A projective map of the unit square to
    the quad gives each target's source place in closed form; up to four pixels are joined there.
    Quads whose sides leave no such map have no pixels.
    """
    (tl, tr, br, bl) = G.corners(F.col("q"))
    part = lambda k: {f"{k}0": tl[k], f"{k}1": tr[k] - br[k], f"{k}2": bl[k] - br[k], f"{k}s": tl[k] - tr[k] + br[k] - bl[k]}
    m = quads.withColumns(part("x") | part("y")).withColumn("det", F.expr("x1 * y2 - x2 * y1")).where("det <> 0")
    m = m.withColumns({"g": F.expr("try_divide(xs * y2 - x2 * ys, det)"), "h": F.expr("try_divide(x1 * ys - xs * y1, det)")})
    slope = lambda k: {f"{k}u": tr[k] - tl[k] + F.col("g") * tr[k], f"{k}v": bl[k] - tl[k] + F.col("h") * bl[k]}
    m = m.withColumns(slope("x") | slope("y")).select(IMAGE, "g", "h", "x0", "y0", "xu", "xv", "yu", "yv")
    out = m.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(width * height - 1)))).withColumns({"tx": F.col("i") % width, "ty": F.floor(F.col("i") / width).cast("int")})
    out = out.withColumns({"u": F.col("tx") / width, "w": F.col("ty") / height}).withColumn("z", F.expr("g * u + h * w + 1"))
    out = out.select(IMAGE, "tx", "ty", F.expr("try_divide(xu * u + xv * w + x0, z)").alias("sx"), F.expr("try_divide(yu * u + yv * w + y0, z)").alias("sy"))
    tap = lambda i, j: F.struct((F.floor("sx") + i).cast("int").alias("x"), (F.floor("sy") + j).cast("int").alias("y"))
    taps = out.withColumn("t", F.explode(F.array(*(tap(i, j) for i in (0, 1) for j in (0, 1)))))
    weight = (1 - F.abs(F.col("sx") - F.col("t.x"))) * (1 - F.abs(F.col("sy") - F.col("t.y")))
    taps = taps.select(IMAGE, "tx", "ty", "t.x", "t.y", weight.alias("weight"))
    found = taps.join(pixels.select(IMAGE, "x", "y", channel), [IMAGE, "x", "y"], "left")
    return found.groupBy(IMAGE, F.col("tx").alias("x"), F.col("ty").alias("y")).agg(F.sum(F.coalesce(F.col(channel), F.lit(0)) * F.col("weight")).alias("v"))


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def write_report(entries: DataFrame, title: str, path: str) -> None:
    """``name, html`` as one page over ordered part files; joined in order they are the page."""
    spark = entries.sparkSession
    head = f'<!DOCTYPE html><html><head><meta charset="UTF-8"/><title>{title}</title></head><body><h1>{title}</h1>'
    ends = spark.createDataFrame([(0, "", head), (2, "", "</body></html>")], "part int, name string, html string")
    rows = ends.unionByName(entries.select(F.lit(1).alias("part"), "name", "html"))
    rows.orderBy("part", "name").select("html").write.text(path)
