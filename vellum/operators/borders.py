"""Edges and borders of masks: crests of the gradient that hang together, and the rings about their pixels.

Within its row an image is one of a stack (:mod:`vellum.functions.stacks`), so nothing is shuffled and no
round goes over all images. Pixels in long form are gathered by image to follow their borders; which
of them hang together is also told without gathering, by smallest labels that spread to neighbours, hook
roots to smaller ones and are followed by pointer jumping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import stacks as K
from vellum.functions.stacks import AROUND, SHIFT
from vellum.operators.lineage import fingerprint, settled


def _place(x: Column, y: Column) -> Column:
    return F.shiftleft(y.cast("long"), SHIFT) + x


def _pixel(at: Column) -> tuple[Column, Column]:
    return at.bitwiseAND(2**SHIFT - 1).cast("int").alias("x"), F.shiftright(at, SHIFT).cast("int").alias("y")


def with_crests(images: DataFrame, column: str, width: Column, height: Column, name: str = "crest") -> DataFrame:
    """Crests of the gradient of an image in a row: an array of 0, 1 where above LOW, 2 where above HIGH."""
    return images.withColumn(name, K.filtered(F.col(column), width, height, K.crests))


def pixels_at(images: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """``keys, x, y`` of the pixels at an array of places."""
    rows = images.withColumn("_at", at)
    return rows.select(*keys, F.explode("_at").alias("at")).select(*keys, *_pixel(F.col("at")))


def connected(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, x, y`` and ``label`` of pixels ``keys, x, y``: alike for pixels of an image that hang together, diagonals included."""
    labels = settled(pixels.select(*keys, _place(F.col("x"), F.col("y")).alias("at")).withColumn("label", F.col("at")))
    ways = F.explode(F.array(*(F.lit(dy * 2**SHIFT + dx).cast("long") for dx, dy in AROUND if (dx, dy) != (0, 0))))
    near = labels.select(*keys, "at", ways.alias("way")).select(*keys, "at", (F.col("at") + F.col("way")).alias("to"))
    near = settled(near.join(labels.select(*keys, F.col("at").alias("to")), [*keys, "to"]))
    before = None
    while before != (before := fingerprint(labels, "label")):
        least = near.join(labels.select(*keys, F.col("at").alias("to"), "label"), [*keys, "to"]).groupBy(*keys, "at").agg(F.min("label").alias("other"))
        seen = labels.join(least, [*keys, "at"], "left").select(*keys, "at", "label", F.least("label", F.coalesce("other", "label")).alias("seen"))
        hooked = seen.groupBy(*keys, "label").agg(F.min("seen").alias("root"))
        moved = settled(seen.join(hooked, [*keys, "label"]).select(*keys, "at", F.col("root").alias("label")))
        jump = moved.select(*keys, F.col("at").alias("label"), F.col("label").alias("root"))
        labels = settled(moved.join(jump, [*keys, "label"]).select(*keys, "at", F.col("root").alias("label")))
    return labels.select(*keys, *_pixel(F.col("at")), "label")


def edge_pixels(images: DataFrame, keys: list[str], width: Column) -> DataFrame:
    """``keys, x, y``: pixels of the crests that hang together with one above HIGH; of :func:`with_crests` images."""
    return pixels_at(images, keys, K.places(F.col("crest"), width, (F.size("crest") / width).cast("int"), K.kept))


def borders(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, border, points``: the borders of the regions of pixels and of their holes, as rings of points.

    A ring begins with its first side in reading order; a pixel follows itself only once.
    """
    images = pixels.groupBy(*keys).agg(F.collect_set(_place(F.col("x"), F.col("y"))).alias("at"))
    return images.withColumn("rings", K.rings(F.col("at"))).select(*keys, F.inline("rings"))


def ring_area(points: Column) -> Column:
    """Area in a ring of points."""
    n = F.size(points)
    twice = F.transform(points, lambda p, i: G.let(F.get(points, F.pmod(i + 1, n)), lambda q: p["x"] * q["y"] - q["x"] * p["y"]))
    return F.abs(F.aggregate(twice, F.lit(0.0), lambda s, t: s + t)) / 2


def largest_border(rings: Column) -> Column:
    """``area, points`` of the ring of the largest area, the first of equals; null where none has an area."""
    sized = F.transform(rings, lambda r: F.struct(ring_area(r["points"]).alias("area"), (-r["border"]).alias("last"), r["points"].alias("points")))
    return G.let(F.array_max(sized), lambda best: F.when(best["area"] > 0, F.struct(best["area"].alias("area"), best["points"].alias("points"))))
