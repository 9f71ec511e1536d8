"""Raster operators on images in rows: an image is one row, its values a row-major array.

A window never leaves its image, so these are projections: nothing is shuffled, and images of any
number spread over the cluster like any other rows. Every pass is a column of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.geometry import let

#: Weights of the usual small Gaussian kernels, as binomials.
GAUSSIAN = {3: (1, 2, 1), 5: (1, 4, 6, 4, 1)}


def each_pixel(width, height, pixel: Callable[[Column, Column, Column], Column]) -> Column:
    """The image whose values are ``pixel(x, y, place)``, row by row; sizes are numbers or Columns."""
    w, h = (n if isinstance(n, Column) else F.lit(n) for n in (width, height))
    row = lambda y: F.transform(F.sequence(F.lit(0), w - 1), lambda x: pixel(x, y, y * w + x))
    return F.flatten(F.transform(F.sequence(F.lit(0), h - 1), row))


def _mirrored(at: Column, size: int) -> Column:
    """Border rule: the image continues mirrored, its border pixel not repeated."""
    return F.when(at < 0, -at).when(at > size - 1, 2 * (size - 1) - at).otherwise(at)


def _swept(images: DataFrame, column: str, weights: tuple, width: int, height: int, along_x: bool) -> DataFrame:
    """Weighted sums along rows or columns of the image, anchored in the middle of the weights."""
    v, anchor = F.col(column), len(weights) // 2

    def pixel(x: Column, y: Column, place: Column) -> Column:
        total = None
        for k, weight in enumerate(weights):
            o = k - anchor
            at = place if o == 0 else place - x + _mirrored(x + o, width) if along_x else _mirrored(y + o, height) * width + x
            part = F.get(v, at) * weight
            total = part if total is None else total + part
        return total

    return images.withColumn(column, F.when(v.isNotNull(), each_pixel(width, height, pixel)))


def weighted(images: DataFrame, column: str, weights: tuple, width: int, height: int) -> DataFrame:
    """Separable filter with mirrored borders: the weights along x, then along y, divided by their sum."""
    rows = _swept(_swept(images, column, weights, width, height, True), column, weights, width, height, False)
    return rows.withColumn(column, F.transform(column, lambda e: e / float(sum(weights)) ** 2))


def gaussian(images: DataFrame, column: str, size: int, width: int, height: int) -> DataFrame:
    """Gaussian blur of 3 x 3 or 5 x 5 pixels."""
    return weighted(images, column, GAUSSIAN[size], width, height)


def box(images: DataFrame, column: str, size: float, width: int, height: int) -> DataFrame:
    """Mean over a square; a size that isn't whole is cut, one below 1 counts as 1."""
    return weighted(images, column, (1,) * max(1, int(size)), width, height)


def ellipse(size: int) -> list[tuple[int, int]]:
    """Offsets of an elliptical structuring element in a square of an odd size."""
    r, out = size // 2, []
    for dy in range(-r, r + 1):
        half = int(r * ((r * r - dy * dy) / (r * r)) ** 0.5 + 0.5) if r else 0
        out += [(dx, dy) for dx in range(-half, half + 1)]
    return out


def _picked(images: DataFrame, column: str, offsets: list[tuple[int, int]], width: int, height: int, pick: Callable) -> DataFrame:
    """``pick`` of the values at the offsets, which are a middle part of each line: along x once for each
    length of such a part, then along y."""
    v = F.col(column)
    half = {dy: max(dx for dx, y in offsets if y == dy) for _, dy in offsets}

    def line(reach: int) -> Column:
        def value(x: Column, dx: int, place: Column) -> Column:
            there = F.get(v, place + dx)
            return there if dx == 0 else F.when(x < width - dx if dx > 0 else x >= -dx, there)

        return each_pixel(width, height, lambda x, _, place: pick(*(value(x, dx, place) for dx in range(-reach, reach + 1)))) if reach else v

    def column_of(lines: Column) -> Column:  # nothing above and below the image
        values = [(lambda place, dy=dy, k=k: F.get(lines[f"h{k}"], place + dy * width)) for dy, k in half.items()]
        return each_pixel(width, height, lambda x, _, place: pick(*(value(place) for value in values)) if len(values) > 1 else values[0](place))

    lines = F.struct(*(line(k).alias(f"h{k}") for k in sorted(set(half.values()))))
    return images.withColumn(column, F.when(v.isNotNull(), let(lines, column_of)))


def eroded(images: DataFrame, column: str, offsets: list[tuple[int, int]], width: int, height: int) -> DataFrame:
    """Least value under the structuring element; beyond the border is nothing."""
    return _picked(images, column, offsets, width, height, F.least)


def dilated(images: DataFrame, column: str, offsets: list[tuple[int, int]], width: int, height: int) -> DataFrame:
    return _picked(images, column, offsets, width, height, F.greatest)


def closed(images: DataFrame, column: str, offsets: list[tuple[int, int]], width: int, height: int) -> DataFrame:
    return eroded(dilated(images, column, offsets, width, height), column, offsets, width, height)


def opened(images: DataFrame, column: str, offsets: list[tuple[int, int]], width: int, height: int) -> DataFrame:
    return dilated(eroded(images, column, offsets, width, height), column, offsets, width, height)


def refined_mask(images: DataFrame, column: str, width: int, height: int) -> DataFrame:
    """A document mask made binary, with small holes filled and lone dots removed."""
    binary = images.withColumn(column, F.transform(column, lambda e: F.when(e > 128, 255).otherwise(0)))
    return opened(closed(binary, column, ellipse(5), width, height), column, ellipse(5), width, height)


def as_pixels(images: DataFrame, key: str, width: int, *columns: str) -> DataFrame:
    """``key, x, y`` and the values of the arrays at each pixel."""
    rows = images.select(key, F.posexplode(F.arrays_zip(*columns)).alias("i", "e"))
    return rows.select(key, (F.col("i") % width).alias("x"), F.floor(F.col("i") / width).cast("int").alias("y"), *(F.col("e")[c].alias(c) for c in columns))
