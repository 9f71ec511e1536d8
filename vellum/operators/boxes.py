"""Least-area boxes about points, over the whole degrees from 0 to 89."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import geometry as G

DEGREES = 90
TURNS = [(math.cos(math.radians(d)), math.sin(math.radians(d))) for d in range(DEGREES)]


def min_area_rects(rows: DataFrame, keys: list[str], points: list[Column] | Column, width=None, height=None) -> DataFrame:
    """``keys, area, degree, corners``: the box of least area about each row's points, the first of equal degrees.

    ``points`` is an array of points, or a list of Columns where their number is fixed. All is done in
    the row: nothing is multiplied, sorted or shuffled. Corners are clipped to a width x height image where there is one. Rows of fewer than three points
    give none.
    """
    ring = F.array(*points) if isinstance(points, list) else points  # an array is made once, where single points would be put into the lambda
    named = rows.select(*keys, ring.alias("p"), *((s if isinstance(s, Column) else F.lit(s)).alias(n) for n, s in (("_w", width), ("_h", height)) if s is not None)).where(F.size("p") >= 3)
    ends = lambda f, at: f(F.transform("p", at))

    def sides(cos: Column, sin: Column) -> dict[str, Column]:
        along, across = (lambda p: p["x"] * cos - p["y"] * sin), (lambda p: p["x"] * sin + p["y"] * cos)
        return {"x0": ends(F.array_min, along), "x1": ends(F.array_max, along), "y0": ends(F.array_min, across), "y1": ends(F.array_max, across)}

    def area(s: dict[str, Column]) -> Column:
        return (s["x1"] - s["x0"]) * (s["y1"] - s["y0"])

    areas = F.transform(F.array(*(F.struct(F.lit(c).alias("c"), F.lit(s).alias("s")) for c, s in TURNS)), lambda t: area(sides(t["c"], t["s"])))
    size = [c for c in ("_w", "_h") if c in named.columns]
    first = F.coalesce(F.array_position("areas", F.array_min("areas")), F.lit(1)) - 1
    turned = named.withColumn("areas", areas).withColumn("degree", first.cast("int"))
    turned = turned.withColumns({"c": F.get(F.array(*(F.lit(c) for c, _ in TURNS)), "degree"), "s": F.get(F.array(*(F.lit(s) for _, s in TURNS)), "degree")})
    best = turned.select(*keys, *size, "degree", "c", "s", *(e.alias(n) for n, e in sides(F.col("c"), F.col("s")).items()))
    clip = lambda v, n: F.greatest(F.lit(0.0), F.least(F.col(n) - 1.0, v)) if n in size else v
    back = lambda x, y: G.point(clip(F.col(x) * F.col("c") + F.col(y) * F.col("s"), "_w"), clip(F.col(y) * F.col("c") - F.col(x) * F.col("s"), "_h"))
    return best.select(*keys, area({n: F.col(n) for n in ("x0", "x1", "y0", "y1")}).alias("area"), "degree", F.array(back("x0", "y0"), back("x1", "y0"), back("x1", "y1"), back("x0", "y1")).alias("corners"))
