"""Points, lines and quads as Columns. A point is struct<x,y>, a quad struct of four points.

Image axes: x to the right, y down. All functions map Columns to Columns and stay in the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

CORNERS = ("topLeft", "topRight", "bottomRight", "bottomLeft")


def point(x, y) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def quad(tl: Column, tr: Column, br: Column, bl: Column) -> Column:
    return F.struct(*(p.alias(n) for p, n in zip((tl, tr, br, bl), CORNERS, strict=True)))


def corners(q: Column) -> list[Column]:
    return [q[n] for n in CORNERS]


def norm(a: Column, b: Column) -> Column:
    """Distance of two points."""
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def centroid(points: list[Column]) -> Column:
    n = len(points)
    return point(sum(p["x"] for p in points) / n, sum(p["y"] for p in points) / n)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def create_quad(points: Column) -> Column:
    """Quad of an array of four points, ordered by their angle about the centroid.

    Null for any other number of points. Equal angles keep the array's order.
    """

    def ordered(ps: Column, total: Column) -> Column:
        n = F.size(ps)
        return F.array_sort(F.transform(ps, lambda p, i: F.struct(F.atan2(p["y"] - total["y"] / n, p["x"] - total["x"] / n).alias("angle"), i.alias("i"), p.alias("p"))))

    total = lambda ps: F.aggregate(ps, point(F.lit(0.0), F.lit(0.0)), lambda a, p: point(a["x"] + p["x"], a["y"] + p["y"]))
    pick = lambda o: F.when(F.size(o) == 4, quad(*(F.get(o, F.lit(k))["p"] for k in range(4))))
    return let(points, lambda ps: let(total(ps), lambda t: let(ordered(ps, t), pick)))


def rotate90(q: Column, turns: Column, width: Column, height: Column) -> Column:
    """Corners after quarter turns clockwise of a width x height image; other turns than 1 to 3
    modulo 4 change nothing."""
    k = turns % 4

    def turned(p: Column) -> Column:
        return F.when(k == 1, point(height - p["y"], p["x"])).when(k == 2, point(width - p["x"], height - p["y"])).when(k == 3, point(p["y"], width - p["x"])).otherwise(p)

    return create_quad(F.transform(F.array(*corners(q)), turned))


def scaled(q: Column, sx: Column, sy: Column) -> Column:
    return quad(*(point(p["x"] * sx, p["y"] * sy) for p in corners(q)))


def scaled_to(q: Column, from_w: Column, from_h: Column, to_w: Column, to_h: Column) -> Column:
    return scaled(q, to_w / from_w, to_h / from_h)


def is_inside(q: Column, width: Column, height: Column) -> Column:
    """All corners within the image, its border included."""
    ok = F.lit(True)
    for p in corners(q):
        ok = ok & p["x"].between(0, width) & p["y"].between(0, height)
    return ok


def is_convex(q: Column) -> Column:
    """All turns from corner to corner go the same, positive way."""
    ps, ok = corners(q), F.lit(True)
    for i in range(4):
        a, b, c = ps[i], ps[(i + 1) % 4], ps[(i + 2) % 4]
        ok = ok & ((b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"]) > 0)
    return ok


def lerp(a: Column, b: Column, alpha: Column) -> Column:
    return a + alpha * (b - a)


def lerp_quad(a: Column, b: Column, alpha: Column) -> Column:
    return quad(*(point(lerp(p["x"], q["x"], alpha), lerp(p["y"], q["y"], alpha)) for p, q in zip(corners(a), corners(b), strict=True)))


def max_corner_distance(a: Column, b: Column) -> Column:
    """Largest distance of corresponding corners, in single precision."""
    return F.greatest(*(norm(p, q).cast("float") for p, q in zip(corners(a), corners(b), strict=True)))


def normalize_angle(a: Column) -> Column:
    """The same direction within (-pi, pi]."""
    turn = 2 * math.pi
    return a - turn * F.ceil((a - math.pi) / turn)


def angle_diff(a: Column, b: Column) -> Column:
    return F.abs(normalize_angle(a - b))


def fit_line(xs: Column, ys: Column) -> Column:
    """Total-least-squares line of grouped points: struct<x, y, dx, dy>; an aggregate."""
    n = F.count("*")
    xx = F.sum(xs * xs) - F.sum(xs) * F.sum(xs) / n
    yy = F.sum(ys * ys) - F.sum(ys) * F.sum(ys) / n
    xy = F.sum(xs * ys) - F.sum(xs) * F.sum(ys) / n
    theta = 0.5 * F.atan2(2 * xy, xx - yy)
    return F.struct(F.avg(xs).alias("x"), F.avg(ys).alias("y"), F.cos(theta).alias("dx"), F.sin(theta).alias("dy"))


def intersect_lines(a: Column, b: Column) -> Column:
    """Point that two lines struct<x, y, dx, dy> share; null if they are parallel."""
    cross = a["dx"] * b["dy"] - a["dy"] * b["dx"]
    t = ((b["x"] - a["x"]) * b["dy"] - (b["y"] - a["y"]) * b["dx"]) / F.when(F.abs(cross) >= 1e-6, cross)
    return F.when(t.isNotNull(), point(a["x"] + t * a["dx"], a["y"] + t * a["dy"]))


def shoelace(points: list[Column]) -> Column:
    n = len(points)
    twice = sum(points[i]["x"] * points[(i + 1) % n]["y"] - points[(i + 1) % n]["x"] * points[i]["y"] for i in range(n))
    return F.abs(twice) / 2


def touch_candidates(q: Column, x: Column, y: Column, radius: float = 90.0) -> Column:
    """Indices of corners nearer than ``radius``, nearest first."""
    at = F.array(*(F.struct(norm(p, point(x, y)).alias("d"), F.lit(i).alias("i")) for i, p in enumerate(corners(q))))
    return F.transform(F.array_sort(F.filter(at, lambda c: c["d"] < radius)), lambda c: c["i"])


def update_corner(q: Column, index: Column, dx: Column, dy: Column) -> Column:
    """The unit-square quad with one corner moved and clamped; as it was if that isn't convex."""
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    moved = quad(*(F.when(index == i, point(clamp(p["x"] + dx), clamp(p["y"] + dy))).otherwise(p) for i, p in enumerate(corners(q))))
    return F.when(is_convex(moved), moved).otherwise(q)


def letterbox(image_w: Column, image_h: Column, box_w: Column, box_h: Column) -> Column:
    """Size, in whole pixels, and place of an image that fits a box."""
    wide = image_w / image_h > box_w / box_h
    w = F.when(wide, box_w).otherwise(box_h * image_w / image_h).cast("int")
    h = F.when(wide, box_w * image_h / image_w).otherwise(box_h).cast("int")
    return F.struct(w.alias("width"), h.alias("height"), ((box_w - w) / 2).alias("left"), ((box_h - h) / 2).alias("top"))


def loupe_center(x: Column, y: Column, radius: Column, gap: Column, margin: Column, width: Column) -> Column:
    """Centre of a loupe: above the finger, else to its left, else to its right, within the margins."""
    side = F.greatest(margin + radius, y)
    above = y - gap - radius - radius >= margin
    left = x - gap - radius - radius >= margin
    most = width - margin - radius
    return F.when(above, point(F.greatest(margin + radius, F.least(most, x)), y - gap - radius)).when(left, point(x - gap - radius, side)).otherwise(point(F.least(most, x + gap + radius), side))


def dragged(q: Column, index: Column, steps: Column, still: Column, undo: Column) -> Column:
    """The unit-square quad after a gesture: its corner follows the array of ``dx, dy`` steps.

    A step that would leave the quad not convex changes nothing. The last step is taken back where
    ``undo``, a likely wiggle on lifting, holds. Without a touched corner (``still``) nothing moves.
    """
    kept = F.when(undo, F.slice(steps, 1, F.greatest(F.size(steps) - 1, F.lit(0)))).otherwise(steps)
    return F.when(still, q).otherwise(F.aggregate(kept, q, lambda quad_, s: update_corner(quad_, index, s["dx"], s["dy"])))
