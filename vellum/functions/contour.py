"""Sides and corners of closed contours, and convex hulls, as Columns.

A contour is an array of points struct<x,y> in order. Folds over the array carry what decides on the
next point: the direction of the open run, the sides chosen so far, the stack of a hull. Angles
within 1e-9 of a limit count as on it, and of equal turns the first counts, so that results don't
hang on the last digit of a sine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.geometry import angle_diff, intersect_lines, let, point

#: Smoothing window, angles (degrees) within a run, between runs that merge and between
#: dominant ones, least part of the perimeter, least points of a contour, sides.
WINDOW, WITHIN, MERGE, APART, LEAST_PART, LEAST_POINTS, SIDES = 5, 5.0, 7.0, 25.0, 0.02, 20, 4
EPSILON = 1e-9
RUN = "struct<start:int,end:int,angle:double,length:double>"


def _at(array: Column, i: Column) -> Column:
    """Element of a ring: indices wrap around."""
    return F.get(array, F.pmod(i, F.size(array)))


def _from(array: Column, i) -> Column:
    """A ring from its element ``i`` on, as a whole: cheaper than to look up each element by a wrapped index."""
    n = F.size(array)
    k = F.pmod(i if isinstance(i, Column) else F.lit(i), F.greatest(n, F.lit(1)))
    return F.concat(F.slice(array, k + 1, n), F.slice(array, F.lit(1), k))


def _sums(values: Column, count: int) -> Column:
    """Sums over ``count`` elements of a ring from each one on, out of sums over powers of two."""

    def wider(s: Column, done: int, left: int) -> Column:  # s: sums over ``done`` elements, whatever remains is added behind
        if not left:
            return s
        if left >= done:
            return let(F.zip_with(s, _from(s, done), lambda a, b: a + b), lambda t: wider(t, 2 * done, left - done))
        return let(_sums(values, left), lambda rest: F.zip_with(s, _from(rest, done), lambda a, b: a + b))

    return wider(values, 1, count - 1)


def _mean(a: Column, b: Column) -> Column:
    return F.atan2(F.sin(a) + F.sin(b), F.cos(a) + F.cos(b))


def _run(start: Column, end: Column, angle: Column, length: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), angle.alias("angle"), length.alias("length"))


def perimeter(points: Column) -> Column:
    """Length of the line through the points, from the first to the last."""
    steps = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.size(points)), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, v: s + v)


def smoothed_angles(points: Column, window: int = WINDOW) -> Column:
    """Direction of a ring at each point, from its neighbours, as circular mean over ``window`` points either way."""

    def units(ps: Column) -> Column:
        angles = F.zip_with(_from(ps, 1), _from(ps, -1), lambda b, a: F.atan2(b["y"] - a["y"], b["x"] - a["x"]))
        return let(angles, lambda a: F.struct(F.transform(a, F.cos).alias("c"), F.transform(a, F.sin).alias("s")))

    def smooth(us: Column) -> Column:
        wide = F.struct(_sums(us["s"], 2 * window + 1).alias("s"), _sums(us["c"], 2 * window + 1).alias("c"))
        return let(wide, lambda w: _from(F.zip_with(w["s"], w["c"], F.atan2), -window))

    return let(let(points, units), smooth)


def sharpest_turn(angles: Column) -> Column:
    """The index behind the sharpest turn of a ring of directions; 0 if none turns."""
    turns = F.zip_with(_from(angles, 1), angles, angle_diff)
    # the maximum is bound: inside the lambda it would be sought again for each point
    place = lambda k: F.array_position(F.transform(k["t"], lambda d: d >= k["most"] - EPSILON), True) % F.size(k["t"])
    first = lambda k: F.when(k["most"] > EPSILON, place(k)).otherwise(0)
    return let(let(turns, lambda t: F.struct(t.alias("t"), F.array_max(t).alias("most"))), lambda k: first(k).cast("int"))


def straight_runs(points: Column, angles: Column) -> Column:
    """Runs of a ring that keep within WITHIN degrees of their running mean direction, as array of
    struct<start, end, angle, length>: indices of the first point and of the one behind the last.

    They begin behind the sharpest turn. Runs shorter than LEAST_PART of the perimeter are left out,
    and so is one all around, which has no length.
    """

    def walk(c: Column) -> Column:
        angle, way, first = c["angles"], c["way"], c["first"]
        n, least = F.size(angle), F.aggregate(F.slice(way, 2, F.size(way)), F.lit(0.0), lambda s, v: s + v) * LEAST_PART
        start = F.struct(F.lit(0).alias("s"), _at(angle, first).alias("angle"), F.lit(0).alias("start"), F.lit(0.0).alias("length"), F.array().cast(f"array<{RUN}>").alias("runs"))
        ahead = F.zip_with(_from(angle, first + 1), _from(way, first + 1), lambda a, w: F.struct(a.alias("angle"), w.alias("way")))
        at = lambda s: F.pmod(first + s, n)

        def go(k: Column) -> Column:
            def step(have: Column, p: Column) -> Column:
                s, length = have["s"] + 1, have["length"] + p["way"]
                stays = (s < k["n"]) & (angle_diff(p["angle"], have["angle"]) < math.radians(WITHIN) - EPSILON)
                kept = (length >= k["least"]) & (length > 0) & (s - have["start"] < k["n"])
                closed = F.when(kept, F.concat(have["runs"], F.array(_run(at(have["start"]), at(s), have["angle"], length)))).otherwise(have["runs"])
                state = lambda angle, start, length, runs: F.struct(s.alias("s"), angle.alias("angle"), start.alias("start"), length.alias("length"), runs.alias("runs"))
                return F.when(stays, state(_mean(have["angle"], p["angle"]), have["start"], length, have["runs"])).otherwise(state(p["angle"], s, F.lit(0.0), closed))

            return F.aggregate(k["ahead"], start, step, lambda a: a["runs"])

        return let(F.struct(n.alias("n"), least.alias("least"), ahead.alias("ahead")), go)

    way = F.zip_with(points, _from(points, -1), lambda b, a: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    known = F.struct(angles.alias("angles"), way.alias("way"), sharpest_turn(angles).alias("first"))
    return F.when(F.size(points) > 0, let(known, walk)).otherwise(F.array().cast(f"array<{RUN}>"))


def merged_runs(runs: Column) -> Column:
    """Neighbours of nearly one direction as one run, where there are more than four."""
    start = lambda r: F.struct(F.get(r, F.lit(0)).alias("open"), F.array().cast(f"array<{RUN}>").alias("done"))

    def step(have: Column, run: Column) -> Column:
        last = have["open"]
        joins = angle_diff(run["angle"], last["angle"]) < math.radians(MERGE) - EPSILON
        both = _run(last["start"], run["end"], _mean(last["angle"], run["angle"]), last["length"] + run["length"])
        return F.struct(F.when(joins, both).otherwise(run).alias("open"), F.when(joins, have["done"]).otherwise(F.concat(have["done"], F.array(last))).alias("done"))

    fold = lambda r: F.aggregate(F.slice(r, 2, F.size(r)), start(r), step, lambda a: F.concat(a["done"], F.array(a["open"])))
    return let(runs, lambda r: F.when(F.size(r) > 4, fold(r)).otherwise(r))


def dominant_sides(runs: Column, most: int = SIDES) -> Column:
    """The longest runs, at most ``most``, whose directions lie APART degrees or more from those of all longer ones chosen, in contour order.

    Of runs equal to six digits the earlier one counts as longer.
    """
    ranked = F.transform(F.array_sort(F.transform(runs, lambda r, i: F.struct((-F.round(r["length"], 6)).alias("l"), i.alias("i"), r.alias("run")))), lambda x: x["run"])
    clear = lambda chosen, run: F.forall(chosen, lambda c: angle_diff(run["angle"], c["angle"]) >= math.radians(APART) - EPSILON)
    chosen = F.aggregate(ranked, F.array().cast(f"array<{RUN}>"), lambda have, run: F.when((F.size(have) < most) & clear(have, run), F.concat(have, F.array(run))).otherwise(have))
    return F.array_sort(chosen)


def fitted_line(points: Column) -> Column:
    """Total-least-squares line of an array of points: struct<x, y, dx, dy>."""

    def around(c: Column) -> Column:
        sums = lambda f: F.aggregate(points, F.lit(0.0), lambda s, p: s + f(p["x"] - c["x"], p["y"] - c["y"]))
        theta = 0.5 * F.atan2(2 * sums(lambda x, y: x * y), sums(lambda x, y: x * x) - sums(lambda x, y: y * y))
        return let(theta, lambda t: F.struct(c["x"].alias("x"), c["y"].alias("y"), F.cos(t).alias("dx"), F.sin(t).alias("dy")))

    total = F.aggregate(points, point(F.lit(0.0), F.lit(0.0)), lambda a, p: point(a["x"] + p["x"], a["y"] + p["y"]))
    return let(let(total, lambda t: point(t["x"] / F.size(points), t["y"] / F.size(points))), around)


def points_of_run(points: Column, run: Column) -> Column:
    """A run's points, around the end of the array where it wraps."""
    start, end = run["start"], run["end"]
    return F.when(start < end, F.slice(points, start + 1, end - start)).otherwise(F.concat(F.slice(points, start + 1, F.size(points) - start), F.slice(points, F.lit(1), end)))


def sides_of_contour(points: Column) -> Column:
    """:func:`dominant_sides` of a contour of doubles."""
    return dominant_sides(merged_runs(let(points, lambda ps: let(smoothed_angles(ps), lambda a: straight_runs(ps, a)))))


def quad_of_contour(points: Column) -> Column:
    """Corners, in contour order, where the lines fitted to the four dominant sides meet.

    Null for fewer than LEAST_POINTS points, another number of sides, and neighbours that are parallel.
    """

    def corners(c: Column) -> Column:
        lines = F.transform(c["sides"], lambda run: let(points_of_run(c["points"], run), fitted_line))
        meet = lambda ls: F.array(*(intersect_lines(F.get(ls, F.lit(i)), F.get(ls, F.lit((i + 1) % SIDES))) for i in range(SIDES)))
        whole = let(let(lines, meet), lambda q: F.when(F.forall(q, lambda p: p.isNotNull()), q))
        return F.when(F.size(c["sides"]) == SIDES, whole)

    found = let(points, lambda ps: let(F.struct(ps.alias("points"), sides_of_contour(ps).alias("sides")), corners))
    return F.when(F.size(points) >= LEAST_POINTS, found)


def _left(o: Column, a: Column, b: Column) -> Column:
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"]) > 0


def hull_ring(points: Column) -> Column:
    """Corners of the convex hull as ends of its edges, from the least (x, y) on, each turn of positive sense.

    Points on its edges are no corners; a line has its two ends, a lone point no edge.
    """

    def chain(sorted_: Column) -> Column:
        def push(stack: Column, p: Column) -> Column:
            # what a loop would pop lies behind the last place from which p is a left turn
            keep = F.filter(F.sequence(F.lit(2), F.size(stack)), lambda j: _left(F.get(stack, j - 2), F.get(stack, j - 1), p))
            return F.when(F.size(stack) < 2, F.concat(stack, F.array(p))).otherwise(F.concat(F.slice(stack, F.lit(1), F.coalesce(F.array_max(keep), F.lit(1))), F.array(p)))

        none = F.filter(sorted_, lambda _: F.lit(False))
        return let(F.aggregate(sorted_, none, push), lambda s: F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))))

    return let(F.array_sort(F.array_distinct(points)), lambda ps: F.concat(chain(ps), chain(F.reverse(ps))))


def convex_hull(points: Column) -> Column:
    """:func:`hull_ring` of more than three distinct points; three or fewer come back in order."""
    return let(F.array_sort(F.array_distinct(points)), lambda ps: F.when(F.size(ps) > 3, hull_ring(ps)).otherwise(ps))
