"""Columns whose values numpy works out for a whole Arrow batch: filters, edges and borders of images in rows.

An image is a row-major array. Images of one size form a stack, on which a step is a few array
operations; a stack has at most STACK pixels, or one image. Places are y * 2 ** SHIFT + x. Spark
would copy a deterministic function into each filter that is pushed through its projection, so these
are declared otherwise; they do give the same values again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Thresholds of the gradient, weights of the usual small Gaussian kernels.
LOW, HIGH = 75, 200
GAUSSIAN = {3: (1, 2, 1), 5: (1, 4, 6, 4, 1)}
#: Most pixels of a stack of several images.
STACK = 1 << 18
#: Steps right, down, left, up, and those with diagonals.
STEPS, SHIFT = ((1, 0), (0, 1), (-1, 0), (0, -1)), 20
AROUND = tuple((dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1))


def lists(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The elements of all lists one after the other, and where each list begins, and the last ends."""
    lengths = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return values.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def stacks(values: pa.Array, width: pa.Array, height: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of images of one size, and their pixels by image, y and x. Images of another size than they say have none."""
    flat, start = lists(values)
    size = np.stack([width.fill_null(0).to_numpy(zero_copy_only=False), height.fill_null(0).to_numpy(zero_copy_only=False)], axis=1).astype(np.int64)
    whole = np.flatnonzero((np.diff(start) == size.prod(axis=1)) & (np.diff(start) > 0))
    for w, h in np.unique(size[whole], axis=0):
        rows = whole[(size[whole] == (w, h)).all(axis=1)]
        step = max(1, STACK // (w * h))
        for part in (rows[lo : lo + step] for lo in range(0, len(rows), step)):
            yield part, flat[start[part][:, None] + np.arange(w * h)].reshape(len(part), h, w)


def _listed(n: int, rows: np.ndarray, values: np.ndarray | pa.Array) -> pa.Array:
    """A list for each of n rows, of the values in order of their rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def blurred(size: int) -> Callable:
    """Gaussian blur, mirrored at the border, rounded to whole values."""
    weights, r = GAUSSIAN[size], size // 2

    def run(a: np.ndarray) -> np.ndarray:
        a = a.astype(np.int32)
        for axis in (1, 2):
            p = np.pad(a, [(r, r) if k == axis else (0, 0) for k in range(3)], mode="reflect")
            at = lambda k: p[:, k : k + a.shape[1]] if axis == 1 else p[:, :, k : k + a.shape[2]]  # noqa: B023, E731
            a = sum(w * at(k) for k, w in enumerate(weights))
        total = sum(weights) ** 2
        return (a + total // 2) // total

    return run


#: Offsets of an elliptical structuring element of 5 x 5 pixels.
ELLIPSE = [(dx, dy) for dy, half in zip(range(-2, 3), (0, 2, 2, 2, 0), strict=True) for dx in range(-half, half + 1)]


def _under(a: np.ndarray, pick: Callable, beyond: int) -> np.ndarray:
    p = np.pad(a, ((0, 0), (2, 2), (2, 2)), constant_values=beyond)
    return reduce(pick, (p[:, 2 + dy : 2 + dy + a.shape[1], 2 + dx : 2 + dx + a.shape[2]] for dx, dy in ELLIPSE))


def closed(a: np.ndarray) -> np.ndarray:
    """A binary image without small holes; beyond the border is nothing."""
    return _under(_under(a, np.maximum, 0), np.minimum, 255)


def refined(a: np.ndarray) -> np.ndarray:
    """A document mask made binary, with small holes filled and lone dots removed."""
    return _under(_under(closed(np.where(a > 128, 255, 0).astype(np.uint8)), np.minimum, 255), np.maximum, 0)


def crests(a: np.ndarray) -> np.ndarray:
    """0, 1 at crests of the gradient above LOW, 2 at those above HIGH.

    The image goes on with its border pixels. Across a crest the gradient falls on one side and doesn't
    rise on the other, by direction in four sectors.
    """
    p = np.pad(a.astype(np.int32), ((0, 0), (1, 1), (1, 1)), mode="edge")
    across, down = p[:, :, 2:] - p[:, :, :-2], p[:, 2:] - p[:, :-2]
    gx, gy = across[:, :-2] + 2 * across[:, 1:-1] + across[:, 2:], down[:, :, :-2] + 2 * down[:, :, 1:-1] + down[:, :, 2:]
    wide = np.pad(np.abs(gx) + np.abs(gy), ((0, 0), (1, 1), (1, 1)))
    here = np.nonzero(wide[:, 1:-1, 1:-1] > LOW)
    gx, gy = gx[here], gy[here]
    at = lambda dx, dy: wide[here[0], here[1] + 1 + dy, here[2] + 1 + dx]
    size = at(0, 0)
    flat, steep = np.abs(gy) < math.tan(math.pi / 8) * np.abs(gx), np.abs(gy) > math.tan(3 * math.pi / 8) * np.abs(gx)
    tops = [(size > at(-dx, -dy)) & (size >= at(dx, dy)) for dx, dy in ((1, 0), (0, 1), (1, 1), (-1, 1))]
    top = np.select([flat, steep, (gx < 0) == (gy < 0)], tops[:3], tops[3])
    out = np.zeros(a.shape, np.uint8)
    out[here] = np.where(top, np.where(size > HIGH, 2, 1), 0)
    return out


def kept(crest: np.ndarray) -> np.ndarray:
    """Crests that hang together with one above HIGH, diagonals included: each round goes on from those of the round before."""
    p = np.pad(crest, ((0, 0), (1, 1), (1, 1))).ravel()
    line = crest.shape[2] + 2
    ways = np.array([dx + dy * line for dx, dy in AROUND if (dx, dy) != (0, 0)])
    new = np.flatnonzero(p == 2)
    while len(new):
        near = (new[:, None] + ways).ravel()
        new = np.unique(near[p[near] == 1])
        p[new] = 2
    return p.reshape(len(crest), crest.shape[1] + 2, line)[:, 1:-1, 1:-1] == 2


def filtered(image: Column, width: Column, height: Column, *steps: Callable) -> Column:
    """The image after the steps, each a function of a stack."""

    def run(values: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
        rows, out = [], []
        for part, a in stacks(values, width, height):
            rows.append(np.repeat(part, a[0].size))
            out.append(reduce(lambda b, step: step(b), steps, a).astype(np.int32).ravel())
        rows, out = (np.concatenate([*x, np.empty(0, np.int32)]) for x in (rows, out))
        order = np.argsort(rows, kind="stable")
        return _listed(len(values), rows[order], out[order])

    return F.arrow_udf(run, "array<int>").asNondeterministic()(image, width, height)


def places(image: Column, width: Column, height: Column, *steps: Callable, limit: Column | None = None) -> Column:
    """Places of the pixels that aren't 0 after the steps, in reading order. With a limit the image is first cut there, and small holes closed."""

    def run(values: pa.Array, width: pa.Array, height: pa.Array, limit: pa.Array) -> pa.Array:
        limits = limit.to_numpy(zero_copy_only=False)
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for part, a in stacks(values, width, height):
            if cut:
                a = closed(np.where(a > limits[part][:, None, None], 255, 0).astype(np.uint8))
            i, y, x = np.nonzero(reduce(lambda b, step: step(b), steps, a))
            found.append((part[i], (y << SHIFT) + x))
        rows, at = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(rows, kind="stable")
        return _listed(len(values), rows[order], at[order])

    cut = limit is not None
    return F.arrow_udf(run, "array<bigint>").asNondeterministic()(image, width, height, limit if cut else F.lit(0.0))


def _sides(row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each side, 4 * number of a pixel + direction, the side that follows; and whether it faces outside.

    A side has its pixel to the right. Diagonal neighbours hang together. Pixels are in order of row and place.
    """
    key = (row << 2 * SHIFT) + at
    n = len(key)

    def there(dx: int, dy: int) -> tuple[np.ndarray, np.ndarray]:
        want = key + (dy << SHIFT) + dx
        k = np.minimum(np.searchsorted(key, want), n - 1)
        return key[k] == want, k

    near = {way: there(*way) for way in AROUND if way != (0, 0)}
    follows, faces = np.empty((n, 4), np.int64), np.empty((n, 4), bool)
    for d, (ax, ay) in enumerate(STEPS):
        lx, ly = STEPS[d - 1]
        (turn, turned), (ahead, on) = near[ax + lx, ay + ly], near[ax, ay]
        follows[:, d] = np.where(turn, 4 * turned + (d - 1) % 4, np.where(ahead, 4 * on + d, 4 * np.arange(n) + (d + 1) % 4))
        faces[:, d] = ~near[lx, ly][0]
    return follows.ravel(), faces.ravel()


def _rings(at: pa.Array) -> pa.Array:
    flat, start = lists(at)
    row = np.repeat(np.arange(len(at)), np.diff(start))
    order = np.lexsort((flat, row))
    row, flat = row[order], flat[order].astype(np.int64)
    after, faces = _sides(row, flat) if len(flat) else (np.empty(0, np.int64), np.empty(0, bool))
    # pointer doubling: the least side of the border and the way to it, over twice as many sides each round
    least, steps, span = np.arange(len(after)), np.zeros(len(after), np.int64), 1
    while True:
        far = least[after]
        nearer = (far < least) & faces
        if not nearer.any():
            break
        least, steps = np.where(nearer, far, least), np.where(nearer, steps[after] + span, steps)
        after, span = after[after], 2 * span
    sides = np.flatnonzero(faces)
    sides = sides[np.lexsort((np.where(steps[sides] == 0, -(2**62), -steps[sides]), least[sides]))]
    ring, spot = least[sides], flat[sides // 4]
    # a pixel follows itself only once, also from the last side to the first
    first = np.flatnonzero(np.r_[True, ring[1:] != ring[:-1]][: len(ring)])
    before = np.roll(spot, 1)
    before[first] = spot[np.r_[first[1:], len(ring)] - 1] if len(first) else before[first]
    fresh = spot != before
    fresh[first] |= ~np.logical_or.reduceat(fresh, first) if len(first) else False
    borders, ring, spot = ring[first], ring[fresh], spot[fresh]
    points = pa.StructArray.from_arrays([pa.array((spot & (2**SHIFT - 1)).astype(np.float64)), pa.array((spot >> SHIFT).astype(np.float64))], names=["x", "y"])
    ends = np.searchsorted(ring, borders) if len(borders) else np.empty(0, np.int64)
    points = pa.ListArray.from_arrays(pa.array(np.r_[ends, len(ring)], pa.int32()), points)
    found = pa.StructArray.from_arrays([pa.array(4 * flat[borders // 4] + borders % 4), points], names=["border", "points"])
    return _listed(len(at), row[borders // 4], found)


def rings(at: Column) -> Column:
    """``border, points`` of each border of a region or hole of the pixels at some places, as a ring of points.

    A border's number is 4 * place + direction of its first side in reading order, with which its ring begins.
    """

    def run(at: pa.Array) -> pa.Array:
        return _rings(at)

    return F.arrow_udf(run, "array<struct<border:bigint,points:array<struct<x:double,y:double>>>>").asNondeterministic()(at)


def quad_means(mask: Column, width: Column, points: Column) -> Column:
    """``share, mean``: the part of a mask that lies in a quad of whole corners, its sides included, and the mean there."""

    def run(mask: pa.Array, width: pa.Array, points: pa.Array) -> pa.Array:
        share, mean = np.full(len(mask), np.nan), np.full(len(mask), np.nan)
        corners, many = points.flatten(), points.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        begin = np.cumsum(many) - many
        wide = np.where(many == 4, width.fill_null(0).to_numpy(zero_copy_only=False), 0)
        width, height = pa.array(wide), pa.array(np.diff(lists(mask)[1]) // np.maximum(1, wide))
        cx, cy = (np.trunc(corners.field(k).to_numpy(zero_copy_only=False) + 1e-9).astype(np.int64) for k in (0, 1))
        for part, a in stacks(mask, width, height):
            y, x = np.mgrid[: a.shape[1], : a.shape[2]]
            odd, on = np.zeros(a.shape, bool), np.zeros(a.shape, bool)
            for k in range(4):
                x0, y0, x1, y1 = (c[begin[part] + j][:, None, None] for j in (k, (k + 1) % 4) for c in (cx, cy))
                turn = (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)
                on |= (turn == 0) & (x >= np.minimum(x0, x1)) & (x <= np.maximum(x0, x1)) & (y >= np.minimum(y0, y1)) & (y <= np.maximum(y0, y1))
                odd ^= ((y0 <= y) != (y1 <= y)) & ((turn < 0) == (y1 > y0))
            inside = (odd | on).reshape(len(a), -1)
            count = inside.sum(axis=1)
            share[part] = count / inside.shape[1]
            mean[part] = np.cumsum(np.where(inside, a.reshape(inside.shape), 0.0), axis=1)[:, -1] / np.maximum(count, 1)
        return pa.StructArray.from_arrays([pa.array(share, from_pandas=True), pa.array(mean, from_pandas=True)], names=["share", "mean"])

    return F.arrow_udf(run, "struct<share:double,mean:double>").asNondeterministic()(mask, width, points)
