"""Plain numpy versions of detection, one image at a time, to hold the Spark ones against."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from vellum.operators.rasters import ellipse

#: Neighbours clockwise from the right, in image axes.
AROUND = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))
#: Fixed values of contour sides and of scores.
WINDOW, WITHIN, MERGE, APART, LEAST_PART, LEAST_POINTS, LEAST_AREA = 5, 5.0, 7.0, 25.0, 0.02, 20, 0.02


def smoothed(a: np.ndarray, weights: tuple[int, ...] = (1, 2, 1)) -> np.ndarray:
    """Gaussian blur with mirrored borders, rounded: 3 x 3, or 5 x 5 with (1, 4, 6, 4, 1)."""
    r, total = len(weights) // 2, sum(weights) ** 2
    p = np.pad(a.astype(np.int64), r, mode="reflect")
    rows = sum(w * p[:, k : k + a.shape[1]] for k, w in enumerate(weights))
    return (sum(w * rows[k : k + a.shape[0]] for k, w in enumerate(weights)) + total // 2) // total


def edges(a: np.ndarray, low: int = 75, high: int = 200) -> np.ndarray:
    """Canny edges: crests of the gradient above ``low`` that hang together with one above ``high``."""
    p = np.pad(a.astype(np.int64), 1, mode="edge")
    smooth = lambda q, axis: sum(w * np.take(q, range(k, k + q.shape[axis] - 2), axis) for k, w in enumerate((1, 2, 1)))
    gx, gy = smooth(p[:, 2:] - p[:, :-2], 0), smooth(p[2:] - p[:-2], 1)
    size = np.abs(gx) + np.abs(gy)
    wide = np.pad(size, 1)
    at = lambda dx, dy: wide[1 + dy : 1 + dy + a.shape[0], 1 + dx : 1 + dx + a.shape[1]]
    flat, steep = np.abs(gy) < np.tan(np.pi / 8) * np.abs(gx), np.abs(gy) > np.tan(3 * np.pi / 8) * np.abs(gx)
    falling = (gx < 0) == (gy < 0)
    crest = np.zeros(a.shape, bool)
    for where, (dx, dy) in ((flat, (1, 0)), (steep & ~flat, (0, 1)), (~flat & ~steep & falling, (1, 1)), (~flat & ~steep & ~falling, (-1, 1))):
        crest |= where & (size > at(-dx, -dy)) & (size >= at(dx, dy))
    crest &= size > low
    kept = crest & (size > high)
    while True:  # a ring further along the crests each time
        wide_kept = np.pad(kept, 1)
        more = crest & np.logical_or.reduce([wide_kept[1 + dy : 1 + dy + a.shape[0], 1 + dx : 1 + dx + a.shape[1]] for dx, dy in (*AROUND, (0, 0))])
        if (more == kept).all():
            return kept
        kept = more


def _under(a: np.ndarray, pick: Callable, beyond: int, size: int = 5) -> np.ndarray:
    r = size // 2
    p = np.pad(a, r, constant_values=beyond)
    return pick.reduce([p[r + dy : r + dy + a.shape[0], r + dx : r + dx + a.shape[1]] for dx, dy in ellipse(size)])


def dilated(a: np.ndarray) -> np.ndarray:
    return _under(a, np.maximum, 0)


def eroded(a: np.ndarray) -> np.ndarray:
    return _under(a, np.minimum, 255)


def refined(a: np.ndarray) -> np.ndarray:
    """A binary mask without small holes and lone dots."""
    return dilated(eroded(eroded(dilated(np.where(a > 128, 255, 0)))))


def contours(mask: np.ndarray) -> list[np.ndarray]:
    """Borders of the regions of a mask and of their holes, pixel by pixel, as arrays of (x, y).

    Every pixel whose left neighbour is outside and that no border met so far has, begins one.
    """
    inside = np.pad(mask > 0, 1)
    met = np.zeros(inside.shape, bool)
    out = []
    for y, x in zip(*np.nonzero(inside[:, 1:] & ~inside[:, :-1]), strict=True):
        start = (int(x) + 1, int(y))
        if met[start[1], start[0]]:
            continue
        path, at, back, second = [], start, 4, None
        while True:
            path.append(at)
            met[at[1], at[0]] = True
            for k in (k % 8 for k in range(back + 1, back + 9)):
                after = (at[0] + AROUND[k][0], at[1] + AROUND[k][1])
                if inside[after[1], after[0]]:
                    break
            else:
                break
            if at == start and after == second:
                path.pop()
                break
            second = second or after
            at, back = after, (k + 6) % 8 if k % 2 == 0 else (k + 5) % 8
        out.append(np.array(path) - 1)
    return out


def area(points: np.ndarray) -> float:
    x, y = points[:, 0], points[:, 1]
    return abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2


def largest_contour(a: np.ndarray) -> np.ndarray | None:
    """The border of largest area about the edges of the refined mask, the first of equals; none without area."""
    found = contours(edges(smoothed(refined(a), (1, 4, 6, 4, 1))))
    best = max(found, key=area, default=None)
    return best if best is not None and area(best) > 0 else None


def polygon_mask(points: np.ndarray, width: int, height: int) -> np.ndarray:
    """Pixels in a polygon of whole coordinates, its border included."""
    y, x = np.mgrid[:height, :width]
    odd, on = np.zeros((height, width), bool), np.zeros((height, width), bool)
    corners = np.trunc(points + 1e-9).astype(np.int64)
    for (x0, y0), (x1, y1) in zip(corners, np.roll(corners, -1, axis=0), strict=True):
        side = (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)
        on |= (side == 0) & (x >= min(x0, x1)) & (x <= max(x0, x1)) & (y >= min(y0, y1)) & (y <= max(y0, y1))
        if y0 != y1:
            odd ^= ((y0 <= y) != (y1 <= y)) & ((side < 0) == (y1 > y0))
    return odd | on


def score(points: np.ndarray, mask: np.ndarray) -> float:
    """Mean probability in a quad, favouring area; 0 where it is tiny."""
    inside = polygon_mask(points, mask.shape[1], mask.shape[0])
    share = inside.mean()
    return 0.0 if share < LEAST_AREA else float(mask[inside].mean() * (0.7 + 0.3 * share))


def quad_at(mask: np.ndarray, threshold: float, size: tuple[float, float]) -> np.ndarray | None:
    gray = np.clip(np.rint(mask * 255), 0, 255)
    cut = np.where(smoothed(gray) > threshold * 255, 255, 0)
    border = largest_contour(eroded(dilated(cut)))
    if border is None:
        return None
    scale = np.array(size) / (mask.shape[1], mask.shape[0])
    corners = quad_of_contour(border * scale)
    return None if corners is None else corners / scale


def directions(z: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Smoothed unit directions along a closed contour of complex points."""
    step = np.roll(z, -1) - np.roll(z, 1)
    unit = np.exp(1j * np.angle(step))
    padded = np.concatenate([unit[-window:], unit, unit[:window]])
    total = np.convolve(padded, np.ones(2 * window + 1), "valid")
    return np.exp(1j * np.angle(total))


def _between(a: complex, b: complex) -> float:
    return abs(np.degrees(np.angle(a / b)))


def _middle(a: complex, b: complex) -> complex:
    return np.exp(1j * np.angle(a + b))


def straight_runs(z: np.ndarray, way: np.ndarray, least: float) -> list[tuple[int, int, complex, float]]:
    """Runs (start, end, direction, length) that keep within an angle of their running direction.

    They begin behind the sharpest turn. A run once around has no length and is dropped.
    """
    n = len(z)
    turn = np.abs(np.angle(np.roll(way, -1) / way))
    start = (int(np.argmax(turn >= turn.max() - 1e-9)) + 1) % n if turn.max() > 1e-9 else 0
    order = (start + np.arange(n)) % n
    upto = np.concatenate([[0.0], np.cumsum(np.abs(np.diff(z[np.append(order, start)])))])
    runs, begin, mean = [], 0, way[start]
    for i in range(1, n + 1):
        if i < n and _between(way[order[i]], mean) < WITHIN - 1e-7:
            mean = _middle(mean, way[order[i]])
            continue
        length = 0.0 if i - begin == n else upto[i] - upto[begin]
        if length >= least and length > 0:
            runs.append((int(order[begin]), int(order[i % n]), mean, length))
        if i < n:
            begin, mean = i, way[order[i]]
    return runs


def merged(runs: list[tuple]) -> list[tuple]:
    """Neighbours of nearly one direction as one run, where there are more than four."""
    if len(runs) <= 4:
        return runs
    out = runs[:1]
    for run in runs[1:]:
        last = out[-1]
        if _between(run[2], last[2]) < MERGE - 1e-7:
            out[-1] = (last[0], run[1], _middle(last[2], run[2]), last[3] + run[3])
        else:
            out.append(run)
    return out


def dominant(runs: list[tuple], most: int = 4) -> list[tuple]:
    """The longest runs whose directions lie apart, in contour order."""
    chosen: list[tuple] = []
    for run in sorted(runs, key=lambda r: -round(r[3], 6)):
        if len(chosen) < most and all(_between(run[2], c[2]) >= APART - 1e-7 for c in chosen):
            chosen.append(run)
    return sorted(chosen)


def quad_of_contour(points: np.ndarray) -> np.ndarray | None:
    """Corners where lines fitted to the four dominant sides meet; none for other shapes."""
    if len(points) < LEAST_POINTS:
        return None
    z = points[:, 0] + 1j * points[:, 1]
    least = LEAST_PART * np.abs(np.diff(z)).sum()
    sides = dominant(merged(straight_runs(z, directions(z), least)))
    if len(sides) != 4:
        return None
    lines = []
    for start, end, *_ in sides:
        own = points[start:end] if start < end else np.concatenate([points[start:], points[:end]])
        centre = own.mean(axis=0)
        _, _, axes = np.linalg.svd(own - centre, full_matrices=False)
        lines.append((centre, axes[0]))
    corners = []
    for (p, d), (q, e) in zip(lines, lines[1:] + lines[:1], strict=True):
        cross = d[0] * e[1] - d[1] * e[0]
        if abs(cross) < 1e-6:
            return None
        t = ((q[0] - p[0]) * e[1] - (q[1] - p[1]) * e[0]) / cross
        corners.append(p + t * d)
    return np.array(corners)


def _turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> float:
    return (b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0])


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Hull of distinct points in order; up to three are returned sorted."""
    p = np.unique(points, axis=0)
    if len(p) <= 3:
        return p

    def chain(ps: np.ndarray) -> list:
        kept: list = []
        for q in ps:
            while len(kept) > 1 and _turn(kept[-2], kept[-1], q) <= 0:
                kept.pop()
            kept.append(q)
        return kept[:-1]

    return np.array(chain(p) + chain(p[::-1]))
