"""Documents cut out of photos and enhanced: sizes by Columns, pixels by Arrow-batched kernels.

A photo is one row; Spark works out each page's size from its quad and optics, and the kernels here
see one photo at a time. Sums over windows are differences of running sums, resampling is a product
with two small matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import metrology as M

# Fixed values of the colour enhancement: window sizes as parts of the longer side, amplitude about the mean, share of
# the corrected lightness, percentiles of the stretch and its upper end; then of the grey one.
COLOR_WINDOWS, AMPLITUDE, BLEND, COLOR_LOW, COLOR_HIGH, BRIGHTEST = (80, 10, 2), 60.0, 0.6, 0.001, 0.995, 245.0
GRAY_WINDOWS, GRAY_LOW, GRAY_HIGH, OVERDONE = (6, 50), 0.004, 0.99, 254
# Diameter, colour and space deviations of the denoising filter.
DIAMETER, COLOR_SIGMA, SPACE_SIGMA = 9, 20.0, 10.0
_RGB_TO_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.950456, 1.0, 1.088754])


def byte(a: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(a), 0, 255).astype(np.uint8)


def to_lab(bgr: np.ndarray) -> np.ndarray:
    """CIE Lab in 8 bits of 8-bit sRGB, blue first."""
    s = bgr[:, :, ::-1] / 255.0
    linear = np.where(s <= 0.04045, s / 12.92, ((s + 0.055) / 1.055) ** 2.4)
    x, y, z = np.moveaxis(linear @ _RGB_TO_XYZ.T / _WHITE, 2, 0)
    root = lambda v: np.where(v > 0.008856, np.cbrt(v), 7.787 * v + 16 / 116)
    light = np.where(y > 0.008856, 116 * np.cbrt(y) - 16, 903.3 * y)
    return byte(np.stack([light * 2.55, 500 * (root(x) - root(y)) + 128, 200 * (root(y) - root(z)) + 128], axis=2))


def from_lab(lab: np.ndarray) -> np.ndarray:
    light, a, b = lab[:, :, 0] / 2.55, lab[:, :, 1] - 128.0, lab[:, :, 2] - 128.0
    low = light <= 8.0
    fy = np.where(low, 7.787 * light / 903.3 + 16 / 116, (light + 16) / 116)
    back = lambda f: np.where(f > 0.206893, f**3, (f - 16 / 116) / 7.787)
    xyz = np.stack([back(fy + a / 500), np.where(low, light / 903.3, fy**3), back(fy - b / 200)], axis=2) * _WHITE
    linear = np.clip(xyz @ np.linalg.inv(_RGB_TO_XYZ).T, 0, 1)
    return byte(255 * np.where(linear <= 0.0031308, 12.92 * linear, 1.055 * linear ** (1 / 2.4) - 0.055))[:, :, ::-1]


def box_mean(a: np.ndarray, size: float) -> np.ndarray:
    """Mean over a square with mirrored borders; a size that isn't whole is cut, below 1 it is 1."""
    k = max(1, int(size))
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (k // 2, k - 1 - k // 2)
        total = np.cumsum(np.pad(a, pad, mode="reflect") if a.shape[axis] > 1 else np.pad(a, pad, mode="edge"), axis=axis)
        total = np.concatenate([np.zeros_like(np.take(total, [0], axis)), total], axis)
        upper, lower = np.take(total, range(k, total.shape[axis]), axis), np.take(total, range(total.shape[axis] - k), axis)
        a = (upper - lower) / k
    return a


def area_weights(old: int, new: int) -> np.ndarray:
    """Parts of the old places that each new, wider place covers."""
    edges = np.arange(new + 1) * old / new
    covered = np.minimum(edges[1:, None], np.arange(1, old + 1)) - np.maximum(edges[:-1, None], np.arange(old))
    return np.maximum(covered, 0) * new / old


def cubic_weights(old: int, new: int, a: float = -0.75) -> np.ndarray:
    """Weights of the four old places about each new place; beyond the border the last one counts."""
    at = (np.arange(new) + 0.5) * old / new - 0.5
    out = np.zeros((new, old))
    for k in range(-1, 3):
        t = np.abs(at - np.floor(at) - k)
        w = np.where(t <= 1, (a + 2) * t**3 - (a + 3) * t**2 + 1, a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a)
        np.add.at(out, (np.arange(new), np.clip(np.floor(at) + k, 0, old - 1).astype(int)), w)
    return out


def resampled(a: np.ndarray, height: int, width: int, weights=area_weights) -> np.ndarray:
    rows, columns = weights(a.shape[0], height), weights(a.shape[1], width)
    return np.einsum("ij,jk...->ik...", rows, np.moveaxis(np.tensordot(columns, a, (1, 1)), 0, 1), optimize=True)


def histogram_level(a: np.ndarray, p: float) -> float:
    """Smallest of 256 bins whose cumulative share reaches p."""
    counts = np.bincount(np.clip(a, 0, 255).astype(np.int64).ravel(), minlength=256)
    return float(min(np.searchsorted(np.cumsum(counts) / a.size, p), 255))


def place_value(a: np.ndarray, p: float) -> float:
    """The value at place floor(n p) in ascending order."""
    k = min(int(a.size * p), a.size - 1)
    return float(np.partition(a, k, axis=None)[k])


def _retinex(log: np.ndarray, blurred: list[np.ndarray]) -> np.ndarray:
    return sum(log - b for b in blurred) / len(blurred)


def enhanced_color(bgr: np.ndarray) -> np.ndarray:
    """Even lighting by a multi-scale retinex of the lightness, then its contrast stretched."""
    lab = to_lab(bgr)
    light = lab[:, :, 0].astype(np.float64)
    small = resampled(light + 1, max(1, light.shape[0] // 2), max(1, light.shape[1] // 2))
    log, longest = np.log(small), max(light.shape) / 2
    even = _retinex(log, [box_mean(log, max(int(longest / part), 3) | 1) for part in COLOR_WINDOWS])
    even -= even.min()
    if even.max() > 1e-6:
        even /= even.max()
    even = resampled(even, *light.shape, cubic_weights) * AMPLITUDE + light.mean() - AMPLITUDE / 2
    mixed = (1 - BLEND) * light + BLEND * even
    low, high = histogram_level(mixed, COLOR_LOW), histogram_level(mixed, COLOR_HIGH)
    darkest = min(low, histogram_level(light, COLOR_LOW))
    lab[:, :, 0] = byte((mixed - low) * (BRIGHTEST - darkest) / (high - low + 1e-6) + darkest)
    return from_lab(lab)


def bilateral(a: np.ndarray) -> np.ndarray:
    """Mean over a disc, weighted by nearness in place and value."""
    r = DIAMETER // 2
    wide, own = np.pad(a.astype(np.float64), r, mode="reflect" if min(a.shape) > r else "edge"), a.astype(np.float64)
    total, weight = np.zeros(a.shape), np.zeros(a.shape)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            if dx * dx + dy * dy <= r * r:
                v = wide[r + dy : r + dy + a.shape[0], r + dx : r + dx + a.shape[1]]
                w = np.exp(-(dx * dx + dy * dy) / (2 * SPACE_SIGMA**2) - (v - own) ** 2 / (2 * COLOR_SIGMA**2))
                total += w * v
                weight += w
    return byte(total / weight)


def enhanced_gray(bgr: np.ndarray) -> np.ndarray:
    """A white page in grey: retinex, stretched so that the usual bright level is white, denoised.

    Where retinex overdoes it, the grey values themselves are stretched instead.
    """
    gray = byte(bgr @ np.array([0.114, 0.587, 0.299])).astype(np.float64)
    even = np.exp(_retinex(np.log(gray + 1), [np.log(box_mean(gray + 1, max(gray.shape) / part) + 1) for part in GRAY_WINDOWS]))
    low, high = place_value(even, GRAY_LOW), place_value(even, GRAY_HIGH)
    level = byte((even - low) * (255 / (high - low) if high > low else 1.0))
    bright = np.bincount(level.ravel(), minlength=256)[180:]
    usual = 180 + int(bright.argmax()) if bright.any() else 220
    if usual >= OVERDONE:
        low, high = place_value(gray, 0.01), place_value(gray, 0.99)
        white = byte((gray - low) * 255 / (high - low + 1e-6))
    else:
        white = byte(level * (255.0 / usual))
    return np.repeat(bilateral(white)[:, :, None], 3, axis=2)


def warped(bgr: np.ndarray, corners: np.ndarray, width: int, height: int) -> np.ndarray:
    """The quad's content as an upright image, bilinear; beyond the photo is black."""
    target = np.array([(0, 0), (width, 0), (width, height), (0, height)], np.float64)
    rows, right = [], []
    for (u, v), (x, y) in zip(target, corners, strict=True):  # from the upright image back to the photo
        rows += [[u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]]
        right += [x, y]
    h = np.append(np.linalg.solve(np.array(rows), np.array(right)), 1.0).reshape(3, 3)
    v, u = np.mgrid[:height, :width]
    x, y, z = h @ np.stack([u.ravel(), v.ravel(), np.ones(u.size)])
    x, y = x / z, y / z
    out = np.zeros((u.size, 3))
    x0, y0 = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    for dx in (0, 1):
        for dy in (0, 1):
            weight = np.abs(1 - dx - (x - x0)) * np.abs(1 - dy - (y - y0))
            ok = (x0 + dx >= 0) & (x0 + dx < bgr.shape[1]) & (y0 + dy >= 0) & (y0 + dy < bgr.shape[0])
            out[ok] += weight[ok, None] * bgr[y0[ok] + dy, x0[ok] + dx]
    return byte(out).reshape(height, width, 3)


def extract(bgr: np.ndarray, corners: np.ndarray, width: float, height: float, most: int, mode: str, degrees: int) -> np.ndarray:
    """A page cut out, kept within a pixel budget, enhanced for its colour mode and turned clockwise."""
    page = warped(bgr, corners, max(1, int(width)), max(1, int(height)))
    h, w = page.shape[:2]
    if h * w > most:
        scale = (most / (h * w)) ** 0.5
        page = byte(resampled(page.astype(np.float64), max(1, int(h * scale)), max(1, int(w * scale))))
    page = enhanced_color(page) if mode == "COLOR" else enhanced_gray(page)
    return np.ascontiguousarray(np.rot90(page, -(degrees // 90) % 4))


def extracted_documents(photos: DataFrame, id_col: str, most: int, focal_px: Column | None = None, distance: Column | None = None) -> DataFrame:
    """``id, width, height, data`` of the pages in photos: ``id, width, height, data, q, mode, rotation``.

    ``data`` are BGR bytes, ``q`` the page's quad, ``mode`` COLOR or GRAYSCALE, ``rotation`` in degrees.
    Sizes come from perspective and optics, snapped to paper formats. A photo without a quad, with
    other data than its size asks for, or with a rotation that isn't a quarter turn gives no row.
    """
    fits = F.col("q").isNotNull() & (F.octet_length("data") == 3 * F.col("width") * F.col("height")) & (F.pmod("rotation", F.lit(90)) == 0)
    rows = M.with_real_dimensions(photos.where(fits), "q", F.col("width").cast("double"), F.col("height").cast("double"), focal_px, distance)
    size = M.pixel_dimensions(M.snap_to_format(F.col("dims")), F.col("q"))
    corners = F.array(*(p[c] for p in G.corners(F.col("q")) for c in "xy"))
    rows = rows.select(id_col, "width", "height", "data", "mode", "rotation", corners.alias("corners"), size.alias("size")).select("*", F.col("size.width").alias("w"), F.col("size.height").alias("h")).drop("size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                bgr = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3)
                page = extract(bgr, np.array(r["corners"]).reshape(4, 2), r["w"], r["h"], most, r["mode"], r["rotation"])
                out.append((r[id_col], page.shape[1], page.shape[0], page.tobytes()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            types = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[id_col, "width", "height", "data"])

    return rows.mapInArrow(run, f"{id_col} long, width int, height int, data binary")
