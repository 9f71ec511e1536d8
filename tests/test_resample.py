"""Window means and resampling against numpy, on images of sizes of their own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import enhance as H
from vellum.operators import resample as R

SIZES = "id long, width int, height int, new_width int, new_height int, window double"


def _images(spark, sizes, seed=0):
    rng = np.random.default_rng(seed)
    images = [rng.integers(0, 256, (s[1], s[0])).astype(float) for s in sizes]
    rows = [(i, x, y, float(v)) for i, m in enumerate(images) for (y, x), v in np.ndenumerate(m)]
    table = spark.createDataFrame([(i, *s[:4], float(s[4])) for i, s in enumerate(sizes)], SIZES)
    return images, spark.createDataFrame(rows, "id long, x int, y int, v double"), table


def _as_images(rows, n):
    out = []
    for i in range(n):
        part = rows[rows["id"] == i]
        a = np.full((part["y"].max() + 1, part["x"].max() + 1), np.nan)
        a[part["y"], part["x"]] = part["v"]
        out.append(a)
    return out


def test_box_means(spark):
    images, pixels, sizes = _images(spark, [(9, 7, 0, 0, 3), (9, 7, 0, 0, 4.6), (12, 5, 0, 0, 5), (6, 6, 0, 0, 0.2), (40, 30, 0, 0, 21)])
    got = _as_images(R.box_means(pixels, sizes, ["id"], "v", F.col("window")).toPandas(), len(images))
    for image, found, window in zip(images, got, (3, 4.6, 5, 0.2, 21), strict=True):
        assert np.allclose(found, H.box_mean(image, window), atol=1e-6)


def test_wide_windows(spark):
    """An 80th, a 10th and half of the side of an image of 512 pixels: the same number of rows each."""
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (512, 512)).astype(float)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(image)], "y int, line array<double>")
    pixels = rows.select(F.lit(0).cast("long").alias("id"), "y", F.posexplode("line").alias("x", "v"))
    for part in (80, 10, 2):
        window = int(512 / part) | 1
        sizes = spark.createDataFrame([(0, 512, 512, 0, 0, float(window))], SIZES)
        found = _as_images(R.box_means(pixels, sizes, ["id"], "v", F.col("window")).toPandas(), 1)[0]
        assert np.allclose(found, H.box_mean(image, window), atol=1e-6)


@pytest.mark.parametrize("kind", ["area", "cubic"])
def test_resampling(spark, kind):
    sizes = [(9, 7, 4, 3, 0), (9, 7, 9, 7, 0), (30, 20, 7, 19, 0), (5, 5, 1, 1, 0)] if kind == "area" else [(9, 7, 20, 15, 0), (4, 3, 9, 3, 0), (2, 2, 5, 5, 0), (1, 6, 3, 7, 0)]
    images, pixels, table = _images(spark, sizes, 2)
    ours, plain = {"area": (R.area_weights, H.area_weights), "cubic": (R.cubic_weights, H.cubic_weights)}[kind]
    got = _as_images(R.resampled(pixels, table, ["id"], ["v"], ours).toPandas(), len(images))
    for image, found, s in zip(images, got, sizes, strict=True):
        assert np.allclose(found, H.resampled(image, s[3], s[2], plain), atol=1e-6)


def test_budget(spark):
    rows = spark.createDataFrame([(4400, 3300, 786432), (100, 50, 786432), (10, 1000, 100), (1024, 768, 786432)], "w int, h int, most int")
    w, h = R.within_budget(F.col("w"), F.col("h"), F.col("most"))
    assert [tuple(r) for r in rows.select(w, h).collect()] == [(1024, 768), (100, 50), (1, 100), (1024, 768)]


def test_edge_keeping(spark):
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (11, 14))
    rows = spark.createDataFrame([(image.ravel().tolist(),)], "v array<int>")
    found = np.array(rows.select(R.edge_keeping(F.col("v"), 14, 11).alias("v")).first().v).reshape(11, 14)
    assert (H.byte(found) == H.bilateral(image.astype(np.uint8))).mean() > 0.99 and np.abs(found - H.bilateral(image.astype(np.uint8))).max() <= 0.51


def test_lab_and_back(spark):
    colors = [(b, g, r) for b in range(0, 256, 51) for g in range(0, 256, 51) for r in range(0, 256, 51)]
    lab = H.to_lab(np.array(colors, np.uint8)[None])[0]
    rows = spark.createDataFrame([(i, *map(int, x)) for i, x in enumerate(lab)], "i int, l int, a int, b int")
    found = np.array([tuple(r.c) for r in rows.select("i", R.bgr_of_lab(F.col("l"), F.col("a"), F.col("b")).alias("c")).orderBy("i").collect()])
    assert np.abs(found - H.from_lab(lab[None])[0].astype(int)).max() <= 1


def test_retinex(spark):
    """Against numpy, on images of two sizes, one of them without contrast."""
    images, pixels, sizes = _images(spark, [(31, 20, 0, 0, 0), (12, 9, 0, 0, 0)], 4)
    flat = pixels.withColumn("v", F.when(F.col("id") == 1, 7.0).otherwise(F.col("v")))
    windows = R.retinex_windows(F.col("width"), F.col("height"), (8, 4, 2))
    got = _as_images(R.retinex(flat, sizes, ["id"], "v", windows).toPandas(), 2)
    log = np.log(images[0] + 1)
    even = sum(log - H.box_mean(log, max(31 // part, 3) | 1) for part in (8, 4, 2)) / 3
    assert np.allclose(got[0], (even - even.min()) / (even.max() - even.min()), atol=1e-9) and np.allclose(got[1], 0, atol=1e-6)
