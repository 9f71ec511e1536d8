from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.operators import drawing as D


def tile(spark):
    return spark.range(16).selectExpr("1L as vec_id", "cast(id % 4 as int) as x", "cast(id div 4 as int) as y", "cast(id * 10 as int) as b")


def square(x0, y0, x1, y1):
    p = lambda x, y: G.point(F.lit(float(x)), F.lit(float(y)))
    return G.quad(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1))


def test_warp_of_the_whole_image_is_the_image(spark):
    rows = tile(spark)
    got = D.warped(rows, spark.range(1, 2).select(F.col("id").alias("vec_id"), square(0, 0, 4, 4).alias("q")), "b", 4, 4)
    assert sorted((r.x, r.y, r.v) for r in got.collect()) == sorted((r.x, r.y, r.b) for r in rows.collect())


def test_warp_without_a_map_has_no_pixels(spark):
    flat = spark.range(1, 2).select(F.col("id").alias("vec_id"), square(0, 0, 4, 0).alias("q"))
    assert D.warped(tile(spark), flat, "b", 4, 4).count() == 0


def test_resize(spark):
    same = D.resized(tile(spark), "b", (4, 4), (4, 4))
    assert sorted((r.x, r.y, r.v) for r in same.collect()) == sorted((i % 4, i // 4, 10.0 * i) for i in range(16))
    half = D.resized(tile(spark), "b", (4, 4), (2, 2))
    assert sorted((r.x, r.y, r.v) for r in half.collect()) == [(0, 0, 25.0), (0, 1, 105.0), (1, 0, 45.0), (1, 1, 125.0)]
    assert D.resized(tile(spark), "b", (4, 4), (9, 9)).count() == 81
    assert D.thumbnail_size(4000, 3000, 400) == (400, 300)


def test_report(spark, tmp_path):
    entries = spark.createDataFrame([("b", "<p>2</p>"), ("a", "<p>1</p>")], "name string, html string")
    D.write_report(entries, "Pages", str(tmp_path / "out"))
    page = "".join(f.read_text() for f in sorted((tmp_path / "out").glob("part-*")))
    assert page.startswith("<!DOCTYPE html>") and page.index("<p>1</p>") < page.index("<p>2</p>") < page.index("</html>")
    assert spark.range(1).select(D.escaped(F.lit('<a & "b">'))).first()[0] == "&lt;a &amp; &quot;b&quot;&gt;"
