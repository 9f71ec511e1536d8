"""Further scalar and list operators with SQL: edits, mappings, labels, keys, list operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import names as N
from vellum.plans.registry import register
from vellum.plans.views import sql
from vellum.sources import tables as T


@register("f12_vector_cross_dot", sql("keyed", "SELECT o_orderkey, round(tly-try_,4) AS x, round(trx-tlx,4) AS y, round(tlx*try_-tly*trx,3) AS z, round(tlx*trx+tly*try_+1,3) AS dot FROM keyed"))
def f12(spark, d):
    """Line through two homogeneous points, and their dot product."""
    a, b = F.col("q.topLeft"), F.col("q.topRight")
    z = a["x"] * b["y"] - a["y"] * b["x"]
    return T.keyed_quads(spark, d).select("o_orderkey", F.round(a["y"] - b["y"], 4).alias("x"), F.round(b["x"] - a["x"], 4).alias("y"), F.round(z, 3).alias("z"), F.round(a["x"] * b["x"] + a["y"] * b["y"] + 1, 3).alias("dot"))


UNIT = "SELECT o_orderkey, 0.2::DOUBLE AS x0, 0.2::DOUBLE AS y0, 0.8::DOUBLE AS x1, 0.2::DOUBLE AS y1, 0.8::DOUBLE AS x2, 0.8::DOUBLE AS y2, 0.2::DOUBLE AS x3, 0.8::DOUBLE AS y3, ((o_orderkey % 21) - 10) / 10.0::DOUBLE AS dx, ((o_orderkey % 17) - 8) / 10.0::DOUBLE AS dy FROM orders"
MOVED = f"SELECT o_orderkey, greatest(0.0, least(1.0, x0 + dx)) AS px, greatest(0.0, least(1.0, y0 + dy)) AS py, x0, y0, x1, y1, x2, y2, x3, y3 FROM ({UNIT})"
TURNS = " AND ".join(f"(({b}x-{a}x)*({c}y-{b}y)-({b}y-{a}y)*({c}x-{b}x)) > 0" for a, b, c in (("p", "r", "s"), ("r", "s", "t"), ("s", "t", "p"), ("t", "p", "r")))


@register("f24_move_corner", f"SELECT o_orderkey, round(CASE WHEN {TURNS} THEN px ELSE x0 END, 6) AS x, round(CASE WHEN {TURNS} THEN py ELSE y0 END, 6) AS y FROM (SELECT *, x1 AS rx, y1 AS ry, x2 AS sx, y2 AS sy, x3 AS tx, y3 AS ty FROM ({MOVED}))")
def f24(spark, d):
    at = lambda x, y: G.point(F.lit(x), F.lit(y))
    rows = T.table(spark, d, "orders").withColumn("q", G.quad(at(0.2, 0.2), at(0.8, 0.2), at(0.8, 0.8), at(0.2, 0.8)))
    key = F.col("o_orderkey")
    moved = G.update_corner(F.col("q"), F.lit(0), (key % 21 - 10) / 10.0, (key % 17 - 8) / 10.0)
    return rows.select("o_orderkey", moved.alias("m")).select("o_orderkey", F.round("m.topLeft.x", 6).alias("x"), F.round("m.topLeft.y", 6).alias("y"))


@register("f29_progress", "SELECT o_orderkey, CASE WHEN o_orderkey % 8 > 0 THEN round((o_orderkey % 5)::DOUBLE / (o_orderkey % 8), 6) ELSE 0 END AS progress FROM orders")
def f29(spark, d):
    """Completed of total; nothing to do is no progress."""
    key = F.col("o_orderkey")
    return T.table(spark, d, "orders").select("o_orderkey", F.coalesce(F.round((key % 5).cast("double") / F.nullif(key % 8, F.lit(0)), 6), F.lit(0.0)).alias("progress"))


@register("f31_screen_to_image", "SELECT o_orderkey, round(greatest(0.0::DOUBLE, least(2999.0::DOUBLE, ((o_orderkey % 1100) - 50) / 1000.0::DOUBLE * 3000)), 4) AS x, round(greatest(0.0::DOUBLE, least(3999.0::DOUBLE, ((o_orderkey % 1700) - 100) / 1333.0::DOUBLE * 4000)), 4) AS y, round(3000 / 1000.0::DOUBLE * 90 / 2.5, 4) AS half FROM orders")
def f31(spark, d):
    """A touch on a display of 1000 x 1333 with margins, on an image of 3000 x 4000, and the half
    width that a magnifier of radius 90 at 2.5 times shows."""
    key = F.col("o_orderkey")
    place = lambda pos, offset, shown, size: F.round(F.greatest(F.lit(0.0), F.least(F.lit(size - 1.0), (pos - offset) / shown * size)), 4)
    return T.table(spark, d, "orders").select("o_orderkey", place(key % 1100, 50, 1000.0, 3000).alias("x"), place(key % 1700, 100, 1333.0, 4000).alias("y"), F.round(F.lit(3000 / 1000.0 * 90 / 2.5), 4).alias("half"))


@register("f32_corner_box", sql("keyed", 'SELECT o_orderkey, round(greatest(0, tlx - 90), 4) AS "left", round(greatest(0, tly - 90), 4) AS top, round(least(640, tlx + 90), 4) AS "right", round(least(480, tly + 90), 4) AS bottom FROM keyed'))
def f32(spark, d):
    x, y = F.col("q.topLeft.x"), F.col("q.topLeft.y")
    low, high = (lambda v: F.round(F.greatest(F.lit(0.0), v - 90), 4)), (lambda v, most: F.round(F.least(F.lit(most), v + 90), 4))
    return T.keyed_quads(spark, d).select("o_orderkey", low(x).alias("left"), low(y).alias("top"), high(x, T.WIDTH).alias("right"), high(y, T.HEIGHT).alias("bottom"))


@register("c8_default_color_mode", sql("pages", "SELECT doc, id, coalesce(mode, CASE WHEN doc % 2 = 0 THEN 'COLOR' ELSE 'GRAYSCALE' END) AS mode FROM pages_"))
def c8(spark, d):
    own = F.when(F.col("doc") % 2 == 0, "COLOR").otherwise("GRAYSCALE")
    return T.pages(spark, d).select("doc", "id", F.coalesce("mode", own).alias("mode"))


@register("c10_label", "SELECT page_id, CASE split_part(split_part(url, '/', 3), '.', -1) WHEN 'com' THEN 'Commercial' WHEN 'org' THEN 'Organisation' ELSE 'Other' END AS label FROM pages")
def c10(spark, d):
    """A label for the last part of an authority."""
    end = F.substring_index(F.split_part("url", F.lit("/"), F.lit(3)), ".", -1)
    return T.table(spark, d, "pages").select("page_id", F.when(end == "com", "Commercial").when(end == "org", "Organisation").otherwise("Other").alias("label"))


@register("k11_export_key", sql("pages", "SELECT doc, md5(string_agg(id || ':' || rotation || ':' || coalesce(mode, '') || ':' || quad_version, ',' ORDER BY position) || '|PDF|BALANCED') AS key FROM pages_ GROUP BY doc"))
def k11(spark, d):
    """A key that changes when an export would."""
    item = F.concat_ws(":", "id", F.col("rotation").cast("string"), F.coalesce("mode", F.lit("")), F.col("quad_version").cast("string"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", item.alias("item")))), lambda r: r["item"])
    return T.pages(spark, d).groupBy("doc").agg(F.md5(F.concat(F.array_join(ordered, ","), F.lit("|PDF|BALANCED")).cast("binary")).alias("key"))


@register("k3_add_page", sql("pages", "SELECT doc, id, position FROM pages_ UNION ALL SELECT doc, doc || '-new', max(position) + 1 FROM pages_ GROUP BY doc"))
def k3(spark, d):
    pages = T.pages(spark, d).select("doc", "id", "position")
    new = pages.groupBy("doc").agg((F.max("position") + 1).alias("position")).withColumn("id", F.concat(F.col("doc").cast("string"), F.lit("-new")))
    return pages.unionByName(new)


@register("i5_sorted_names", sql("pages files", "SELECT doc, string_agg(name, ' ' ORDER BY name) AS names FROM files GROUP BY doc"))
def i5(spark, d):
    return T.files(spark, d).groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list("name")), " ").alias("names"))


@register("i7_longest_sides", sql("keyed", """, s AS (SELECT o_orderkey, 0 AS i, sqrt((tlx-trx)**2+(tly-try_)**2) AS n FROM keyed UNION ALL SELECT o_orderkey, 1, sqrt((trx-brx)**2+(try_-bry)**2) FROM keyed
UNION ALL SELECT o_orderkey, 2, sqrt((brx-blx)**2+(bry-bly)**2) FROM keyed UNION ALL SELECT o_orderkey, 3, sqrt((blx-tlx)**2+(bly-tly)**2) FROM keyed)
SELECT o_orderkey, i FROM s QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY round(n, 9) DESC, i) <= 2"""))
def i7(spark, d):
    """The two longest sides of each quad; of equals the first."""
    tl, tr, br, bl = G.corners(F.col("q"))
    sides = F.array(*(F.struct((-F.round(G.norm(a, b), 9)).alias("n"), F.lit(i).alias("i")) for i, (a, b) in enumerate(((tl, tr), (tr, br), (br, bl), (bl, tl)))))
    return T.keyed_quads(spark, d).select("o_orderkey", F.explode(F.slice(F.array_sort(sides), 1, 2)).alias("s")).select("o_orderkey", "s.i")


@register("i10_distinct_points", sql("keyed", "SELECT count(*) AS n FROM (SELECT DISTINCT round(tlx, 4), round(tly, 4) FROM keyed)"))
def i10(spark, d):
    return T.keyed_quads(spark, d).select(F.round("q.topLeft.x", 4), F.round("q.topLeft.y", 4)).distinct().agg(F.count("*").alias("n"))


@register("i11_wrapped_slice", "SELECT vec_id, round((embedding[61]+embedding[62]+embedding[63]+embedding[64]+embedding[1]+embedding[2])::DOUBLE, 4) AS total, 6 AS n FROM embeddings")
def i11(spark, d):
    """A slice that goes on at the start of a closed sequence."""
    part = F.concat(F.slice("embedding", 61, 4), F.slice("embedding", 1, 2))
    total = F.aggregate(part, F.lit(0.0).cast("float"), lambda a, e: (a + e).cast("float"))
    return T.table(spark, d, "embeddings").select("vec_id", F.round(total.cast("double"), 4).alias("total"), F.size(part).alias("n"))


CODES = ("eng", "deu", "chi_sim_vert", "kat_old", "kat", "srp_latn", "srp", "aze_cyrl", "jpn_vert", "frm", "deu_latf")


@register("f27_language_tags", "SELECT o_orderkey, CASE c WHEN 'deu' THEN 'de' WHEN 'chi_sim_vert' THEN 'zh-CN-vertical' WHEN 'kat' THEN 'ka' WHEN 'srp_latn' THEN 'sr-Latn' WHEN 'aze_cyrl' THEN 'az-Cyrl' WHEN 'jpn_vert' THEN 'ja-vertical' WHEN 'deu_latf' THEN 'de-1901' ELSE split_part(c, '_', 1) END AS tag "
          f"FROM (SELECT o_orderkey, {list(CODES)}[o_orderkey % {len(CODES)} + 1] AS c FROM orders)")  # fmt: skip
def f27(spark, d):
    code = F.element_at(F.array(*map(F.lit, CODES)), (F.col("o_orderkey") % len(CODES) + 1).cast("int"))
    return T.table(spark, d, "orders").select("o_orderkey", N.language_tag(code).alias("tag"))
