"""Geometry and page-size queries with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import metrology as M
from vellum.operators.boxes import min_area_rects
from vellum.plans.registry import register
from vellum.plans.views import sql
from vellum.sources import tables as T

KEY = ["l_orderkey", "l_linenumber"]


def _flat(q, digits=4):
    out = []
    for name, p in zip(("tl", "tr", "br", "bl"), G.corners(q), strict=True):
        out += [F.round(p["x"], digits).alias(f"{name}_x"), F.round(p["y"], digits).alias(f"{name}_y")]
    return out


TOP, BOTTOM = "sqrt((tlx-trx)**2+(tly-try_)**2)", "sqrt((blx-brx)**2+(bly-bry)**2)"
LEFT, RIGHT = "sqrt((tlx-blx)**2+(tly-bly)**2)", "sqrt((trx-brx)**2+(try_-bry)**2)"
FLAT = "round(tlx,4) tl_x, round(tly,4) tl_y, round(trx,4) tr_x, round(try_,4) tr_y, round(brx,4) br_x, round(bry,4) br_y, round(blx,4) bl_x, round(bly,4) bl_y"


@register("f1_norm", sql("quads", f'SELECT l_orderkey, l_linenumber, round({TOP},4) AS top, round({RIGHT},4) AS "right", round({BOTTOM},4) AS bottom, round({LEFT},4) AS "left" FROM quads'))
def f1(spark, d):
    tl, tr, br, bl = G.corners(F.col("q"))
    sides = {"top": (tl, tr), "right": (tr, br), "bottom": (bl, br), "left": (tl, bl)}
    return T.quads(spark, d).select(*KEY, *(F.round(G.norm(a, b), 4).alias(n) for n, (a, b) in sides.items()))


ORDERED = """, pts AS (SELECT {keys}, list_sort([
  {{a: atan2(p.y - cy, p.x - cx), i: i, x: p.x, y: p.y}} FOR p, i IN [{{x: x1, y: y1}}, {{x: x2, y: y2}}, {{x: x3, y: y3}}, {{x: x4, y: y4}}]]) AS s
  FROM (SELECT *, (x1+x2+x3+x4)/4 AS cx, (y1+y2+y3+y4)/4 AS cy FROM raw))
SELECT {keys}, round(s[1].x,4) tl_x, round(s[1].y,4) tl_y, round(s[2].x,4) tr_x, round(s[2].y,4) tr_y, round(s[3].x,4) br_x, round(s[3].y,4) br_y, round(s[4].x,4) bl_x, round(s[4].y,4) bl_y FROM pts"""


@register("f2_create_quad", sql("keyed", "") + ", raw AS (SELECT o_orderkey, brx x1, bry y1, tlx x2, tly y2, blx x3, bly y3, trx x4, try_ y4 FROM keyed)" + ORDERED.format(keys="o_orderkey"))
def f2(spark, d):
    tl, tr, br, bl = G.corners(F.col("q"))
    return T.keyed_quads(spark, d).select("o_orderkey", G.create_quad(F.array(br, tl, bl, tr)).alias("q")).select("o_orderkey", *_flat(F.col("q")))


def _turned(n, x, y):
    return f"CASE l_linenumber % 6 % 4 WHEN 1 THEN {dict(x='480-' + y, y=x)[n]} WHEN 2 THEN {dict(x='640-' + x, y='480-' + y)[n]} WHEN 3 THEN {dict(x=y, y='640-' + x)[n]} ELSE {dict(x=x, y=y)[n]} END"


@register(
    "f3_rotate90",
    sql("quads", "") + ", raw AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"{_turned('x', x, y)} x{i}, {_turned('y', x, y)} y{i}" for i, (x, y) in enumerate((("tlx", "tly"), ("trx", "try_"), ("brx", "bry"), ("blx", "bly")), 1))
    + " FROM quads)" + ORDERED.format(keys="l_orderkey, l_linenumber"),
)
def f3(spark, d):
    q = T.quads(spark, d).withColumn("r", G.rotate90(F.col("q"), F.col("l_linenumber") % 6, F.lit(T.WIDTH), F.lit(T.HEIGHT)))
    return q.select(*KEY, *_flat(F.col("r")))


@register("f4_scaled_to", sql("quads", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({c}{a}{'_' if c + a == 'try' else ''} * {1000 / 640 if a == 'x' else 800 / 480!r}, 4) AS {c}_{a}" for c in ("tl", "tr", "br", "bl") for a in "xy") + " FROM quads"))
def f4(spark, d):
    return T.quads(spark, d).select(*KEY, G.scaled_to(F.col("q"), F.lit(T.WIDTH), F.lit(T.HEIGHT), F.lit(1000.0), F.lit(800.0)).alias("s")).select(*KEY, *_flat(F.col("s")))


@register("c3_valid_quad", sql("quads", "SELECT l_orderkey, l_linenumber, (tlx BETWEEN 0 AND 605 AND tly BETWEEN 0 AND 455 AND trx BETWEEN 0 AND 605 AND try_ BETWEEN 0 AND 455 AND brx BETWEEN 0 AND 605 AND bry BETWEEN 0 AND 455 AND blx BETWEEN 0 AND 605 AND bly BETWEEN 0 AND 455) AS valid FROM quads"))
def c3(spark, d):
    return T.quads(spark, d).select(*KEY, G.is_inside(F.col("q"), F.lit(605), F.lit(455)).alias("valid"))


def _cross(a, b, c):
    return f"(({b}x-{a}x)*({c[0]}-{b}y{'_' if b == 'tr' else ''})-({b}y{'_' if b == 'tr' else ''}-{a}y{'_' if a == 'tr' else ''})*({c[1]}-{b}x))"


CONVEX = " AND ".join(f"{_cross(a, b, (c + ('y_' if c == 'tr' else 'y'), c + 'x'))} > 0" for a, b, c in (("tl", "tr", "br"), ("tr", "br", "bl"), ("br", "bl", "tl"), ("bl", "tl", "tr")))


@register("c4_convex", sql("quads", f"SELECT l_orderkey, l_linenumber, ({CONVEX}) AS convex FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN brx ELSE tlx END AS tlx, CASE WHEN l_linenumber % 3 = 0 THEN bry ELSE tly END AS tly, trx, try_, CASE WHEN l_linenumber % 3 = 0 THEN tlx ELSE brx END AS brx, CASE WHEN l_linenumber % 3 = 0 THEN tly ELSE bry END AS bry, blx, bly FROM quads)"))
def c4(spark, d):
    tl, tr, br, bl = G.corners(F.col("q"))
    turned = F.when(F.col("l_linenumber") % 3 == 0, G.quad(br, tr, tl, bl)).otherwise(F.col("q"))
    return T.quads(spark, d).select(*KEY, G.is_convex(turned).alias("convex"))


@register("c9_touch_candidates", sql("keyed", """, c AS (SELECT o_orderkey, i, sqrt((x-20)**2+(y-(o_orderkey % 480))**2) AS dist FROM (
  SELECT o_orderkey, 0 AS i, tlx AS x, tly AS y FROM keyed UNION ALL SELECT o_orderkey, 1, trx, try_ FROM keyed UNION ALL SELECT o_orderkey, 2, brx, bry FROM keyed UNION ALL SELECT o_orderkey, 3, blx, bly FROM keyed))
SELECT o_orderkey, i::INTEGER AS corner, (row_number() OVER (PARTITION BY o_orderkey ORDER BY dist, i))::INTEGER AS place FROM c WHERE dist < 90"""))
def c9(spark, d):
    found = G.touch_candidates(F.col("q"), F.lit(20.0), (F.col("o_orderkey") % 480).cast("double"))
    return T.keyed_quads(spark, d).select("o_orderkey", F.posexplode(found).alias("place", "corner")).select("o_orderkey", "corner", (F.col("place") + 1).alias("place"))


@register("f10_pixel_dimensions", sql("quads", f"SELECT l_orderkey, l_linenumber, round(sqrt(w*h/1.4142),4) AS width, round(sqrt(w*h/1.4142)*1.4142,4) AS height FROM (SELECT *, ({TOP}+{BOTTOM})/2 AS w, ({LEFT}+{RIGHT})/2 AS h FROM quads)"))
def f10(spark, d):
    dims = M.dimensions(F.lit("Ratio"), F.lit(1.0), F.lit(1.4142))
    return T.quads(spark, d).select(*KEY, M.pixel_dimensions(dims, F.col("q")).alias("s")).select(*KEY, F.round("s.width", 4).alias("width"), F.round("s.height", 4).alias("height"))


def _perspective(focal: str, distance: str, view: str = "quads", keys: str = "l_orderkey, l_linenumber", digits: int = 3) -> str:
    y = lambda c: c + ("y_" if c == "tr" else "y")
    line = lambda n, a, b: f"{y(a)}-{y(b)} AS {n}a, {b}x-{a}x AS {n}b, {a}x*{y(b)}-{y(a)}*{b}x AS {n}c"
    cross = lambda n, p, q: f"{p}b*{q}c-{p}c*{q}b AS {n}x, {p}c*{q}a-{p}a*{q}c AS {n}y, {p}a*{q}b-{p}b*{q}a AS {n}z"
    place = lambda c: f"scale*({c}x-320)/f/den_{c} AS {c}px, scale*({y(c)}-240)/f/den_{c} AS {c}py, scale/den_{c} AS {c}pz"
    apart = lambda a, b: f"sqrt(({a}px-{b}px)**2+({a}py-{b}py)**2+({a}pz-{b}pz)**2)"
    den = ", ".join(f"nx*({c}x-320)/f+ny*({y(c)}-240)/f+nz AS den_{c}" for c in ("tl", "tr", "br", "bl"))
    return sql(view, f""", s1 AS (SELECT *, {line("t", "tl", "tr")}, {line("o", "bl", "br")}, {line("e", "tl", "bl")}, {line("r", "tr", "br")}, {focal} AS given, {distance} AS dist FROM {view}),
s2 AS (SELECT *, {cross("h", "t", "o")}, {cross("k", "e", "r")} FROM s1),
s3 AS (SELECT *, abs(hz) < 1e-6 OR abs(kz) < 1e-6 AS far, hx/nullif(hz,0)-320 AS v1x, hy/nullif(hz,0)-240 AS v1y, kx/nullif(kz,0)-320 AS v2x, ky/nullif(kz,0)-240 AS v2y FROM s2),
s4 AS (SELECT *, coalesce(given, CASE WHEN -(v1x*v2x+v1y*v2y) > 0 THEN sqrt(-(v1x*v2x+v1y*v2y)) END) AS f FROM s3),
s5 AS (SELECT *, coalesce(NOT far AND f IS NOT NULL AND f <= 640*1.2, false) AS usable, (v1y-v2y)*f AS nx, (v2x-v1x)*f AS ny, v1x*v2y-v1y*v2x AS nz,
  ((tlx+trx+blx+brx)/4-320)/f AS mx, ((tly+try_+bly+bry)/4-240)/f AS my FROM s4),
s6 AS (SELECT *, abs(mx*nx+my*ny+nz)/sqrt(mx*mx+my*my+1) AS cosine, {den} FROM s5),
s7 AS (SELECT *, CASE WHEN given IS NOT NULL AND cosine >= 0.1 THEN dist*cosine END AS known FROM s6),
s8 AS (SELECT *, coalesce(known, 1.0) AS scale FROM s7),
s9 AS (SELECT *, {place("tl")}, {place("tr")}, {place("br")}, {place("bl")} FROM s8)
SELECT {keys}, CASE WHEN usable AND known IS NOT NULL THEN 'Physical' ELSE 'Ratio' END AS kind,
  round(CASE WHEN usable THEN ({apart("tr", "tl")}+{apart("br", "bl")})/2 / (CASE WHEN known IS NULL THEN ({apart("bl", "tl")}+{apart("br", "tr")})/2 ELSE 1 END) ELSE ({TOP}+{BOTTOM})/2 END, {digits}) AS width,
  round(CASE WHEN usable THEN CASE WHEN known IS NULL THEN 1 ELSE ({apart("bl", "tl")}+{apart("br", "tr")})/2 END ELSE ({LEFT}+{RIGHT})/2 END, {digits}) AS height FROM s9""")


def _dims_out(rows):
    """A ratio from perspective has an arbitrary scale, so it is shown with height 1."""
    dims = F.col("dims")
    plain = (dims["kind"] == "Physical") | ~F.col("perspective")
    w = F.when(plain, dims["width"]).otherwise(dims["width"] / dims["height"])
    return rows.select(*KEY, dims["kind"].alias("kind"), F.round(w, 3).alias("width"), F.round(F.when(plain, dims["height"]).otherwise(1.0), 3).alias("height"))


@register("f9_real_dimensions", _perspective("NULL::DOUBLE", "NULL::DOUBLE"))
def f9(spark, d):
    return _dims_out(M.with_real_dimensions(T.quads(spark, d), "q", T.WIDTH, T.HEIGHT))


@register("f9b_real_dimensions_optics", _perspective("CASE WHEN l_linenumber % 2 = 0 THEN 500.0 END", "CASE WHEN l_linenumber % 4 = 0 THEN 350.0 END"))
def f9b(spark, d):
    focal = F.when(F.col("l_linenumber") % 2 == 0, 500.0)
    distance = F.when(F.col("l_linenumber") % 4 == 0, 350.0)
    return _dims_out(M.with_real_dimensions(T.quads(spark, d), "q", T.WIDTH, T.HEIGHT, focal, distance))


SNAP = "CASE WHEN kind='Physical' THEN CASE " + " ".join(
    f"WHEN abs(b/a-{h}::DOUBLE/{w})/({h}::DOUBLE/{w}) < 0.04 AND greatest(abs(a-{w})/{w}, abs(b-{h})/{h}) < 0.20 THEN {{{i}}}" for i, (_, w, h) in enumerate(M.PAPER_FORMATS)
) + " ELSE {own} END ELSE {own} END"


def _snap(first: bool) -> str:
    values = [f"CASE WHEN width<=height THEN {w if first else h}::DOUBLE ELSE {h if first else w}::DOUBLE END" for _, w, h in M.PAPER_FORMATS]
    return SNAP.format(*values, own="width" if first else "height")


@register("d8_snap_format", sql("sizes", f"SELECT p_partkey, kind, round({_snap(True)},4) AS width, round({_snap(False)},4) AS height FROM (SELECT *, least(width,height) AS a, greatest(width,height) AS b FROM sizes)"))
def d8(spark, d):
    return T.page_sizes(spark, d).select("p_partkey", M.snap_to_format(F.col("dims")).alias("s")).select("p_partkey", "s.kind", F.round("s.width", 4).alias("width"), F.round("s.height", 4).alias("height"))


FIT = "least(297/greatest({w},{h}), 215.9/least({w},{h}), 1.0)"


@register("f7_constrain_format", sql("sizes", f"SELECT p_partkey, round(width*{FIT.format(w='width', h='height')},4) AS width, round(height*{FIT.format(w='width', h='height')},4) AS height FROM sizes"))
def f7(spark, d):
    return T.page_sizes(spark, d).select("p_partkey", M.constrain_to_max(F.col("dims.width"), F.col("dims.height")).alias("s")).select("p_partkey", F.round("s.width", 4).alias("width"), F.round("s.height", 4).alias("height"))


@register("f8_page_points", sql("sizes", f"SELECT p_partkey, round(w*{FIT.format(w='w', h='h')}*72/25.4,4) AS width, round(h*{FIT.format(w='w', h='h')}*72/25.4,4) AS height FROM (SELECT p_partkey, width*s AS w, height*s AS h FROM (SELECT *, CASE kind WHEN 'Physical' THEN 1 ELSE 297/greatest(width,height) END AS s FROM sizes))"))
def f8(spark, d):
    return T.page_sizes(spark, d).select("p_partkey", M.page_points(F.col("dims")).alias("s")).select("p_partkey", F.round("s.width", 4).alias("width"), F.round("s.height", 4).alias("height"))


def _page_dimensions() -> str:
    """Perspective with optics, snapped to paper, in points."""
    steps, _, dims = _perspective("500.0::DOUBLE", "350.0::DOUBLE", "keyed", "o_orderkey", 12).rpartition("\nSELECT ")
    points = lambda n: f"round({n}*{FIT.format(w='w', h='h')}*72/25.4,3)"
    return f"""{steps}, dims AS (SELECT {dims}), snapped AS (SELECT o_orderkey, kind, {_snap(True)} AS width, {_snap(False)} AS height FROM (SELECT *, least(width,height) AS a, greatest(width,height) AS b FROM dims))
SELECT o_orderkey, {points("w")} AS width, {points("h")} AS height FROM (SELECT o_orderkey, width*s AS w, height*s AS h FROM (SELECT *, CASE kind WHEN 'Physical' THEN 1 ELSE 297/greatest(width,height) END AS s FROM snapped))"""


@register("k12_page_dimensions", _page_dimensions())
def k12(spark, d):
    """Export size of a quad: perspective, snap to paper, in PDF points."""
    rows = M.with_real_dimensions(T.keyed_quads(spark, d), "q", T.WIDTH, T.HEIGHT, F.lit(500.0), F.lit(350.0))
    return rows.select("o_orderkey", M.page_points(M.snap_to_format(F.col("dims"))).alias("s")).select("o_orderkey", F.round("s.width", 3).alias("width"), F.round("s.height", 3).alias("height"))


@register("f14_rotate_dimensions", sql("sizes", "SELECT p_partkey, kind, CASE WHEN t THEN height ELSE width END AS width, CASE WHEN t THEN width ELSE height END AS height FROM (SELECT *, kind='Physical' AND p_partkey % 4 IN (1,3) AS t FROM sizes)"))
def f14(spark, d):
    return T.page_sizes(spark, d).select("p_partkey", M.rotate_dimensions(F.col("dims"), ((F.col("p_partkey") % 4) * 90 - 360).cast("int")).alias("s")).select("p_partkey", "s.*")


@register("f11_focal_pixels", "SELECT p_partkey, round((CASE WHEN p_size % 7 > 0 THEN p_size::FLOAT END / (5 + p_partkey % 3)::FLOAT * 4000::FLOAT)::DOUBLE, 2) AS focal FROM part")
def f11(spark, d):
    focal = M.focal_in_pixels(F.when(F.col("p_size") % 7 > 0, F.col("p_size")), 5 + F.col("p_partkey") % 3, F.lit(4000))
    return T.table(spark, d, "part").select("p_partkey", F.round(focal.cast("double"), 2).alias("focal"))


@register("f13_rotation", "SELECT o_orderkey, CASE WHEN a % 90 = 0 AND b % 90 = 0 THEN (((a+b) % 360) + 360) % 360 END::INTEGER AS total FROM (SELECT o_orderkey, (o_orderkey % 9 - 4) * 90 + CASE WHEN o_orderkey % 13 = 0 THEN 30 ELSE 0 END AS a, (o_orderkey % 5) * 90 AS b FROM orders)")
def f13(spark, d):
    key = F.col("o_orderkey")
    a, b = (key % 9 - 4) * 90 + F.when(key % 13 == 0, 30).otherwise(0), (key % 5) * 90
    total = F.when((a % 90 == 0) & (b % 90 == 0), F.pmod(a + b, F.lit(360)))
    return T.table(spark, d, "orders").select("o_orderkey", total.cast("int").alias("total"))


@register("f15_lerp_quad", sql("keyed", "SELECT o_orderkey, " + ", ".join(f"round({c}{a}{'_' if c + a == 'try' else ''} + 0.15 * ({0 if c in ('tl', 'bl') and a == 'x' or c in ('tl', 'tr') and a == 'y' else (640 if a == 'x' else 480)} - {c}{a}{'_' if c + a == 'try' else ''}), 4) AS {c}_{a}" for c in ("tl", "tr", "br", "bl") for a in "xy") + " FROM keyed"))
def f15(spark, d):
    z, W, H = F.lit(0.0), F.lit(T.WIDTH), F.lit(T.HEIGHT)  # noqa: N806
    frame = G.quad(G.point(z, z), G.point(W, z), G.point(W, H), G.point(z, H))
    return T.keyed_quads(spark, d).select("o_orderkey", G.lerp_quad(F.col("q"), frame, F.lit(0.15)).alias("s")).select("o_orderkey", *_flat(F.col("s")))


@register("f17_angle_diff", f"SELECT o_orderkey, round(abs(x - {2 * math.pi!r} * ceil((x - {math.pi!r}) / {2 * math.pi!r})), 6) AS diff FROM (SELECT o_orderkey, (o_orderkey % 97) * 0.31::DOUBLE - (o_orderkey % 89) * 0.17::DOUBLE AS x FROM orders)")
def f17(spark, d):
    key = F.col("o_orderkey")
    return T.table(spark, d, "orders").select("o_orderkey", F.round(G.angle_diff((key % 97) * 0.31, (key % 89) * 0.17), 6).alias("diff"))


@register("f19_intersect_diagonals", sql("keyed", "SELECT o_orderkey, round(tlx + t*(brx-tlx),3) AS x, round(tly + t*(bry-tly),3) AS y FROM (SELECT *, ((trx-tlx)*(bly-try_)-(try_-tly)*(blx-trx)) / ((brx-tlx)*(bly-try_)-(bry-tly)*(blx-trx)) AS t FROM keyed)"))
def f19(spark, d):
    line = lambda a, b: F.struct(a["x"].alias("x"), a["y"].alias("y"), (b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy"))
    tl, tr, br, bl = G.corners(F.col("q"))
    return T.keyed_quads(spark, d).select("o_orderkey", G.intersect_lines(line(tl, br), line(tr, bl)).alias("p")).select("o_orderkey", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


@register("g12_contour_area", sql("keyed", "SELECT o_orderkey, round(abs(tlx*try_-trx*tly + trx*bry-brx*try_ + brx*bly-blx*bry + blx*tly-tlx*bly)/2,4) AS area FROM keyed"))
def g12(spark, d):
    return T.keyed_quads(spark, d).select("o_orderkey", F.round(G.shoelace(G.corners(F.col("q"))), 4).alias("area"))


POINTS = """, pts AS (SELECT o_orderkey, 0 AS i, tlx AS x, tly AS y FROM keyed UNION ALL SELECT o_orderkey, 1, trx, try_ FROM keyed UNION ALL SELECT o_orderkey, 2, brx, bry FROM keyed UNION ALL SELECT o_orderkey, 3, blx, bly FROM keyed)
"""


def _points(spark, d):
    return T.keyed_quads(spark, d).select("o_orderkey", F.posexplode(F.array(*G.corners(F.col("q")))).alias("i", "p")).select("o_orderkey", "i", "p.x", "p.y")


@register("e17_centroid_covariance", sql("keyed", POINTS + "SELECT o_orderkey, round(avg(x),4) AS cx, round(avg(y),4) AS cy, round(covar_pop(x,x)+0.00123,2) AS xx, round(covar_pop(x,y)+0.00123,2) AS xy, round(covar_pop(y,y)+0.00123,2) AS yy FROM pts GROUP BY o_orderkey"))
def e17(spark, d):
    cov = lambda a, b, n: F.round(F.covar_pop(a, b) + 0.00123, 2).alias(n)
    return _points(spark, d).groupBy("o_orderkey").agg(F.round(F.avg("x"), 4).alias("cx"), F.round(F.avg("y"), 4).alias("cy"), cov("x", "x", "xx"), cov("x", "y", "xy"), cov("y", "y", "yy"))


@register("e18_circular_mean", sql("frames", "SELECT session, round(atan2(sum(sin(dx)), sum(cos(dx))), 5) AS mean FROM frames WHERE dx IS NOT NULL GROUP BY session"))
def e18(spark, d):
    dx = F.col("q.topLeft.x") - 10.0
    return T.frames(spark, d).where("q is not null").groupBy("session").agg(F.round(F.atan2(F.sum(F.sin(dx)), F.sum(F.cos(dx))), 5).alias("mean"))


@register("e19_bounding_box", sql("keyed", POINTS + "SELECT o_orderkey, round(min(x),4) AS x0, round(min(y),4) AS y0, round(max(x),4) AS x1, round(max(y),4) AS y1 FROM pts GROUP BY o_orderkey"))
def e19(spark, d):
    r = lambda f, c, n: F.round(f(c), 4).alias(n)
    return _points(spark, d).groupBy("o_orderkey").agg(r(F.min, "x", "x0"), r(F.min, "y", "y0"), r(F.max, "x", "x1"), r(F.max, "y", "y1"))


@register("f18_fit_line", sql("keyed", POINTS + """SELECT o_orderkey, round(avg(x),4) AS x, round(avg(y),4) AS y, round(cos(0.5*atan2(2*covar_pop(x,y), var_pop(x)-var_pop(y))) + 0.00123,4) + 0.0::DOUBLE AS dx, round(sin(0.5*atan2(2*covar_pop(x,y), var_pop(x)-var_pop(y))) + 0.00123,4) + 0.0::DOUBLE AS dy FROM pts GROUP BY o_orderkey"""))
def f18(spark, d):
    fitted = _points(spark, d).groupBy("o_orderkey").agg(G.fit_line(F.col("x"), F.col("y")).alias("l"))
    return fitted.select("o_orderkey", *(F.round(F.col(f"l.{n}") + more, 4).alias(n) for n, more in (("x", 0.0), ("y", 0.0), ("dx", 0.00123), ("dy", 0.00123))))


@register("f22_min_area_angle", sql("keyed", POINTS + """, turned AS (SELECT o_orderkey, a, min(x*cos(radians(a))-y*sin(radians(a))) AS x0, max(x*cos(radians(a))-y*sin(radians(a))) AS x1, min(x*sin(radians(a))+y*cos(radians(a))) AS y0, max(x*sin(radians(a))+y*cos(radians(a))) AS y1
  FROM pts, range(90) AS t(a) GROUP BY o_orderkey, a),
best AS (SELECT o_orderkey, unnest(arg_min({a: a, x0: x0, x1: x1, y0: y0, y1: y1}, ((x1 - x0) * (y1 - y0), a))), min((x1 - x0) * (y1 - y0)) AS area FROM turned GROUP BY o_orderkey)
SELECT o_orderkey, round(area, 2) AS area, a::INTEGER AS degree, round(greatest(0, least(639, x0*cos(radians(a))+y0*sin(radians(a)))) + 0.00123, 2) AS x, round(greatest(0, least(479, y1*cos(radians(a))-x1*sin(radians(a)))) + 0.00123, 2) AS y FROM best"""))
def f22(spark, d):
    """Least-area enclosing box over the whole degrees from 0 to 89, clipped to the image: two coordinates of its corners."""
    orders = T.quads_of_keys(T.spread(T.table(spark, d, "orders").select("o_orderkey"), "o_orderkey").distinct())  # an order is one box, as in SQL
    rows = min_area_rects(orders, ["o_orderkey"], G.corners(F.col("q")), T.WIDTH, T.HEIGHT)
    c = F.col("corners")
    return rows.select("o_orderkey", F.round("area", 2).alias("area"), "degree", F.round(c[0]["x"] + 0.00123, 2).alias("x"), F.round(c[2]["y"] + 0.00123, 2).alias("y"))


@register("f25_loupe_center", """SELECT o_orderkey, round(CASE WHEN y - 140 >= 16 THEN greatest(76, least(924, x)) WHEN x - 140 >= 16 THEN x - 80 ELSE least(924, x + 80) END, 4) AS cx,
  round(CASE WHEN y - 140 >= 16 THEN y - 80 ELSE greatest(76, y) END, 4) AS cy FROM (SELECT o_orderkey, (o_orderkey % 1001)::DOUBLE AS x, (o_orderkey % 397)::DOUBLE AS y FROM orders)""")
def f25(spark, d):
    """A loupe of radius 60, 20 away from the finger, on a screen 1000 wide with margins of 16."""
    key, n = F.col("o_orderkey"), lambda v: F.lit(float(v))
    at = G.loupe_center((key % 1001).cast("double"), (key % 397).cast("double"), n(60), n(20), n(16), n(1000))
    return T.table(spark, d, "orders").select("o_orderkey", at.alias("p")).select("o_orderkey", F.round("p.x", 4).alias("cx"), F.round("p.y", 4).alias("cy"))


@register("a6_decode_cap", "SELECT o_orderkey, CASE WHEN w*h <= 12000000 THEN w ELSE floor(w*(12000000/(w*h)::DOUBLE)) END::INTEGER AS width, CASE WHEN w*h <= 12000000 THEN h ELSE floor(h*(12000000/(w*h)::DOUBLE)) END::INTEGER AS height FROM (SELECT o_orderkey, 1000 + (o_orderkey % 50)*100 AS w, 1500 + (o_orderkey % 37)*100 AS h FROM orders)")
def a6(spark, d):
    key = F.col("o_orderkey")
    return T.table(spark, d, "orders").select("o_orderkey", M.capped_size(1000 + (key % 50) * 100, 1500 + (key % 37) * 100).alias("s")).select("o_orderkey", "s.*")


@register("g16_erosion_size", "SELECT o_orderkey, (CASE WHEN k % 2 = 0 THEN k + 1 ELSE k END)::INTEGER AS k FROM (SELECT o_orderkey, greatest(3, least(15, floor(0.02*least(o_orderkey % 900 + 50, o_orderkey % 700 + 80) + 0.5)))::INTEGER AS k FROM orders)")
def g16(spark, d):
    key = F.col("o_orderkey")
    return T.table(spark, d, "orders").select("o_orderkey", M.erosion_size(key % 900 + 50, key % 700 + 80).alias("k"))


@register("g19_budget_size", "SELECT o_orderkey, floor(w*s)::INTEGER AS width, floor(h*s)::INTEGER AS height FROM (SELECT *, CASE WHEN w*h <= 786432 THEN 1.0::DOUBLE ELSE sqrt(786432/(w*h)::DOUBLE) END AS s FROM (SELECT o_orderkey, 600 + (o_orderkey % 50)*30 AS w, 700 + (o_orderkey % 37)*20 AS h FROM orders))")
def g19(spark, d):
    key = F.col("o_orderkey")
    return T.table(spark, d, "orders").select("o_orderkey", M.budget_size((600 + (key % 50) * 30).cast("double"), (700 + (key % 37) * 20).cast("double"), F.lit(786_432)).alias("s")).select("o_orderkey", "s.*")


@register("f23_letterbox", 'SELECT o_orderkey, w::INTEGER AS width, h::INTEGER AS height, (1000-w)/2.0::DOUBLE AS "left", (800-h)/2.0::DOUBLE AS top FROM (SELECT o_orderkey, trunc(CASE WHEN iw/ih > 1.25 THEN 1000 ELSE 800*iw/ih END) AS w, trunc(CASE WHEN iw/ih > 1.25 THEN 1000*ih/iw ELSE 800 END) AS h FROM (SELECT o_orderkey, (600 + (o_orderkey % 50)*30)::DOUBLE AS iw, (700 + (o_orderkey % 37)*20)::DOUBLE AS ih FROM orders))')
def f23(spark, d):
    key = F.col("o_orderkey")
    s = G.letterbox((600 + (key % 50) * 30).cast("double"), (700 + (key % 37) * 20).cast("double"), F.lit(1000.0), F.lit(800.0))
    return T.table(spark, d, "orders").select("o_orderkey", s.alias("s")).select("o_orderkey", "s.*")


@register("a10_subject_distance", "SELECT p_partkey, round(1000.0::DOUBLE / nullif(p_size % 6, 0), 4) AS distance FROM part")
def a10(spark, d):
    """Distance in mm from diopters; none at infinity."""
    diopters = F.col("p_size") % 6
    return T.table(spark, d, "part").select("p_partkey", F.round(1000.0 / F.when(diopters != 0, diopters), 4).alias("distance"))
