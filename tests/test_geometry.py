"""Geometry, sizes and names on known cases, and properties."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import metrology as M
from vellum.functions import names as N


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


def pt(x, y):
    return G.point(F.lit(float(x)), F.lit(float(y)))


def quad_of(points):
    return G.create_quad(F.array(*(pt(*p) for p in points)))


def flat(q):
    return [tuple(q[n]) for n in G.CORNERS]


def test_norm_and_order(spark):
    assert one(spark, G.norm(pt(1, 2), pt(4, 6))) == 5
    assert flat(one(spark, quad_of([(3, 9), (1, 2), (11, 12), (10, 3)]))) == [(1, 2), (10, 3), (11, 12), (3, 9)]
    assert one(spark, G.create_quad(F.array(pt(0, 0)))) is None


@pytest.mark.parametrize(("n", "want"), [(1, {(48, 1), (47, 10), (38, 11), (41, 3)}), (2, {(99, 48), (90, 47), (89, 38), (97, 41)}), (3, {(2, 99), (3, 90), (12, 89), (9, 97)}), (4, {(1, 2), (10, 3), (11, 12), (3, 9)}), (5, {(48, 1), (47, 10), (38, 11), (41, 3)})])
def test_rotate90(spark, n, want):
    q = G.rotate90(quad_of([(1, 2), (10, 3), (11, 12), (3, 9)]), F.lit(n), F.lit(100.0), F.lit(50.0))
    assert set(flat(one(spark, q))) == want


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.permutations([(1, 2), (90, 5), (95, 44), (4, 40)]))
def test_order_of_points_is_irrelevant(spark, points):
    assert flat(one(spark, quad_of(points))) == [(1, 2), (90, 5), (95, 44), (4, 40)]


@pytest.mark.parametrize(("size", "want"), [((212, 300), (210, 297)), ((297, 420), (297, 420)), ((149, 211), (148, 210)), ((300, 212), (297, 210)), ((218, 281), (215.9, 279.4)), ((150, 400), (150, 400))])
def test_snap(spark, size, want):
    dims = lambda kind: M.dimensions(F.lit(kind), F.lit(float(size[0])), F.lit(float(size[1])))
    assert tuple(one(spark, M.snap_to_format(dims("Physical"))))[1:] == want
    assert tuple(one(spark, M.snap_to_format(dims("Ratio"))))[1:] == size


@pytest.mark.parametrize(("size", "want"), [((100, 150), (100, 150)), ((210, 297), (210, 297)), ((297, 150), (297, 150))])
def test_constrain(spark, size, want):
    assert tuple(one(spark, M.constrain_to_max(F.lit(float(size[0])), F.lit(float(size[1]))))) == pytest.approx(want)


def test_pdf_rect(spark):
    rect = lambda *r: tuple(one(spark, M.pdf_rect(*map(F.lit, (*r, 1000, 2000, 500, 1000)))))
    assert rect(0, 0, 100, 200) == (0, 900, 50, 100) and rect(900, 1800, 1000, 2000) == (450, 0, 50, 100)


@pytest.mark.parametrize(("image", "box", "want"), [((1920, 1080), (1000, 800), (1000, 562)), ((1080, 1920), (1000, 800), (450, 800)), ((500, 500), (1000, 1000), (1000, 1000)), ((800, 600), (400, 300), (400, 300))])
def test_letterbox(spark, image, box, want):
    got = one(spark, G.letterbox(*(F.lit(float(v)) for v in (*image, *box))))
    assert (got.width, got.height) == want


def test_corner_edit(spark):
    unit = G.quad(pt(0.2, 0.2), pt(0.8, 0.2), pt(0.8, 0.8), pt(0.2, 0.8))
    move = lambda i, dx, dy: flat(one(spark, G.update_corner(unit, F.lit(i), F.lit(dx), F.lit(dy))))
    assert move(0, -0.5, -0.5)[0] == (0, 0)
    assert move(0, 0.7, 0.7) == move(5, 0.1, 0.1) == flat(one(spark, unit))


def test_text_layer_counts_utf16_units(spark):
    op = lambda w: one(spark, M.text_operators(F.lit(w), F.lit(30.0), F.lit(20), F.lit(50), F.lit(0.5), F.lit(100.0)))
    assert op("\U0001f600").hex == "D83DDE000020" and op("\U0001f600").h_scale == op("ab").h_scale and op("").h_scale == 100


def test_names(spark):
    got = [one(spark, N.with_extension(F.lit(n))) for n in ("f1.pdf", "f2.PDF", "f3", "f4.txt")]
    assert got == ["f1.pdf", "f2.PDF", "f3.pdf", "f4.txt.pdf"]
    assert one(spark, N.processed_name(F.lit("7"), F.lit("COLOR"), F.lit(2))) == "7.color.q2.jpg"
    assert one(spark, N.processed_name(F.lit("7"), F.lit(None).cast("string"), F.lit(0))) == "7.jpg"


@pytest.mark.parametrize(("focal", "distance", "kind"), [(None, None, "Ratio"), (500.0, 350.0, "Physical"), (500.0, None, "Ratio"), (5000.0, 350.0, "Ratio")])
def test_perspective(spark, focal, distance, kind):
    rows = spark.createDataFrame([(((60.0, 50.0), (560.0, 30.0), (610.0, 460.0), (20.0, 420.0)),), (((0.0, 0.0), (100.0, 0.0), (100.0, 50.0), (0.0, 50.0)),)], f"q struct<{', '.join(f'{n}:struct<x:double,y:double>' for n in G.CORNERS)}>")
    optional = lambda v: F.lit(v).cast("double")
    dims, square = (r.dims for r in M.with_real_dimensions(rows, "q", 640.0, 480.0, optional(focal), optional(distance)).collect())
    assert dims.kind == kind and dims.width > 0 and dims.height > 0
    assert tuple(square) == ("Ratio", 100, 50)
