"""Photos painted from drawn masks."""

from vellum.plans import contour_queries as Q
from vellum.plans import export_queries as X

SF = "/root/testdata/sf0.001"


def test_photos(spark):
    """Bright pages with a line at each seventh pixel, on dark ground."""
    masks = {r.s_suppkey: r.mask for r in Q.drawn_masks(spark, SF).collect()}
    photos = X._photos(spark, SF).collect()
    assert sorted(r.s_suppkey for r in photos) == sorted(masks)
    for r in photos:
        dark, bright, line = bytes.fromhex("202428"), bytes.fromhex("F0E8DC"), bytes([r.s_suppkey % 40 * 5 + 20, 0xD0, 0xE0])
        assert bytes(r.data) == b"".join((bright if i % 7 else line) if p > 0.5 else dark for i, p in enumerate(masks[r.s_suppkey]))


def test_photos_are_painted_once(spark):
    """A filter on their size used to draw and paint them once more, pixel by pixel."""
    plan = X._enhanced(spark, SF, "GRAYSCALE")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython ") == 2 and "transform(" not in plan
