"""Kernels of enhancement and extraction against plain versions; documents cut out of drawn photos."""

import numpy as np
import pytest

from vellum.operators import enhance as H

RNG = np.random.default_rng(4)


@pytest.mark.parametrize("size", [1, 3, 4.7, 9])
def test_box_mean(size):
    a = RNG.random((11, 14))
    k = int(size)
    wide = np.pad(a, [(k // 2, k - 1 - k // 2)] * 2, mode="reflect")
    want = [[wide[y : y + k, x : x + k].mean() for x in range(14)] for y in range(11)]
    assert np.allclose(H.box_mean(a, size), want)


def test_resampling():
    a = RNG.random((12, 9))
    assert np.allclose(H.resampled(a, 4, 3), a.reshape(4, 3, 3, 3).mean(axis=(1, 3)))
    for weights, new in ((H.area_weights, 5), (H.cubic_weights, 23)):
        assert np.allclose(weights(9, new).sum(axis=1), 1)
    ramp = np.arange(10.0)
    assert np.allclose((H.cubic_weights(10, 20) @ ramp)[4:16], ((np.arange(20) + 0.5) / 2 - 0.5)[4:16], atol=0.06)


def test_lab_round_trip():
    colors = RNG.integers(0, 256, (40, 40, 3)).astype(np.uint8)
    back = H.from_lab(H.to_lab(colors)).astype(int)
    assert np.abs(back - colors).mean() < 3
    gray = np.repeat(np.arange(256, dtype=np.uint8)[None, :, None], 3, axis=2)
    lab = H.to_lab(gray)
    assert (np.abs(lab[:, :, 1:].astype(int) - 128) <= 1).all() and lab[0, 255, 0] == 255 and lab[0, 0, 0] == 0


def test_levels():
    a = np.array([0, 0, 10, 20, 255])
    assert [H.histogram_level(a, p) for p in (0.1, 0.4, 0.5, 0.99)] == [0, 0, 10, 255]
    assert [H.place_value(a, p) for p in (0.0, 0.5, 0.99, 1.0)] == [0, 10, 255, 255]


def _page(h=120, w=90):
    page = np.full((h, w, 3), 215.0) - np.linspace(0, 60, w)[None, :, None]
    page[20:100:10, 15:75] = 40
    page[60:64, 30:50] = (30, 40, 200)
    return H.byte(page)


def test_enhancement_flattens_light():
    page = _page()
    gray, color = H.enhanced_gray(page), H.enhanced_color(page)
    paper = (slice(5, 15), slice(10, 80))
    assert gray.shape == color.shape == page.shape and gray.dtype == np.uint8
    assert np.ptp(gray[paper][:, :, 0].mean(axis=0)) < np.ptp(page[paper][:, :, 0].mean(axis=0)) / 2 and np.median(gray) > 240
    assert gray[70, 20].max() < 140 and (gray[:, :, 0] == gray[:, :, 2]).all()
    assert color[62, 40, 2] > color[62, 40, 0] + 60 and np.median(color) > 200
    flat = np.full((30, 30, 3), 128, np.uint8)
    assert H.enhanced_color(flat).shape == H.enhanced_gray(flat).shape == flat.shape


def test_bilateral_keeps_edges():
    a = np.where(np.arange(30)[None, :] < 15, 40, 220) + RNG.integers(-4, 5, (30, 30))
    out = H.bilateral(H.byte(a)).astype(int)
    assert out[:, :15].std() < 2 and out[:, 15:].std() < 2 and np.abs(out[:, 14] - 40).max() < 6


def test_extracted_documents(spark):
    photo = np.zeros((200, 160, 3), np.uint8)
    photo[40:160, 30:120] = _page()
    corners = [(30.0, 40.0), (120.0, 40.0), (120.0, 160.0), (30.0, 160.0)]
    quad = dict(zip(("topLeft", "topRight", "bottomRight", "bottomLeft"), ({"x": x, "y": y} for x, y in corners), strict=True))
    data = bytearray(photo.tobytes())
    rows = [(1, 160, 200, data, quad, "COLOR", 0), (2, 160, 200, data, quad, "GRAYSCALE", 90), (3, 160, 200, data, None, "COLOR", 0), (4, 160, 200, bytearray(b"x"), quad, "COLOR", 0), (5, 160, 200, data, quad, "COLOR", 42)]
    point = "struct<x:double,y:double>"
    table = spark.createDataFrame(rows, f"id long, width int, height int, data binary, q struct<topLeft:{point},topRight:{point},bottomRight:{point},bottomLeft:{point}>, mode string, rotation int")
    got = {r.id: r for r in H.extracted_documents(table, "id", 1_000_000).collect()}
    assert sorted(got) == [1, 2] and (got[1].width, got[1].height) == (90, 120) and (got[2].width, got[2].height) == (120, 90)
    assert bytes(got[1].data) == H.enhanced_color(_page()).tobytes()
    small = H.extracted_documents(table.where("id = 1"), "id", 2_700).first()
    assert (small.width, small.height) == (45, 60)
    tilted = H.warped(photo, np.array([(30, 40), (120, 40), (120, 160), (30, 160)], float)[[1, 2, 3, 0]], 120, 90)
    assert (tilted[:, 0] == photo[40, 120 - np.arange(90)]).all()
