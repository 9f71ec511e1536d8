import re

import numpy as np

from vellum.operators import export as E
from vellum.operators import jpeg as J
from vellum.plans import QUERIES
from vellum.sources import files as F_images

WORD = {"text": "é\U0001f600", "x": 1.0, "baseline": 2.0, "font_size": 8.0, "h_scale": 90.0}


def test_pdf_structure():
    page = {"width": 100.0, "height": 200.0, "jpeg": None, "words": [WORD]}
    out = E.pdf_bytes([page, page | {"jpeg": b"JPEG", "image_width": 3, "image_height": 4}])
    start = int(re.search(rb"startxref\n(\d+)", out)[1])
    assert out.startswith(b"%PDF") and out[start : start + 4] == b"xref" and out.count(b"/Type /Page ") == 2
    places = [int(x) for x in re.findall(rb"(\d{10}) 00000 n", out)]
    assert all(out[p:].startswith(b"%d 0 obj" % i) for i, p in enumerate(places, 1))


def test_png_is_read_by_spark(spark, tmp_path):
    gray = np.arange(48).reshape(6, 8) * 5
    (tmp_path / "a.png").write_bytes(E.png_bytes(gray))
    image = spark.read.format("image").load(str(tmp_path)).first().image
    assert (image.height, image.width) == (6, 8) and list(image.data)[:: image.nChannels] == gray.ravel().tolist()


def test_queries(spark):
    sf = "/root/testdata/sf0.001"
    assert {r.n_pages > 0 and r.bytes > 500 for r in QUERIES["b2_pdf_documents"](spark, sf).collect()} == {True}
    assert QUERIES["b10_mask_images"](spark, sf).where("bytes > 60").count() == 500


def test_jpeg_is_read_by_spark(spark, tmp_path):
    y, x = np.mgrid[:45, :61]
    image = np.stack([4 * x, 5 * y, 255 - 3 * x - y], axis=2).clip(0, 255).astype(np.uint8)
    image[10:20, 15:30] = (20, 200, 90)
    sizes = []
    for quality, most in ((0, 90), (60, 12), (90, 5), (120, 2)):
        (tmp_path / f"{quality}.jpg").write_bytes(J.jpeg_bytes(image, quality))
        sizes.append(len(J.jpeg_bytes(image, quality)))
        read = F_images.images(spark, str(tmp_path)).where(f"name = '{quality}.jpg'").first()
        got = np.frombuffer(bytes(read.data), np.uint8).reshape(45, 61, 3)
        assert np.abs(got.astype(int) - image).mean() < most, quality
    assert sizes == sorted(sizes)
    rows = spark.createDataFrame([(1, 61, 45, bytearray(image.tobytes())), (2, 5, 5, bytearray(b"x")), (3, None, 4, None)], "id long, width int, height int, data binary")
    assert [r.jpeg and bytes(r.jpeg) for r in J.jpeg_files(rows, "id", 60).orderBy("id").collect()] == [J.jpeg_bytes(image, 60), None, None]
    noise = np.random.default_rng(1).integers(0, 256, (16, 24, 3), np.uint8)
    (tmp_path / "noise.jpg").write_bytes(J.jpeg_bytes(noise, 100))
    got = F_images.images(spark, str(tmp_path)).where("name = 'noise.jpg'").first()
    assert np.abs(np.frombuffer(bytes(got.data), np.uint8).reshape(16, 24, 3).astype(int) - noise).mean() < 3


def test_documents_are_shuffled_once(spark):
    """As texts, by document; words, which are several times as large, and pages stay where they are."""
    from vellum.plans import QUERIES

    plan = QUERIES["b2_pdf_documents"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
