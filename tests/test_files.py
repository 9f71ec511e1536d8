import json

import numpy as np

from vellum.operators import export as E
from vellum.sources import files as S


def test_lists(spark, tmp_path):
    (tmp_path / "images.csv").write_text('imgName,docId\n a.jpg , d1 \n"b".jpg,d2\n')
    (tmp_path / "documents.csv").write_text("docId,isColored\nd1,TRUE\nd2,no\nd1,False\nd3, True\n")
    assert sorted(map(tuple, S.image_list(spark, str(tmp_path / "images.csv")).collect())) == [('"b".jpg', "d2"), ("a.jpg", "d1")]
    assert sorted(map(tuple, S.document_list(spark, str(tmp_path / "documents.csv")).collect())) == [("d1", False), ("d2", False), ("d3", True)]


def test_images(spark, tmp_path):
    (tmp_path / "a.JPG").write_bytes(E.png_bytes(np.full((3, 5), 7)))
    (tmp_path / "b.jpeg").write_bytes(b"not an image")
    (tmp_path / "c.txt").write_text("x")
    assert sorted(r.name for r in S.image_files(spark, str(tmp_path)).collect()) == ["a.JPG", "b.jpeg"]
    rows = S.images(spark, str(tmp_path)).collect()
    assert [(r.name, r.width, r.height) for r in rows] == [("a.JPG", 5, 3)] and set(rows[0].data) == {7}


def test_documents(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"pages": [{"file": "9-x.jpg"}, {"file": "10.jpg"}]}, indent=1))
    (tmp_path / "2.json").write_text("xxx")
    rows = S.stored_documents(spark, str(tmp_path)).orderBy("position").collect()
    assert [r.id for r in rows] == ["9", "10"]


def test_preferences(spark):
    rows = spark.createDataFrame([("format", "PDF"), ("mode", "odd")], "k string, v string")
    got = S.preferences(rows, "k", "v", {"format": "JPEG", "mode": "AUTO"}, {"format": ("PDF", "JPEG"), "mode": ("AUTO", "COLOR")}).first()
    assert tuple(got) == ("PDF", "AUTO")
