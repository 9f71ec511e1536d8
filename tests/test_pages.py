"""Page store: reading, migration, order, names."""

import json

from pyspark.sql import functions as F

from vellum.operators import pages as P

PAGE = {"id": "5", "baseRotationDegrees": 90, "manualRotationDegrees": 0, "quad": None, "quadVersion": 1, "userQuad": None, "isColored": True, "colorMode": "COLOR", "focalLength": None, "sensorWidth": None, "subjectDistance": None, "sourceWidth": 1, "sourceHeight": 2}


def read(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc long, json string")
    return [(r.doc, r.position, r.id, r.rotation) for r in P.read_documents(rows).orderBy("doc", "position").collect()]


def test_versions(spark):
    two = json.dumps({"version": 2, "pages": [PAGE]})
    one = json.dumps({"pages": [{"file": "1.jpg"}, {"file": "12-90.jpg"}]})
    odd = [json.dumps({"version": 3, "pages": [PAGE]}), "xxx", json.dumps({"version": 2, "pages": [PAGE | {"more": 1}]}), json.dumps({"version": 2, "pages": [PAGE], "more": 1}), None]
    assert read(spark, two, one, *odd) == [(0, 0, "5", 90), (1, 0, "1", 0), (1, 1, "12", 0)]


def test_round_trip(spark):
    rows = spark.createDataFrame([(1, i, f"p{i}", "COLOR", 90, 1, 10, 20) for i in range(5)], "doc long, position long, id string, mode string, rotation int, quad_version int, source_width int, source_height int")
    got = P.read_documents(P.write_documents(rows)).orderBy("position").collect()
    assert [(r.id, r.rotation, r.quad_version, r.mode) for r in got] == [(f"p{i}", 90, 1, "COLOR") for i in range(5)]


def test_move(spark):
    pages = spark.createDataFrame([(1, i, str(i)) for i in range(4)], "doc long, position long, id string")
    order = lambda page, to: [r.id for r in P.move(pages, spark.createDataFrame([(1, page, to)], "doc long, id string, to int")).orderBy("position").collect()]
    assert order("2", 0) == ["2", "0", "1", "3"] and order("0", 9) == ["1", "2", "3", "0"] and order("x", 1) == ["0", "1", "2", "3"]


def test_legacy(spark):
    names = ["123-90.jpg", "123-270.jpg", "5.jpg", "5-90.jpg", "7-8-90.jpg"]
    files = spark.createDataFrame([(1, n) for n in names], "doc long, name string")
    got = {r.name: (r.action, r.target) for r in P.legacy_actions(files).collect()}
    assert got == {"123-270.jpg": ("rename", "123.jpg"), "123-90.jpg": ("delete", None), "5.jpg": ("keep", None), "5-90.jpg": ("delete", None), "7-8-90.jpg": ("rename", "7-8.jpg")}


def test_free_names(spark):
    wanted = lambda names: [r.name for r in P.free_names(spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "doc long, i long, want string"), ["doc"], "want", "i").orderBy("i").collect()]
    assert wanted(["f.pdf"] * 3) == ["f.pdf", "f(1).pdf", "f(2).pdf"]
    assert wanted(["f.pdf", "f(1).pdf", "f.pdf", "g.pdf", "f(1).pdf"]) == ["f.pdf", "f(1).pdf", "f(2).pdf", "g.pdf", "f(1)(1).pdf"]


def test_load(spark):
    page = lambda **more: json.dumps({"version": 2, "pages": [PAGE | more]})
    quad = {n: {"x": 0.5, "y": 0.5} for n in ("topLeft", "topRight", "bottomRight", "bottomLeft")}
    stored = {1: "xxx", 2: json.dumps({"pages": [{"file": "1.jpg"}, {"file": "2.jpg"}]}), 3: page(manualRotationDegrees=42), 4: page(quad=quad, baseRotationDegrees=42), 5: page(quad=quad, userQuad=quad)}
    files = {0: ["3.jpg", "1.jpg", "2-90.jpg", "2-270.jpg"], 1: ["1.jpg"], 2: ["2.jpg"], 3: ["5.color.q1.jpg"], 4: ["5.color.q1.jpg"], 5: ["5.color.q1.jpg"]}
    documents = spark.createDataFrame(list(stored.items()), "doc long, json string")
    listed = spark.createDataFrame([(d, n) for d, names in files.items() for n in names], "doc long, name string")
    got = P.load_documents(documents, listed).orderBy("doc", "position").collect()
    assert [(r.doc, r.id) for r in got] == [(0, "1"), (0, "2"), (0, "3"), (1, "1"), (2, "2"), (5, "5")]
    assert got[-1].user_quad.topLeft.x == 0.5 and got[-1].rotation == 90


def test_rotation(spark):
    rows = spark.createDataFrame([(d,) for d in (0, 90, 360, -90, 42)], "rotation int").where(P.valid_rotation(F.col("rotation")))
    assert [r.rotation for r in P.rotate(rows, F.lit(True)).collect()] == [90, 180, 90, 0]
