"""The camera source, resets and drags in streams, across restarts; outputs made once."""

import datetime

import pytest
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.operators import incremental as I
from vellum.sources import tables as T
from vellum.streaming import camera, gestures
from vellum.streaming import stabilizer as S

SF = "/root/testdata/sf0.001"


def _run(stream, name, path, spark):
    """One go of a stream with a checkpoint, and all its rows so far."""
    query = stream.writeStream.option("checkpointLocation", f"{path}/cp-{name}").trigger(availableNow=True).format("parquet").option("path", f"{path}/out-{name}").start()
    query.awaitTermination(180)
    assert query.exception() is None
    return spark.read.parquet(f"{path}/out-{name}")


def _shot(spark, folder, name, rows):
    """A file of frames appears at once, as a camera's would."""
    point = lambda x, y: dict(x=float(x), y=float(y))
    quad = lambda dx: None if dx is None else dict(zip(G.CORNERS, (point(10 + dx, 12), point(600 + dx, 10), point(620 + dx, 460), point(15 + dx, 450)), strict=True))
    at = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    rows = [(s, at + datetime.timedelta(seconds=q), q, quad(dx)) for s, q, dx in rows]
    spark.createDataFrame(rows, camera.SCHEMA).coalesce(1).write.parquet(f"{folder}/.tmp-{name}")
    part = next(p for p in (folder / f".tmp-{name}").iterdir() if p.suffix == ".parquet")
    part.rename(folder / f"{name}.parquet")


@pytest.mark.parametrize("keep", [1, 2])
def test_camera(spark, tmp_path, keep):
    """Stale files are dropped, and a restart goes on where the last run ended."""
    camera.register(spark)
    folder = tmp_path / "shots"
    folder.mkdir()
    shots = {f"s{i}": [(1, 10 * i + j, 5.0 * j) for j in range(4)] + [(2, 10 * i + 5, None)] for i in range(1, 6)}
    read = lambda: spark.readStream.format("camera").option("path", str(folder)).option("keep", keep).load()
    for name in ("s1", "s2", "s3"):
        _shot(spark, folder, name, shots[name])
    seen = {r.seq for r in _run(read(), "camera", tmp_path, spark).collect()}
    assert seen == {q for n in ("s2", "s3")[-keep:] for _, q, _ in shots[n]}
    for name in ("s4", "s5"):
        _shot(spark, folder, name, shots[name])
    more = {r.seq for r in _run(read(), "camera", tmp_path, spark).collect()} - seen
    assert more == {q for n in ("s4", "s5")[-keep:] for _, q, _ in shots[n]}
    again = {r.seq for r in _run(read(), "camera", tmp_path, spark).collect()}
    assert again == seen | more


def test_stable_quads_of_a_camera(spark, tmp_path):
    camera.register(spark)
    folder = tmp_path / "shots"
    folder.mkdir()
    _shot(spark, folder, "a", [(1, 1, 0.0), (1, 2, 5.0), (1, 3, 9.0), (2, 1, None)])
    stream = lambda: S.stabilize_stream(spark.readStream.format("camera").option("path", str(folder)).load())
    _run(stream(), "stable", tmp_path, spark)
    _shot(spark, folder, "b", [(1, 4, 12.0), (1, 5, 300.0), (2, 2, 1.0)])
    got = sorted((r.session, r.seq, r["count"], r.stable) for r in _run(stream(), "stable", tmp_path, spark).collect())
    assert got == [(1, 1, 1, False), (1, 2, 2, False), (1, 3, 3, True), (1, 4, 4, True), (1, 5, 1, False), (2, 1, 0, False), (2, 2, 1, False)]


def test_resets_after_restarts(spark, tmp_path):
    """The stream with resets, stopped twice, equals the window form."""
    frames, reset = T.frames(spark, SF), "event_type = 'signup'"
    bounds = [r.t for r in frames.select(F.percentile_approx("ts", [0.3, 0.7]).alias("t")).select(F.explode("t").alias("t")).collect()]
    parts = [frames.where(F.col("ts") < bounds[0]), frames.where(F.col("ts").between(bounds[0], bounds[1])), frames.where(F.col("ts") > bounds[1])]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in"))
        got = _run(S.stabilize_stream(stream, reset), "reset", tmp_path, spark)
    want = S.run_lengths(frames, reset).select("session", "seq", "count", "stable")
    assert sorted(got.collect()) == sorted(want.collect()) and want.where("stable").count()


def test_drags_after_restarts(spark, tmp_path):
    """Gestures cut anywhere by restarts give what one run gives; wiggles are taken back on lifting."""
    at = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    script = [("touch", 2, 0, 0, 0), ("move", 0, 0.1, 0.1, 40), ("move", 0, 0.01, 0.0, 40), ("lift", 0, 0, 0, 100), ("move", 0, 0.3, 0.3, 40), ("touch", 0, 0, 0, 40), ("move", 0, 0.7, 0.7, 40), ("move", 0, -2, -2, 40)]
    script += [("lift", 0, 0, 0, 40), ("touch", 1, 0, 0, 40), ("move", 0, 0.01, 0.01, 40), ("lift", 0, 0, 0, 400), ("touch", 7, 0, 0, 40), ("move", 0, 0.1, 0.1, 40), ("lift", 0, 0, 0, 40)]
    rows, ms = [], 0
    for i, (kind, corner, dx, dy, wait) in enumerate(script):
        ms += wait
        rows += [(s, at + datetime.timedelta(milliseconds=ms), i, kind, corner, float(dx), float(dy)) for s in (1, 2)]
    rows += [(2, at + datetime.timedelta(seconds=60), 99, "reset", 0, 0.0, 0.0)]
    for k, (lo, hi) in enumerate(((0, 5), (5, 14), (14, 99))):
        spark.createDataFrame(rows[lo:hi], gestures.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = _run(gestures.drag_stream(spark.readStream.schema(gestures.EVENTS).parquet(str(tmp_path / "in"))), "drag", tmp_path, spark)
    last = {(r.session, r.seq): [round(r[f"q{i}"], 6) for i in range(8)] for r in got.collect()}
    assert len(last) == len(rows)
    start = list(gestures.START)
    after = start[:4] + [0.9, 0.9] + start[6:]
    assert last[1, 2] == start[:4] + [0.91, 0.9] + start[6:] and last[1, 3] == after  # taken back
    assert last[1, 6] == after and last[1, 8] == [0.0, 0.0] + after[2:]  # not convex: as it was; clamped
    assert last[1, 11] == [0.0, 0.0, 0.81, 0.21] + after[4:] == last[1, 14]  # lifted late; no corner taken
    assert last[2, 99] == start


def test_made_once(spark, tmp_path):
    """The second run works on nothing; an edited page alone is made anew."""
    path, done = str(tmp_path / "store"), []

    def work(rows):
        done.append(rows.count())
        return rows.withColumn("made", F.lit(len(done)))

    pages = T.pages(spark, SF).select("doc", "id", "mode", "quad_version", I.view_key({c: F.col(c) for c in ("id", "mode", "quad_version")}).alias("view"))
    n = pages.select("view").distinct().count()
    assert I.process_missing(pages, path, ["view"], work) == n and I.process_missing(pages, path, ["view"], work) == 0 and done == [n]
    edited = pages.withColumn("quad_version", F.when(F.col("doc") == 3, 9).otherwise(F.col("quad_version"))).withColumn("view", I.view_key({c: F.col(c) for c in ("id", "mode", "quad_version")}))
    changed = edited.where("doc = 3").select("view").distinct().count()
    assert I.process_missing(edited, path, ["view"], work) == changed > 0 and done == [n, changed]
    assert I.stored(edited, path, ["view"]).count() == n + changed
    assert I.missing(edited, path, ["view"]).isEmpty()
