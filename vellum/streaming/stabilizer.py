"""Stable quads in ordered frame streams: a window form for tables, a stateful one for streams.

A quad is stable once it and the quads before it, each within a distance of the one before, make a
run of three. A frame without a quad ends the run; so does a reset.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vellum.functions import geometry as G

#: Largest distance (px, single precision, exclusive) and frames until stable.
MAX_DISTANCE, STABLE_COUNT = 20.0, 3
FLAT = [f"{n}_{c}" for n in ("tl", "tr", "br", "bl") for c in "xy"]


def run_lengths(frames: DataFrame, reset: str = "false") -> DataFrame:
    """``frames`` (session, ts, seq, q) with ``count``, ``stable``: the run up to each frame.

    Rows are ordered by (ts, seq) in their session; a session's rows meet in one task, as its order
    demands. ``reset`` is a condition for frames before which a run ends.
    """
    w = Window.partitionBy("session").orderBy("ts", "seq")
    near = G.max_corner_distance(F.col("q"), F.lag("q").over(w)) < F.lit(MAX_DISTANCE).cast("float")
    rows = frames.withColumn("starts", (~F.coalesce(near, F.lit(False)) | F.expr(reset) | F.col("q").isNull()).cast("int"))
    rows = rows.withColumn("island", F.sum("starts").over(w))
    n = F.row_number().over(Window.partitionBy("session", "island").orderBy("ts", "seq"))
    count = F.when(F.col("q").isNull(), 0).otherwise(n)
    return rows.withColumn("count", count.cast("int")).withColumn("stable", F.col("count") >= STABLE_COUNT).drop("starts", "island")


class QuadRun(StatefulProcessor):
    """The run of a session: its last quad and length."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", ", ".join(f"{c} double" for c in FLAT) + ", count int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        batch = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        last = self.last.get() if self.last.exists() else None
        points, count = (last[:8], last[8]) if last else (None, 0)
        corners = batch[FLAT].to_numpy(np.float64).reshape(-1, 4, 2)
        before = np.concatenate([np.full((1, 4, 2), np.nan) if points is None else np.array(points).reshape(1, 4, 2), corners[:-1]])
        far = np.hypot(*np.moveaxis(corners - before, 2, 0)).max(axis=1).astype(np.float32)
        counts = []
        goes_on = (far < MAX_DISTANCE) & ~batch["reset"].to_numpy(bool)
        for missing, near in zip(np.isnan(corners[:, 0, 0]).tolist(), goes_on.tolist(), strict=True):
            count = 0 if missing else count + 1 if near else 1
            counts.append(count)
        points = corners[-1].ravel()
        if count:
            self.last.update((*map(float, points), int(count)))
        else:
            self.last.clear()
        yield pd.DataFrame({"session": key[0], "seq": batch["seq"].to_numpy(), "count": counts, "stable": [c >= STABLE_COUNT for c in counts]}).astype({"count": "int32"})

    def close(self) -> None:
        pass


def camera_frames(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of frames (session, ts, seq, q) from the Parquet files that come to a folder.

    Frames behind what a micro-batch takes wait in the folder; :func:`latest_only` drops stale ones.
    """
    point = "struct<x:double,y:double>"
    quad = "struct<" + ",".join(f"{n}:{point}" for n in G.CORNERS) + ">"
    return spark.readStream.schema(f"session bigint, ts timestamp, seq bigint, q {quad}").option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def flat_quads(frames: DataFrame, reset: str = "false") -> DataFrame:
    points = zip(("tl", "tr", "br", "bl"), G.corners(F.col("q")), strict=True)
    return frames.select("session", "ts", "seq", F.coalesce(F.expr(reset), F.lit(False)).alias("reset"), *(p[c].alias(f"{n}_{c}") for n, p in points for c in "xy"))


def stabilize_stream(frames: DataFrame, reset: str = "false") -> DataFrame:
    """``session, seq, count, stable`` of a stream of frames, with a session's run kept as state.

    ``reset`` is a condition for frames before which a run ends. The session must use the RocksDB state store. Frames that come in a later micro-batch than
    frames behind them are taken in the order they come.
    """
    schema = "session long, seq long, count int, stable boolean"
    return flat_quads(frames, reset).groupBy("session").transformWithStateInPandas(QuadRun(), schema, "Append", "None")


def latest_only(batch: DataFrame) -> DataFrame:
    """The last frame of each session in a micro-batch; for use in foreachBatch."""
    return batch.groupBy("session").agg(F.max_by(F.struct("seq", "q"), F.struct("ts", "seq")).alias("f")).select("session", "f.seq", "f.q")
