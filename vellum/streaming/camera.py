"""A camera as a streaming source: files of frames, of which a slow reader sees the newest only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from vellum.functions.geometry import CORNERS

POINT = "struct<x:double,y:double>"
SCHEMA = "session bigint, ts timestamp, seq bigint, q struct<" + ",".join(f"{n}:{POINT}" for n in CORNERS) + ">"


class Shot(InputPartition):
    """One file of frames."""

    def __init__(self, path: str):
        self.path = path


class CameraReader(DataSourceStreamReader):
    """Offsets are file names, which ascend as the camera writes.

    A trigger takes up all files that came since the last one and reads the newest ``keep`` of them: what lies
    further behind is stale and dropped, as when a camera keeps only the latest frame for a busy
    analyser. Which files a trigger reads follows from its two offsets and the folder alone, so a trigger that
    is repeated after a restart reads the same ones.
    """

    def __init__(self, path: str, keep: int):
        self.path, self.keep = path, keep

    def _files(self) -> list[str]:
        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.File and f.base_name.endswith(".parquet") and not f.base_name.startswith((".", "_")))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"file": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"file": max(self._files(), default="")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        new = [f for f in self._files() if start["file"] < f <= end["file"]]
        return [Shot(f"{self.path.rstrip('/')}/{f}") for f in new[-self.keep :]]

    def read(self, partition: Shot) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(partition.path) if "://" in partition.path else (fs.LocalFileSystem(), partition.path)
        with store.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=["session", "ts", "seq", "q"]):
                yield batch.set_column(1, "ts", batch.column("ts").cast(pa.timestamp("us", tz="UTC")))

    def commit(self, end: dict) -> None:
        """Nothing is held back for a trigger."""


class Camera(DataSource):
    """Format ``camera``: options ``path``, a folder of Parquet files of frames, and ``keep``, files read in a trigger."""

    @classmethod
    def name(cls) -> str:
        return "camera"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> CameraReader:  # noqa: N802
        return CameraReader(self.options["path"], int(self.options.get("keep", 1)))


def register(spark: SparkSession) -> None:
    """Make ``spark.readStream.format("camera")`` known."""
    spark.dataSource.register(Camera)
