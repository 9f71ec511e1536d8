"""Every query with SQL against DuckDB on the smallest tables; the stream against its window form."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from vellum import plans
from vellum.sources import tables as T
from vellum.streaming import stabilizer as S

SF = "/root/testdata/sf0.001"
TABLES = "customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or v is pd.NA or isinstance(v, float) and np.isnan(v) else round(float(v), 6) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else v
    return sorted((tuple(clean(v) for v in row) for row in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_as_sql(spark, duck, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), duck.execute(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_stream_and_window_agree(spark, tmp_path):
    T.frames(spark, SF).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(T.frames(spark, SF).schema).parquet(str(tmp_path / "in"))
    query = S.stabilize_stream(stream).writeStream.format("memory").queryName("runs").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    query.stop()
    want = S.run_lengths(T.frames(spark, SF)).select("session", "seq", "count", "stable").collect()
    assert sorted(spark.table("runs").select("session", "seq", "count", "stable").collect()) == sorted(want) and want
