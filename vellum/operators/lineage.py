"""Tables between rounds: written to the folder that the cluster shares, so lost executors cost a read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Used only where a local session names no shared folder, as in tests.
LOCAL_DIR = "/tmp/vellum-shared"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to spark.checkpoint.dir, which only a local session may lack, and read again."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{(base or LOCAL_DIR).rstrip('/')}/rounds-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fingerprint(df: DataFrame, column: str) -> tuple:
    """Number of rows and sum of a column of whole numbers: what a round changes."""
    return tuple(df.agg(F.count("*"), F.sum(F.col(column).cast("decimal(38,0)"))).first())
