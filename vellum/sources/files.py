"""Readers of image folders, evaluation lists, stored documents and preferences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import names as N
from vellum.operators.pages import read_documents


def image_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("jpg", "jpeg")) -> DataFrame:
    """``name, path, mtime, length`` of a folder's files with one of the extensions in any case.

    Contents aren't read: the reader prunes the column that nobody selects.
    """
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.col("modificationTime").alias("mtime"), "length").where(N.is_image(F.col("name"), extensions))


def images(spark: SparkSession, path: str) -> DataFrame:
    """``name, width, height, channels, data`` of a folder's readable images (BGR); others are left out."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path)
    name = F.element_at(F.split("image.origin", "/"), -1)
    return rows.select(name.alias("name"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def _fields(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A list file by position: no quoting, values trimmed, the first line of each file dropped."""
    schema = ", ".join(f"{n} string" for n in names)
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("quote", "").csv(path)
    return rows.select(*(F.trim(n).alias(n) for n in names))


def image_list(spark: SparkSession, path: str) -> DataFrame:
    """``img_name, doc_id``."""
    return _fields(spark, path, ["img_name", "doc_id"])


def document_list(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, colored``; of ids that repeat in a file, the last line counts."""
    rows = _fields(spark, path, ["doc_id", "colored"]).withColumn("row", F.monotonically_increasing_id())
    last = rows.groupBy("doc_id").agg(F.max_by("colored", "row").alias("colored"))
    return last.select("doc_id", (F.lower("colored") == "true").alias("colored"))


def stored_documents(spark: SparkSession, path: str) -> DataFrame:
    """Pages of document files, one document in each file: ``doc`` is the file's path."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), F.col("value").alias("json"))
    return read_documents(rows)


def preferences(rows: DataFrame, key: str, value: str, defaults: dict[str, str], allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row of settings from key-value rows: the default where a value is missing or unknown."""
    columns = []
    for name, default in defaults.items():
        found = F.max(F.when((F.col(key) == name) & F.col(value).isin(*allowed[name]), F.col(value)))
        columns.append(F.coalesce(found, F.lit(default)).alias(name))
    return rows.agg(*columns)
