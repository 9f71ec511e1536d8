"""Outputs made once: what a store lacks is worked out, and nothing else."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stored(needed: DataFrame, path: str, keys: list[str]) -> DataFrame | None:
    """The store's rows, one for each key, or None before the first run."""
    try:
        rows = needed.sparkSession.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return rows.dropDuplicates(keys)


def missing(needed: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """The rows of ``needed`` whose keys the store at ``path`` lacks, one for each key."""
    have, rows = stored(needed, path, keys), needed.dropDuplicates(keys)
    return rows if have is None else rows.join(have.select(*keys), keys, "left_anti")


def process_missing(needed: DataFrame, path: str, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> int:
    """Run ``work`` on what the store lacks and append its result, which keeps the key columns; gives the number of rows added.

    The key says all that an output depends on, so an edited page has another key and is made
    anew while all others stay. Where nothing is missing no work is planned and nothing written.
    A run that fails leaves the store as it was; two that overlap may write a row twice, of which :func:`stored` shows one.
    """
    rows = missing(needed, path, keys)
    if rows.isEmpty():
        return 0
    before = stored(needed, path, keys)
    n = before.count() if before is not None else 0
    work(rows).write.mode("append").parquet(path)
    return stored(needed, path, keys).count() - n


def view_key(columns: dict[str, Column]) -> Column:
    """A key of named columns, nulls told from empty values."""
    return F.sha2(F.to_json(F.struct(*(c.alias(n) for n, c in columns.items())), {"ignoreNullFields": "false"}), 256)
