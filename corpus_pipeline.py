"""Corpus pipeline: documents through language ID, deduplication, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents. Rows without
a doc_id, and rows that share one, are documents of their own in every stage. An empty table stays
empty through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import language, lines, minhash, mixing, packing
from vellum.llm.tables import columns_of, table, unused_names, written


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted, with the identified language in lang.

    Null, empty and blank texts have no language and go, and so does text unlike its language.
    """
    (whole,) = unused_names(docs, "whole")
    rows = language.document_rows(docs.withColumn(whole, F.struct(*columns_of(docs))), [whole])
    found = language.identify(rows, language.train(rows), [whole])
    return found.where("accepted").select(*(F.col("language").alias(c) if c == "lang" else F.col(whole).getField(c).alias(c) for c in docs.columns))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat, or nearly repeat, an earlier line of the corpus.

    Documents that lose every line that isn't blank go with them.
    """
    return lines.drop_repeated_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8.

    The one with the smallest doc_id stays, one without an id only where none has one. Rows that
    share an id with different texts are told apart; documents without words all stay.
    """
    (key,) = unused_names(docs, "key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", F.col("doc_id").isNull(), "text"))
    found = minhash.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text")).where("n_shingles > 0")
    groups = found.select(F.col("doc_id").alias("key"), "component_id").distinct()
    ids = keyed.select(F.col(key).alias("key"), F.col("doc_id").isNull().alias("no_id"), "doc_id").distinct()
    first = groups.join(ids, "key").groupBy("component_id").agg(F.min(F.struct("no_id", "doc_id", "key")).alias("first"))
    kept = keyed.join(first.select(F.col("first.key").alias(key)), key, "left_semi").dropDuplicates([key]).select(columns_of(docs))
    return kept.unionByName(docs.where(F.col("text").isNull() | ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, which may be never.

    Equal rows share their copies out. Documents without words are taken a rounded number of times.
    """
    row, copies = unused_names(docs, "row", "copies")
    taken = mixing.mixed_rows(docs).groupBy("row").agg(F.sum("copies").alias("copies")).where("copies > 0")
    taken = taken.select(F.col("row").alias(row), F.col("copies").alias(copies))
    rows = docs.withColumn(row, mixing.row_hash(docs)).dropDuplicates([row]).join(taken, row)
    return rows.withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(columns_of(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_languages),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: MinHash components, random rounding and tokenization are beyond SQL. tests/llm/test_pipeline.py
#: holds the stages against plain Python on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
