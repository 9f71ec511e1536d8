"""What goes to Python in language identification: texts without the rest of their rows, in small batches."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from vellum.llm import language


def test_texts_go_alone(spark, monkeypatch):
    docs = spark.range(300).select(
        F.col("id").alias("doc_id"),
        F.expr("repeat(concat('some words in ', id, ' '), 6000)").alias("text"),
        F.lit("en").alias("lang"),
        F.lit("a").alias("source"),
        F.repeat(F.lit("wide"), 20_000).alias("other"),
    )
    seen, write = [], language.written

    def kept(df, name, *more):
        if name == "likelihoods":
            seen.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name, *more)

    def sizes(model):
        """In place of likelihoods, the bytes of each text's batch as their logarithm."""

        def run(texts: pa.Array) -> pa.Array:
            bytes_of = [float(texts.nbytes)] * len(texts)
            return pa.StructArray.from_arrays([pa.array([1] * len(texts), pa.int64()), pa.array([[b] for b in bytes_of], pa.list_(pa.float64()))], names=["n", "sums"])

        return F.arrow_udf(run, "n long, sums array<double>")

    monkeypatch.setattr(language, "written", kept)
    found = corpus_pipeline.keep_languages(spark, docs, "")
    assert found.count() == 300 and sorted(found.columns) == sorted(docs.columns)
    assert len(seen) == 1 and "MapInArrow" not in seen[0] and "ArrowEvalPython" in seen[0]

    def written(df, name, *more):
        out = write(df, name, *more)
        if name == "likelihoods":
            seen.append(out.agg(F.max(F.get("sums", F.lit(0)))).first()[0])
        return out

    monkeypatch.setattr(language, "written", written)
    monkeypatch.setattr(language, "_likelihoods", sizes)
    rows = language.document_rows(docs.coalesce(1), ["other"])
    assert language.identify(rows, language.Model(["en"], language.np.zeros((1, 1 << language.BITS))), ["other"]).count() == 300
    assert 0 < seen[1] <= 2 * language.BATCH_BYTES, seen[1]
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(64 << 20) + "b"
