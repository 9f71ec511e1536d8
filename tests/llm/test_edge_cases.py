"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vellum.llm import fixity, language, lines, minhash, mixing, packing, tokens, topk, toxicity, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, h long, size long, component string, rows string"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ROWS = [
    (1, "the cat sat on the mat\nand the dog ran off", "en", "a", 40, 5, 5, 5, "x", "y"),
    (2, "the cat sat on the mat\nand the dog ran off", "en", "a", 40, 5, 5, 5, "x", "y"),
    (2, "the cat sat on the mat\nand the dog ran off", "en", "a", 40, 5, 5, 5, "x", "y"),
    (3, None, "en", None, None, None, None, None, None, None),
    (4, "", None, "b", 0, 5, 5, 5, "x", "y"),
    (5, " \n   ", "fr", "", 5, 5, 5, 5, "x", "y"),
    (None, "une phrase sans numéro", "fr", "b", 22, 5, 5, 5, "x", "y"),
    (6, LONG, "en", "c", len(LONG), 5, 5, 5, "x", "y"),
    (7, "x" * 20_000, "de", "c", 20_000, 5, 5, 5, "x", "y"),
    (8, "one", "xx", "\U0001f600", 3, 5, 5, 5, "x", "y"),
]


@pytest.fixture(scope="module", params=["rows", "empty"])
def docs(spark, request):
    return spark.createDataFrame(ROWS if request.param == "rows" else [], DOCS)


def test_minhash(docs):
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    if got:
        assert (by[1].component_id, by[1].kept, by[2].component_id, by[2].kept) == (1, True, 1, False)
        assert by[3].n_shingles == by[4].n_shingles == by[5].n_shingles == 0 and by[3].kept and by[8].n_shingles == 1
        assert by[None].component_id is None and by[None].kept


def test_lines(docs):
    got = lines.marked_lines(docs).collect()
    kept = {(r.doc_id, r.line_no) for r in got if r.kept}
    if got:
        assert {(1, 0), (1, 1), (6, 0), (7, 0), (8, 0), (None, 0)} == kept
        assert len(got) == 10
    out = lines.drop_repeated_lines(docs)
    assert out.columns == docs.columns
    if got:
        assert sorted(r.doc_id for r in out.where("doc_id is not null").collect()) == [1, 3, 4, 5, 6, 7, 8]


def test_mixing(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.copies <= 2 and r.taken == r.copies * r.size for r in got)


def test_packing(docs):
    got = packing.pack(docs).collect()
    whole = {}
    for r in got:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
    if got:
        assert whole[3] == whole[4] == whole[5] == 1 and whole[2] == 2 * whole[1]
        assert all(r.length <= packing.LIMIT for r in got)


def test_tokens(docs):
    got = {r.doc_id: r for r in tokens.token_counts(docs).collect()}
    if got:
        assert got[3].n_tokens == got[4].n_tokens == got[5].n_words == 0
        assert got[6].n_words == 60_000


def test_language(spark, docs):
    rows = language.document_rows(docs)
    got = language.identify(rows, language.train(rows)).collect()
    assert len(got) == docs.count()
    assert not any(r.accepted for r in got if r.id in (3, 4, 5))
    pages = spark.createDataFrame([(1, None, None), (2, "no address", "<p>text"), (None, "http://x.y/", "")], "page_id long, url string, html string")
    assert len(language.identify(language.page_rows(pages), language.train(rows)).collect()) == 3


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, 0), (3, None), (None, 1), (8, 1)], "doc_id long, toxic int")
    for marked in (labels, labels.limit(0)):
        got = toxicity.toxicity(docs, marked).collect()
        assert len(got) == docs.count()
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int, id long, v string"
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.1]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 0.0]), (10, [0.0, 1.0]), (11, [1.0, 0.0, 0.0])]
    table = spark.createDataFrame([(*r, 0, 0, "x") for r in rows], schema)
    got = {r.vec_id: r for r in vectors.near_vectors(table).collect()}
    assert len(got) == len(rows)
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in (1, 2, 3, 10, 6, 11)] == [(2, 1, True), (2, 1, False), (2, 1, False), (0, 10, True), (0, 6, True), (0, 11, True)]
    assert vectors.near_vectors(table.limit(0)).count() == 0
    ints = topk.integer_vectors(table)
    found = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(ints, ints.where("vec_id = 1"), 10).orderBy("rank").collect()]
    assert found == [(1, 1, 3, 2048 * 1024), (1, 2, 2, 1024 * 1024), (1, 3, 6, 0), (1, 4, 10, 0)]
    assert topk.top_k(ints.limit(0), ints.limit(0), 10).count() == 0


def test_fixity(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>") for i in range(300)] + [(7, "again", None), (None, "u", "h")], "page_id long, url string, html string")
    a = fixity.archive_records(pages)
    assert fixity.audit(a, a).count() == 0
    b = fixity.archive_records(pages.withColumn("html", F.when(F.col("page_id") == 250, "bad").otherwise(F.col("html"))).where("page_id is null or page_id <> 17"))
    found = {(r.level, r.node): r.status for r in fixity.audit(a, b).collect()}
    assert found == {(0, 250): "changed", (0, 17): "missing_b", (1, 15): "changed", (1, 1): "changed", (2, 0): "changed", (3, 0): "changed"}
    gone = fixity.audit(a, a.limit(0)).where("level = 0").collect()
    assert len(gone) == 300 and {r.status for r in gone} == {"missing_b"}
    assert fixity.audit(a.limit(0), a.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    plain = spark.createDataFrame(ROWS, DOCS).select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0
    docs = plain
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert sorted(docs.columns) == sorted(plain.columns)
        docs = spark.createDataFrame(docs.collect(), plain.schema)
