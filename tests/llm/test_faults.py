"""Cases that an earlier version got wrong, one operator after the other."""

import math

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from vellum.llm import fixity, language, minhash, mixing, tokens, topk, toxicity, vectors
from vellum.llm.tables import table

DOCS = "/root/testdata/sf0.01"


# op1


def test_queries_that_share_an_id(spark):
    rows = [(100, [9, 0]), (100, [0, 9]), (100, [0, 9]), (1, [5, 1]), (2, [1, 7]), (3, [3, 3])]
    df = spark.createDataFrame(rows, "vec_id long, x array<long>")
    got = sorted((r.rank, r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id = 100"), k=2).collect())
    assert got == [(1, 1, 45), (1, 2, 63), (2, 3, 27), (2, 3, 27)]


# op2


def test_long_words(monkeypatch):
    pieces = tokens.piece_scores(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(4)
    words = ["▁" + "".join(rng.choice(list("abcdehilnorst"), n)) for n in (5, 30, 31, 60, 200, 700)] + ["▁" + "ab" * 300, "▁" + "é漢x" * 100]
    whole = tokens.UnigramTrie(pieces)
    monkeypatch.setattr(tokens, "DEEPEST", 10**9)
    want = [whole.insert(w) for w in words]
    for deepest in (1, 7, 30):
        monkeypatch.setattr(tokens, "DEEPEST", deepest)
        trie = tokens.UnigramTrie(pieces)
        assert [trie.insert(w) for w in words] == want and trie.nodes <= deepest * len(words)


# op4


def _plain_targets(sizes, weights, share, cap):
    """By filling all sources at the same level per weight until each is full or the words are out."""
    total, weight = sum(sizes) * share, [weights[i % len(weights)] for i in range(len(sizes))]
    full: set = set()
    while True:
        rest = total - sum(cap * sizes[i] for i in full)
        free = [i for i in range(len(sizes)) if i not in full]
        level = rest / sum(weight[i] for i in free) if free else 0
        over = {i for i in free if weight[i] * level >= cap * sizes[i]}
        if not over:
            return [cap * sizes[i] if i in full else weight[i] * level for i in range(len(sizes))]
        full |= over


def _plain_settled(docs, draw):
    """Pivotal rounding step by step: sizes and chances in turn; ``draw(i)`` decides for the carried one."""
    (size, x, who), done = docs[0], {}
    for other, y, name in docs[1:]:
        gain, loss = min(size * (1 - x), other * y), min(other * (1 - y), size * x)
        up = draw(who) * (gain + loss) < loss
        moved = gain if up else -loss
        x, y = x + moved / size, y - moved / other
        if (up and size * (1 - x) <= 1e-9 * size) or (not up and size * x <= 1e-9 * size):
            done[who] = round(x)
            size, x, who = other, y, name
        else:
            done[name] = round(y)
    return done, (who, x)


def test_mixing_targets(spark):
    docs = table(spark, DOCS, "documents").select("doc_id", "text", F.when(F.col("source") != "src_3", F.col("source")).alias("source"))
    got = mixing.mix(docs)
    by = {r.source: (r.n, r.t) for r in got.groupBy("source").agg(F.first("source_size").alias("n"), F.first("target").alias("t")).collect()}
    ordered = sorted(by, key=lambda s: (s is None, s))
    want = _plain_targets([by[s][0] for s in ordered], (3, 1, 2), 1.5, 2.0)
    assert [by[s][1] for s in ordered] == pytest.approx(want)
    sums = {r.source: r.s for r in docs.groupBy("source").agg(F.sum(F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), ""))).alias("s")).collect()}
    assert sums == {s: n for s, (n, _) in by.items()}


def test_mixing_steps(spark):
    """A block against the plain walk, with the same draws."""
    rng = np.random.default_rng(8)
    docs = [(int(n), float(x), i) for i, (n, x) in enumerate(zip(np.sort(rng.integers(1, 400, 60))[::-1], rng.random(60)))]
    key = lambda d: F.struct(F.lit(d[2]).cast("long").alias("row"), F.lit(1).cast("long").alias("nth"))
    df = spark.range(1).select(F.array(*(F.struct(F.lit(d[0]).cast("long").alias("size"), F.lit(d[2]).cast("long").alias("doc_id"), key(d).alias("key"), F.lit(d[1]).alias("x")) for d in docs)).alias("docs"))
    row = df.select(mixing._settle(F.col("docs"), 7).alias("s")).first().s
    draws = {d.doc_id: d.u for d in spark.createDataFrame([(d[2], d[0]) for d in docs], "doc_id long, size long").select("doc_id", mixing._uniform(F.struct("doc_id", F.lit(1).cast("long")), "size", F.lit(7)).alias("u")).collect()}
    done, (who, x) = _plain_settled(docs, draws.get)
    assert {d.doc_id: d.extra for d in row.done} == done and row.doc_id == who and row.x == pytest.approx(x)
    total = sum(d[0] * d[1] for d in docs)
    sizes = {d[2]: d[0] for d in docs}
    assert sum(sizes[i] * n for i, n in done.items()) + sizes[who] * x == pytest.approx(total)


# op5


def test_texts_that_share_an_id(spark):
    rng = np.random.default_rng(0)
    words = lambda: [f"w{i}" for i in rng.integers(0, 10**6, 120)]
    near = lambda w: " ".join([*w[:-1], "other"])
    a, b, c, d = words(), words(), words(), words()
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (9, " ".join(c)), (7, near(c)), (7, None), (8, " ".join(d)), (5, near(d)), (5, " ".join(b))]
    for part in (1, 4):
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(part)).collect()
        assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (9, 7), (7, 7), (8, 1), (5, 1)} and len(got) == 10
        assert {r.doc_id for r in got if r.kept} == {1, 7}


# op6


def _rows(spark, relabelled):
    docs = table(spark, DOCS, "documents").withColumn("lang", relabelled)
    rows = language.document_rows(docs)
    return {r.id: (r.language, r.accepted) for r in language.identify(rows, language.train(rows)).collect()}


def test_regions(spark):
    plain = _rows(spark, F.col("lang"))
    assert _rows(spark, F.concat("lang", F.lit("-"), F.upper("lang"))) == plain
    got = _rows(spark, F.when((F.col("lang") == "en") & (F.col("doc_id") % 2 == 0), "EN_us").otherwise(F.col("lang")))
    assert got == plain


def test_many_labels(spark):
    """Each tenth row has a misspelt declaration of its own: no more languages, no document lost."""
    plain = _rows(spark, F.col("lang"))
    rows = language.document_rows(table(spark, DOCS, "documents").withColumn("lang", F.when(F.col("doc_id") % 10 == 0, F.concat("lang", F.lit("x"), "doc_id")).otherwise(F.col("lang"))))
    model = language.train(rows)
    assert model.languages == sorted({x for x, _ in plain.values()})
    got = {r.id: (r.language, r.accepted) for r in language.identify(rows, model).collect()}
    assert sum(got[i] != plain[i] for i in plain) <= 3 and model.labels.count() > 90


# op7


def test_labels_without_a_document(spark):
    docs, labels = table(spark, DOCS, "documents"), table(spark, DOCS, "labels").select("doc_id", "toxic")
    more = labels.unionByName(spark.range(10**9, 10**9 + 500).select(F.col("id").alias("doc_id"), F.lit(0).alias("toxic")))
    scores = lambda x: {r.doc_id: round(r.score, 9) for r in toxicity.toxicity(docs, x).collect()}
    assert scores(labels) == scores(more)


def test_toxic_ids_that_repeat(spark):
    rows = [(i, f"plain words here {i % 7}") for i in range(60)] + [(i, f"vile insults there {i % 5}") for i in range(60, 120)] + [(1, "vile insults again"), (1, None), (None, "vile insults")]
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(120)], "doc_id long, toxic int")
    got = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert len(got) == len(rows) and all(r.predicted == int(r.doc_id >= 60) for r in got if r.doc_id not in (1, None))


# op9


def test_wide_ids(spark):
    ids = [2**60 + i for i in range(0, 9000, 7)] + [-1, -4096, -4097, 2**63 - 1, -(2**63), 5, 4096]
    pages = spark.createDataFrame([(i, "http://x/", f"page {i}") for i in ids], "page_id long, url string, html string")
    got = fixity.archive_records(pages).collect()
    assert all((r.archive, r.place) == divmod(r.page_id, fixity.PLACES) for r in got) and len(got) == len(ids)


# op10


def test_extreme_vectors(spark):
    rows = [(1, [1e200, 1e200]), (2, [2e200, 2e200]), (3, [1e-200, 1e-200]), (4, [3e-200, 3e-200]), (5, [1.0, 1.0]), (6, [1.0, -1.0]), (7, [5e-324, 0.0]), (8, [1.7e308, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (4, 1), 5: (4, 1), 6: (0, 6), 7: (1, 7), 8: (1, 7)}
    assert math.isfinite(sum(n for n, _ in got.values()))
