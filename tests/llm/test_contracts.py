"""Counts, posteriors, draws and records against plain Python; wide values, many repeats, clashing names."""

import hashlib
import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from vellum.llm import fixity, language, lines, mixing, topk, toxicity


def test_toxicity_counts_and_scores(spark):
    texts = ["you are kind", "you are awful, AWFUL", "", "ab", "so kind of you", "awful awful awful", None, "kind"]
    labels = [0, 1, 0, 1, 0, 1, 0, 0]
    rows = spark.createDataFrame([(t, y) for t, y in zip(texts, labels, strict=True)], "text string, label int")
    want = defaultdict(lambda: [0, 0])
    sets = []
    for t, y in zip(texts, labels, strict=True):
        grams = b" " + (t or "").lower().encode() + b"  "
        found = set(toxicity.codes((t or "").encode()).tolist())
        distinct = {grams[i : i + n] for n in (4, 6, 8) for i in range(len(grams) - n + 1)}
        assert len(distinct) - 1 <= len(found) <= len(distinct)  # hashes rarely meet
        sets.append(found)
        for f in found:
            want[f][y] += 1
    counts = toxicity.feature_counts(rows)
    assert {r.feature: [r.n0, r.n1] for r in counts.collect()} == dict(want)
    got = {r.feature: r for r in toxicity.log_ratios(counts, {0: 5, 1: 3}).collect()}
    assert set(got) == {f for f, (a, b) in want.items() if a + b >= toxicity.LEAST_DOCS}
    for f, r in got.items():
        a, b = want[f]
        ratio = math.log((b + 1) / (3 + 2)) - math.log((a + 1) / (5 + 2))
        assert abs(r.ratio - ratio) < 1e-12 and abs(r.z - abs(ratio) / math.sqrt(1 / (a + 1) + 1 / (b + 1))) < 1e-12
    chosen = np.array(sorted(want))[::2]
    places = toxicity.Places(chosen)
    for t, found in zip(texts, sets, strict=True):
        assert chosen[places.of((t or "").encode())].tolist() == sorted(found & set(chosen.tolist()))


def test_logistic_fit():
    rows = [np.array([0, 1]), np.array([0]), np.array([1]), np.array([], int), np.array([2]), np.array([2, 0])]
    labels, scale = np.array([1.0, 1, 0, 0, 0, 1]), np.array([1.5, -1.0, 0.3])
    weights, bias = toxicity.fit_logistic(rows, labels, scale, steps=3000)
    dense = np.zeros((6, 3))
    for i, r in enumerate(rows):
        dense[i, r] = scale[r]
    z = dense @ (weights / scale) + bias
    error = 1 / (1 + np.exp(-z)) - labels
    slope = dense.T @ error / 6 + toxicity.PENALTY * weights / scale
    assert np.abs(slope).max() < 2e-3 and abs(error.mean()) < 2e-3


def test_language_posterior(spark):
    rng = np.random.default_rng(3)
    model = language.Model(["aa", "bb", "cc"], rng.integers(0, 3, (3, 1 << language.BITS)).astype(float))
    rows = [(i, f"text {i} " * (i % 4), ("aa", "bb-XY", "zz", None)[i % 4], ("h1", "h2", None)[i % 3], ("com", None)[i % 2]) for i in range(40)]
    got = language.identify(spark.createDataFrame(rows, "id long, text string, lang string, host string, suffix string"), model).collect()
    sums, votes = {}, {}
    for i, text, *_ in rows:
        codes = language._trigrams(language._bytes(text.encode()))
        blank = not text.strip()
        sums[i] = (0, np.zeros(3)) if blank else (len(codes), np.array([t[codes].sum() for t in model.log], float))
        votes[i] = None if blank else int(np.argmax(sums[i][1]))
    count = lambda pick: np.array([sum(1 for r in rows if votes[r[0]] == k and pick(r)) for k in range(3)], float)
    wide = (count(lambda r: True) + 1) / (count(lambda r: True).sum() + 3)
    smooth = lambda v, w: (v + language.SMOOTHING * w) / (v.sum() + language.SMOOTHING)
    for r in got:
        _, _, lang, host, suffix = rows[r.id]
        prior = smooth(count(lambda x: x[4] == suffix), wide) if suffix else wide
        prior = smooth(count(lambda x: x[3] == host), prior) if host else prior
        n, s = sums[r.id]
        logs = s * (min(1.0, language.MOST_EVIDENCE / n) if n else 0.0) + np.log(prior)
        told = (lang or "").split("-")[0]
        if told in model.languages:
            logs = logs + np.where(np.arange(3) == model.languages.index(told), np.log(0.9), np.log(0.05))
        best = int(np.argmax(logs))
        assert r.language == model.languages[best] and abs(r.posterior - 1 / np.exp(logs - logs.max()).sum()) < 1e-4
        if not n:
            assert not r.accepted


def test_mixing_of_many_sources(spark):
    """400 like sources of few documents: each ends within one document of its target, all together on it."""
    sizes = (1, 2, 3, 5, 9)
    rows = [(s * 10 + k, "w " * n, f"s{s:03d}") for s in range(400) for k, n in enumerate(sizes)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1,), share=1.3).collect()
    taken = defaultdict(int)
    for r in got:
        assert abs(r.target - 26) < 1e-9 and r.copies in (1, 2) and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    assert len(taken) == 400 and all(abs(t - 26) <= 9 for t in taken.values())
    assert abs(sum(taken.values()) / (400 * 26) - 1) < 0.02


def test_top_k_of_wide_values(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 6)) * 1e3
    x[3, 2], x[4, 2], x[5] = 1e6, -1e6, x[6]
    rows = spark.createDataFrame([(i, v.tolist(), 1, "k") for i, v in enumerate(x)], "vec_id long, embedding array<double>, rank int, shard string")
    vectors = topk.integer_vectors(rows)
    got = topk.top_k(vectors, vectors.where("vec_id % 50 < 7"), 10).toPandas()
    ints = np.floor(1024 * x).astype(np.int64)
    for q, part in got.groupby("query_id"):
        score = ints @ ints[q]
        order = [i for i in np.lexsort((np.arange(500), -score)) if i != q][:10]
        part = part.sort_values("rank")
        assert part["vec_id"].tolist() == order and part["score"].tolist() == score[order].tolist()


def test_archive_of_many_repeats(spark):
    one = spark.range(70_000).select(F.lit(7).cast("long").alias("page_id"), F.lit("http://h/").alias("url"), F.lit("<p>").alias("html"), F.lit(1).alias("digest"), F.lit(2).alias("n"))
    (record,) = fixity.archive_records(one).collect()
    assert (record.place, record.length) == (7, 70_000 * len(_record("http://h/", "<p>")))
    fewer = fixity.audit(fixity.archive_records(one), fixity.archive_records(one.limit(69_999))).where("level = 0").collect()
    assert [r.status for r in fewer] == ["changed"]


def _record(url, html):
    return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(html.encode())}\r\n\r\n{html}\r\n\r\n".encode()


def test_records_round_trip(spark):
    pages = [("http://é/1", "<p>ö</p>\r\n\r\nWARC/1.0"), ("http://x/2", ""), ("http://x/3", "y" * 200_000)]
    got = spark.createDataFrame(pages, "url string, html string").select(fixity.warc_record("url", "html").alias("r")).collect()
    assert [bytes(r.r) for r in got] == [_record(*p) for p in pages]
    whole = b"".join(_record(*p) for p in pages)
    files = spark.createDataFrame([("a", bytearray(whole)), ("b", bytearray(whole[:-3])), ("c", bytearray(b"junk")), ("d", None)], "path string, content binary")
    read = fixity.read_records(files).collect()
    assert [(r.url, bytes(r.block).decode()) for r in read if r.path == "a"] == pages
    starts = np.cumsum([0, *(len(_record(*p)) for p in pages)]).tolist()
    assert [(r.offset, r.length) for r in read if r.path == "a"] == [(a, b - a) for a, b in zip(starts, starts[1:], strict=False)]
    assert [r.block is None for r in read if r.path == "b"] == [False, False, True]
    assert [(r.offset, r.length, r.block) for r in read if r.path in "cd"] == [(0, 4, None)]


def test_tree_hashes_ranges(spark):
    """Two records that swap a byte between their lengths keep their digests here, but not their ranges."""
    rows = [(0, 0, 0, 0, 10, "a"), (0, 1, 1, 10, 10, "b")]
    moved = [(0, 0, 0, 0, 11, "a"), (0, 1, 1, 11, 9, "b")]
    frames = [spark.createDataFrame(r, "archive long, place int, page_id long, offset long, length long, digest string") for r in (rows, moved)]
    a, b = ({(r.level, r.node): r.digest for r in fixity.tree(f).collect()} for f in frames)
    assert a[0, 0] == b[0, 0] and a[1, 0] != b[1, 0] and a[3, 0] != b[3, 0]
    assert a[1, 0] == hashlib.sha256(b"0=a@0-10,1=b@10-20").hexdigest()


def test_clashing_names(spark):
    names = ("lost", "lost_id", "lost_row", "row", "h", "component", "doc", "line")
    rows = [(1, "a line of text\nanother line here", *range(8)), (2, "a line of text\nsomething else", *range(8))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = sorted(tuple(r) for r in lines.drop_repeated_lines(docs).collect())
    assert got == [rows[0], (2, "something else", *range(8))]
