"""Operators against plain versions on small data, round trips and held-out accuracy."""

import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellum.llm import language, lines, minhash, mixing, packing, queries, tokens, topk, toxicity, vectors
from vellum.llm.components import connected_components
from vellum.llm.tables import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


def _roots(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(0)
    chain = [(i, i + 1) for i in range(100, 160)]
    links = [*map(tuple, rng.integers(0, 90, (60, 2)).tolist()), *chain, (500, 400), (500, 300), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = _roots({x for link in links for x in link}, links)
    assert all(want[n] == c for n, c in got.items())
    assert {n for a, b in links if a != b for n in (a, b)} == set(got)


@pytest.mark.parametrize("noise", [0.01, 0.05])
def test_minhash_family(spark, noise):
    """A family whose similarities lie about the limit, where stars alone would miss links."""
    rng = np.random.default_rng(int(noise * 100))
    base = [f"w{i}" for i in rng.integers(0, 500, 150)]
    texts = [" ".join(w if rng.random() > noise else f"n{rng.integers(10**9)}" for w in base) for _ in range(120)]
    sets = [{tuple(t.split()[i : i + 3]) for i in range(148)} for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(120), 2) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width=3, percent=85)
    assert {r.doc_id: r.component_id for r in got.collect()} == _roots(range(120), links)


def test_lines(docs):
    got = {(r.doc_id, r.line_no) for r in lines.marked_lines(docs).where("kept").collect()}
    first: dict = {}
    for r in docs.orderBy("doc_id").collect():
        for i, line in enumerate(r.text.split("\n")):
            if line.strip(" "):
                first.setdefault(line.strip(" "), (r.doc_id, i))
    low = [x.lower() for x in first]
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} or {x} for x in low]
    near = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 100 * min(map(len, (sets[i], sets[j]))) >= 80 * max(map(len, (sets[i], sets[j])))]
    links = [(i, j) for i, j in near if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    roots = _roots(range(len(sets)), links)
    places = list(first.values())
    want = {places[i] for i in set(roots.values())}
    assert len(got ^ want) <= 0.02 * len(links) + 1


def test_token_counts(spark, docs):
    pieces = tokens.piece_scores(public_tokenizers.path("piece_bpe_32k.model"))

    def brute(word):
        best = [(0.0, 0)] + [None] * len(word)
        for i in range(1, len(word) + 1):
            n = len(word[i - 1].encode())
            best[i] = (best[i - 1][0] + tokens.BYTE_SCORE * n, best[i - 1][1] + n)
            for j in range(i - 1, -1, -1):
                score = pieces.get(word[j:i])
                if score is not None and best[j][0] + score >= best[i][0]:
                    best[i] = (best[j][0] + score, best[j][1] + 1)
        return best[-1][1]

    some = docs.limit(40)
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in tokens.token_counts(some).collect()}
    cache: dict = {}
    for r in some.collect():
        words = r.text.split()
        for w in words:
            cache.setdefault(w, brute("▁" + w))
        assert got[r.doc_id] == (len(words), sum(cache[w] for w in words))
    trie = tokens.UnigramTrie(pieces)
    words = ["▁abd", "▁abc", "▁abcd", "▁abd"]
    assert [trie.insert(w) for w in words] == [brute(w) for w in words]
    assert trie.nodes == 6  # of 17 characters
    ties = tokens.UnigramTrie({"a": -1.0, "b": -1.0, "ab": -2.0, "▁": -1.0, "abb": -3.0})
    assert [ties.insert(w) for w in ("▁ab", "▁abb", "▁é")] == [2, 2, 3]  # the longest last piece; two bytes


def test_mixing(docs):
    rows = mixing.mix(docs).toPandas()
    by = rows.groupby("source").agg(size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert abs(by["target"].sum() - 1.5 * by["size"].sum()) < 1e-6 * by["size"].sum()
    assert (by["target"] <= 2 * by["size"] + 1e-6).all() and (abs(by["taken"] - by["target"]) <= by["most"]).all()
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(by.index))}
    free = by[by["target"] < 2 * by["size"] - 1e-6]
    rate = free["target"] / free.index.map(weight)
    assert rate.max() - rate.min() < 1e-6 * rate.max()
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert rows.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()


def test_packing_round_trip(spark, docs):
    odd = [(10**6, None), (10**6 + 1, "<|endoftext|> HI <|ENDOFTEXT|>x it's !!. a... Été xİ ΣΣ é. 12,34."), (10**6 + 2, "a" * 9000 + " b. " * 6000)]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    pieces = packing.pack(rows).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in rows.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], np.uint32)
        at = 0
        for p in pieces[pieces.doc_id == r.doc_id].sort_values("start").itertuples():
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    ordered = pieces.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"] == ordered["offset"]).all()
    lengths = ordered.groupby("sequence_id")["length"].sum()
    padding = sum(0 if n & (n - 1) == 0 else packing.LIMIT - n for n in lengths)
    assert lengths.max() <= packing.LIMIT and padding <= 0.03 * lengths.sum()


def test_window_cuts():
    rng = np.random.default_rng(3)
    for _ in range(30):
        places = [0, *np.cumsum(rng.integers(1, 9, 14)).tolist()]
        costs = [0, *rng.integers(0, 12, 14).tolist()]
        cost = lambda cuts: sum(20 - (b - a) for a, b in itertools.pairwise(places[c] for c in cuts)) + sum(costs[c] for c in cuts)  # noqa: E731, B023
        got = packing.window_cuts(places, costs, 20)
        every = [(0, *mid, 14) for n in range(14) for mid in itertools.combinations(range(1, 14), n)]
        fits = [c for c in every if all(places[b] - places[a] <= 20 for a, b in itertools.pairwise(c))]
        assert cost(got) == min(map(cost, fits))


def test_top_k(spark):
    got = queries.op1_exact_top_k(spark, SF).toPandas()
    rows = table(spark, SF, "embeddings").orderBy("vec_id").toPandas()
    x = np.floor(1024 * np.array(rows["embedding"].tolist(), np.float64)).astype(np.int64)
    for q, part in got.groupby("query_id"):
        score = x @ x[rows.index[rows.vec_id == q][0]]
        order = [i for i in np.lexsort((rows.vec_id, -score)) if rows.vec_id[i] != q][:10]
        part = part.sort_values("rank")
        assert part["vec_id"].tolist() == rows.vec_id[order].tolist() and part["score"].tolist() == score[order].tolist()


def test_vectors_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    x = np.concatenate([centres[rng.integers(0, 20, 400)] + 0.25 * rng.normal(size=(400, 16)), rng.normal(size=(300, 16))])
    got = vectors.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).toPandas().sort_values("vec_id")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    assert (got["n_links"].to_numpy() <= true).all() and got["n_links"].sum() >= 0.97 * true.sum()


def test_language_accuracy(spark, docs):
    rows = language.document_rows(docs)
    model = language.train(rows)
    blind = language.identify(rows.withColumn("lang", F.lit(None).cast("string")).withColumn("host", F.lit(None).cast("string")), model).withColumnRenamed("id", "doc_id")
    both = blind.join(docs, "doc_id").toPandas()
    assert (both["language"] == both["lang"]).mean() >= 0.97 and both["accepted"].mean() >= 0.95


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    scored = toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))
    rows = scored.where("held_out").join(table(spark, sf, "labels"), "doc_id").toPandas()
    order = rows["score"].rank().to_numpy()
    bad = rows["toxic"].to_numpy() == 1
    auc = (order[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    assert auc >= 0.95 and ((rows["predicted"] == 1) & ~bad).mean() <= 0.01
    assert rows["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0).all()


def test_impact_index_ties():
    x = np.ones((60, 4), np.int64)
    ids, scores = topk.ImpactIndex(np.arange(60), x).search(np.array([3, -1, 2, 0]), 0, 5)
    assert ids.tolist() == [1, 2, 3, 4, 5] and set(scores.tolist()) == {4}
