"""The pipeline's stages against plain Python, on documents planted so that every stage has work."""

import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long, lost string, copies long, whole string"
SYLLABLES = {"en": "the and ing ion ter was her ofo thi wit", "fr": "que les des ent pas ous eur ais oui ver"}


def _prose(draw, lang, words):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(draw.choice(parts) for _ in range(draw.randint(1, 3))) for _ in range(words))


def _rows():
    draw = random.Random(11)
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "fr"
        text = "\n".join(_prose(draw, lang, 30) for _ in range(4))
        rows.append([i if i % 7 else None, text, lang, f"s{i % 4}"])
    rows[8][0] = rows[9][0]  # one id, two texts
    rows[20][1] = rows[21][1]  # an exact copy
    rows[30][1] += "\n" + rows[31][1].split("\n")[2].upper()  # a line that nearly repeats
    rows.append([900, None, "en", "s0"])
    rows.append([901, " \n ", None, None])
    rows.append([902, "@#$%^&*()0123456789@#$%^&*!!??<><>{}[]~~" * 30, None, "s0"])
    return [(i, t, lang, s, len(t or ""), "x", 5, "y") for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), DOCS)


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def _roots(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in links:
        root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


def _texts(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_languages(spark, docs):
    got = _texts(corpus_pipeline.keep_languages(spark, docs, ""))
    want = Counter((r[0], r[1]) for r in _rows() if r[1] and r[1].strip() and r[0] != 902)
    assert got == want


def test_lines(spark, docs):
    rows = sorted(((r[0] is not None, r[0] or 0, n), r[1]) for n, r in enumerate(_rows()) if r[1] is not None)
    places = [(n, line.strip(" ")) for (_, _, n), text in rows for line in text.split("\n") if line.strip(" ")]
    low = [{x.lower()[i : i + 5] for i in range(len(x) - 4)} for _, x in places]
    links = [(i, j) for i, j in itertools.combinations(range(len(low)), 2) if _jaccard(low[i], low[j]) >= 0.8]
    roots = _roots(len(low), links)
    got = Counter(line.strip(" ").lower() for t in corpus_pipeline.drop_lines(spark, docs, "").collect() if t.text for line in t.text.split("\n") if line.strip(" "))
    assert sum(got.values()) == len(set(roots))
    groups = defaultdict(set)
    for r, (_, line) in zip(roots, places, strict=True):
        groups[r].add(line.lower())
    assert all(sum(got[x] for x in group) == 1 for group in groups.values())


def test_near_copies(spark, docs):
    rows = _rows()
    words = [(r[1] or "").lower().split() for r in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set() for w in words]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and _jaccard(sets[i], sets[j]) >= 0.8]
    roots = _roots(len(rows), links)
    groups = defaultdict(list)
    for i, root in enumerate(roots):
        groups[root].append(rows[i])
    want = Counter()
    for group in groups.values():
        best = min(group, key=lambda r: (r[0] is None, r[0] or 0))
        want[best[0], best[1]] += 1
    assert _texts(corpus_pipeline.drop_near_copies(spark, docs, "")) == want


def test_mixing(spark, docs):
    got = _texts(corpus_pipeline.mix_sources(spark, docs, ""))
    sizes = defaultdict(int)
    for r in _rows():
        sizes[r[3]] += len((r[1] or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets, level = {}, 0.0
    while True:  # the excess of capped sources goes to the others by weight
        open_ = [s for s in order if s not in targets]
        left = 1.5 * sum(sizes.values()) - sum(targets.values())
        level = left / max(sum((3, 1, 2)[order.index(s) % 3] for s in open_), 1)
        full = [s for s in open_ if (3, 1, 2)[order.index(s) % 3] * level >= 2 * sizes[s]]
        targets |= {s: 2.0 * sizes[s] for s in full}
        if not full:
            targets |= {s: (3, 1, 2)[order.index(s) % 3] * level for s in open_}
            break
    source = {(r[0], r[1]): r[3] for r in _rows()}
    taken = defaultdict(int)
    for (i, text), n in got.items():
        rate = targets[source[i, text]] / max(sizes[source[i, text]], 1)
        assert n <= 2 and int(rate) <= n <= int(rate) + 1
        taken[source[i, text]] += n * len((text or "").split())
    assert all(abs(taken[s] - t) <= 240 for s, t in targets.items())


def test_columns_and_rerun(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
        assert stage(spark, docs.limit(0), "").count() == 0


def test_odd_columns(spark, docs):
    """Names with dots and backticks, map columns and columns that hold them go through every stage."""
    odd = docs.withColumns({"n": F.struct(F.create_map(F.lit("k"), "doc_id").alias("m"))}).withColumn("tags", F.create_map(F.lit("a"), "source")).withColumnRenamed("whole", "a.b").withColumnRenamed("lost", "c`d.e")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, "")
        assert out.columns == odd.columns
        plain = stage(spark, docs, "")
        assert out.select("doc_id", "text").distinct().count() == plain.select("doc_id", "text").distinct().count() or stage is corpus_pipeline.mix_sources
        assert out.select("`a.b`", "`c``d.e`", "tags", "n.m").count() == out.count() > 0
