"""Rows without ids, and rows that share one, through the stages of the pipeline."""

from collections import Counter

import corpus_pipeline
from vellum.llm import lines, mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "amber birch cedar delta ember fjord grove heron inlet jetty knoll lotus maple north ocean pearl quartz river stone thorn umbra vapor willow xenon yield zephyr".split()


def _line(i):
    """Lines of words in an order of their own, unlike each other."""
    return " ".join(f"{w}{(i * 7919 + k * 104729) % 9973}" for k, w in enumerate(WORDS[i % 5 :: 2]))


def _docs(spark, texts):
    return spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in texts], DOCS)


def test_lines_of_rows_without_ids(spark):
    shared, first, second, third = _line(0), _line(1), _line(2), _line(3)
    rows = [(1, shared), (None, f"{shared}\n{first}"), (None, f"{second}\n{shared}"), (5, f"{third}\n{shared}"), (5, f"{shared}\n{_line(4)}")]
    got = {r.text for r in lines.drop_repeated_lines(_docs(spark, rows)).collect()}
    assert got == {shared, first, second, third, _line(4)}


def test_near_lines_that_only_rows_without_ids_have(spark):
    rows = [(None, _line(1) + "\n" + _line(2)), (None, _line(3) + "\n" + _line(1) + "x")]
    left = "\n".join(r.text for r in lines.drop_repeated_lines(_docs(spark, rows)).collect()).split("\n")
    assert len(left) == 3 and {_line(2), _line(3)} < set(left)


def test_mix_takes_rows_without_ids(spark):
    rows = [(None, f"w{i} " * 40) for i in range(700)] + [(None, "same text here " * 20)] * 40 + [(9, f"v{i} " * 30) for i in range(60)]
    docs = _docs(spark, rows)
    mixed = mixing.mixed_rows(docs).collect()
    assert len(mixed) == len(rows)
    taken = {r.row: 0 for r in mixed}
    for r in mixed:
        taken[r.row] += r.copies
    by_text = {r.text: taken[r.row] for r in docs.select("text", mixing.row_hash(docs).alias("row")).collect()}
    got = Counter(r.text for r in corpus_pipeline.mix_sources(spark, docs, "").collect())
    assert got == Counter({t: n for t, n in by_text.items() if n})
    assert abs(sum(r.taken for r in mixed) - mixed[0].target) <= 60


def test_each_stage_keeps_rows_without_ids(spark):
    rows = [(i if i % 2 else None, "\n".join(_line(20 * i + k) for k in range(6))) for i in range(40)]
    docs = _docs(spark, rows)
    want = {t for d, t in rows if d is None}
    for _, stage in corpus_pipeline.STAGES[1:4]:
        kept = {r.text for r in stage(spark, docs, "").where("doc_id is null").collect()}
        assert kept == want
