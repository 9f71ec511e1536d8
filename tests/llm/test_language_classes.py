"""Rare languages, and more languages than 64, keep their class."""

from vellum.llm import language

ROW = "id long, text string, lang string, host string, suffix string"


def _text(k, n, i):
    """Prose in an alphabet that language k has for itself."""
    base = 0x4E00 + 40 * k
    return " ".join("".join(chr(base + (i * 31 + w * 17 + c * c * 7) % 40) for c in range(5)) for w in range(n))


def test_rare_languages(spark):
    """One language has most rows, 70 others two each; one of those has no ids."""
    rows = [(i, _text(0, 20, i), "hot", "h", None) for i in range(9000)]
    rows += [(None if k == 70 else 10**6 + 2 * k + i, _text(k, 30, i), f"l{k:02d}", "h", None) for k in range(1, 71) for i in range(2)]
    df = spark.createDataFrame(rows, ROW).repartition(4)
    model = language.train(df)
    assert model.languages == sorted({r[2] for r in rows})
    rare = language.identify(df.where("lang <> 'hot'"), model, ["lang"]).collect()
    assert len(rare) == 140 and all(r.language == r.lang and r.accepted for r in rare)
