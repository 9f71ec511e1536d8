"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Texts are UTF-8 bytes between blanks, A-Z lower-cased; features are the hashed byte n-grams that
occur in a text. Documents with and without the label are counted for every feature by a grouped
aggregation over all training rows. The features whose log-count ratio stands out most from chance
are kept, a bounded number of them, so the model has a fixed size. The weights of a logistic
regression on the presence of a feature times its ratio are fitted on a bounded number of training
rows, those with the smallest hashes of their ids. Scoring reads whole texts and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.tables import likely_ids, written

#: Bits of a hashed n-gram; n-grams have 4, 6 and 8 bytes.
BITS = 20
#: Defaults of the features in the model and of the labelled rows that its weights are fitted on.
FEATURES, TRAIN_ROWS = 4_096, 16_000
#: Added to counts; least documents of a feature; strength of the penalty; steps of the fit.
ALPHA, LEAST_DOCS, PENALTY, STEPS = 1.0, 3, 2e-4, 200


def codes(text: bytes | None) -> np.ndarray:
    """Hashes of the n-grams of a text, one for each place and size.

    The four bytes from a place make a number; two such numbers, two or four places apart, tell
    longer n-grams apart.
    """
    raw = b" " + (text or b"").lower() + b"  "
    if len(raw) < 4:
        return np.empty(0, np.uint32)
    four = np.ndarray(len(raw) - 3, "<u4", raw, 0, (1,))
    low, high = four * np.uint32(0x9E3779B1), four * np.uint32(0x85EBCA6B)
    high ^= high >> np.uint32(15)
    found = [low]
    for ahead, salt in ((2, 0xC2B2AE35), (4, 0x27D4EB2F)):
        found.append((low[:-ahead] ^ high[ahead:]) * np.uint32(salt))
    out = np.concatenate(found)
    out ^= out >> np.uint32(13)
    out *= np.uint32(0x9E3779B1)
    return out >> np.uint32(32 - BITS)


def distinct(found: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hashes without repeats, in no order; ``last`` is room for a place of every hash."""
    at = np.arange(len(found), dtype=last.dtype)
    last[found] = at
    return found[last[found] == at]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, last = np.zeros((2, 1 << BITS), np.int64), np.zeros(1 << BITS, np.int32)
    for batch in batches:
        for text, label in zip(batch.column("text").cast(pa.large_binary()), batch.column("label").to_pylist(), strict=True):
            seen[label, distinct(codes(text.as_py()), last)] += 1
    at = np.flatnonzero(seen.sum(axis=0))
    for lo in range(0, len(at), 50_000):
        part = at[lo : lo + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(seen[0, part]), pa.array(seen[1, part])], names=["feature", "n0", "n1"])


class Places:
    """Which of the chosen features a text has, by their places among them."""

    def __init__(self, chosen: np.ndarray):
        self.place = np.full(1 << BITS, -1, np.int32)
        self.place[chosen] = np.arange(len(chosen))
        self.hit = np.zeros(len(chosen), bool)

    def of(self, text: bytes | None) -> np.ndarray:
        at = self.place[codes(text)]
        self.hit[:] = False
        self.hit[at[at >= 0]] = True
        return np.flatnonzero(self.hit)


def _present(chosen: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(chosen)
        for batch in batches:
            found = [places.of(t.as_py()).tolist() for t in batch.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.int32()))], names=["label", "found"])

    return run


def fit_logistic(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights (times ``scale``) and bias of a penalised logistic regression on sparse presence."""
    weights, bias = np.zeros(len(scale)), 0.0
    if not len(labels) or labels.min() == labels.max():
        return weights, float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    sizes = np.array([len(r) for r in rows])
    columns, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes)
    value = scale[columns]
    step = np.zeros((2, len(scale) + 1))
    for t in range(1, steps + 1):
        z = np.bincount(owner, weights=value * weights[columns], minlength=len(rows)) + bias
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        slope = np.bincount(columns, weights=value * error[owner], minlength=len(scale)) / len(rows) + PENALTY * weights
        slope = np.append(slope, error.mean())
        step[0] = 0.9 * step[0] + 0.1 * slope
        step[1] = 0.99 * step[1] + 0.01 * slope**2
        move = 0.1 * (step[0] / (1 - 0.9**t)) / (np.sqrt(step[1] / (1 - 0.99**t)) + 1e-8)
        weights -= move[:-1]
        bias -= move[-1]
    return weights * scale, float(bias)


def _fit(scale: np.ndarray):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(key=pdf["found"].map(tuple)).sort_values(["label", "key"], kind="stable")
        rows = [np.asarray(x, np.int64) for x in pdf["found"]]
        weights, bias = fit_logistic(rows, pdf["label"].to_numpy(np.float64), scale)
        return pd.DataFrame({"place": np.arange(-1, len(weights)), "weight": np.concatenate([[bias], weights])})

    return run


def _score(chosen: np.ndarray, weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(chosen)
        for batch in batches:
            z = np.array([bias + weights[places.of(t.as_py())].sum() for t in batch.column("text").cast(pa.large_binary())])
            score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64())], names=["doc_id", "held_out", "score"])

    return run


def feature_counts(rows: DataFrame) -> DataFrame:
    """``feature, n0, n1``: rows of ``text, label`` without and with the label that have a feature."""
    return rows.select("text", "label").mapInArrow(_count, "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def log_ratios(counts: DataFrame, total: dict[int, int]) -> DataFrame:
    """``feature, ratio, z`` of features in LEAST_DOCS rows or more; ``total`` has the rows by label."""
    rate = lambda n, label: F.log((F.col(n) + ALPHA) / (total.get(label, 0) + 2 * ALPHA))
    ratio = rate("n1", 1) - rate("n0", 0)
    spread = F.sqrt(1 / (F.col("n0") + ALPHA) + 1 / (F.col("n1") + ALPHA))
    return counts.where(F.col("n0") + F.col("n1") >= LEAST_DOCS).select("feature", ratio.alias("ratio"), (F.abs(ratio) / spread).alias("z"))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, features: int = FEATURES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Score every document of ``docs`` after fitting on the labelled ones outside the held-out fold.

    Held out are rows with crc32(doc_id as text) mod ``folds`` = 0. Counts cover all other labelled
    rows; the weights of at most ``features`` features, ties to the smaller hash, are fitted on at
    most ``train_rows`` of them. Returns ``doc_id, held_out, score, predicted`` for every row. Null
    and empty texts get the score of no features. Rows without a doc_id have no label and aren't held
    out. Labels other than 0 and 1 are ignored; a doc with several labels trains with each, a label without a document with none. Without
    labels of both kinds all scores are alike.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out"))
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("label in (0, 1)").distinct()
    marked = written(marked, "labels")
    train = lambda ids: likely_ids(source.where("not held_out"), ids, "doc_id").join(marked, "doc_id").select("doc_id", "text", "label")
    counts = feature_counts(train(marked))
    rows = written(source.where("not held_out").select("doc_id").join(marked, "doc_id"), "rows")  # labels without a document say nothing
    total = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    best = log_ratios(counts, total).orderBy(F.desc("z"), "feature").limit(features).select("feature", "ratio").toPandas().sort_values("feature")
    chosen, scale = best["feature"].to_numpy(np.int64), best["ratio"].to_numpy()
    sample = written(rows.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows), "sample")
    chosen_rows = train(sample).join(sample.select("doc_id").distinct(), "doc_id", "left_semi")
    found = chosen_rows.select("text", "label").mapInArrow(_present(chosen), "label int, found array<int>")
    model = found.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_fit(scale), "place int, weight double").toPandas().sort_values("place")
    bias, weights = (float(model["weight"].iloc[0]), model["weight"].to_numpy()[1:]) if len(model) else (0.0, np.zeros(len(chosen)))
    scored = source.mapInArrow(_score(chosen, weights, bias), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
