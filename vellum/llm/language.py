"""Language identification by Bayesian fusion of text, declared language, address and host.

The text gives log-likelihoods under byte-trigram models, fitted on a bounded sample of the rows of
each declared language. Declarations that samples can't tell apart, such as misspelt ones, share a model: languages are taken by
their number of rows, and one is new if the halves of its texts are likelier under each other
than under any model so far. So the number of models is that of languages, however many labels there are. Every row's most likely language by text alone is then counted by host, by
address suffix and over all rows; the counts make a prior for each host, smoothed towards that of
its suffix, which is smoothed towards that of all rows. A declared language (a markup attribute or
a column) counts as one more observation of known reliability. Whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.tables import likely_ids, unused_names, written

BITS = 16
#: Training rows of a language at most, those with the smallest hashes. Up to 1000, partitions keep no
#: more of a language before the shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
TRAIN_ROWS = 1_000
#: Labels that are compared on the driver at once, and by how much the mean log-likelihood per trigram must
#: be higher under a label's own model for it to be a language of its own.
LABELS, DISTINCT = 48, 0.1
#: Trigrams overlap: a text counts as if it had at most so many independent ones.
MOST_EVIDENCE = 40.0
#: Bytes of text that go to Python at once: JVM and worker hold several copies of a batch.
BATCH_BYTES = 4 << 20
#: Probability that a declared language is right; weight of the wider prior, in rows.
RELIABILITY, SMOOTHING = 0.9, 20.0
#: A text whose mean log-likelihood per trigram is further below its language's than MARGIN and
#: SPREAD / sqrt(trigrams), three standard deviations of such a mean, isn't prose of that language;
#: nor is one with a lower posterior.
MARGIN, SPREAD, LEAST_POSTERIOR = 2.5, 9.0, 0.5


def _trigrams(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.uint32)
    code = (x[:-2] << np.uint32(16)) ^ (x[1:-1] << np.uint32(8)) ^ x[2:]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def _bytes(text: bytes | None) -> np.ndarray:
    """A text's UTF-8 bytes with A-Z lowered, a blank before and after."""
    return np.frombuffer(b" " + (text or b"").lower() + b" ", np.uint8)


def declared_language(lang: Column) -> Column:
    """The primary subtag of a declaration in lower case; null if blank."""
    tag = F.lower(F.trim(F.regexp_extract(lang.cast("string"), r"^\s*([^-_]*)", 1)))
    return F.when(tag != "", tag)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams of each label's texts, apart for the first and the second half of each text."""
    seen: dict[tuple, np.ndarray] = {}

    def rows():
        for (lang, half), have in seen.items():
            at = np.flatnonzero(have)
            columns = [pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), half), pa.int32()), pa.array(at, pa.int64()), pa.array(have[at], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "half", "feature", "n"])
        seen.clear()

    for batch in batches:
        for text, lang in zip(batch.column("text").cast(pa.large_binary()), batch.column("lang").to_pylist(), strict=True):
            raw = _bytes(text.as_py())
            for half, part in enumerate(np.array_split(raw, 2)):
                have = seen.setdefault((lang, half), np.zeros(1 << BITS, np.int64))
                have += np.bincount(_trigrams(part), minlength=1 << BITS)
            if len(seen) > 2 * LABELS:
                yield from rows()
    yield from rows()


def _log(counts: np.ndarray) -> np.ndarray:
    return np.log((counts + 0.5) / (counts.sum(axis=-1, keepdims=True) + 0.5 * (1 << BITS)))


class Model:
    """Trigram log-probabilities by language, and each language's usual mean of them; ``labels`` has
    ``label, declared``: the place of the language that a declaration stands for, by default its own name's."""

    def __init__(self, languages: list[str], table: np.ndarray, labels: DataFrame | None = None):
        order = np.argsort(languages)
        self.languages, self.labels = [languages[i] for i in order], labels
        self.log = _log(table[order]).astype(np.float32)  # languages x features
        share = table[order] / np.maximum(table[order].sum(axis=1, keepdims=True), 1)
        self.usual = (share * self.log).sum(axis=1)


def gains(own: np.ndarray, tables: list[np.ndarray]) -> list[float]:
    """By how much the halves of a sample are likelier under each other than under each table of counts.

    Of a sample of the same language as a table the gain is negative or about 0, however few texts it
    has; of four languages' samples, even of one text, it was 0.8 or more under another's table.
    ``own`` has the counts of both halves; the result is a mean log-likelihood per trigram. A half
    without trigrams tells nothing: no gain.
    """
    if not own.sum(axis=1).all():
        return [0.0] * len(tables)
    logs = _log(own)
    mine = [(own[1 - k] * logs[k]).sum() for k in (0, 1)]
    return [float(sum(mine) - (own * _log(t)).sum()) / float(own.sum()) for t in tables]


def train(rows: DataFrame) -> Model:
    """Fit on ``id, text, lang``; the sample holds TRAIN_ROWS rows of each declared language at most.

    Labels are taken LABELS at a time, those of the most rows first. The driver holds the counts of so
    many labels and of the languages found; all other labels are compared with these languages by a
    grouped aggregation, and those that are unlike all go on to the next turn.
    """
    known = rows.select(declared_language(F.col("lang")).alias("lang"), "text", F.xxhash64("id", "text").alias("at")).where("lang is not null and trim(text) <> ''")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("at"))
    sample = written(known.select("lang", "at").withColumn("nth", nth).where(F.col("nth") <= TRAIN_ROWS).select("lang", "at").distinct(), "sample")
    texts = likely_ids(known, sample, "at").join(sample, ["lang", "at"]).dropDuplicates(["lang", "at"]).select("text", "lang")
    found = texts.mapInArrow(_counts, "lang string, half int, feature long, n long").groupBy("lang", "half", "feature").agg(F.sum("n").alias("n"))
    counts = written(found, "trigrams")
    left = written(known.groupBy("lang").agg(F.count("*").alias("rows")), "labels")
    languages, tables, labels = [], [], None
    while True:
        some = [r["lang"] for r in left.orderBy(F.desc("rows"), "lang").limit(LABELS).collect()]
        if not some:
            break
        turn = counts.where(F.col("lang").isin(some)).toPandas()  # LABELS labels of 2 ** BITS features
        own = np.zeros((len(some), 2, 1 << BITS))
        own[turn["lang"].map({x: i for i, x in enumerate(some)}), turn["half"].to_numpy(int), turn["feature"].to_numpy(int)] = turn["n"]
        placed = []
        for label, both in zip(some, own, strict=True):
            gain = gains(both, tables)
            if not gain or min(gain) > DISTINCT:
                placed.append((label, label))
                languages.append(label)
                tables.append(both.sum(axis=0))
            else:
                placed.append((label, languages[int(np.argmin(gain))]))
        spark = rows.sparkSession
        named = spark.createDataFrame(placed, "label string, language string")
        left = left.join(F.broadcast(named.select(F.col("label").alias("lang"))), "lang", "left_anti")
        alike = written(_alike(counts, left, languages, tables), "alike")
        labels = named if labels is None else labels.unionByName(named)
        labels = labels.unionByName(alike)
        left = written(left.join(alike.select(F.col("label").alias("lang")), "lang", "left_anti"), "labels")
    if not languages:
        return Model(["und"], np.zeros((1, 1 << BITS)))
    at = F.array_position(F.array(*map(F.lit, sorted(languages))), F.col("language")).cast("int") - 1
    return Model(languages, np.array(tables), written(labels.select("label", at.alias("declared")), "labels"))


def _alike(counts: DataFrame, left: DataFrame, languages: list[str], tables: list[np.ndarray]) -> DataFrame:
    """``label, language``: those of the labels left that :func:`gains` places with a language."""
    rows = counts.join(left.select("lang"), "lang").groupBy("lang", "feature").agg(*(F.sum(F.when(F.col("half") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1)))
    size = float(1 << BITS)
    totals = rows.groupBy("lang").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
    logs = _log(np.array(tables)).T

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = sum(batch.column(c).to_numpy().astype(float) for c in ("n0", "n1"))
            sums = logs[batch.column("feature").to_numpy()] * n[:, None]
            label = batch.column("lang").to_pandas()
            for lang, at in label.groupby(label).indices.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(languages), pa.string()), pa.array(range(len(languages)), pa.int32()), pa.array(sums[at].sum(axis=0))], names=["lang", "i", "s"])

    under = rows.mapInArrow(likely, "lang string, i int, s double").groupBy("lang", "i").agg(F.sum("s").alias("s"))
    best = under.groupBy("lang").agg(F.max(F.struct("s", (-F.col("i")).alias("i"))).alias("best"))
    log = lambda n, t: F.log((F.col(n) + 0.5) / (F.col(t) + 0.5 * size))
    mine = rows.join(totals, "lang").groupBy("lang", "t0", "t1").agg(F.sum(F.col("n1") * log("n0", "t0") + F.col("n0") * log("n1", "t1")).alias("mine"))
    gain = F.when((F.col("t0") > 0) & (F.col("t1") > 0), (F.col("mine") - F.col("best.s")) / (F.col("t0") + F.col("t1"))).otherwise(0.0)
    language = F.element_at(F.array(*map(F.lit, languages)), 1 - F.col("best.i"))
    return mine.join(best, "lang").where(gain <= DISTINCT).select(F.col("lang").alias("label"), language.alias("language"))


def _likelihoods(model: Model):
    """A text column's ``n`` trigrams and their log-likelihood under each language. Python gets the texts alone."""
    tables = model.log  # not the labels, which are a DataFrame
    kind = T.StructType().add("n", "long").add("sums", T.ArrayType(T.DoubleType()))

    def run(texts: pa.Array) -> pa.Array:
        sizes, sums = [], []
        for text in texts.cast(pa.large_binary()):
            raw = text.as_py()
            codes = _trigrams(_bytes(raw))
            blank = raw is None or not raw.strip()
            sizes.append(0 if blank else len(codes))
            sums.append([0.0] * len(tables) if blank else [float(t[codes].sum()) for t in tables])
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(sums, pa.list_(pa.float64()))], names=["n", "sums"])

    return F.arrow_udf(run, kind)


def _best(scores: Column) -> Column:
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def _votes(rows: DataFrame, key: str, size: int) -> DataFrame:
    counts = [F.count_if(F.col("vote") == i) for i in range(size)]
    return rows.where(F.col(key).isNotNull() & F.col("vote").isNotNull()).groupBy(key).agg(F.array(*counts).alias(f"{key}_votes"))


def _smoothed(votes: str, wider: Column) -> Column:
    total = F.aggregate(votes, F.lit(0.0), lambda a, v: a + v)
    mixed = F.zip_with(votes, wider, lambda v, w: (v + SMOOTHING * w) / (total + SMOOTHING))
    return F.when(F.col(votes).isNull(), wider).otherwise(mixed)


def identify(rows: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Language of every row of ``id, text, lang`` (declared), ``host``, ``suffix``.

    Returns ``id``, the columns in ``keep``, ``language``, ``posterior`` and ``accepted``. A row is
    accepted if its posterior reaches LEAST_POSTERIOR and its text looks like prose of that
    language. Null, empty and blank texts have no evidence of their own: their language is that of
    the declaration and the prior, and they aren't accepted. Unknown or missing declarations, hosts
    and suffixes leave the next wider prior. Ties go to the first language in code-point order.
    Rows may repeat; each gets a result. A declaration counts by its part before the first - or _.
    """
    keep, size = keep or [], len(model.languages)
    label, found = unused_names(rows, "label", "found")
    source = rows.select("id", *keep, declared_language(F.col("lang")).alias(label), "host", "suffix", F.col("text").cast("string").alias("text"))
    scored = source.withColumn(found, _likelihoods(model)("text")).select(*(c for c in source.columns if c != "text"), f"{found}.n", f"{found}.sums")
    scored = written(scored.withColumn("vote", F.when(F.col("n") > 0, _best(F.col("sums")))), "likelihoods", BATCH_BYTES)
    labels = model.labels
    if labels is None:
        labels = rows.sparkSession.createDataFrame(list(zip(model.languages, range(size), strict=True)), "label string, declared int")
    told = labels.select(F.col("label").alias("told"), "declared")
    spread = F.coalesce(F.col(label), F.concat(F.lit("\u0000"), F.pmod(F.xxhash64("id", "n", "sums"), F.lit(1 << 20)).cast("string")))

    every = scored.agg(*(F.count_if(F.col("vote") == i).alias(f"n{i}") for i in range(size))).first()
    total = sum(every) + size
    wide = F.array(*(F.lit((n + 1) / total) for n in every))
    joined = scored.join(told, spread == F.col("told"), "left")
    for key in ("suffix", "host"):  # rows without a key are spread, and match nothing
        votes = _votes(scored, key, size).withColumnRenamed(key, "at")
        place = F.coalesce(key, F.concat(F.lit("\u0000"), F.pmod(F.xxhash64("id", "n", "sums"), F.lit(1 << 20)).cast("string")))
        joined = joined.withColumn("place", place).join(votes, F.col("place") == F.col("at"), "left").drop("place", "at")
    prior = _smoothed("host_votes", _smoothed("suffix_votes", wide))
    scale = F.when(F.col("n") > 0, F.least(F.lit(1.0), F.lit(MOST_EVIDENCE) / F.col("n"))).otherwise(0.0)
    other = (1 - RELIABILITY) / max(size - 1, 1)
    told = F.array(*(F.when(F.col("declared").isNull(), 0.0).when(F.col("declared") == i, F.lit(float(np.log(RELIABILITY)))).otherwise(F.lit(float(np.log(other)))) for i in range(size)))
    logs = F.zip_with(F.zip_with("sums", prior, lambda s, p: s * F.col("scale") + F.log(p)), told, lambda a, b: a + b)
    out = joined.withColumn("scale", scale).withColumn("logs", logs).withColumn("best", _best(F.col("logs")))
    posterior = 1 / F.aggregate("logs", F.lit(0.0), lambda a, v: a + F.exp(v - F.array_max("logs")))
    at = F.col("best") + 1
    usual = F.element_at(F.array(*(F.lit(float(u)) for u in model.usual)), at)
    fits = F.element_at("sums", at) / F.greatest("n", F.lit(1)) >= usual - MARGIN - SPREAD / F.sqrt(F.greatest("n", F.lit(1)))
    out = out.withColumn("posterior", posterior).withColumn("language", F.element_at(F.array(*map(F.lit, model.languages)), at))
    return out.select("id", *keep, "language", "posterior", ((F.col("n") > 0) & (F.col("posterior") >= LEAST_POSTERIOR) & fits).alias("accepted"))


def document_rows(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Documents as input of :func:`identify`: their lang is declared, their source is a host."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), *(keep or []), "text", "lang", F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages as input of :func:`identify`: text without markup, html lang, host and its suffix."""
    declared = F.regexp_extract(F.col("html"), r"(?is)<html[^>]*?\slang\s*=\s*[\"']?([a-z]+)", 1)
    body = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    host = F.lower(F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", host)
    return pages.select(F.col("page_id").cast("long").alias("id"), body.alias("text"), F.when(declared != "", declared).alias("lang"), host.alias("host"), F.substring_index(host, ".", -1).alias("suffix"))
