"""Near-duplicate documents: MinHash, banding, signature check, exact check, components.

The job runs in these steps, each a distributed DataFrame step.

1. Every document becomes a set of hashed word shingles, many universal hash minima of it, and
   one key for each band of minima. Documents with equal sets form one class (exact copies), known
   by a digest of its set and numbered.
2. Classes that share a band key are candidates. Each bucket links its members to its smallest
   member, a star, so a bucket of m members gives m - 1 candidate pairs.
3. A pair passes when the signatures agree well enough, and then when the full sets do. Passing
   pairs are links; their components are found by large-star and small-star.
4. A star can miss a link between two members that both differ from the centre. So each candidate
   family that still holds several components is checked in tiles: members outside the largest
   component against all members, by exact intersection counts. Only spanning links leave a tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.components import connected_components
from vellum.llm.tables import discard, likely_ids, written

BANDS, ROWS = 25, 5
#: Shingles of one side of a tile; a longer single document is a side of its own.
TILE_SHINGLES = 200_000
#: Bytes of sets that a batch passes on at once.
BATCH_BYTES = 1 << 24
#: Standard deviations by which a signature may fall short before its pair is dismissed.
SLACK = 7

_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a UTF-8 text, A-Z lower-cased.

    bytes.lower and bytes.split act on exactly A-Z and \\x20\\x09-\\x0D.
    """
    words = np.fromiter(map(xxhash.xxh64_intdigest, text.lower().split()), np.uint64) if text else np.empty(0, np.uint64)
    n = len(words)
    if n == 0:
        return words
    span = min(n, width)
    mixed = np.full(n - span + 1, span, np.uint64)
    for j in range(span):
        mixed = (mixed ^ words[j : n - span + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of the universal hashes (a x + b mod 2^32) of the folded shingle hashes."""
    folded = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    out = np.full(len(_MUL), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(folded), 4096):
        np.minimum(out, (folded[None, i : i + 4096] * _MUL[:, None] + _ADD[:, None]).min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> list[int]:
    raw = sig.tobytes()
    return [xxhash.xxh64_intdigest(raw[4 * ROWS * b : 4 * ROWS * (b + 1)], seed=b) - 2**63 for b in range(BANDS)]


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[bytes | None]:
    for x in batch.column(name).cast(pa.large_binary()):
        yield x.as_py()


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, bands = [], [], [], []
            for text in _texts(batch, "text"):
                s = shingle_set(text, width)
                n.append(len(s))
                high, low = _halves(s)
                d1.append(high)
                d2.append(low)
                bands.append(band_keys(signature(s)) if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                names=["id", "n", "d1", "d2", "bands"],
            )

    return run


def _halves(shingles: np.ndarray) -> tuple[int, int]:
    """A digest of a set, as two signed numbers."""
    h = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (h >> 64) - 2**63, (h & (2**64 - 1)) - 2**63


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for text in _texts(batch, "text"):
                s = shingle_set(text, width)
                rows.append((*_halves(s), s.tobytes(), signature(s).tobytes()))
                size += len(rows[-1][2])
                if size > BATCH_BYTES:
                    yield _rows(rows)
                    rows, size = [], 0
            yield _rows(rows)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["d1", "d2", "shingles", "sig"])


def _linked(n_common: int, n_a: int, n_b: int, percent: int) -> bool:
    return 100 * n_common >= percent * (n_a + n_b - n_common)


def _check(percent: int):
    least = percent / 100
    least -= SLACK * np.sqrt(least * (1 - least) / (BANDS * ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = []
            for i, (sa, sb, ga, gb) in enumerate(zip(*(batch.column(c) for c in ("set_a", "set_b", "sig_a", "sig_b")), strict=True)):
                agree = np.frombuffer(ga.as_py(), np.uint32) == np.frombuffer(gb.as_py(), np.uint32)
                if agree.mean() < least:
                    continue
                x, y = np.frombuffer(sa.as_py(), np.uint64), np.frombuffer(sb.as_py(), np.uint64)
                if _linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    return run


def spanning_links(left: list[np.ndarray], right: list[np.ndarray], groups_left, groups_right, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) by exact intersection counts, without those that join what is joined already."""
    if not left or not right:
        return []
    root: dict = {}

    def find(x):
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    sizes = np.array([len(s) for s in right])
    flat, owner = np.concatenate(right), np.repeat(np.arange(len(right)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    out = []
    for i, s in enumerate(left):
        lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
        many = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        common = np.bincount(owner[at], minlength=len(right))
        for j in np.flatnonzero(100 * common >= percent * (len(s) + sizes - common)):
            a, b = find(groups_left[i]), find(groups_right[j])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((i, int(j)))
    return out


def _tile(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        minor, every = pdf[pdf["minor"]], pdf[~pdf["minor"]]
        sets = [[np.frombuffer(x, np.uint64) for x in part["shingles"]] for part in (minor, every)]
        labels = minor["label"].tolist(), every["label"].tolist()
        found = spanning_links(*sets, *labels, percent)
        return pd.DataFrame({"a": [labels[0][i] for i, _ in found], "b": [labels[1][j] for _, j in found]}, dtype="int64")

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Group documents whose word-shingle sets have a Jaccard similarity of percent / 100 or more.

    Returns one row per input row: ``doc_id, n_shingles, component_id, kept``; component_id is the
    smallest id reachable by links, kept says whether it is the row's own. Documents of fewer than
    ``width`` words count as one shingle; null, empty and blank texts have none and link nothing.
    Rows that repeat an id are one node, which has the links of all their texts. A row without an id links nothing, has a null
    component_id and is kept. Other columns of ``docs`` are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketches = written(source.mapInArrow(_sketch(width), "id long, n long, d1 long, d2 long, bands array<long>"), "sketches")
    usable = sketches.where("n > 0 and id is not null")
    classes = usable.groupBy("d1", "d2").agg(F.min("id").alias("low"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    members = classes.select("id", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("top")).where("centre < top")
    star = members.join(buckets, "key").where("id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct()
    star = written(star, "star")

    candidates = star.select(F.col("a").alias("id")).union(star.select(F.col("b").alias("id"))).distinct()
    wanted = written(classes.select("id", "d1", "d2", "low").join(candidates, "id"), "candidates")
    texts = likely_ids(source, wanted.select(F.col("low").alias("id")).distinct()).select("text")
    made = texts.mapInArrow(_sets(width), "d1 long, d2 long, shingles binary, sig binary").where("length(shingles) > 0")
    sets = written(made.join(wanted.select("id", "d1", "d2"), ["d1", "d2"]).dropDuplicates(["id"]).select("id", "shingles", "sig"), "sets")
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"), F.col("sig").alias("sig_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"), F.col("sig").alias("sig_b"))
    links = written(star.join(left, "a").join(right, "b").mapInArrow(_check(percent), "a long, b long"), "links")

    labels = written(connected_components(links), "labels")
    families = connected_components(star)
    placed = families.withColumnRenamed("component", "family").join(labels.withColumnRenamed("component", "label"), "node", "left")
    placed = written(placed.select(F.col("node").alias("id"), "family", F.coalesce("label", "node").alias("label")), "placed")
    more = written(_links_in_tiles(placed, sets, percent), "more")
    joined = labels.select(F.col("node").alias("id"), "component")
    if not more.isEmpty():  # links between components of the stars' links
        wider = connected_components(more).select(F.col("node").alias("component"), F.col("component").alias("wider"))
        placed_all = placed.select("id", F.col("label").alias("component")).join(wider, "component", "left")
        joined = placed_all.select("id", F.coalesce("wider", "component").alias("component"))

    known = classes.select("id", "d1", "d2", "low").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    first = known.groupBy("component").agg(F.min("low").alias("first"))
    known = written(known.join(first, "component").select("d1", "d2", "first"), "known")
    found = sketches.where("n > 0 and id is not null").select("id", "n", "d1", "d2").join(known, ["d1", "d2"]).select("id", "n", "first")
    found = written(found.unionByName(sketches.where("not (n > 0 and id is not null)").select("id", "n", F.col("id").alias("first"))), "found")
    # an id whose rows are in several components joins them
    spans = found.where("id is not null").groupBy("id").agg(F.min("first").alias("b"), F.max("first").alias("top")).where("b < top").select("id", "b")
    bridges = written(found.join(spans, "id").select(F.col("first").alias("a"), "b"), "bridges")
    component = F.col("first")
    if not bridges.isEmpty():
        found = found.join(connected_components(bridges), F.col("first") == F.col("node"), "left")
        component = F.coalesce("component", "first")
    for t in (classes, star, wanted, sets, links, placed):
        discard(t)
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _links_in_tiles(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of labels that links join which the stars missed: families of several components, in tiles of bounded size."""
    sized = placed.join(sets.select("id", (F.length("shingles") / 8).cast("long").alias("n")), "id")
    parts = sized.groupBy("family", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    whole = parts.groupBy("family").agg(
        F.max(F.struct("rows", "label")).alias("largest"), F.sum("n").alias("n"), F.count("*").alias("labels")
    ).where("labels > 1")
    main = F.col("largest.label")
    minor = parts.join(whole.select("family", main.alias("main")), "family").where("label <> main").groupBy("family").agg(F.sum("n").alias("minor_n"))
    plan = whole.join(minor, "family").select(
        "family",
        main.alias("main"),
        F.ceil(F.col("minor_n") / TILE_SHINGLES).cast("int").alias("rows"),
        F.ceil(F.col("n") / TILE_SHINGLES).cast("int").alias("columns"),
    )
    rows = placed.join(plan, "family")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    minors = rows.where("label <> main").select(
        "id", "label", "family", F.lit(True).alias("minor"), F.pmod(F.xxhash64("id"), "rows").cast("int").alias("i"), upto(F.col("columns")).alias("j")
    )
    every = rows.select(
        "id", "label", "family", F.lit(False).alias("minor"), upto(F.col("rows")).alias("i"), F.pmod(F.xxhash64("id", F.lit(1)), "columns").cast("int").alias("j")
    )
    tiles = minors.unionByName(every).join(sets.select("id", "shingles"), "id")
    return tiles.groupBy("family", "i", "j").applyInPandas(_tile(percent), "a long, b long")
