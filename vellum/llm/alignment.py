"""Align two tokenizers' tokens of the same texts and count the id pairs that they link.

Tokens cover bytes. Offsets at which a token of either tokenizer ends cut a text into groups, and
every token of the first is linked with every token of the second in its group. The job's steps:

1. Texts are tokenized and aligned where they are read, many at once as array operations: running
   sums of token lengths are the ends, their intersection the cuts, a binary search in the cuts
   labels each token's group, and repeated indices make the links. A document keeps its distinct
   linked pairs and how often it holds each.
2. How many documents hold a pair is counted in two shuffles: by pair and a salt, then by pair.
   Tasks add up what they hold before the first one.
3. Counts go back to documents. The commonest pairs, HEAD at most by a histogram of the counts, are
   looked up where the documents are read; the others are joined, and there no pair is common.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.tables import discard, written

#: Bytes of text that a worker aligns at once; links expanded at once; segments and tokens that it keeps.
SLICE_BYTES, LINKS, KEPT_SEGMENTS, KEPT_TOKENS = 1 << 20, 1 << 21, 300_000, 1 << 22
#: Distinct pairs that a task holds before it passes them on; salts of a pair; commonest pairs looked up in memory.
HELD_PAIRS, SALTS, HEAD = 1 << 20, 16, 1 << 18

#: The characters that regular expressions of the first tokenizer take as white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Letters and the marks behind them where a segment may end.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ",.!?;:"


def byte_alphabet() -> dict[str, int]:
    """Characters of byte-level vocabularies and their bytes: printable Latin-1 stands for itself,
    the other bytes in turn for the characters from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, with the ids of each distinct segment: white space and a word, or the marks behind one.

    Neither tokenizer joins tokens over the ends of segments (the pieces are searched for those
    that would; texts with white space that occurs in them are one segment, marks that do end none), so a text's ids are its
    segments' ids in turn.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet, vocab = byte_alphabet(), self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        self.space, self.letter = self.b.piece_to_id("▁"), self.b.piece_to_id("▁x")
        marks = re.escape("".join(m for m in MARKS if not any(re.search(f"[{LETTERS}]{re.escape(m)}", p) for p in pieces)))
        short = f"[^{SPACES}{marks}]*[{LETTERS}](?=[{marks}])|" if marks else ""
        self.segment = re.compile(f"[{SPACES}]*(?:{short}[^{SPACES}]+)|[{SPACES}]+")
        largest = max(len(self.bytes_a), len(self.bytes_b))
        self.numbers = [f"{i}{end}" for i in range(largest) for end in ",|;\n"]  # an id and what stands behind it
        joined = [p for p in pieces if len(p) > 1 and re.search(f"[{SPACES}]", p) or re.search("[^▁]▁", p)]
        self.whole = re.compile(f"[{re.escape(''.join({c for p in joined for c in p if c.isspace()}))}]") if joined else None
        if any(re.search("[^▁]▁", p) for p in joined):
            self.whole = re.compile("")  # every text is one segment
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.ids: list[list] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)]]
        self.many: list[list] = [[], []]
        self.starts = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.good = np.empty(0, bool)
        self.written: list[str] = []

    def _encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids as inside a text, behind a space, which the second tokenizer adds itself, or another word."""
        a = [x.ids for x in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        b = self.b.encode([s[1:] if s[0] == " " else "x" + s for s in segments], num_threads=1)
        for i, s in enumerate(segments):
            if s == " ":
                b[i] = [self.space]
            elif s[0] != " ":
                b[i] = b[i][1:] if b[i][:1] == [self.letter] else []  # [] can't give the segment's bytes
        return a, b

    def learn(self, segments: list[str]) -> None:
        base = len(self.good)
        good = []
        for lo in range(0, len(segments), 4096):
            part = segments[lo : lo + 4096]
            ids, raw = self._encode(part), [s.encode() for s in part]
            sizes, right = np.fromiter(map(len, raw), np.int64, len(part)), np.ones(len(part), bool)
            for k, known in enumerate((self.bytes_a, self.bytes_b)):
                many = np.fromiter(map(len, ids[k]), np.int64, len(part))
                listed = list(chain.from_iterable(ids[k]))
                flat = np.array(listed, np.int64)
                self.ids[k].append(flat)
                self.many[k].append(many)
                parts = list(map(known.__getitem__, listed))
                ends = np.cumsum(many)
                own = np.diff(np.concatenate(([0], np.cumsum((self.size_a, self.size_b)[k][flat])))[ends], prepend=0)
                if (own != sizes).any() or b"".join(parts) != b"".join(raw):
                    right &= [b"".join(parts[hi - n : hi]) == r for n, hi, r in zip(many.tolist(), ends.tolist(), raw, strict=True)]
            good.append(right)
        self.at.update(zip(segments, range(base, base + len(segments)), strict=True))
        self.good = np.concatenate([self.good, *good])
        for k in (0, 1):
            self.ids[k] = [np.concatenate(self.ids[k])]
            self.starts[k] = np.concatenate([self.starts[k], self.starts[k][-1] + np.cumsum(np.concatenate(self.many[k]))])
            self.many[k] = []
        new = base + np.flatnonzero(self.good[base:])
        self.written += [""] * len(segments)
        if len(new):
            for i, text in zip(new.tolist(), self._write(new), strict=True):
                self.written[i] = text

    def _write(self, segments: np.ndarray) -> list[str]:
        """The groups of each segment in writing: a group's first ids, its second ones, the next group's."""
        a, b = self.tokens(segments, 0), self.tokens(segments, 1)
        label_a, label_b, cuts = groups(self.size_a[a], self.size_b[b])
        ends = self._ends(segments)
        label, side = np.concatenate([label_a, label_b]), np.repeat([0, 1], [len(a), len(b)])
        order = np.argsort(2 * label + side, kind="stable")
        ids, label, side = np.concatenate([a, b])[order], label[order], side[order]
        last = np.append(label[1:] != label[:-1], True)  # of its group
        behind = np.zeros(len(ids), np.int64)
        behind[:-1][(side[1:] == 1) & (side[:-1] == 0)] = 1
        behind[last] = 2
        behind[last & np.isin(cuts[label], ends)] = 3
        return "".join(map(self.numbers.__getitem__, (4 * ids + behind).tolist())).split("\n")[:-1]

    def _ends(self, segments: np.ndarray) -> np.ndarray:
        """Where the bytes of segments in turn end."""
        many = self.starts[0][segments + 1] - self.starts[0][segments]
        return np.cumsum(self.size_a[self.tokens(segments, 0)])[np.cumsum(many) - 1]

    def tokens(self, segments: np.ndarray, k: int) -> np.ndarray:
        """Ids of tokenizer k of learnt segments in turn."""
        many = self.starts[k][segments + 1] - self.starts[k][segments]
        upto = np.cumsum(many)
        return self.ids[k][0][np.repeat(self.starts[k][segments] - upto + many, many) + np.arange(upto[-1] if len(upto) else 0)]

    def segments(self, text: str) -> list[str]:
        return [text] if self.whole and self.whole.search(text) else self.segment.findall(text)

    def align(self, texts: list[bytes]) -> tuple[np.ndarray, list[str], tuple]:
        """Per text ``n_a, n_b, n_groups, n_links`` and the groups in writing; and the distinct
        linked pairs of all texts: text, a, b, how often."""
        if len(self.at) > KEPT_SEGMENTS or len(self.ids[0][0]) > KEPT_TOKENS:
            self.clear()
        split = []
        for t in texts:
            try:
                split.append(self.segments(" " + t.decode()) if t else [])
            except UnicodeDecodeError:
                split.append([])
        every = list(chain.from_iterable(split))
        new = list(dict.fromkeys(s for s in every if s not in self.at))
        if new:
            self.learn(new)
        at = np.fromiter(map(self.at.get, every, repeat(-1)), np.int64, len(every))
        text_of = np.repeat(np.arange(len(texts)), [len(s) for s in split])
        bad = np.zeros(len(texts), bool)
        bad[text_of[~self.good[at]]] = True
        at, text_of = at[~bad[text_of]], text_of[~bad[text_of]]
        bounds = np.searchsorted(text_of, np.arange(len(texts) + 1))
        names = [";".join(map(self.written.__getitem__, at[lo:hi].tolist())) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]

        many = [self.starts[k][at + 1] - self.starts[k][at] for k in (0, 1)]
        a, b = self.tokens(at, 0), self.tokens(at, 1)
        label_a, label_b, cuts = groups(self.size_a[a], self.size_b[b])
        in_a, in_b = (np.repeat(text_of, m) for m in many)
        count_a, count_b = np.bincount(label_a, minlength=len(cuts)), np.bincount(label_b, minlength=len(cuts))
        owner = np.zeros(len(cuts), np.int64)
        owner[label_a] = in_a
        numbers = np.zeros((len(texts), 4), np.int64)
        numbers[:, 0], numbers[:, 1], numbers[:, 2] = (np.bincount(x, minlength=len(texts)) for x in (in_a, in_b, owner))
        np.add.at(numbers[:, 3], owner, count_a * count_b)
        return numbers, names, self._pairs(owner, label_a, a, label_b, b)

    def _pairs(self, owner: np.ndarray, label_a, a, label_b, b) -> tuple:
        """Distinct linked pairs of each text, from each group's distinct ids of either side."""
        wide_a, wide_b = len(self.size_a), len(self.size_b)
        key_a, times_a = np.unique(label_a * wide_a + a, return_counts=True)
        key_b, times_b = np.unique(label_b * wide_b + b, return_counts=True)
        group_a, a, b = key_a // wide_a, key_a % wide_a, key_b % wide_b
        first = np.searchsorted(key_b // wide_b, np.arange(len(owner) + 1))
        wide = np.diff(first)[group_a]  # links of each entry of a
        upto = np.cumsum(wide)
        keys, times = [], []
        lo = 0
        while lo < len(a):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + LINKS, "right")))
            w = wide[lo:hi]
            left = np.repeat(np.arange(lo, hi), w)
            right = np.repeat(first[group_a[lo:hi]] - (np.cumsum(w) - w), w) + np.arange(w.sum())
            key, which = np.unique((owner[group_a[left]] * wide_a + a[left]) * wide_b + b[right], return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, which, times_a[left] * times_b[right])
            keys.append(key)
            times.append(total)
            lo = hi
        if not keys:
            return (np.empty(0, np.int64),) * 4
        key, total = keys[0], times[0]
        if len(keys) > 1:
            key, which = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, which, np.concatenate(times))
        return key // (wide_a * wide_b), key // wide_b % wide_a, key % wide_b, total


def groups(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's group, and the offsets at which groups end; both sides cover the same bytes."""
    ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b), cuts


_pairs: dict[tuple[str, str], Pair] = {}  # of this worker, by paths
_ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, times array<long>"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
            ids.append(i)
            texts.append(t.as_py() or b"")
            size += len(texts[-1])
            if size >= SLICE_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _align(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _pairs.get((path_a, path_b)) or _pairs.setdefault((path_a, path_b), Pair(path_a, path_b))
        row = TaskContext.get().partitionId() << 40
        for ids, texts in _slices(batches):
            numbers, names, (text, a, b, times) = both.align(texts)
            offsets = pa.array(np.searchsorted(text, np.arange(len(ids) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((a, pa.int32()), (b, pa.int32()), (times, pa.int64()))]
            digests = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in names]
            columns = [pa.array(range(row, row + len(ids)), pa.int64()), pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in numbers.T), pa.array(digests, pa.string()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _ALIGNED.split(", ")])
            row += len(ids)

    return run


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """One row per document: its numbers of tokens, groups and links, the hash of its groups, and its
    distinct linked pairs as the arrays ``a, b, times``. ``row`` tells rows apart, also those
    without an id or with the same one, once the result is written."""
    paths = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_align(*paths), _ALIGNED)


def _numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the batch, pair as one number, and how often, of all links of a batch."""
    lists = [batch.column(c) for c in ("a", "b", "times")]
    a, b, times = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
    return np.repeat(np.arange(len(batch)), np.diff(lists[0].offsets.to_numpy())), a << 32 | b, times


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each pair, added up in parts of HELD_PAIRS pairs or little more."""
    salt = TaskContext.get().partitionId() % SALTS

    def merged(parts):
        key, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return key, np.bincount(which, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

    def rows(key, n):
        for lo in range(0, len(key), 50_000):
            k = key[lo : lo + 50_000]
            columns = [pa.array(k >> 32, pa.int32()), pa.array(k & 0xFFFFFFFF, pa.int32()), pa.array(np.full(len(k), salt), pa.int32()), pa.array(n[lo : lo + 50_000], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "salt", "n"])

    parts, size = [], 0
    for batch in batches:
        for lo in range(0, len(batch), 256):
            parts.append(np.unique(_numbers(batch.slice(lo, 256))[1], return_counts=True))
            size += len(parts[-1][0])
            if size > 2 * HELD_PAIRS:
                parts = [merged(parts)]
                if len(parts[0][0]) > HELD_PAIRS:
                    yield from rows(*parts.pop())
                size = len(parts[0][0]) if parts else 0
    if parts:
        yield from rows(*merged(parts))


def pair_counts(documents: DataFrame) -> DataFrame:
    """``a, b, count, best`` of :func:`aligned` documents: how many hold the pair linked, and whether
    no pair of the same a is held by more."""
    held = documents.select("a", "b", "times").mapInArrow(_held, "a int, b int, salt int, n long")
    salted = held.groupBy("a", "b", "salt").agg(F.sum("n").alias("n"))
    counts = written(salted.groupBy("a", "b").agg(F.sum("n").alias("count")), "counts")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def _score(keys: np.ndarray, counts: np.ndarray, best: np.ndarray):
    """Adds up the counts of the pairs in ``keys``, which ascend, and passes on all other pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 256):
                batch = whole.slice(lo, 256)
                row, pair, times = _numbers(batch)
                at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
                known = keys[at] == pair
                sums = np.zeros((2, len(batch)), np.int64)
                np.add.at(sums[0], row[known], times[known] * best[at[known]])
                np.add.at(sums[1], row[known], times[known] * counts[at[known]])
                offsets = pa.array(np.searchsorted(row[~known], np.arange(len(batch) + 1)), pa.int32())
                rest = [pa.ListArray.from_arrays(offsets, pa.array(x[~known], t)) for x, t in ((pair >> 32, pa.int32()), (pair & 0xFFFFFFFF, pa.int32()), (times, pa.int64()))]
                plain = [batch.column(c) for c in _PLAIN]
                yield pa.RecordBatch.from_arrays([*plain, *(pa.array(x, pa.int64()) for x in sums), *rest], names=[*_PLAIN, "n_best", "count_sum", "a", "b", "times"])

    return run


_PLAIN = ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")


def common_pairs(counts: DataFrame, most: int = HEAD) -> tuple[DataFrame, float]:
    """The pairs of the highest counts, ``most`` of them or fewer, and the least count among them.

    Counts fall into classes an eighth of a power of two wide; whole classes are taken.
    """
    width = F.floor(F.log2("count") * 8).cast("int")
    sizes = {r.k: r.n for r in counts.groupBy(width.alias("k")).agg(F.count("*").alias("n")).collect()}  # 512 rows at most
    total, least = 0, None
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > most:
            break
        least = k
    return (counts.where(width >= least) if least is not None else counts.where(F.lit(False))), least


def alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, head: int = HEAD) -> DataFrame:
    """Token groups and linked pairs of two tokenizers, per document, with corpus-wide counts.

    Returns one row per input row: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256``. The first tokenizer (a byte-level one) reads a space and the text, the second
    (of pieces) the text, to which it adds the space; strings of special tokens are plain text. Rows whose text is
    null, empty, not UTF-8 or not given back byte for byte by either have no tokens: zeros and ''. Rows that
    repeat an id, or have none, are documents of their own. An empty table gives no rows. Other
    columns are ignored. Equal texts count as often as they come.
    """
    documents = written(aligned(docs, path_a, path_b), "aligned")
    counts = written(pair_counts(documents), "pairs")
    common, _ = common_pairs(counts, head)
    known = common.select("a", "b", "count", "best").toArrow()  # ``head`` rows at most
    a, b, count = (known.column(c).to_numpy().astype(np.int64) for c in ("a", "b", "count"))
    best = known.column("best").to_numpy(zero_copy_only=False).astype(np.int64)
    key = a << 32 | b
    order = np.argsort(key)
    key, count, best = (x[order] if len(order) else np.full(1, -1, np.int64) for x in (key, count, best))
    schema = ", ".join(("row long", "doc_id long", "n_a long", "n_b long", "n_groups long", "n_links long", "groups_sha256 string", "n_best long", "count_sum long"))
    scored = written(documents.mapInArrow(_score(key, count, best), f"{schema}, a array<int>, b array<int>, times array<long>"), "scored")
    discard(documents)
    rest = scored.where("size(a) > 0").select("row", F.explode(F.arrays_zip("a", "b", "times")).alias("x")).select("row", "x.a", "x.b", "x.times")
    rest = rest.join(counts, ["a", "b"]).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("count")).alias("more_sum")
    )
    out = scored.drop("a", "b", "times").join(rest, "row", "left")
    sums = [(F.col(x) + F.coalesce(F.col(y), F.lit(0))).alias(x) for x, y in (("n_best", "more_best"), ("count_sum", "more_sum"))]
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *sums, "groups_sha256")
