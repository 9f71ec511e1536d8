"""Pack token streams into sequences by order-preserving dynamic programming.

Every task packs the documents of its own partition in their order, so nothing is shuffled and a
task that is repeated after a lost executor gives the same rows. A document's ids follow those of
the document before it; window cuts are chosen among document ends, sentence ends and, where
neither comes for a while, spare places inside a sentence, such that padding plus penalties for
cut documents is least. With ``f(j)`` the least cost of a cut at ``p(j)``::

    f(j) = penalty(j) + min over i with p(j) - p(i) <= limit of f(i) + limit - (p(j) - p(i))

so ``f(i) + p(i)`` is all that a start i contributes, and a monotone queue holds the best starts
of the sliding window: each place enters and leaves it once.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 4096
END_ID = 2
#: Costs, in tokens of padding, of a cut at a sentence end and of one inside a sentence.
SENTENCE_PENALTY, INSIDE_PENALTY = 8, 48
#: A spare place to cut after so many tokens without a sentence end.
SPARE = 128
#: Tokens that are packed at once; the last window stays open and goes on with the next ones.
CHUNK = 1 << 19
#: Distinct words of which a worker keeps the ids, and bytes of text that it splits at once.
CACHE_WORDS, SLICE_BYTES = 1_000_000, 1 << 21

_ENDS = (b".", b"!", b"?")


def window_cuts(places: list[int], penalties: list[int], limit: int = LIMIT) -> list[int]:
    """Indices of the best cuts, the first and the last place included.

    Neighbouring places must be at most ``limit`` apart.
    """
    reach = [0] * len(places)  # f + p
    come = [0] * len(places)
    queue = deque([0])
    reach[0] = places[0]
    for j in range(1, len(places)):
        least = places[j] - limit
        while places[queue[0]] < least:
            queue.popleft()
        i = queue[0]
        come[j] = i
        cost = reach[j] = reach[i] + limit + penalties[j]
        while queue and reach[queue[-1]] >= cost:
            queue.pop()
        queue.append(j)
    out, j = [], len(places) - 1
    while j:
        out.append(j)
        j = come[j]
    return [0, *reversed(out)]


class WordIds:
    """Token ids of white-space separated words, each distinct word tokenized once.

    White space never joins tokens in this vocabulary, so a text's ids are its words' ids in turn.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for word, i in vocab.items() if word.endswith("</w>")]] = True
        self.marks = {m: vocab[f"{m.decode()}</w>"] for m in (b".", b",")}
        self.clear()

    def clear(self) -> None:
        """Entry 0 is the id that ends a document."""
        self.at: dict[bytes, int] = {}
        self.flat = np.array([END_ID], np.uint32)
        self.starts = np.array([0, 1], np.int64)
        self.ends = np.array([True])

    def _encode(self, words: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def learn(self, words: list[bytes]) -> None:
        """Letters alone are one pre-token each and can share a call: its ids close with </w>."""
        stems: dict[str, int] = {}
        known, stem_of, mark_of, odd = [], [], [], []
        for w in words:
            mark = self.marks.get(w[-1:], 0)
            text = (w[:-1] if mark else w).decode("utf-8", "replace")
            if text.isalpha():
                known.append(w)
                stem_of.append(stems.setdefault(text, len(stems)))
                mark_of.append(mark)
            else:
                odd.append(w)
        listed, ids, sizes = list(stems), [], []
        for i in range(0, len(listed), 2000):
            part = listed[i : i + 2000]
            own = np.array(self._encode([" ".join(part)])[0], np.uint32)
            size = np.diff(np.flatnonzero(self.closes[own]) + 1, prepend=0)
            if len(size) != len(part):  # normalization made other words of one
                each = self._encode(part)
                own, size = np.array([x for e in each for x in e], np.uint32), np.array([len(e) for e in each])
            ids.append(own)
            sizes.append(size)
        if known:
            flat, size = np.concatenate(ids), np.concatenate(sizes)
            stem, mark = np.array(stem_of), np.array(mark_of, np.uint32)
            many = size[stem] + (mark > 0)
            upto = np.cumsum(many)
            source = np.repeat((np.cumsum(size) - size)[stem] - upto + many, many) + np.arange(upto[-1])
            out = flat[np.minimum(source, len(flat) - 1)]
            out[upto[mark > 0] - 1] = mark[mark > 0]
            self._add(known, out, many)
        if odd:
            each = self._encode([w.decode("utf-8", "replace") for w in odd])
            self._add(odd, np.array([x for e in each for x in e], np.uint32), np.array([len(e) for e in each]))

    def _add(self, words: list[bytes], flat: np.ndarray, many: np.ndarray) -> None:
        self.at.update(zip(words, range(len(self.ends), len(self.ends) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(many)])
        self.flat = np.concatenate([self.flat, flat])
        self.ends = np.concatenate([self.ends, [w.endswith(_ENDS) for w in words]])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by the ending id; where each text's ids end; and the
        places behind the ids of words that end sentences."""
        if len(self.at) > CACHE_WORDS:
            self.clear()
        # A-Z can be lowered ahead of the tokenizer, except in what may be a special token
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        counts = np.array([len(w) for w in split])
        words = list(chain.from_iterable(split))
        at = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            self.learn(list(dict.fromkeys(map(words.__getitem__, new))))
            at[new] = [self.at[words[i]] for i in new]
        at = np.insert(at, np.cumsum(counts), 0)
        many = (self.starts[1:] - self.starts[:-1])[at]
        upto = np.cumsum(many)
        ids = self.flat[np.repeat(self.starts[at] - upto + many, many) + np.arange(upto[-1])]
        return ids, upto[np.cumsum(counts + 1) - 1], upto[self.ends[at]]


class Packer:
    """Documents in, rows of pieces out."""

    def __init__(self, limit: int, first_sequence: int):
        self.limit, self.sequence = limit, first_sequence
        self.held: list = []  # (doc_id, start, ids, sentence ends, tokens of the document)
        self.tokens = 0

    def add(self, doc_id, ids: np.ndarray, stops: np.ndarray) -> Iterator[tuple]:
        self.held.append((doc_id, 0, ids, stops, len(ids)))
        self.tokens += len(ids)
        if self.tokens >= CHUNK:
            yield from self.pack(last=False)

    def pack(self, last: bool) -> Iterator[tuple]:
        if not self.held:
            return
        sizes = np.array([len(x[2]) for x in self.held])
        begins = np.concatenate(([0], np.cumsum(sizes)))
        places = np.unique(np.concatenate([begins, *(b + x[3] for b, x in zip(begins, self.held, strict=False))]))
        wide = np.flatnonzero(np.diff(places) > SPARE)
        spare = [np.arange(places[i] + SPARE, places[i + 1], SPARE) for i in wide]
        cost = np.zeros(begins[-1] + 1, np.int64)
        cost[places] = SENTENCE_PENALTY
        cost[begins] = 0
        if spare:
            extra = np.concatenate(spare)
            cost[extra] = INSIDE_PENALTY
            places = np.unique(np.concatenate([places, extra]))
        cuts = places[window_cuts(places.tolist(), cost[places].tolist(), self.limit)].tolist()
        open_end, end = cuts[-2], cuts[-1]
        cuts.pop()
        if last:  # lengths that are powers of two need no padding
            left = end - open_end
            while left:
                step = left if left == self.limit else 1 << (left.bit_length() - 1)
                cuts.append(cuts[-1] + step)
                left -= step
        yield from self._pieces(begins, cuts)
        rest, self.held, self.tokens = self.held, [], 0
        for b, (doc_id, start, ids, stops, n) in zip(begins, rest, strict=False):
            if not last and b + len(ids) > open_end:
                skip = max(0, open_end - b)
                self.held.append((doc_id, int(start + skip), ids[skip:], stops[stops > skip] - skip, n))
                self.tokens += len(ids) - skip

    def _pieces(self, begins: np.ndarray, cuts: list[int]) -> Iterator[tuple]:
        edges = np.unique(np.concatenate([begins[begins < cuts[-1]], cuts]))
        docs = np.searchsorted(begins, edges[:-1], "right") - 1
        windows = np.searchsorted(cuts, edges[:-1], "right") - 1
        for a, b, d, w in zip(edges[:-1].tolist(), edges[1:].tolist(), docs.tolist(), windows.tolist(), strict=True):
            doc_id, start, ids, _, n = self.held[d]
            at = a - int(begins[d])
            yield doc_id, start + at, b - a, zlib.crc32(ids[at : at + b - a].tobytes()), n, self.sequence + w, a - cuts[w]
        self.sequence += len(cuts) - 1


_COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
_SCHEMA = pa.schema([(c, pa.int64()) for c in _COLUMNS])
_words: dict[str, WordIds] = {}  # of this worker, by path


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
    yield ids, texts


def _run(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words.get(path) or _words.setdefault(path, WordIds(path))
        packer = Packer(limit, TaskContext.get().partitionId() << 40)
        rows: list[tuple] = []
        for ids, texts in _slices(batches):
            if not ids:
                continue
            tokens, stops_at, sentences = words.encode(texts)
            begin = 0
            cut = np.searchsorted(sentences, stops_at, "right").tolist()
            for doc_id, end, lo, hi in zip(ids, stops_at.tolist(), [0, *cut], cut, strict=False):
                rows += packer.add(doc_id, tokens[begin:end], sentences[lo:hi] - begin)
                begin = end
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_SCHEMA)
                rows = []
        rows += packer.pack(last=True)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_SCHEMA)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Place the ids of ``docs``, each document's followed by id 2, in sequences of ``limit`` at most.

    Returns one row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset``. A sequence shorter than ``limit`` is meant to be padded to it, unless its length is
    a power of two. A null or empty text has the closing id alone. Repeated rows are packed as
    often as they come; null ids stay null. An empty table gives no rows. Other columns are ignored.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_run(path, limit), ", ".join(f"{c} long" for c in _COLUMNS))
