"""Token counts under a unigram model, by dynamic programming along a trie of pre-tokens.

A document's pre-tokens are its white-space separated words. A worker keeps a trie of the distinct
pre-tokens it met, in all its batches: a prefix that pre-tokens share is a node and is scored once,
and a terminal node stores its number of tokens. The memory of a worker is bounded: a trie that has
grown past its limit is begun anew, and of very long words only the first DEEPEST characters are nodes. Nothing is shuffled, whatever words are frequent.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens and nodes that a worker keeps before it starts anew, and bytes of text that it splits at once.
CACHE_WORDS, TRIE_NODES, SLICE_BYTES = 1_000_000, 1_000_000, 1 << 21
#: Characters of a word that are nodes of the trie; what follows is scored without.
DEEPEST = 256
#: Score of a byte of a character that no piece covers.
BYTE_SCORE = -25.0
WORD_START = "▁"


def piece_scores(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece file with log-probabilities by Zipf's law from their rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    score = -np.log(np.arange(len(pieces)) + 2.7)
    score -= np.log(np.exp(score).sum())
    return dict(zip(pieces, score.tolist(), strict=True))


class UnigramTrie:
    """A trie of pre-tokens whose nodes hold the forward score of their prefix and its number of tokens."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        ends: dict[str, set[int]] = {}
        for piece in pieces:
            ends.setdefault(piece[-1], set()).add(len(piece))
        self.ends = {c: sorted(n) for c, n in ends.items()}  # lengths of the pieces that end in a character
        self.longest = max(map(len, pieces), default=1)
        self.clear()

    def clear(self) -> None:
        self.edges: dict[int, int] = {}  # node * 2 ** 21 + code point of the child's character
        self.score, self.count = array("d", [0.0]), array("q", [0])

    @property
    def nodes(self) -> int:
        """Nodes below the root, each of which was scored once."""
        return len(self.score) - 1

    def insert(self, word: str) -> int:
        """Tokens of the best segmentation of a word, kept at its terminal node.

        Of segmentations of equal score the one whose last piece is longest counts.
        """
        node, path = 0, [0]
        for i, end in enumerate(word[:DEEPEST], 1):
            edge = node << 21 | ord(end)
            child = self.edges.get(edge)
            if child is None:
                child = self.edges[edge] = self._grow(word, i, end, path)
            path.append(child)
            node = child
        return self.count[node] if len(word) <= DEEPEST else self._go_on(word, path)

    def _go_on(self, word: str, path: list[int]) -> int:
        """Tokens of a word longer than the trie is deep, from the scores of the places that a piece can reach back to."""
        ring = self.longest + 1
        scores, counts = [0.0] * ring, [0] * ring
        for i in range(max(0, DEEPEST - self.longest), DEEPEST + 1):
            scores[i % ring], counts[i % ring] = self.score[path[i]], self.count[path[i]]
        for i in range(DEEPEST + 1, len(word) + 1):
            end = word[i - 1]
            size = len(end.encode("utf-8", "replace"))
            best, tokens = scores[(i - 1) % ring] + BYTE_SCORE * size, counts[(i - 1) % ring] + size
            for n in self.ends.get(end, ()):
                if n > i:
                    break
                own = self.pieces.get(word[i - n : i])
                if own is not None and (own := own + scores[(i - n) % ring]) >= best:
                    best, tokens = own, counts[(i - n) % ring] + 1
            scores[i % ring], counts[i % ring] = best, tokens
        return counts[len(word) % ring]

    def _grow(self, word: str, i: int, end: str, path: list[int]) -> int:
        """A node for the first i characters of a word, scored from those of its path."""
        score, count = self.score, self.count
        size = len(end.encode("utf-8", "replace"))
        best, tokens = score[path[-1]] + BYTE_SCORE * size, count[path[-1]] + size
        for n in self.ends.get(end, ()):
            if n > i:
                break
            own = self.pieces.get(word[i - n : i])
            if own is not None and (own := own + score[path[i - n]]) >= best:
                best, tokens = own, count[path[i - n]] + 1
        score.append(best)
        count.append(tokens)
        return len(score) - 1


class Counter:
    """A worker's trie, and the counts of the words that it met."""

    def __init__(self, path: str):
        self.trie = UnigramTrie(piece_scores(path))
        self.at: dict[bytes, int] = {}

    def count(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words and tokens of each text."""
        if len(self.at) > CACHE_WORDS:
            self.at.clear()
        if self.trie.nodes > TRIE_NODES:
            self.trie.clear()
        split = [t.split() for t in texts]
        sizes = np.array([len(w) for w in split])
        words = list(chain.from_iterable(split))
        got = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(got < 0).tolist()
        if new:
            for w in {words[i] for i in new}:
                self.at[w] = self.trie.insert(WORD_START + w.decode("utf-8", "replace"))
            got[new] = [self.at[words[i]] for i in new]
        total = np.concatenate(([0], np.cumsum(got)))
        ends = np.cumsum(sizes)
        return sizes, total[ends] - total[ends - sizes]


_counters: dict[str, Counter] = {}  # of this worker, by path


def _run(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(path) or _counters.setdefault(path, Counter(path))
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            lo = 0
            while lo < len(texts):
                part, size, hi = [], 0, lo
                while hi < len(texts) and size < SLICE_BYTES:
                    part.append(texts[hi].as_py() or b"")
                    size += len(part[-1])
                    hi += 1
                words, tokens = counter.count(part)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])
                lo = hi

    return run


def token_counts(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``; each, behind a word-start mark, is segmented into the pieces
    of ``model`` with the highest total score. Null, empty and blank texts count 0. Repeated rows
    are counted each; null ids stay null; other columns are ignored.
    """
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_run(path), "doc_id long, n_words long, n_tokens long")
