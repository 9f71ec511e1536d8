"""Cross-tokenizer alignment against a plain version, token by token."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from vellum.llm import alignment
from vellum.llm.tables import table

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, row int, a string, times int"


@pytest.fixture(scope="module")
def plain():
    """Function of a text: (ids of A, ids of B, groups), or None where the bytes differ."""
    first = Tokenizer.from_file(PATHS[0])
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    alphabet, entries = alignment.byte_alphabet(), {i: e for e, i in first.get_vocab().items()}

    def piece(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:-1], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()

    def run(text):
        raw = (" " + (text or "")).encode()
        a, b = first.encode(" " + (text or ""), add_special_tokens=False).ids, second.encode(text or "")
        bytes_a, bytes_b = [bytes(alphabet[c] for c in entries[i]) for i in a], [piece(i) for i in b]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            return None
        ends = [[sum(map(len, x[: i + 1])) for i in range(len(x))] if len(x) < 2000 else _ends(x) for x in (bytes_a, bytes_b)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for c in cuts:
            lo, at = i, j
            while i < len(a) and ends[0][i] <= c:
                i += 1
            while j < len(b) and ends[1][j] <= c:
                j += 1
            groups.append((a[lo:i], b[at:j]))
        return a, b, groups

    def _ends(parts):
        out, n = [], 0
        for p in parts:
            n += len(p)
            out.append(n)
        return out

    return run


def _brute(plain, rows):
    found = [(i, plain(t)) for i, t in rows]
    counts: Counter = Counter()
    for _, x in found:
        if x:
            counts.update({(u, v) for us, vs in x[2] for u in us for v in vs})
    most: dict = defaultdict(int)
    for (u, _), n in counts.items():
        most[u] = max(most[u], n)
    for i, x in found:
        if not x:
            yield (i, 0, 0, 0, 0, 0, 0, "")
            continue
        links = [(u, v) for us, vs in x[2] for u in us for v in vs]
        text = ";".join(f"{','.join(map(str, us))}|{','.join(map(str, vs))}" for us, vs in x[2])
        yield i, len(x[0]), len(x[1]), len(x[2]), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest()


def _same(got, want):
    return sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("head", [alignment.HEAD, 300, 0])
def test_documents(spark, plain, head):
    """The same whether common pairs are looked up or all are joined."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = alignment.alignment(docs, head=head).collect()
    assert _same(got, _brute(plain, [(r.doc_id, r.text) for r in docs.collect()]))


def test_odd_texts(spark, plain):
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\r", "\r\n", " ", "　", " ", "\x85", "\x1c", "a", "foo", "Bar", "'s", "é", "é", "漢字", "😀", ".", "!!", "123", "▁"]
    parts += ["<|endoftext|>", "<s>", "<0x0A>", "<unk>", "\x00", "ﬁ", "﻿", "​", ";\r", "퟿"]
    rows = [(i % 900, "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))) for i in range(1500)]
    rows += [(None, "no id"), (None, "no id"), (1, None), (2, ""), (3, " "), (4, "   "), (5, "\n"), (6, "same"), (6, "same")]
    got = alignment.alignment(spark.createDataFrame([(*r, 0, "", 0) for r in rows], SCHEMA)).collect()
    assert _same(got, _brute(plain, rows))


def test_long_words_and_texts(spark, plain):
    rng = random.Random(2)
    rows = [(1, "x" * 30_000), (2, "".join(rng.choice("abcé漢") for _ in range(20_000))), (3, "word " * 50_000), (4, " " * 5000 + "é" * 5000)]
    got = alignment.alignment(spark.createDataFrame([(*r, 0, "", 0) for r in rows], SCHEMA)).collect()
    assert _same(got, _brute(plain, rows))


def test_empty_and_not_utf8(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert alignment.alignment(empty).count() == 0
    bad = spark.sql("SELECT 5L AS doc_id, cast(X'61ff62' AS string) AS text")
    assert [tuple(r) for r in alignment.alignment(bad).collect()] == [(5, 0, 0, 0, 0, 0, 0, "")]


def test_small_memory(spark, plain, monkeypatch):
    """Links in parts, segments forgotten, pairs passed on early: the same result."""
    both = alignment.Pair(*PATHS)
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["tok", "enizers", "漢字漢字", "élan", "x" * 50]) for _ in range(30)) for _ in range(40)]
    for links, kept in ((alignment.LINKS, 10**6), (3, 0)):
        monkeypatch.setattr(alignment, "LINKS", links)
        monkeypatch.setattr(alignment, "KEPT_SEGMENTS", kept)
        for lo in range(0, 40, 20):
            _, _, (text, a, b, times) = both.align([t.encode() for t in texts[lo : lo + 20]])
            got = {(lo + d, u, v): n for d, u, v, n in zip(text.tolist(), a.tolist(), b.tolist(), times.tolist(), strict=True)}
            want = Counter((lo + i, u, v) for i, t in enumerate(texts[lo : lo + 20]) for us, vs in plain(t)[2] for u in us for v in vs)
            assert got == dict(want)
    docs = spark.createDataFrame([(i, t, 0, "", 0) for i, t in enumerate(texts)], SCHEMA)
    counts = {(r.a, r.b): r["count"] for r in alignment.pair_counts(alignment.aligned(docs)).collect()}
    want = Counter(p for t in texts for p in {(u, v) for us, vs in plain(t)[2] for u in us for v in vs})
    assert counts == dict(want)
