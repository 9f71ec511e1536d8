"""Merkle manifest against trees built by hand: proofs, odd rows, partitions that share runs."""

import hashlib
import random
import zlib

import pytest

from vellum.llm import manifest
from vellum.llm.tables import table

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest int, `a.b` int"


def _hash(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row, text):
    values = [None if v is None else str(v) for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)]
    return _hash("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def _tree(leaves):
    rows = [leaves]
    while len(rows[-1]) > 1:
        rows.append([_hash("".join(rows[-1][i : i + 3])) for i in range(0, len(rows[-1]), 3)])
    return rows


def _path(rows, i):
    for row in rows[:-1]:
        run = i // 3 * 3
        yield "".join(row[run:i]), "".join(row[i + 1 : run + 3])
        i //= 3


def _brute(rows):
    by: dict = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r, r["text"])))
    trees = [_tree([_leaf(r, r["text"]) for r in by[s]]) for s in sources]
    top = _tree([t[-1][0] for t in trees])
    for k, (s, tree) in enumerate(zip(sources, trees, strict=True)):
        for i, r in enumerate(by[s]):
            text, path = r["text"], [*_path(tree, i), *_path(top, k)]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = _leaf(r, text)
            for left, right in path:
                folded = _hash(left + folded + right)
            yield r["doc_id"], tree[0][i], tree[-1][0], top[-1][0], _hash("".join(a + b for a, b in path)), folded, folded == top[-1][0]


def _same(got, want):
    return sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("step", [7, 2])
def test_documents(spark, monkeypatch, step):
    monkeypatch.setattr(manifest, "STEP", step)
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    assert _same(manifest.audit(docs).collect(), _brute([r.asDict() for r in docs.collect()]))


def test_odd_rows(spark):
    """Null ids, sources and texts; rows repeated; sources that look like separators; one row; none."""
    rng = random.Random(3)
    many = [(i % 250, rng.choice(["a", "b", "é", "z\n", None, "a,b;c|d", ""]), None, 3, rng.choice(["x\ny", "z", None, "", "\n"]), 0, 0) for i in range(400)]
    cases = [(None,) * 7] * 5 + [(7, "", "l", 3, "é\n", 2, 0)] * 4 + many
    for rows in ([], [(2**62, "a", "x", 1, "t\nq", 1, 1)], cases):
        docs = spark.createDataFrame(rows, SCHEMA)
        assert _same(manifest.audit(docs).collect(), _brute([r.asDict() for r in docs.collect()]))


def test_very_long_text(spark):
    docs = spark.createDataFrame([(i, "s", None, None, "line\n" * 400_000, 0, 0) for i in range(3)], SCHEMA)
    assert _same(manifest.audit(docs).collect(), _brute([r.asDict() for r in docs.collect()]))


@pytest.mark.parametrize("cuts", [(1,), (2, 3, 4), (5, 17, 18, 40), tuple(range(1, 61))])
def test_stack_over_partitions(cuts):
    """Runs that partitions share are left open and merged to the same nodes, short last runs included."""
    import pandas as pd

    for n in (1, 2, 3, 9, 10, 28, 61):
        leaves = [_hash(str(i)) for i in range(n)]
        want = {(k, i, d) for k, row in enumerate(_tree(leaves)) if k for i, d in enumerate(row)}
        made, left = set(), []
        bounds = [0, *[c for c in cuts if c < n], n]
        for lo, hi in zip(bounds, bounds[1:]):
            stack = manifest.MountainRange(n)
            for i in range(lo, hi):
                made |= set(stack.push((0, i, leaves[i])))
            left += stack.left_open()
        if left:
            merged = manifest._merged(pd.DataFrame(left, columns=["level", "place", "digest"]).assign(total=n, part=0, group="g"))
            assert (merged["kind"] == "node").all()
            made |= set(merged[["level", "place", "digest"]].itertuples(index=False, name=None))
        assert made == want
