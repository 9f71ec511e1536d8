"""Near-duplicate vectors: memory of a task where nearly all vectors link, and graphs stored in pieces."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from vellum.llm import vectors


def _family(n, others, dim=16):
    """A family in which all link, and vectors in pairs."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal(dim)
    near = base + 0.1 * rng.standard_normal((n, dim))
    apart = np.repeat(rng.standard_normal((others // 2, dim)), 2, axis=0) + 0.01 * rng.standard_normal((others, dim))
    return np.concatenate([near, apart])


def _run(x, shard, least=0.9):
    """Links of all rows of ``x`` in a graph of those numbered ``shard``."""
    rows = pd.DataFrame({"id": shard, "v": list(x[shard]), "copies": 1, "dim": x.shape[1], "shard": 0})
    stored = vectors._build(rows)
    queries = pd.DataFrame({"id": np.arange(len(x)), "v": list(x)})
    return stored, vectors._search(least)(stored, queries)


def test_hubs_and_pieces(monkeypatch):
    monkeypatch.setattr(vectors, "PIECE", 300)
    monkeypatch.setattr(vectors, "WIDEST", 128)
    x = _family(900, 400)
    shard = np.flatnonzero(np.arange(len(x)) % 3)
    stored, found = _run(x, shard)
    assert len(stored) == 3 and sorted(stored["piece"]) == [0, 1, 2]
    ids = vectors._joined(stored.sample(frac=1, random_state=1))[0]
    assert sorted(ids) == list(shard)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    true = unit @ unit[shard].T >= 0.9
    true[shard, np.arange(len(shard))] = False
    links = found.groupby("id")["links"].sum().reindex(range(len(x)), fill_value=0).to_numpy()
    assert np.mean(links == true.sum(axis=1)) > 0.99 and (links <= true.sum(axis=1)).all()
    # the links handed on are links, few, and join all that belongs together
    pairs = found[found["id"] != found["other"]]
    assert all(unit[a] @ unit[b] >= 0.9 for a, b in zip(pairs["id"], pairs["other"], strict=True)) and len(pairs) < 2 * len(x)
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in zip(pairs["id"], pairs["other"], strict=True):
        root[find(a)] = find(b)
    family = set(map(find, range(900)))
    assert len(family) == 1 and not family & set(map(find, range(900, len(x))))


@pytest.mark.parametrize("n", [1500])
def test_memory_of_hubs(n):
    """All vectors link: beams as wide as the shard and all links of a slice were held at once."""
    x = _family(n, 0)
    rows = pd.DataFrame({"id": np.arange(n), "v": list(x), "copies": 1, "dim": x.shape[1], "shard": 0})
    stored, queries = vectors._build(rows), pd.DataFrame({"id": np.arange(n), "v": list(x)})
    tracemalloc.start()
    found = vectors._search(0.8)(stored, queries)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found.groupby("id")["links"].sum() == n - 1).all() and most < 120e6, most
