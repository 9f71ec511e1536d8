"""Near-duplicate vectors with hierarchical navigable small-world graphs, one for each shard.

Equal vectors are first made one (with their number). Every shard then gets a graph of its own
vectors, written to the shared folder, and every vector is looked up in every shard: queries come
in slices, a shard's graph once for each slice, so a task holds one graph and one slice. Within a
task all queries of a block move through the graph in step, as array operations. A query's beam is
widened while its worst member still links, or while a vector does not find itself; and all beams
of a block are widened while brute force over audited queries finds links that the graph missed. A query
with more links than the widest beam holds gets them from the vectors themselves, a block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.components import connected_components
from vellum.llm.tables import discard, written

#: Most vectors of a shard and of a slice of queries, on average; least number of shards.
SHARD_ROWS, SLICE_ROWS, LEAST_SHARDS = 50_000, 16_384, 8
#: Neighbours kept in upper layers and in the lowest, beam while building, first beam of a search.
M, M0, BUILD_BEAM, BEAM = 12, 24, 40, 32
#: Audited queries of a task, and the part of their true links that must be found.
AUDIT, RECALL = 64, 0.99
#: Widest beam, queries of a block, and vectors of a stored piece of a graph: these bound a task's memory, whatever links.
WIDEST, BLOCK, PIECE = 1024, 1024, 4096
_VISITED_BYTES, _PAIR_BYTES = 1 << 25, 1 << 26


class Graph:
    """A navigable small-world graph of unit vectors, built and searched in batches."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray] | None = None):
        self.x = np.ascontiguousarray(x, np.float32)
        self.layers = layers if layers is not None else self._build()

    def _build(self) -> list[np.ndarray]:
        n = len(self.x)
        draw = np.random.default_rng(1).random(n)
        level = np.minimum(np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(M)), 6).astype(int)
        level = -np.sort(-level)  # nodes come in any order: let the first be the tall ones
        self.layers = [np.full((n, M if k else M0), -1, np.int32) for k in range(level[0] + 1)]
        done = 1
        while done < n:
            new = np.arange(done, min(n, done + max(8, min(512, done))))
            entry = np.zeros((len(new), 1), np.int64)
            near = self.x[new] @ self.x[new].T
            near[np.arange(len(new)), np.arange(len(new))] = -2
            for k in range(level[0], -1, -1):
                here = level[new] >= k
                ids, sims = self._beam(self.x[new], entry, BUILD_BEAM if here.any() else 1, k)
                entry = ids[:, :4]
                if here.any():
                    inner = np.where(here[None, :], near, -2)
                    top = np.argsort(-inner, axis=1)[:, :8]
                    own = np.take_along_axis(inner, top, 1)
                    both = np.concatenate([ids, np.where(own > -2, new[top], -1)], 1)[here]
                    value = np.where(both >= 0, np.concatenate([sims, own], 1)[here], -2)
                    picked = self._diverse(both, value, M if k else M0 // 2)
                    self.layers[k][new[here], : picked.shape[1]] = picked
                    self._link_back(new[here], picked, k)
            done += len(new)
        return self.layers

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Per row the candidates that are nearer to the row's node than to any picked before."""
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        picked = np.full((len(ids), most), -1, np.int32)
        count = np.zeros(len(ids), int)
        between = np.einsum("aid,ajd->aij", self.x[ids], self.x[ids], optimize=True)
        chosen = np.zeros(ids.shape, bool)
        rows = np.arange(len(ids))
        for j in range(ids.shape[1]):
            closest = np.where(chosen, between[:, j, :], -2).max(axis=1)
            ok = (ids[:, j] >= 0) & (count < most) & (closest < sims[:, j] - 1e-6)
            chosen[:, j] = ok
            picked[rows[ok], count[ok]] = ids[ok, j]
            count += ok
        for j in range(ids.shape[1]):  # places left over go to the nearest of the rest
            ok = (ids[:, j] >= 0) & ~chosen[:, j] & (count < most) & ~(picked == ids[:, j : j + 1]).any(axis=1)
            picked[rows[ok], count[ok]] = ids[ok, j]
            count += ok
        return picked

    def _link_back(self, new: np.ndarray, picked: np.ndarray, k: int) -> None:
        links = self.layers[k]
        source, target = np.repeat(new, picked.shape[1]), picked.ravel()
        ok = target >= 0
        source, target = source[ok], target[ok].astype(np.int64)
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, start, many = np.unique(target, return_index=True, return_counts=True)
        width = links.shape[1]
        fewest = np.argsort(many, kind="stable")  # nodes that many link to come last, in small groups
        nodes, start, many = nodes[fewest], start[fewest], many[fewest]
        lo, end = 0, 0
        while end < len(nodes):
            lo, end = end, min(len(nodes), end + 256)
            while end - lo > 1 and (end - lo) * (width + int(many[end - 1])) ** 2 * 4 > _PAIR_BYTES:
                end = lo + (end - lo) // 2
            part, at, cnt = nodes[lo:end], start[lo:end], many[lo:end]
            extra = np.full((len(part), cnt.max()), -1, np.int64)
            place = np.arange(cnt.max())[None, :] < cnt[:, None]
            extra[place] = np.concatenate([source[a : a + c] for a, c in zip(at, cnt, strict=True)])
            both = np.concatenate([links[part], extra], 1)
            same = (both[:, :, None] == both[:, None, :]) & np.tri(both.shape[1], k=-1, dtype=bool)[None]
            both[same.any(axis=2)] = -1
            sims = np.where(both >= 0, np.einsum("ad,aid->ai", self.x[part], self.x[both]), -2)
            links[part] = self._diverse(both, sims, width)

    def _beam(self, q: np.ndarray, entry: np.ndarray, ef: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Best ``ef`` nodes of layer k that a beam search from ``entry`` finds, best first."""
        n, width = len(self.x), self.layers[k].shape[1]
        ef = min(ef, n)
        ids = np.full((len(q), ef), -1, np.int64)
        sims = np.full((len(q), ef), -2, np.float32)
        entry = entry[:, :ef]
        ids[:, : entry.shape[1]] = entry
        sims[:, : entry.shape[1]] = np.where(entry >= 0, np.einsum("ad,aid->ai", q, self.x[entry]), -2)
        open_ = ids >= 0
        seen = np.zeros((len(q), n + 1), bool)
        np.put_along_axis(seen, np.where(entry >= 0, entry, n), True, 1)
        seen[:, n] = True
        step = min(4, ef)
        active = np.arange(len(q))
        while len(active):
            score = np.where(open_[active], sims[active], -3)
            best = np.argpartition(-score, step - 1, axis=1)[:, :step] if step < ef else np.argsort(-score, axis=1)
            real = np.take_along_axis(score, best, 1) > -3
            go = real.any(axis=1)
            active, best, real = active[go], best[go], real[go]
            if not len(active):
                break
            rows = active[:, None]
            open_[rows, best] = False
            nodes = np.where(real, ids[rows, best], -1)
            more = np.where(nodes[:, :, None] >= 0, self.layers[k][nodes], -1).reshape(len(active), step * width).astype(np.int64)
            more = np.where(more >= 0, more, n)
            more = np.where(seen[rows, more], n, more)
            more.sort(axis=1)
            more[:, 1:][more[:, 1:] == more[:, :-1]] = n
            seen[rows, more] = True
            value = np.where(more < n, np.einsum("ad,aid->ai", q[active], self.x[np.minimum(more, n - 1)]), -2)
            all_ids = np.concatenate([ids[active], np.where(more < n, more, -1)], 1)
            all_sims = np.concatenate([sims[active], value], 1)
            all_open = np.concatenate([open_[active], more < n], 1)
            keep = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
            ids[active] = np.take_along_axis(all_ids, keep, 1)
            sims[active] = np.take_along_axis(all_sims, keep, 1)
            open_[active] = np.take_along_axis(all_open, keep, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, q: np.ndarray, ef: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        size = max(16, min(1024, _VISITED_BYTES // (len(self.x) + 1)))
        for lo in range(0, len(q), size):
            part = q[lo : lo + size]
            entry = np.zeros((len(part), 1), np.int64)
            for k in range(len(self.layers) - 1, 0, -1):
                entry = self._beam(part, entry, 4, k)[0]
            yield slice(lo, lo + len(part)), *self._beam(part, entry, ef, 0)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, initial=0.0)[:, None]  # squares of any finite components neither overflow nor vanish
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    x = np.array(pdf["v"].tolist(), np.float64).reshape(len(pdf), -1)
    order = np.random.default_rng(2).permutation(np.argsort(pdf["id"].to_numpy(), kind="stable"))
    graph = Graph(_unit(x[order]))
    x, ids, copies = x[order], pdf["id"].to_numpy()[order], pdf["copies"].to_numpy()[order]
    pieces = [slice(lo, lo + PIECE) for lo in range(0, len(x), PIECE)]
    cut = lambda a: [a[p].tobytes() for p in pieces]
    return pd.DataFrame(
        {
            "dim": x.shape[1], "shard": int(pdf["shard"].iloc[0]), "piece": range(len(pieces)), "ids": cut(ids), "copies": cut(copies), "x": cut(x),
            "layers": [[g[p].tobytes() for g in graph.layers] for p in pieces],
        }
    )


def _joined(pieces: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Ids, numbers of copies, vectors and layers of a graph that is stored in pieces."""
    pieces = pieces.sort_values("piece")
    ids, copies = (np.frombuffer(b"".join(pieces[c]), np.int64) for c in ("ids", "copies"))
    layers = [np.frombuffer(b"".join(parts), np.int32).reshape(len(ids), -1) for parts in zip(*pieces["layers"], strict=True)]
    return ids, copies, np.frombuffer(b"".join(pieces["x"]), np.float64).reshape(len(ids), -1), layers


def _found(graph: Graph, exact: np.ndarray, q: np.ndarray, itself: np.ndarray, least: float, ef: int) -> list[np.ndarray]:
    """For each query the shard's places with a cosine of ``least`` or more, itself included."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(q)
    left = np.arange(len(q))
    q32 = q.astype(np.float32)
    while len(left) and ef <= WIDEST:
        again = []
        for part, ids, sims in graph.search(q32[left], ef):
            rows = left[part]
            missing = (itself[rows] >= 0) & ~(ids == itself[rows][:, None]).any(axis=1)
            wider = (missing | (sims[:, -1] >= least - 1e-3)) & (ids.shape[1] < len(exact))
            for i, r in enumerate(rows):
                if wider[i]:
                    continue
                near = ids[i][sims[i] >= least - 1e-4]
                out[r] = near[exact[near] @ q[r] >= least] if len(near) else near
            again.append(rows[wider])
        left, ef = np.concatenate(again), ef * 2
    size = max(1, _PAIR_BYTES // (8 * len(exact)))
    for rows in (left[lo : lo + size] for lo in range(0, len(left), size)):
        for r, links in zip(rows, q[rows] @ exact.T >= least, strict=True):
            out[r] = np.flatnonzero(links)
    return [near.astype(np.int32) for near in out]


def _audited(graph: Graph, exact: np.ndarray, q: np.ndarray, qid: np.ndarray, itself: np.ndarray, least: float) -> list[np.ndarray]:
    """:func:`_found` with beams as wide as the audits ask for."""
    ef = BEAM
    while True:
        found = _found(graph, exact, q, itself, least, ef)
        linked = np.array([len(f) for f in found])
        # hubs, and queries of any number of links, are audited apart: many links can't hide missed few
        audits = np.argsort(-linked, kind="stable")[: AUDIT // 2], np.argsort(qid % 10007, kind="stable")[: AUDIT // 2]
        parts = []
        for audit in audits:
            true = exact @ q[audit].T >= least
            hits = np.array([np.isin(np.flatnonzero(true[:, i]), found[a]).sum() for i, a in enumerate(audit)])
            sums = true.sum(axis=0)
            parts.append((hits[sums > 0] / sums[sums > 0]).mean() if (sums > 0).any() else 1.0)
        if min(parts) >= RECALL or ef > WIDEST or ef >= len(exact):
            return found
        ef *= 2


def _search(least: float):
    def run(graphs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(graphs) or not len(queries):
            return pd.DataFrame({"id": [], "links": [], "other": []}, dtype="int64")
        ids, copies, x, layers = _joined(graphs)
        exact = _unit(x)
        graph = Graph(exact, layers)
        order = np.argsort(ids)
        part_of = np.arange(len(ids))  # the shard's places by what joins them so far
        out = []
        for lo in range(0, len(queries), BLOCK):
            block = queries.iloc[lo : lo + BLOCK]
            q, qid = _unit(np.array(block["v"].tolist(), np.float64).reshape(len(block), -1)), block["id"].to_numpy()
            at = order[np.minimum(np.searchsorted(ids[order], qid), len(ids) - 1)]
            itself = np.where(ids[at] == qid, at, -1)
            for i, near in enumerate(_audited(graph, exact, q, qid, itself, least)):
                near = near[ids[near] != qid[i]]
                if not len(near):
                    continue
                # a link to each part only, as one link joins it
                parts, first = np.unique(part_of[near], return_index=True)
                other = ids[near[first]]
                if itself[i] >= 0:
                    own = part_of[itself[i]]
                    other, parts = other[parts != own], np.union1d(parts, own)
                out.append(np.array([(qid[i], copies[near].sum(), qid[i]), *((qid[i], 0, o) for o in other)], np.int64))
                if len(parts) > 1:
                    part_of[np.isin(part_of, parts)] = parts[0]
        rows = np.concatenate(out) if out else np.empty((0, 3), np.int64)
        return pd.DataFrame(rows, columns=["id", "links", "other"])

    return run


def usable_vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, v, ok``: v as doubles; ok unless null, empty, zero or with null or non-finite parts."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    zero = F.forall(v, lambda e: e == 0)
    ok = F.coalesce(~bad & ~zero & (F.size(v) > 0), F.lit(False)) & F.col(id_col).isNotNull()
    return table.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), ok.alias("ok"))


def near_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.9) -> DataFrame:
    """Link vectors with a cosine of ``least`` or more and label the components.

    Returns one row per input row: ``vec_id, n_links, component_id, kept``. A vector that is null,
    empty, zero or holds null or non-finite components links with nothing, nor does a row without
    an id (its component_id is null, and it is kept). Equal vectors link with each other. Only
    vectors of equal length are compared. Ids are meant to be unique; rows that repeat one are one
    node of the components. Other columns are ignored. n_links counts what the vector's own searches
    find, RECALL of its links or more by the audits, so two ends may count a link apart; a link that
    either end finds joins the components. A cosine of exactly ``least`` links.
    """
    rows = usable_vectors(table, id_col, vec_col)
    good = rows.where("ok")
    classes = good.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("dim", F.size("v")), "vectors")
    n = classes.count()
    shards, slices = max(LEAST_SHARDS, -(-n // SHARD_ROWS)), -(-n // SLICE_ROWS)
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    graphs = classes.withColumn("shard", shard).groupBy("dim", "shard")
    graphs = graphs.applyInPandas(_build, "dim int, shard int, piece int, ids binary, copies binary, x binary, layers array<binary>")
    stored = written(graphs, "graphs")
    graphs = stored.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(max(slices - 1, 0)))))
    queries = classes.select(
        "dim", "id", "v", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(max(slices, 1))).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    )
    key = ["dim", "shard", "slice"]
    found = graphs.groupBy(*key).cogroup(queries.groupBy(*key)).applyInPandas(_search(least), "id long, links long, other long")
    found = written(found, "found")
    discard(stored)
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    placed = classes.join(counts, "id", "left").select("v", F.col("id").alias("rep"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    copies = written(good.join(placed, "v").select("id", "rep", "n_links"), "copies")
    edges = found.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")).union(copies.where("id <> rep").select("id", "rep"))
    labels = connected_components(edges).withColumnRenamed("node", "id")
    rest = rows.where("not ok").select("id", F.col("id").alias("rep"), F.lit(0).cast("long").alias("n_links"))
    component = F.coalesce("component", "id")
    return copies.unionByName(rest).join(labels, "id", "left").select(
        F.col("id").alias("vec_id"), "n_links", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )
