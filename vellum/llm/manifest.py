"""Merkle manifest of a dataset: mountain ranges of nodes over partitions of an ordered index.

Rows become leaves, ordered within groups. The job's steps, each a DataFrame:

1. Leaves are hashed where rows are read (texts aren't shuffled), range partitioned by group and
   order, sorted and numbered within their partition. The numbers of rows of each group and partition,
   summed up in turn, give every leaf its place in its group.
2. Each indexed partition is read once through a stack, a mountain range: a leaf is pushed, and
   as long as the topmost run has FAN nodes it is carried, hashed into its parent. Runs that a
   neighbouring partition shares stay open, a few on each level and side.
3. Open runs of NEAR neighbouring partitions are merged at a time, until none is left open. A group's
   last run of each level may be short; it is hashed as it is, without padding.
4. Groups' roots are the leaves of one more such tree.
5. Proofs are made from the root downwards, STEP levels at a time: a block of FAN ** STEP neighbouring
   nodes and the path above it are one task's, however large the group is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.tables import discard, written

#: Children of a node; partitions whose open runs are merged at once; levels of a block of proofs.
FAN, NEAR, STEP = 3, 32, 7

Node = tuple[int, int, str]  # level, place, digest


def digest(children: Iterable[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def width(total: int, level: int) -> int:
    """Nodes of a level over ``total`` leaves."""
    for _ in range(level):
        total = -(-total // FAN)
    return total


def height(total: int) -> int:
    """Levels above the leaves."""
    level = 0
    while total > 1:
        total, level = -(-total // FAN), level + 1
    return level


class MountainRange:
    """The stack: nodes in, ascending by place on each level; completed parents out.

    A run is complete when it has as many nodes as its place in a tree of ``total`` leaves has.
    """

    def __init__(self, total: int):
        self.widths = [total]
        while self.widths[-1] > 1:
            self.widths.append(-(-self.widths[-1] // FAN))
        self.runs: dict[int, list[Node]] = {}
        self.open: list[Node] = []

    def push(self, node: Node) -> Iterator[Node]:
        """Adds a node; gives the peaks that it completes, lowest first."""
        level, place, _ = node
        while level + 1 < len(self.widths):
            run = self.runs.setdefault(level, [])
            if run and run[0][1] // FAN != place // FAN:  # left open by what came before
                self.open += run
                run.clear()
            run.append(node)
            first = place // FAN * FAN
            if len(run) < min(FAN, self.widths[level] - first):
                return
            node = (level + 1, place // FAN, digest(x[2] for x in run))
            run.clear()
            yield node
            level, place, _ = node

    def left_open(self) -> list[Node]:
        out = self.open + [x for run in self.runs.values() for x in run]
        self.open, self.runs = [], {}
        return out


def _numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    row = 0
    for rows in batches:
        yield rows.assign(part=TaskContext.get().partitionId(), row=range(row, row + len(rows)))
        row += len(rows)


def _stacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a (part, group) in order, its head first; gives leaves their places, and nodes."""
    now, place, total, stack = None, 0, 0, None

    def closed():
        return [(*now, total, *n, "open", None, None) for n in stack.left_open()] if stack else []

    columns = ["part", "group", "total", "level", "place", "digest", "kind", "row", "more"]
    for batch in batches:
        out: list[tuple] = []
        for part, group, is_leaf, row, start, all_, leaf, more in batch[["part", "group", "is_leaf", "row", "start", "total", "digest", "more"]].itertuples(index=False, name=None):
            if not is_leaf:
                out += closed()
                now, place, total = (part, group), int(start), int(all_)
                stack = MountainRange(total)
                continue
            out.append((*now, total, 0, place, leaf, "leaf", row, more))
            out += [(*now, total, *n, "node", None, None) for n in stack.push((0, place, leaf))]
            place += 1
        if out:
            yield pd.DataFrame(out, columns=columns).astype({"row": "Int64"})
    if stack and (out := closed()):
        yield pd.DataFrame(out, columns=columns).astype({"row": "Int64"})


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """Open runs of one group in neighbouring partitions, level by level."""
    total = int(pdf["total"].iloc[0])
    levels: dict[int, list[Node]] = {}
    for level, place, d in pdf[["level", "place", "digest"]].itertuples(index=False, name=None):
        levels.setdefault(int(level), []).append((int(level), int(place), d))
    made, rest = [], []
    for level in range(height(total)):
        nodes = sorted(levels.get(level, []))
        for parent, run in groupby(nodes, lambda n: n[1] // FAN):
            run = list(run)
            if len(run) < min(FAN, width(total, level) - parent * FAN):
                rest += run
                continue
            node = (level + 1, parent, digest(x[2] for x in run))
            made.append(node)
            levels.setdefault(level + 1, []).append(node)
    rows = [(*n, "node") for n in made] + [(*n, "open") for n in rest]
    out = pd.DataFrame(rows, columns=["level", "place", "digest", "kind"])
    return out.assign(part=pdf["part"].iloc[0], group=pdf["group"].iloc[0], total=total, row=pd.array([None] * len(out), "Int64"), more=None)


_NODES = "part long, group string, total long, level int, place long, digest string, kind string, row long, more string"


def mountain_ranges(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Places of leaves and all nodes above them.

    ``leaves`` has ``group string, digest string, more string`` and the columns of ``order``; its
    rows are ordered by those, nulls first, then by digest. Returns rows of ``group, total, level,
    place, digest, kind, more``: kind ``leaf`` is a leaf, with ``more`` kept, ``node`` one above.
    The table is written.
    """
    by = [F.col(c).asc_nulls_first() for c in ("group", *order, "digest")]
    ranged = leaves.repartitionByRange(*by).sortWithinPartitions(*by).select("group", "digest", "more")
    indexed = written(ranged.mapInPandas(_numbered, "group string, digest string, more string, part long, row long"), "indexed")
    sizes = indexed.groupBy("part", "group").agg(F.count("*").alias("n"))
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = sizes.select(
        "part", "group", F.lit(False).alias("is_leaf"), F.lit(-1).cast("long").alias("row"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
        F.sum("n").over(Window.partitionBy("group")).alias("total"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("more"),
    )
    zero = F.lit(0).cast("long")
    rows = heads.unionByName(indexed.select("part", "group", F.lit(True).alias("is_leaf"), "row", zero.alias("start"), zero.alias("total"), "digest", "more"))
    rows = rows.repartition("part").sortWithinPartitions("part", F.col("group").asc_nulls_first(), "is_leaf", "row")
    stacked = written(rows.mapInPandas(_stacked, _NODES), "stacked")
    discard(indexed)
    tables = [stacked.where("kind in ('leaf', 'node')")]
    still = stacked.where("kind = 'open'")
    while not still.isEmpty():  # a partition's number loses digits each time, and number 0 leaves nothing open
        still = still.withColumn("part", F.floor(F.col("part") / NEAR))
        merged = written(still.groupBy("group", "part").applyInPandas(_merged, _NODES), "merged")
        tables.append(merged.where("kind = 'node'"))
        still = merged.where("kind = 'open'")
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.select("group", "total", "level", "place", "digest", "kind", "more")


def roots(nodes: DataFrame) -> DataFrame:
    """``group, total, level, digest`` of what remains of each group: its highest node."""
    top = F.max_by(F.struct("digest", "total"), "level").alias("top")
    return nodes.where("kind = 'node' or total = 1").groupBy("group").agg(F.max("level").alias("level"), top).select("group", "level", "top.digest", "top.total")


def _up(digests: list[str], levels: int, above: list[str]) -> list[list[str]]:
    """Path of every node of a block: siblings to the left and right, by level."""
    rows = [digests]
    for _ in range(levels):
        rows.append([digest(rows[-1][i : i + FAN]) for i in range(0, len(rows[-1]), FAN)])
    paths = [above]
    for row in reversed(rows[:-1]):
        step = []
        for i in range(len(row)):
            run = i // FAN * FAN
            step.append([f"{''.join(row[run:i])}|{''.join(row[i + 1 : run + FAN])}", *paths[i // FAN]])
        paths = step
    return paths


def fold(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for step in path:
        left, _, right = step.partition("|")
        leaf = hashlib.sha256(f"{left}{leaf}{right}".encode()).hexdigest()
    return leaf


def _blocks(level: int, each: Callable[[list, list[str], str], tuple], columns: list[str]):
    """Runs through blocks of nodes of ``level``, each led by what is said of its root, and its path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        said, path, rows = "", [], []

        def done():
            if rows:
                levels = min(height(rows[0][1]), level + STEP) - level
                return [each(r, p, said) for r, p in zip(rows, _up([r[3] for r in rows], levels, path), strict=True)]
            return []

        for batch in batches:
            out = []
            for *row, above in batch[["group", "total", "place", "digest", "more", "above"]].itertuples(index=False, name=None):
                if above is not None:
                    out += done()
                    said, _, steps = above.rpartition(";")
                    path, rows = steps.split(",") if steps else [], []
                elif not level or height(row[1]) > level:  # a root has no path within its tree
                    rows.append(row)
            if out:
                yield pd.DataFrame(out, columns=columns)
        if out := done():
            yield pd.DataFrame(out, columns=columns)

    return run


def _step(nodes: DataFrame, paths: DataFrame, level: int) -> DataFrame:
    """Nodes of a level, block by block in order, behind the path of their block's root."""
    block = F.floor(F.col("place") / FAN**STEP)
    rows = nodes.where(F.col("level") == level).select("group", block.alias("block"), "total", "place", "digest", "more", F.lit(None).cast("string").alias("above"))
    null = F.lit(None).cast("string")
    heads = paths.select("group", F.col("place").alias("block"), F.lit(0).cast("long").alias("total"), F.lit(-1).cast("long").alias("place"), null.alias("digest"), null.alias("more"), "above")
    return heads.unionByName(rows).repartition("group", "block").sortWithinPartitions(F.col("group").asc_nulls_first(), "block", "place")


def proofs(nodes: DataFrame, above: DataFrame, each: Callable[[list, list[str], str], tuple], schema: str) -> DataFrame:
    """``each(leaf, path, said)`` of all leaves, as rows of ``schema``.

    ``nodes`` is what :func:`mountain_ranges` returns; ``above`` has ``group, level, above``: a group's
    height, and ``said;path`` of its root, with the path in the tree over groups. A leaf is ``[group, total, place,
    digest, more]``, a path a list of ``left|right`` siblings, lowest first.
    """
    rounds = -(-max(above.agg(F.max("level")).first()[0] or 0, 1) // STEP)
    paths = None
    for k in range(rounds - 1, -1, -1):
        first = F.greatest(F.ceil(F.col("level") / STEP), F.lit(1)) - 1  # the round that meets a group's root
        mine = above.where(first == k).select("group", F.lit(0).cast("long").alias("place"), "above")
        paths = mine if paths is None else paths.unionByName(mine)
        inner = nodes if k else nodes.where("kind = 'leaf'")
        step = _step(inner, paths, k * STEP)
        if k:
            path = lambda row, p, said: (row[0], row[2], f"{said};{','.join(p)}")
            paths = written(step.mapInPandas(_blocks(k * STEP, path, ["group", "place", "above"]), "group string, place long, above string"), "paths")
    return step.mapInPandas(_blocks(0, each, [c.split()[0] for c in schema.split(", ")]), schema)


def leaf_hash(doc_id, source, lang, n_chars, text):
    """H of the columns in turn, each ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    each = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(each, (doc_id, source, lang, n_chars, text))).cast("binary"), 256)


def _proved(row: list, path: list[str], said: str) -> tuple:
    doc_id, tampered = row[4].split(",")
    subroot, root = said.split(";")
    folded = fold(tampered or row[3], path)
    siblings = hashlib.sha256("".join(path).replace("|", "").encode()).hexdigest()
    return int(doc_id) if doc_id else None, row[3], subroot, root, siblings, folded, folded == root


def _subpath(row: list, path: list[str], said: str) -> tuple:
    """For a source: its root and the whole one, and the path between them."""
    return row[4], f"{row[3]};{fold(row[3], path)};{','.join(path)}"


def manifest(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the trees of all sources, and of the tree over sources, as :func:`mountain_ranges` gives them."""
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    doc_id, text = F.col("doc_id"), F.col("text").cast("string")
    harmed = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(2)) == 0
    tampered = F.when(harmed & F.contains(text, F.lit("\n")), leaf_hash(*columns[:-1], F.replace(text, F.lit("\n"), F.lit(""))))
    more = F.concat_ws(",", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(tampered, F.lit("")))
    leaves = written(docs.select(F.col("source").cast("string").alias("group"), doc_id.cast("long").alias("doc_id"), leaf_hash(*columns).alias("digest"), more.alias("more")), "leaves")
    nodes = mountain_ranges(leaves, ["doc_id"])
    discard(leaves)
    subroots = roots(nodes).select(F.lit("").alias("group"), F.col("group").alias("source"), "digest", F.to_json(F.struct(F.col("group").alias("s"))).alias("more"))
    return nodes, mountain_ranges(written(subroots, "subroots"), ["source"])


def audit(docs: DataFrame) -> DataFrame:
    """Membership proofs of all documents, and whether what is there now still folds to the root.

    A leaf is the hash of ``doc_id, source, lang, n_chars, text``; a source's leaves ascend by
    doc_id, a null one first, rows that share one by their hashes. Sources ascend by their bytes,
    null first. What is there now is the documents with the \\n characters of text deleted where crc32 of doc_id
    in decimal is even (null ids and texts stay). Returns one row per input row: ``doc_id, leaf, subroot, root, proof_sha256,
    folded_root, verified``. proof_sha256 hashes the siblings in turn, the empty string for a
    dataset of one row. An empty table gives no rows. Other columns are ignored.
    """
    nodes, top = manifest(docs)
    whole = roots(top).select("group", "level", F.lit("").alias("above"))
    under = proofs(top, whole, _subpath, "more string, above string").select(F.from_json("more", "s string")["s"].alias("source"), "above")
    heights = roots(nodes).select("group", "level")
    above = written(heights.join(under, heights["group"].eqNullSafe(under["source"])).select("group", "level", "above"), "above")
    return proofs(nodes, above, _proved, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
