"""Merkle fixity audit of web-archive replicas: descend only where roots differ.

Records are laid out in archives by ascending id, a bounded range of ids for each, with byte
offsets. Every record is hashed; FAN ordered neighbours make a range whose hash is that of their
hashes and offset ranges, and so on up to one root for each archive. Two replicas are compared at the roots, then
only below nodes that differ, level by level, down to the records. All steps are DataFrame joins
and aggregations; a record's bytes are hashed where they are read and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.tables import written

#: Children of a node; places of an archive, FAN ** LEVELS.
FAN, LEVELS = 16, 3
PLACES = FAN**LEVELS


def warc_record(url: str, html: str) -> Column:
    """The bytes of a WARC/1.0 response record: header lines, an empty line, the block, two line ends.

    A null url or html is empty. Line ends within a url, which no header can hold, become blanks.
    """
    uri, block = F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), "[\r\n]", " "), F.coalesce(F.col(html).cast("string"), F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), uri, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    return F.encode(F.concat(head, block, F.lit("\r\n\r\n")), "UTF-8")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").cast(pa.large_binary()), strict=True):
            raw, at, rows = content.as_py() or b"", 0, []
            while at < len(raw):
                body = raw.find(b"\r\n\r\n", at) + 4
                fields = dict(line.split(b": ", 1) for line in raw[at : body - 4].split(b"\r\n")[1:] if b": " in line) if body > 3 else {}
                size = fields.get(b"Content-Length", b"")
                if not raw.startswith(b"WARC/", at) or not size.isdigit() or body + int(size) + 4 > len(raw):
                    rows.append((path, at, len(raw) - at, None, None))  # what no record can be read from
                    break
                end = body + int(size) + 4
                rows.append((path, at, end - at, fields.get(b"WARC-Target-URI", b"").decode("utf-8", "replace"), raw[body : end - 4]))
                at = end
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "offset", "length", "url", "block"])


def read_records(files: DataFrame) -> DataFrame:
    """``path, offset, length, url, block`` of the records in files of ``path, content``.

    ``files`` is what ``spark.read.format("binaryFile")`` gives for uncompressed WARC files. From where
    no whole record follows, the rest of the file is one row with null url and block.
    """
    return files.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content")).mapInArrow(
        _parse, "path string, offset long, length long, url string, block binary"
    )


def archive_records(pages: DataFrame) -> DataFrame:
    """``archive, place, page_id, offset, length, digest`` of pages as :func:`warc_record` records.

    A record's archive and place are page_id div and mod PLACES (towards smaller numbers), so they don't move when another
    record is lost. Offsets count the bytes of the records before it. Rows that repeat a page_id
    share a place; such a place has one digest of their number and of the sums of the quarters of
    their digests, which is the same in any order. Rows without a page_id are in no archive.
    """
    rows = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), warc_record("url", "html").alias("record"))
    rows = rows.select("page_id", F.sha2("record", 256).alias("digest"), F.length("record").cast("long").alias("length"))
    quarters = [F.sum(F.conv(F.substring("digest", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")).alias(f"q{i}") for i in range(4)]
    single = rows.groupBy("page_id").agg(F.count("*").alias("n"), F.min("digest").alias("digest"), F.sum("length").alias("length"), *quarters)
    digest = F.when(F.col("n") == 1, F.col("digest")).otherwise(F.sha2(F.concat_ws(":", "n", "q0", "q1", "q2", "q3").cast("binary"), 256))
    placed = single.select(
        F.call_function("div", F.col("page_id") - F.pmod("page_id", F.lit(PLACES)), F.lit(PLACES)).alias("archive"), F.pmod("page_id", F.lit(PLACES)).cast("int").alias("place"), "page_id", "length", digest.alias("digest")
    )
    before = Window.partitionBy("archive").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # at most PLACES rows
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def tree(records: DataFrame) -> DataFrame:
    """``archive, level, node, digest, offset, end``: level 0 are records, LEVELS the roots.

    A node's hash is over its children in order: place, hash, and offset range from the node's start.
    """
    level = records.select("archive", F.lit(0).alias("level"), F.col("place").alias("node"), "digest", "offset", (F.col("offset") + F.col("length")).alias("end"))
    levels = [level]
    for k in range(1, LEVELS + 1):
        children = F.array_sort(F.collect_list(F.struct("node", "digest", "offset", "end")))  # at most FAN
        level = level.groupBy("archive", F.floor(F.col("node") / FAN).cast("int").alias("parent")).agg(
            children.alias("children"), F.min("offset").alias("offset"), F.max("end").alias("end")
        )
        child = lambda c: F.concat_ws("", c["node"], F.lit("="), c["digest"], F.lit("@"), c["offset"] - F.col("offset"), F.lit("-"), c["end"] - F.col("offset"))
        joined = F.array_join(F.transform("children", child), ",")
        level = level.select("archive", F.lit(k).alias("level"), F.col("parent").alias("node"), F.sha2(joined.cast("binary"), 256).alias("digest"), "offset", "end")
        levels.append(level)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Nodes in which two replicas' trees differ, found from the roots downwards.

    Returns ``archive, level, node, status, offset_a, end_a, offset_b, end_b``: status is
    ``changed``, or ``missing_a`` / ``missing_b`` where only the other replica has the node. Level 0
    rows are records. Equal replicas give no rows; of an archive that only one replica has, all
    nodes are missing from the other.
    """
    a, b = written(tree(left), "tree"), written(tree(right), "tree")
    key = ["archive", "node"]
    parents, found = None, []
    for k in range(LEVELS, -1, -1):
        sides = []
        for side, nodes in (("a", a), ("b", b)):
            level = nodes.where(F.col("level") == k)
            if parents is not None:  # children of nodes that differ, and no others
                level = level.withColumn("parent", F.floor(F.col("node") / FAN).cast("int")).join(parents, ["archive", "parent"], "left_semi")
            sides.append(level.select(*key, F.col("digest").alias(f"digest_{side}"), F.col("offset").alias(f"offset_{side}"), F.col("end").alias(f"end_{side}")))
        joined = sides[0].join(sides[1], key, "full").where("not (digest_a <=> digest_b)")
        status = F.when(F.col("digest_a").isNull(), "missing_a").when(F.col("digest_b").isNull(), "missing_b").otherwise("changed")
        differ = written(joined.select("archive", F.lit(k).alias("level"), "node", status.alias("status"), "offset_a", "end_a", "offset_b", "end_b"), "differ")
        found.append(differ)
        parents = differ.select("archive", F.col("node").alias("parent"))
    out = found[0]
    for differ in found[1:]:
        out = out.unionByName(differ)
    return out


def damaged_replica(pages: DataFrame) -> DataFrame:
    """A second replica to audit: a copy in which a rule by page_id harms some records.

    Of 97 pages in a row one has a byte appended, another one has its letters e changed to 3, and
    a third is lost.
    """
    at = F.pmod("page_id", F.lit(97))
    html = F.when(at == 13, F.concat("html", F.lit("\u0000"))).when(at == 41, F.translate("html", "e", "3")).otherwise(F.col("html"))
    return pages.where(at.isNull() | (at != 67)).withColumn("html", html)
