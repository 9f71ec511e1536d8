"""Export of page sets: PDF documents with an invisible text layer, and mask images."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import metrology as M

WORD = ("font_size", "h_scale", "x", "baseline", "text")


@cache
def _character_map() -> bytes:
    """The ToUnicode map, packed: the same in every file."""
    spans = [b"<%02x00> <%02xff> <%02x00>" % (k, k, k) for k in range(256)]
    maps = b"\n".join(b"%d beginbfrange\n%s\nendbfrange" % (len(part), b"\n".join(part)) for part in (spans[i : i + 64] for i in range(0, 256, 64)))
    cmap = b"/CIDInit /ProcSet findresource begin\n12 dict begin\nbegincmap\n/CMapName /Units def\n/CMapType 2 def\n1 begincodespacerange\n<0000> <ffff>\nendcodespacerange\n" + maps + b"\nendcmap\nend\nend"
    return zlib.compress(cmap)


def pdf_bytes(pages: list[dict]) -> bytes:
    """A PDF file of pages ``width, height`` (points), ``jpeg`` (bytes or none) with ``image_width``
    and ``image_height``, and ``words`` (text, x, baseline, font_size, h_scale).

    A page's image fills it; words are written in invisible mode, as UTF-16 units of a font without
    glyphs whose characters are all half as wide as the font is high, so text of any script can be
    searched and copied.
    """
    packed = _character_map()
    objects: list[bytes] = [
        b"", b"", b"<< /Type /Font /Subtype /Type0 /BaseFont /Unseen /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 6 0 R >>",
        b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Unseen /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /DW 500 /FontDescriptor 5 0 R >>",
        b"<< /Type /FontDescriptor /FontName /Unseen /Flags 4 /FontBBox [0 0 500 1000] /ItalicAngle 0 /Ascent 1000 /Descent 0 /CapHeight 1000 /StemV 80 >>",
        b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(packed) + packed + b"\nendstream",
    ]
    kids = []
    for page in pages:
        draw, resources = [], b"/Font << /F1 3 0 R >>"
        if page.get("jpeg"):
            size = (page["image_width"], page["image_height"], len(page["jpeg"]))
            objects.append(b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /DCTDecode /Length %d >>\nstream\n" % size + page["jpeg"] + b"\nendstream")
            resources += b" /XObject << /Im %d 0 R >>" % len(objects)
            draw.append(b"q %.3f 0 0 %.3f 0 0 cm /Im Do Q" % (page["width"], page["height"]))
        # words are dicts, or columns of them: lists by name
        words = page["words"]
        columns = [words[n] for n in WORD] if isinstance(words, dict) else [[w[n] for w in words] for n in WORD]
        for size, scale, x, baseline, text in zip(*columns, strict=True):
            draw.append(b"BT /F1 %.3f Tf %.3f Tz 3 Tr 1 0 0 1 %.3f %.3f Tm <%s0020> Tj ET" % (size, scale, x, baseline, text.encode("utf-16-be", "replace").hex().encode()))
        stream = zlib.compress(b"\n".join(draw))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(stream) + stream + b"\nendstream")
        content = len(objects)
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.3f %.3f] /Resources << %s >> /Contents %d 0 R >>" % (page["width"], page["height"], resources, content))
        kids.append(len(objects))
    objects[0] = b"<< /Type /Catalog /Pages 2 0 R >>"
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    out, places = bytearray(b"%PDF-1.5\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % i + body + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start)
    return bytes(out)


def _document(table: pa.Table) -> pa.Table:
    """Words stay columns: no object is made for each of them."""
    pages = table.take(pc.sort_indices(table["position"], null_placement="at_end")).combine_chunks()
    of = {c: pages[c].to_pylist() for c in ("width", "height", "jpeg", "image_width", "image_height")}
    words = pages["words"].combine_chunks()
    rows = []
    for i in range(pages.num_rows):
        here = words[i].values
        rows.append({c: v[i] for c, v in of.items()} | {"words": {n: here.field(n).to_pylist() for n in WORD} if here is not None else []})
    return pa.table({"doc": pages["doc"].slice(0, 1), "n_pages": pa.array([len(rows)], pa.int64()), "pdf": pa.array([pdf_bytes(rows)], pa.binary())})


def pdf_documents(pages: DataFrame) -> DataFrame:
    """``doc, n_pages, pdf``: one file for each document, pages by position.

    ``pages``: doc, position, width, height (points), jpeg, image_width, image_height, words. A
    document's pages meet in one task, as a file is one value; documents are small.
    """
    return pages.groupBy("doc").applyInArrow(_document, "doc long, n_pages long, pdf binary")


def text_layer(words: DataFrame, keys: list[str], image_w: int, image_h: int, page_w: float, page_h: float) -> DataFrame:
    """Word boxes as ``words`` of a page: where and how large each is written, in reading order."""
    c = F.col
    sx, sy = page_w / image_w, page_h / image_h
    op = M.text_operators(c("word"), (c("right") - c("left")) * sx, c("line_height"), c("line_bottom"), F.lit(sy), F.lit(float(page_h)))
    rows = words.withColumn("op", op)
    item = F.struct(c("pos"), c("word").alias("text"), (c("left") * sx).alias("x"), c("op.baseline").alias("baseline"), c("op.font_size").alias("font_size"), c("op.h_scale").alias("h_scale"))
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("words"))


def png_bytes(gray: np.ndarray) -> bytes:
    """An 8-bit single-channel PNG file."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w = gray.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), gray.astype(np.uint8)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def mask_images(tiles: DataFrame, id_col: str, values: str, width: int) -> DataFrame:
    """``id, png``: probabilities in row-major arrays as PNG files of round(255 p)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            images = [png_bytes(np.rint(255 * np.asarray(v, np.float64)).reshape(-1, width)) for v in pdf["v"]]
            yield pd.DataFrame({id_col: pdf[id_col], "png": images})

    return tiles.select(id_col, F.col(values).alias("v")).mapInPandas(run, f"{id_col} long, png binary")
