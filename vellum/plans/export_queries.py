"""PDF documents and mask images from the page-image views."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import stacks as P
from vellum.operators import enhance as H
from vellum.operators import export as E
from vellum.operators import jpeg as J
from vellum.plans import contour_queries as Q
from vellum.plans.registry import register
from vellum.sources import tables as T


@register("b2_pdf_documents")
def b2(spark, d):
    """Documents of text pages: 600 words on each A4 page."""
    # texts are dealt by document before they are split: words and pages then stay where they are
    documents = T.spread(T.table(spark, d, "documents").select("doc_id", "text"), "doc_id", parts=16)
    words = T.words_of(documents).where("confidence > 50").withColumn("position", F.floor(F.col("pos") / 600).cast("long"))
    shift = F.col("position") * 2000
    words = words.withColumns({"doc": F.col("doc_id"), "line_bottom": F.col("line_bottom") - shift})
    pages = E.text_layer(words, ["doc", "position"], 1000, 2100, 595.0, 842.0)
    none = lambda t: F.lit(None).cast(t)
    pages = pages.withColumns({"width": F.lit(595.0), "height": F.lit(842.0), "jpeg": none("binary"), "image_width": none("int"), "image_height": none("int")})
    return E.pdf_documents(pages).select("doc", "n_pages", F.length("pdf").alias("bytes"), F.crc32("pdf").alias("crc32"))


@register("b10_mask_images")
def b10(spark, d):
    rows = T.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda e: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + e.cast("double")))).alias("p"))
    return E.mask_images(rows, "vec_id", "p", 8).select("vec_id", F.length("png").alias("bytes"), F.crc32("png").alias("crc32"))


@register("b1_jpeg_files")
def b1(spark, d):
    """Tiles as JPEG files of quality 75."""
    channel = F.transform(F.arrays_zip("b", "g", "r"), lambda e: F.concat(*(F.lpad(F.hex(e[c]), 2, "0") for c in "bgr")))
    rows = T.tiles(spark, d).select("vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), F.unhex(F.array_join(channel, "")).alias("data"))
    return J.jpeg_files(rows, "vec_id", 75).select("vec_id", F.length("jpeg").alias("bytes"), F.crc32("jpeg").alias("crc32"))


def _photos(spark, d):
    """Photos of 48 x 36 pixels with a page in each: one for each supplier."""
    drawn = Q.drawn_masks(spark, d)
    return drawn.select("s_suppkey", "q", "width", "height", _painted(F.col("mask"), (F.col("s_suppkey") % 40 * 5 + 20).cast("int")).alias("data"))


def _painted(mask: Column, shade: Column) -> Column:
    """BGR bytes of a mask: a bright page with a shade at each seventh pixel, on dark ground."""

    def run(mask: pa.Array, shade: pa.Array) -> pa.Array:
        values, start = P.lists(mask)
        nth = np.arange(len(values)) - np.repeat(start[:-1], np.diff(start))
        page = values > 0.5
        bgr = np.where((page & (nth % 7 > 0))[:, None], (0xF0, 0xE8, 0xDC), (0x20, 0x24, 0x28)).astype(np.uint8)
        lines = page & (nth % 7 == 0)
        bgr[lines] = (0, 0xD0, 0xE0)
        bgr[lines, 0] = np.repeat(shade.to_numpy(zero_copy_only=False), np.diff(start))[lines]
        return pa.array([bgr[a:b].tobytes() for a, b in zip(start[:-1], start[1:], strict=True)], pa.binary())

    return F.arrow_udf(run, "binary").asNondeterministic()(mask, shade)


@register("g20_color_enhancement")
def g20(spark, d):
    return _enhanced(spark, d, "COLOR")


@register("g21_gray_enhancement")
def g21(spark, d):
    return _enhanced(spark, d, "GRAYSCALE")


def _enhanced(spark, d, mode):
    """The pages as they are, upright and in full size."""
    rows = _photos(spark, d).withColumns({"mode": F.lit(mode), "rotation": F.lit(0)})
    return H.extracted_documents(rows, "s_suppkey", 1_000_000).select("s_suppkey", "width", "height", F.length("data").alias("bytes"), F.crc32("data").alias("crc32"))


@register("g24_extracted_documents")
def g24(spark, d):
    key = F.col("s_suppkey")
    rows = _photos(spark, d).withColumns({"mode": F.when(key % 2 == 0, "COLOR").otherwise("GRAYSCALE"), "rotation": (key % 4 * 90).cast("int")})
    return H.extracted_documents(rows, "s_suppkey", 1_500).select("s_suppkey", "width", "height", F.length("data").alias("bytes"), F.crc32("data").alias("crc32"))
