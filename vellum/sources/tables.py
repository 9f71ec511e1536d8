"""The driver's tables, and the page-image views that stand in for scanned documents.

There are no images among the tables, so quads, tiles, frames, pages, files, words and labels are
derived from them by plain expressions; SQL has the same ones as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import geometry as G

WIDTH, HEIGHT = 640.0, 480.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str, parts: int = 4) -> DataFrame:
    """``rows`` dealt to all cores, ``parts`` tasks each. A file of narrow rows may be one row group and so one task, however much each row costs."""
    return rows.repartition(parts * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def _quad(qty, disc, tax):
    p = lambda x, y: G.point(x.cast("double"), y.cast("double"))
    return G.quad(p(10 + qty, 12 + 200 * disc), p(600 - qty, 10 + 300 * tax), p(620 - 100 * disc, 460 - qty), p(15 + 100 * tax, 450 - 200 * disc))


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``l_orderkey, l_linenumber, q`` for every line item, in a 640 x 480 image."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", _quad(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")).alias("q"))


def keyed_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``o_orderkey, q``: one quad for each order."""
    return quads_of_keys(table(spark, sf_dir, "orders").select("o_orderkey"))


def quads_of_keys(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    return orders.select("o_orderkey", _quad((key % 50 + 1).cast("double"), (key % 11) / 100.0, (key % 9) / 100.0).alias("q"))


def contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``c_custkey, points``: a closed contour on whole pixels for each customer, 48 points a side.

    By key: a quad, one with a corner cut off, one with a bent side, a hexagon, and a quad of 16 points.
    """
    key = F.col("c_custkey")
    tl, tr, br, bl = G.corners(_quad((key % 50 + 1).cast("double"), (key % 11) / 100.0, (key % 9) / 100.0))
    cut = F.array(G.point(tl["x"] + 60, tl["y"]), tr, br, bl, G.point(tl["x"], tl["y"] + 60))
    bent = F.array(tl, G.point((tl["x"] + tr["x"]) / 2, (tl["y"] + tr["y"]) / 2 - 14), tr, br, bl)
    hexagon = F.array(tl, tr, G.point(tr["x"] + 30, F.lit(235.0)), br, bl, G.point(F.lit(2.0), F.lit(230.0)))
    kind = key % 5
    shape = F.when(kind == 1, cut).when(kind == 2, bent).when(kind == 3, hexagon).otherwise(F.array(tl, tr, br, bl))
    rows = spread(table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", shape.alias("c"), F.when(kind == 4, 4).otherwise(48).alias("per"))
    along = lambda a, b, i: F.round(G.lerp(a, b, i / F.col("per").cast("double")))
    side = lambda a, b: F.transform(F.sequence(F.lit(0), F.col("per") - 1), lambda i: G.point(along(a["x"], b["x"], i), along(a["y"], b["y"], i)))
    return rows.select("c_custkey", F.flatten(F.transform("c", lambda a, j: side(a, F.get("c", (j + 1) % F.size("c"))))).alias("points"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, x, y, p, b, g, r``: 8 x 8 tiles; p in [0, 1], the channels 8-bit."""
    rows = table(spark, sf_dir, "embeddings")
    p = F.transform("embedding", lambda e: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + e.cast("double"))))
    at = lambda shift: F.floor(255 * F.element_at("v", ((F.col("i") + shift) % 64 + 1).cast("int"))).cast("int")
    rows = rows.select("vec_id", p.alias("v")).select("vec_id", "v", F.posexplode("v").alias("i", "p"))
    return rows.select("vec_id", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), "p", at(0).alias("b"), at(21).alias("g"), at(42).alias("r"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, p, b, g, r``: the tiles of :func:`pixels` in rows, their values as arrays."""
    p = F.transform("embedding", lambda e: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + e.cast("double"))))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", p.alias("p")).withColumn("b", F.transform("p", lambda e: F.floor(255 * e).cast("int")))
    turned = lambda k: F.concat(F.slice("b", k + 1, 64 - k), F.slice("b", 1, k))
    return rows.withColumns({"g": turned(21), "r": turned(42)})


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``session, ts, seq, q``: ordered live frames; no quad where detection failed."""
    dx = F.col("value") % 40
    q = G.quad(*(G.point(F.lit(x) + dx, F.lit(y)) for x, y in ((10.0, 12.0), (600.0, 10.0), (620.0, 460.0), (15.0, 450.0))))
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("user_id").alias("session"), "ts", F.col("event_id").alias("seq"), "event_type", F.when(F.col("event_type") != "error", q).alias("q"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc, position, id, mode, rotation, manual_rotation, quad_version``, quads, colour and optics."""
    doc, turn = F.col("conv_id"), F.col("turn")
    bad = (doc + turn) % 29 == 0
    return table(spark, sf_dir, "conversations").select(
        doc.alias("doc"), turn.alias("position"), F.concat_ws("_", doc.cast("string"), turn.cast("string")).alias("id"),
        F.when(F.col("role") == "user", "COLOR").when(F.col("role") == "assistant", "GRAYSCALE").alias("mode"),
        F.when(bad, 42).otherwise(90 * (turn % 4)).cast("int").alias("rotation"), (turn % 3).cast("int").alias("quad_version"),
        (1200 + 100 * (turn % 5)).cast("int").alias("source_width"), (1600 + 100 * (doc % 7)).cast("int").alias("source_height"),
        (90 * (doc % 4)).cast("int").alias("manual_rotation"), F.when(turn % 6 != 5, _quad((turn % 50 + 1).cast("double"), (doc % 11) / 100.0, (turn % 9) / 100.0)).alias("quad"),
        F.when(turn % 2 == 0, _quad((doc % 50 + 1).cast("double"), (turn % 11) / 100.0, (doc % 9) / 100.0)).alias("user_quad"), F.when(doc % 8 != 7, F.col("role") == "user").alias("colored"),
        F.when(turn % 3 > 0, (turn % 3).cast("float")).alias("focal_length"), F.when(doc % 2 > 0, F.lit(2.0).cast("float")).alias("sensor_width"), F.when(turn % 4 > 0, (turn * 100).cast("float")).alias("subject_distance"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc, name, mtime, bytes``: files of nine pages in ten, and rotated legacy copies of some."""
    rows = pages(spark, sf_dir)
    key = F.col("doc") * 1000 + F.col("position")
    base = rows.where(key % 10 != 3).select("doc", F.concat("id", F.lit(".jpg")).alias("name"), (key * 7919 % 100000).alias("mtime"))
    turned = rows.where(key % 4 == 1).select("doc", F.concat("id", F.when(key % 8 == 1, "-90").otherwise("-270"), F.lit(".jpg")).alias("name"), (key * 104729 % 100000).alias("mtime"))
    return base.unionByName(turned).withColumn("bytes", (F.length("name") * 1000 + F.col("mtime")).cast("long"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, pos, word`` and its box: the words of every document, on lines of twelve."""
    return words_of(table(spark, sf_dir, "documents"))


def words_of(documents: DataFrame) -> DataFrame:
    rows = documents.select("doc_id", F.posexplode(F.split("text", r"[ \n\t]+")).alias("pos", "word")).where("word <> ''")
    left, top = 20 + (F.col("pos") % 12) * 80, 30 + F.floor(F.col("pos") / 12).cast("int") * 40
    return rows.select(
        "doc_id", "pos", "word", left.alias("left"), top.alias("top"), (left + F.least(F.length("word") * 7, F.lit(75))).alias("right"), (top + 24).alias("bottom"),
        F.lit(24).alias("line_height"), (top + 22).alias("line_bottom"), ((13 * F.length("word") + F.col("pos")) % 101).alias("confidence"),
    )


def evaluation_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``img, doc_id, detected``: an image for each label, and some whose document is unknown."""
    rows = table(spark, sf_dir, "labels")
    known = rows.select(F.concat(F.lit("img"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("img"), "doc_id", (F.col("toxic") == 1).alias("detected"))
    lost = rows.where("doc_id % 10 = 5").select(F.concat(F.lit("lost"), F.col("doc_id").cast("string"), F.lit(".JPG")).alias("img"), (-F.col("doc_id") - 1).alias("doc_id"), F.lit(True).alias("detected"))
    return known.unionByName(lost)


def evaluation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, row, colored``: rows of a document list in which some ids come twice."""
    rows = table(spark, sf_dir, "labels")
    first = rows.select("doc_id", F.lit(0).alias("row"), (F.col("quality") == 1).alias("colored"))
    again = rows.where("doc_id % 10 = 0").select("doc_id", F.lit(1).alias("row"), (F.col("quality") == 0).alias("colored"))
    return first.unionByName(again)


def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p_partkey, dims``: physical sizes near and far from paper formats, and some ratios."""
    w = 100 + 4.0 * F.col("p_size")
    dims = F.struct(F.when(F.col("p_partkey") % 5 == 0, "Ratio").otherwise("Physical").alias("kind"), w.alias("width"), (w * (1 + (F.col("p_partkey") % 70) / 100.0)).alias("height"))
    return table(spark, sf_dir, "part").select("p_partkey", dims.alias("dims"))


def newest_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
