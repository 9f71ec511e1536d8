"""Document quads in segmentation masks, of any sizes: projections of arrays, and one aggregation.

A mask is one row, its probabilities a row-major array. Thresholds are rows; blurs, morphology, gradients,
edges and borders are worked out in the row, for the masks of an Arrow batch at once; sides and corners are
folds over a border. Nothing is shuffled but the quads found. Spark filters invalid quads and picks the best.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import contour as K
from vellum.functions import geometry as G
from vellum.functions import stacks as P
from vellum.operators import borders as B
from vellum.operators.boxes import min_area_rects
from vellum.operators.lineage import settled

#: Thresholds tried on still images and on live frames, least area of a quad.
STILL, LIVE, LEAST_AREA = (0.5, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95), (0.9,), 0.02


def sides() -> tuple[Column, Column]:
    return F.col("width"), F.col("height")


def _usable(masks: DataFrame) -> DataFrame:
    return masks.where("size(mask) = width * height and size(mask) > 0")


def _grays(p: Column) -> Column:
    return F.transform(p, lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.rint(e * 255).cast("int"))))


def edges(gray: Column, limit: Column | None = None) -> Column:
    """Places of the edge pixels of a grey image, refined as a mask and blurred; with a limit, of what lies above it."""
    return P.places(gray, *sides(), P.refined, P.blurred(5), P.crests, P.kept, limit=limit)


def _grayed(masks: DataFrame, *columns: str) -> DataFrame:
    return _usable(masks).select(*columns, "width", "height", _grays(F.col("mask")).alias("gray"))


def _largest(masks: DataFrame, id_col: str) -> DataFrame:
    rows = _grayed(masks, id_col).withColumn("rings", P.rings(edges(F.col("gray"))))
    return rows.select(id_col, "width", "height", B.largest_border(F.col("rings")).alias("best")).where("best is not null").select(id_col, "width", "height", "best.*")


def largest_contours(masks: DataFrame, id_col: str) -> DataFrame:
    """``id, points, area`` of ``id, mask, width, height``: the largest border about each mask's edges; none without area."""
    return _largest(masks, id_col).select(id_col, "points", "area")


def edge_pixels(masks: DataFrame, id_col: str) -> DataFrame:
    """``id, x, y`` of ``id, mask, width, height``: the edge pixels of each refined, blurred mask."""
    return B.pixels_at(_grayed(masks, id_col), [id_col], edges(F.col("gray")))


def quad_score(mask: Column, width: Column, points: Column) -> Column:
    """Mean probability in a quad of whole corners, its sides included, favouring area; 0 where it is tiny."""
    return G.let(P.quad_means(mask, width, points), lambda s: F.when(s["share"] < LEAST_AREA, 0.0).otherwise(s["mean"] * (0.7 + 0.3 * s["share"])))


def best_quads(masks: DataFrame, id_col: str, thresholds: tuple[float, ...] = STILL) -> DataFrame:
    """``id, points, score``: the best-scored quad over the thresholds, the first of equals.

    ``masks``: id, mask, width, height, and the photo's image_width and image_height, which a quad's
    corners must lie in. Masks without such a quad have no row.
    """
    photo_columns = (id_col, "mask", "image_width", "image_height")
    blurred = _grayed(masks, *photo_columns).withColumn("gray", P.filtered(F.col("gray"), *sides(), P.blurred(3)))
    limits = F.array(*(F.struct(F.lit(i).alias("nth"), F.lit(t * 255).alias("limit")) for i, t in enumerate(thresholds)))
    tried = blurred.withColumn("t", F.explode(limits)).withColumn("rings", P.rings(edges(F.col("gray"), F.col("t.limit"))))
    rings = tried.select(*photo_columns, "t.nth", "width", "height", B.largest_border(F.col("rings"))["points"].alias("points"))
    across, down = F.col("image_width") / F.col("width"), F.col("image_height") / F.col("height")
    photo = F.transform("points", lambda p: G.point(p["x"] * across, p["y"] * down))
    found = rings.select(*photo_columns, "nth", "width", across.alias("across"), down.alias("down"), K.quad_of_contour(photo).alias("photo"))
    found = found.withColumn("points", F.transform("photo", lambda p: G.point(p["x"] / F.col("across"), p["y"] / F.col("down"))))
    # filtered after the score, as Spark would copy the folds over borders into each filter before it
    scored = found.withColumn("score", quad_score(F.col("mask"), F.col("width"), F.col("points")))
    valid = F.forall("points", lambda p: p["x"].between(0, F.col("image_width")) & p["y"].between(0, F.col("image_height")))
    best = F.max_by(F.struct("points", "score"), F.struct("score", -F.col("nth")))
    return scored.where("points is not null and score > 0").where(valid).groupBy(id_col).agg(best.alias("best")).select(id_col, "best.*")


def document_quads(masks: DataFrame, id_col: str, live: bool = False) -> DataFrame:
    """``id, q``: the document's quad in each mask, in mask coordinates, null where none is found.

    On still images a mask without a quad gets the least-area box about its largest border.
    """
    found = settled(best_quads(masks, id_col, LIVE if live else STILL).select(id_col, "points"))
    if not live:
        rest = masks.join(found.select(id_col), id_col, "left_anti")
        hulls = _largest(rest, id_col).withColumn("points", K.convex_hull(F.col("points")))
        boxes = min_area_rects(hulls, [id_col, "width", "height"], F.col("points"), *sides())
        found = found.unionByName(boxes.select(id_col, F.col("corners").alias("points")))
    return masks.select(id_col).join(found, id_col, "left").select(id_col, G.create_quad(F.col("points")).alias("q"))
