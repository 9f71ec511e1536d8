"""Page sizes: paper formats, perspective, PDF points, pixel budgets; Columns to Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import geometry as G

# Paper formats in order of priority (mm), quality grid, and the largest page.
PAPER_FORMATS = (("A4", 210.0, 297.0), ("Letter", 215.9, 279.4), ("Legal", 215.9, 355.6), ("A5", 148.0, 210.0), ("A3", 297.0, 420.0))
EXPORT_QUALITIES = (("LOW", 60, 1_000_000), ("BALANCED", 75, 2_000_000), ("HIGH", 80, 4_000_000))
MAX_LONG_MM, MAX_SHORT_MM, MM_PER_INCH, POINTS_PER_INCH = 297.0, 215.9, 25.4, 72.0


def dimensions(kind: Column, width: Column, height: Column) -> Column:
    return F.struct(kind.alias("kind"), width.alias("width"), height.alias("height"))


def snap_to_format(dims: Column, ratio_tolerance: float = 0.04, dimension_tolerance: float = 0.20) -> Column:
    """The first paper format that physical dimensions come near in ratio and size."""
    w, h = F.least(dims["width"], dims["height"]), F.greatest(dims["width"], dims["height"])
    portrait = dims["width"] <= dims["height"]
    out = None
    for _, fw, fh in PAPER_FORMATS:
        near = (F.abs(h / w - fh / fw) / (fh / fw) < ratio_tolerance) & (F.greatest(F.abs(w - fw) / fw, F.abs(h - fh) / fh) < dimension_tolerance)
        own = F.when(portrait, dimensions(dims["kind"], F.lit(fw), F.lit(fh))).otherwise(dimensions(dims["kind"], F.lit(fh), F.lit(fw)))
        out = F.when((dims["kind"] == "Physical") & near, own) if out is None else out.when((dims["kind"] == "Physical") & near, own)
    return out.otherwise(dims)


def constrain_to_max(width: Column, height: Column) -> Column:
    """Shrink to the largest page, keeping the ratio."""
    scale = F.least(F.lit(MAX_LONG_MM) / F.greatest(width, height), F.lit(MAX_SHORT_MM) / F.least(width, height), F.lit(1.0))
    return F.struct((width * scale).alias("width"), (height * scale).alias("height"))


def page_points(dims: Column) -> Column:
    """PDF page size: physical size, or the longest side as 297 mm; constrained; in points."""
    scale = F.when(dims["kind"] == "Physical", 1.0).otherwise(MAX_LONG_MM / F.greatest(dims["width"], dims["height"]))
    fit = constrain_to_max(dims["width"] * scale, dims["height"] * scale)
    return F.struct(*((fit[n] * POINTS_PER_INCH / MM_PER_INCH).alias(n) for n in ("width", "height")))


def rotate_dimensions(dims: Column, degrees: Column) -> Column:
    """Width and height of physical dimensions change places at 90 and 270 degrees."""
    turn = (dims["kind"] == "Physical") & F.pmod(degrees, F.lit(360)).isin(90, 270)
    return F.when(turn, dimensions(dims["kind"], dims["height"], dims["width"])).otherwise(dims)


def average_sides(q: Column) -> tuple[Column, Column]:
    tl, tr, br, bl = G.corners(q)
    return (G.norm(tl, tr) + G.norm(bl, br)) / 2, (G.norm(tl, bl) + G.norm(tr, br)) / 2


def pixel_dimensions(dims: Column, q: Column) -> Column:
    """Output size in pixels: the quad's average area in the ratio of ``dims``."""
    w, h = average_sides(q)
    ratio = dims["height"] / dims["width"]
    width = F.sqrt(w * h / ratio)
    return F.struct(width.alias("width"), (width * ratio).alias("height"))


def _cross(a, b):
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _dot(a, b):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _length(a):
    return F.sqrt(_dot(a, a))


def with_real_dimensions(rows: DataFrame, q: str, width: float | Column, height: float | Column, focal_px: Column | None = None, distance: Column | None = None) -> DataFrame:
    """``rows`` with ``dims``: width and height of a page seen in perspective, from its quad ``q``.

    The vanishing points of both pairs of sides give the directions of the sides, and without
    optics the focal length too; corners are then projected back onto the page's plane. Average side
    lengths stand in where a pair of sides is parallel, the focal length isn't real, or it exceeds
    1.2 times the longer image side. With a subject distance the result is physical, else a ratio.
    The steps are columns of their own, so that shared terms are computed once.
    """
    c = F.col
    null = F.lit(None).cast("double")
    width, height = (v if isinstance(v, Column) else F.lit(float(v)) for v in (width, height))
    line = lambda a, b: _cross((a["x"], a["y"], F.lit(1.0)), (b["x"], b["y"], F.lit(1.0)))
    # a vector is three columns: arrays of them would cost an allocation and bounds checks at each use
    put = lambda name, vector: {f"{name}{i}": v for i, v in enumerate(vector)}
    xyz = lambda name: tuple(c(f"{name}{i}") for i in range(3))
    cx, cy = width / 2.0, height / 2.0
    ray = lambda x, y: ((x - cx) / c("_f"), (y - cy) / c("_f"), F.lit(1.0))
    tl, tr, br, bl = G.corners(c(q))
    out = rows.withColumns(put("_t", line(tl, tr)) | put("_o", line(bl, br)) | put("_l", line(tl, bl)) | put("_r", line(tr, br)) | {"_given": null if focal_px is None else focal_px, "_dist": null if distance is None else distance})
    out = out.withColumns(put("_h", _cross(xyz("_t"), xyz("_o"))) | put("_k", _cross(xyz("_l"), xyz("_r"))))
    z1, z2 = (F.when(F.abs(n) >= 1e-6, n) for n in (c("_h2"), c("_k2")))
    out = out.withColumns({"_ux": c("_h0") / z1 - cx, "_uy": c("_h1") / z1 - cy, "_vx": c("_k0") / z2 - cx, "_vy": c("_k1") / z2 - cy})
    out = out.withColumn("_f2", -(c("_ux") * c("_vx") + c("_uy") * c("_vy")))
    out = out.withColumn("_f", F.coalesce("_given", F.sqrt(F.when(c("_f2") > 0, c("_f2")))))
    out = out.withColumn("_f", F.when(c("_f2").isNotNull() & (c("_f") <= F.greatest(width, height) * 1.2), c("_f")))
    out = out.withColumns(put("_n", _cross((c("_ux"), c("_uy"), c("_f")), (c("_vx"), c("_vy"), c("_f")))) | put("_m", ray(*(sum(p[x] for p in (tl, tr, bl, br)) / 4.0 for x in ("x", "y")))))
    out = out.withColumn("_cos", F.abs(_dot(xyz("_m"), xyz("_n")) / _length(xyz("_m"))))
    out = out.withColumn("_known", F.when(c("_given").isNotNull() & (c("_cos") >= 0.1), c("_dist") * c("_cos")))
    corners = dict(zip(("_a", "_b", "_c", "_d"), (tl, tr, br, bl), strict=True))
    out = out.withColumns({f"{name}s": F.coalesce("_known", F.lit(1.0)) / _dot(xyz("_n"), ray(p["x"], p["y"])) for name, p in corners.items()})
    for name, p in corners.items():
        out = out.withColumns(put(name, (x * c(f"{name}s") for x in ray(p["x"], p["y"]))))
    apart = lambda a, b: _length(tuple(x - y for x, y in zip(xyz(a), xyz(b), strict=True)))
    w, h = average_sides(c(q))
    kind = F.when(c("_known").isNotNull(), "Physical").otherwise("Ratio")
    dims = dimensions(kind, F.coalesce((apart("_b", "_a") + apart("_c", "_d")) / 2, w), F.coalesce((apart("_d", "_a") + apart("_c", "_b")) / 2, h))
    return out.select(*rows.columns, dims.alias("dims"), c("_f").isNotNull().alias("perspective"))


def focal_in_pixels(focal: Column, sensor: Column, image_width: Column) -> Column:
    """In single precision, as optics are stored; null unless both measures are known."""
    return (focal.cast("float") / sensor.cast("float") * image_width.cast("float")).cast("float")


def budget_size(width: Column, height: Column, most: Column) -> Column:
    """Size within a pixel budget, both sides scaled by the root of the excess."""
    scale = F.when(width * height <= most, 1.0).otherwise(F.sqrt(most / (width * height)))
    return F.struct(F.floor(width * scale).cast("int").alias("width"), F.floor(height * scale).cast("int").alias("height"))


def capped_size(width: Column, height: Column, most: int = 12_000_000) -> Column:
    """Decoding cap: each side is scaled by the excess itself, so 24 MP become 6 MP."""
    pixels = (width * height).cast("double")
    scale = F.when(pixels <= most, 1.0).otherwise(most / pixels)
    return F.struct((width * scale).cast("int").alias("width"), (height * scale).cast("int").alias("height"))


def erosion_size(width: Column, height: Column) -> Column:
    """Odd kernel size for a page's border: 2 % of the shorter edge, 3 to 15."""
    k = F.greatest(F.lit(3), F.least(F.lit(15), F.floor(0.02 * F.least(width, height) + 0.5))).cast("int")
    return F.when(k % 2 == 0, k + 1).otherwise(k)


def pdf_rect(left: Column, top: Column, right: Column, bottom: Column, image_w: Column, image_h: Column, page_w: Column, page_h: Column) -> Column:
    """Image rectangle in PDF points, y upwards, in single precision."""
    sx, sy = page_w.cast("float") / image_w.cast("float"), page_h.cast("float") / image_h.cast("float")
    f = lambda c: c.cast("float")
    return F.struct(
        f(f(left) * sx).alias("x"), f(f(page_h) - f(bottom) * sy).alias("y"), f(f(right - left) * sx).alias("w"), f(f(bottom - top) * sy).alias("h")
    )


def text_operators(text: Column, width: Column, line_height: Column, line_bottom: Column, scale_y: Column, page_h: Column) -> Column:
    """Font size, horizontal scale, baseline and UTF-16 hex of a word of the text layer."""
    size = 0.8 * line_height * scale_y
    units = F.octet_length(F.encode(text, "UTF-16BE")) / 2
    natural = units * size / 2
    stretch = F.when(natural > 0, 100 * width / F.when(natural > 0, natural)).otherwise(100.0)
    return F.struct(
        size.alias("font_size"), stretch.alias("h_scale"), (page_h - line_bottom * scale_y + 0.2 * size).alias("baseline"), F.concat(F.hex(F.encode(text, "UTF-16BE")), F.lit("0020")).alias("hex")
    )
