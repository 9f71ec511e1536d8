"""Operators of the page store: ordered pages of documents as rows ``doc, position, id, ...``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions import metrology as M
from vellum.functions import names as N

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
QUAD = T.StructType([T.StructField(n, POINT) for n in ("topLeft", "topRight", "bottomRight", "bottomLeft")])
PAGE = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("baseRotationDegrees", T.IntegerType()), T.StructField("manualRotationDegrees", T.IntegerType()),
        T.StructField("quad", QUAD), T.StructField("quadVersion", T.IntegerType()), T.StructField("userQuad", QUAD), T.StructField("isColored", T.BooleanType()),
        T.StructField("colorMode", T.StringType()), T.StructField("focalLength", T.FloatType()), T.StructField("sensorWidth", T.FloatType()),
        T.StructField("subjectDistance", T.FloatType()), T.StructField("sourceWidth", T.IntegerType()), T.StructField("sourceHeight", T.IntegerType()),
    ]
)
DOCUMENT = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("pages", T.ArrayType(PAGE))])
DOCUMENT_V1 = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("pages", T.ArrayType(T.StructType([T.StructField("file", T.StringType())])))])


def valid_rotation(degrees: Column) -> Column:
    return F.pmod(degrees, F.lit(360)).isin(0, 90, 180, 270)


def rotate(pages: DataFrame, clockwise: Column) -> DataFrame:
    """Turn pages by a quarter; pixels are left as they are."""
    return pages.withColumn("rotation", F.pmod(F.col("rotation") + F.when(clockwise, 90).otherwise(-90), F.lit(360)))


def unrotate_turns(degrees: Column) -> Column:
    """Quarter turns that undo a rotation."""
    return F.pmod(4 - F.floor(degrees / 90), F.lit(4)).cast("int")


def reconcile(pages: DataFrame, files: DataFrame, name: Column) -> DataFrame:
    """Pages whose file is there."""
    return pages.withColumn("name", name).join(files.select("doc", "name"), ["doc", "name"], "left_semi").drop("name")


def _legacy(files: DataFrame) -> DataFrame:
    """Files that old versions wrote: a dash in the name means rotated, and the id ends at the last one."""
    base = F.regexp_replace("name", r"\.jpg$", "")
    return files.select("doc", F.regexp_replace(base, "-[^-]*$", "").alias("id"), "name", F.contains("name", F.lit("-")).alias("turned"))


def legacy_groups(files: DataFrame) -> DataFrame:
    """Files of each page id: whether it has an unrotated one, and the first rotated one by name."""
    first = F.min(F.when(F.col("turned"), F.col("name")))
    return _legacy(files).groupBy("doc", "id").agg(F.bool_or(~F.col("turned")).alias("has_base"), first.alias("first_turned"), F.count("*").alias("n"))


def legacy_actions(files: DataFrame) -> DataFrame:
    """Keep unrotated files; rename the first rotated one where there is none; delete the rest."""
    rows = _legacy(files).join(legacy_groups(files).drop("n"), ["doc", "id"])
    rename = F.col("turned") & ~F.col("has_base") & (F.col("name") == F.col("first_turned"))
    action = F.when(~F.col("turned"), "keep").when(rename, "rename").otherwise("delete")
    return rows.select("doc", "name", action.alias("action"), F.when(rename, F.concat("id", F.lit(".jpg"))).alias("target"))


def move(pages: DataFrame, moves: DataFrame) -> DataFrame:
    """Move one page in each document of ``moves`` (doc, id, to) to a clamped place.

    Places count from 0. Documents without the page stay as they are. Places are worked out for
    each document on its own.
    """
    w = Window.partitionBy("doc")
    rows = pages.withColumn("i", F.row_number().over(w.orderBy("position")) - 1).withColumn("n", F.count("*").over(w))
    asked = rows.join(moves, ["doc", "id"]).select("doc", F.col("i").alias("src"), F.greatest(F.lit(0), F.least(F.col("n") - 1, F.col("to"))).alias("dst"))
    i, src, dst = F.col("i"), F.col("src"), F.col("dst")
    place = F.when(src.isNull(), i).when(i == src, dst).when((i > src) & (i <= dst), i - 1).when((i >= dst) & (i < src), i + 1).otherwise(i)
    return rows.join(asked, "doc", "left").withColumn("position", place.cast("int")).drop("i", "n", "src", "dst")


def upsert(rows: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """The last values of each key, at the place of its first row."""
    return rows.groupBy(key).agg(F.min(order).alias("place"), F.max_by(F.struct(*values), order).alias("v")).select(key, "place", *(f"v.{c}" for c in values))


def free_names(rows: DataFrame, keys: list[str], want: str, order: str) -> DataFrame:
    """Each row's name: the one it wants, or with (1), (2), ... before the extension the first free one.

    Rows take names one after the other, so a name may be taken by an earlier row that wants it or
    was given it. Only names with one stem can meet: brackets with numbers are cut off to find it,
    and the rows of a stem, few in a folder, are walked through in order.
    """
    stem, ext = F.regexp_replace(want, r"(?s)(.)\.[^.]*$", "$1"), F.regexp_extract(want, r"(?s).(\.[^.]*)$", 1)
    rows = rows.withColumn("stem_", stem).withColumn("ext_", ext).withColumn("family_", F.regexp_replace("stem_", r"(\(\d+\))+$", ""))
    one = F.struct(F.col(order).alias("o"), F.struct(*(F.col(c) for c in rows.columns if c not in keys and c not in ("ext_", "family_"))).alias("row"))
    groups = rows.groupBy(*keys, "family_", "ext_").agg(F.array_sort(F.collect_list(one)).alias("all_"))

    def take(names: Column, r: Column) -> Column:
        numbered = F.transform(F.sequence(F.lit(1), F.size(names) + 1), lambda k: F.concat(r["row"]["stem_"], F.lit("("), k.cast("string"), F.lit(")"), F.col("ext_")))
        free = F.element_at(F.filter(numbered, lambda n: ~F.array_contains(names, n)), 1)
        return F.concat(names, F.array(F.when(F.array_contains(names, r["row"][want]), free).otherwise(r["row"][want])))

    given = F.aggregate("all_", F.array().cast("array<string>"), take)
    pairs = groups.withColumn("pair_", F.explode(F.arrays_zip(F.col("all_").alias("r"), given.alias("name"))))
    return pairs.select(*keys, "pair_.r.row.*", F.col("pair_.name").alias("name")).drop("stem_")


def export_plan(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """What to do for each page and export quality: send as stored, recompress, or process anew."""
    have = sources.select("doc", "name").distinct().withColumn("there", F.lit(True))
    rows = pages.withColumn("name", F.concat("id", F.lit(".jpg"))).join(have, ["doc", "name"], "left")
    grid = F.array(*(F.struct(F.lit(n).alias("quality"), F.lit(j).alias("jpeg"), F.lit(p).alias("budget")) for n, j, p in M.EXPORT_QUALITIES))
    rows = rows.withColumn("g", F.explode(grid)).select("*", "g.*").drop("g")
    able = F.col("there").isNotNull() & F.col("mode").isNotNull() & (F.col("quad_version") > 0)
    return rows.withColumn("action", F.when(F.col("quality") == "LOW", "recompress").when((F.col("quality") == "HIGH") & able, "reprocess").otherwise("stored"))


#: Columns of a stored page beside doc, position and id, by their names in the file.
STORED = {
    "rotation": "baseRotationDegrees", "manual_rotation": "manualRotationDegrees", "quad": "quad", "quad_version": "quadVersion", "user_quad": "userQuad", "colored": "isColored",
    "mode": "colorMode", "focal_length": "focalLength", "sensor_width": "sensorWidth", "subject_distance": "subjectDistance", "source_width": "sourceWidth", "source_height": "sourceHeight",
}


def write_documents(pages: DataFrame) -> DataFrame:
    """``doc, json``: each document's ordered pages as versioned JSON. A document is one row.

    Of the columns of STORED those that ``pages`` lacks are written as null, rotations and the quad's version as 0.
    """
    zero = ("rotation", "manual_rotation", "quad_version")
    value = lambda c: F.col(c) if c in pages.columns else F.lit(0 if c in zero else None)
    page = F.struct(F.col("id"), *(value(c).cast(PAGE[name].dataType).alias(name) for c, name in STORED.items()))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col("position"), F.to_json(page, {"ignoreNullFields": "false"}).alias("page")))), lambda r: r["page"])
    whole = F.concat(F.lit('{"version":2,"pages":['), F.array_join(ordered, ","), F.lit("]}"))
    return pages.groupBy("doc").agg(whole.alias("json"))


def read_documents(documents: DataFrame) -> DataFrame:
    """``doc, position, id`` and the columns of STORED, of ``doc, json``.

    Version 2 is read, version 1 or none is migrated (the id is the file name, cut at its last dash
    behind the extension). A document that is malformed, of another version, or has an unknown key
    at the top or in a page, has no pages.
    """
    version = F.coalesce(F.get_json_object("json", "$.version").cast("int"), F.lit(1))
    strict = {"mode": "PERMISSIVE"}
    known = F.array(*(F.lit(n) for n in PAGE.names))
    each = F.from_json(F.get_json_object("json", "$.pages"), T.ArrayType(T.StringType()), strict)
    keys = F.forall(each, lambda p: F.size(F.array_except(F.json_object_keys(p), known)) == 0)
    top = F.size(F.array_except(F.json_object_keys("json"), F.array(F.lit("version"), F.lit("pages")))) == 0
    two = F.when((version == 2) & keys & top, F.from_json("json", DOCUMENT, strict)["pages"])
    whole = lambda c, v: F.coalesce(v, F.lit(0)) if c in ("rotation", "manual_rotation", "quad_version") else v
    new = F.transform(two, lambda p: F.struct(p["id"].alias("id"), *(whole(c, p[name]).alias(c) for c, name in STORED.items())))
    one = F.when((version == 1) & top, F.from_json("json", DOCUMENT_V1, strict)["pages"])
    empty = lambda c, name: F.lit(0 if c in ("rotation", "manual_rotation", "quad_version") else None).cast(PAGE[name].dataType)
    old = F.transform(one, lambda p: F.struct(N.page_id_of(p["file"]).alias("id"), *(empty(c, name).alias(c) for c, name in STORED.items())))
    rows = documents.select("doc", F.posexplode(F.coalesce(new, old)).alias("position", "p")).select("doc", "position", "p.*")
    return rows.where("id is not null")


def load_documents(documents: DataFrame, files: DataFrame) -> DataFrame:
    """``doc, position, id`` and the columns of STORED: pages whose file is there.

    ``documents`` are ``doc, json``, ``files`` are ``doc, name``. A folder without readable JSON gets its
    pages from the sorted names of its .jpg files, ids once each. An entry without a file, or whose
    rotation is no quarter turn, is left out.
    """
    stored = read_documents(documents)
    name = N.processed_name(F.col("id"), F.col("mode"), F.col("quad_version"))
    kept = reconcile(stored, files, name).where(valid_rotation(F.col("manual_rotation")))
    kept = kept.where(F.col("quad").isNull() | F.col("colored").isNull() | valid_rotation(F.col("rotation")))
    readable = stored.select("doc").distinct()
    listed = files.where(F.col("name").endswith(".jpg")).join(readable, "doc", "left_anti").select("doc", N.page_id_of(F.col("name")).alias("id"), "name")
    listed = listed.groupBy("doc", "id").agg(F.min("name").alias("name"))
    listed = listed.withColumn("position", (F.row_number().over(Window.partitionBy("doc").orderBy("name")) - 1).cast("int")).drop("name")
    return kept.unionByName(listed, allowMissingColumns=True)


def total_rotation(manual: Column, base: Column) -> Column:
    """Manual rotation plus that of the photo, where the page has one."""
    return F.pmod(manual + F.coalesce(base, F.lit(0)), F.lit(360))
