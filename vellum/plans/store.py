"""Page store: load, reconcile, migrate, move, delete, rotate, export plan, file names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.functions import names as N
from vellum.operators import pages as P
from vellum.plans.registry import register
from vellum.plans.views import sql
from vellum.sources import tables as T

NAME = "id || coalesce('.' || lower(mode), '') || CASE WHEN quad_version > 0 THEN '.q' || quad_version ELSE '' END || '.jpg'"


@register("b5_processed_names", sql("pages", f"SELECT doc, position, {NAME} AS name FROM pages_"))
def b5(spark, d):
    return T.pages(spark, d).select("doc", "position", N.processed_name(F.col("id"), F.col("mode"), F.col("quad_version")).alias("name"))


@register("c1_page_metadata", sql("pages", """SELECT doc, position, CASE WHEN has_user_quad THEN round(10.0 + doc % 50 + 1, 4) ELSE round(10.0 + position % 50 + 1, 4) END AS left_x,
  rotation AS base_rotation, CASE WHEN colored THEN 'COLOR' ELSE 'GRAYSCALE' END AS auto_mode, source_width, source_height,
  round((focal_length / sensor_width)::DOUBLE, 4) AS focal_ratio, CASE WHEN focal_length IS NOT NULL AND sensor_width IS NOT NULL THEN subject_distance::DOUBLE END AS distance
FROM pages_ WHERE has_quad AND colored IS NOT NULL"""))
def c1(spark, d):
    """Metadata of pages that have a quad and a colour: the user's quad first, optics only where both lens values are there."""
    c = F.col
    quad = F.coalesce(c("user_quad"), c("quad"))
    known = c("focal_length").isNotNull() & c("sensor_width").isNotNull()
    return T.pages(spark, d).where(c("quad").isNotNull() & c("colored").isNotNull()).select(
        "doc", "position", F.round(quad["topLeft"]["x"], 4).alias("left_x"), c("rotation").alias("base_rotation"), F.when(c("colored"), "COLOR").otherwise("GRAYSCALE").alias("auto_mode"), "source_width",
        "source_height", F.round((c("focal_length") / c("sensor_width")).cast("double"), 4).alias("focal_ratio"), F.when(known, c("subject_distance").cast("double")).alias("distance"),
    )


@register("c2_valid_rotations", sql("pages", "SELECT doc, id FROM pages_ WHERE (rotation % 360 + 360) % 360 IN (0, 90, 180, 270)"))
def c2(spark, d):
    return T.pages(spark, d).where(P.valid_rotation(F.col("rotation"))).select("doc", "id")


@register("c7_files_of_page", sql("pages files", "SELECT p.id, count(f.name) AS n FROM pages_ p JOIN files f ON f.doc = p.doc AND (starts_with(f.name, p.id || '.') OR starts_with(f.name, p.id || '-')) GROUP BY p.id"))
def c7(spark, d):
    pages, files = T.pages(spark, d).select("doc", "id"), T.files(spark, d)
    return pages.join(files, "doc").where(N.belongs_to(F.col("name"), F.col("id"))).groupBy("id").agg(F.count("*").alias("n"))


@register("d5_pages_with_files", sql("pages files", "SELECT doc, position, id FROM pages_ WHERE (doc, id || '.jpg') IN (SELECT doc, name FROM files)"))
def d5(spark, d):
    return P.reconcile(T.pages(spark, d), T.files(spark, d), F.concat("id", F.lit(".jpg"))).select("doc", "position", "id")


@register("e13_newest_file", sql("pages files", "SELECT doc, arg_max(name, (mtime, name)) AS name FROM files GROUP BY doc"))
def e13(spark, d):
    return T.files(spark, d).groupBy("doc").agg(F.max_by("name", F.struct("mtime", "name")).alias("name"))


LEGACY = r"""SELECT doc, CASE WHEN strpos(name, '-') > 0 THEN array_to_string(list_slice(string_split(replace(name, '.jpg', ''), '-'), 1, -2), '-') ELSE replace(name, '.jpg', '') END AS id, name, strpos(name, '-') > 0 AS turned FROM files"""


@register("e15_legacy_groups", sql("pages files", f"SELECT doc, id, bool_or(NOT turned) AS has_base, min(CASE WHEN turned THEN name END) AS first_turned, count(*) AS n FROM ({LEGACY}) GROUP BY doc, id"))
def e15(spark, d):
    return P.legacy_groups(T.files(spark, d))


@register("k2_legacy_actions", sql("pages files", f"""SELECT doc, name, CASE WHEN NOT turned THEN 'keep' WHEN NOT has_base AND name = first_turned THEN 'rename' ELSE 'delete' END AS action,
  CASE WHEN turned AND NOT has_base AND name = first_turned THEN id || '.jpg' END AS target
  FROM ({LEGACY}) JOIN (SELECT doc, id, bool_or(NOT turned) AS has_base, min(CASE WHEN turned THEN name END) AS first_turned FROM ({LEGACY}) GROUP BY doc, id) USING (doc, id)"""))
def k2(spark, d):
    return P.legacy_actions(T.files(spark, d))


@register("i4_export_numbers", sql("pages", "SELECT doc, id, row_number() OVER (PARTITION BY doc ORDER BY position)::INTEGER AS n FROM pages_"))
def i4(spark, d):
    return T.pages(spark, d).select("doc", "id", F.row_number().over(Window.partitionBy("doc").orderBy("position")).alias("n"))


@register("i12_move_page", sql("pages", """, o AS (SELECT doc, id, row_number() OVER (PARTITION BY doc ORDER BY position) - 1 AS i, count(*) OVER (PARTITION BY doc) AS n FROM pages_),
m AS (SELECT doc, i AS src, greatest(0, least(n - 1, doc % 5 - 1)) AS dst FROM o WHERE id = doc || '_1')
SELECT o.doc, o.id, (CASE WHEN src IS NULL THEN i WHEN i = src THEN dst WHEN src < dst AND i > src AND i <= dst THEN i - 1 WHEN dst < src AND i >= dst AND i < src THEN i + 1 ELSE i END)::INTEGER AS position FROM o LEFT JOIN m USING (doc)"""))
def i12(spark, d):
    """Page 1 of each document goes to place doc mod 5 - 1; documents without one stay."""
    pages = T.pages(spark, d).select("doc", "position", "id")
    moves = pages.select("doc").distinct().select("doc", F.concat(F.col("doc").cast("string"), F.lit("_1")).alias("id"), (F.col("doc") % 5 - 1).alias("to"))
    return P.move(pages, moves).select("doc", "id", "position")


@register("i13_upsert", sql("pages", ", r AS (SELECT doc % 20 AS k, doc * 1000 + position AS seq, mode FROM pages_) SELECT k, min(seq) AS place, arg_max_null(mode, seq) AS mode FROM r GROUP BY k"))
def i13(spark, d):
    rows = T.pages(spark, d).select((F.col("doc") % 20).alias("k"), (F.col("doc") * 1000 + F.col("position")).alias("seq"), "mode")
    return P.upsert(rows, "k", "seq", ["mode"]).select("k", "place", "mode")


@register("i14_delete_pages", sql("pages", "SELECT doc, id FROM pages_ WHERE NOT (position % 4 = 2)"))
def i14(spark, d):
    pages = T.pages(spark, d)
    gone = pages.where("position % 4 = 2").select("id").union(spark.createDataFrame([("none",)], "id string"))
    return pages.join(gone, "id", "left_anti").select("doc", "id")


@register("k4_rotate_pages", sql("pages", "SELECT doc, id, ((rotation + CASE WHEN doc % 2 = 0 THEN 90 ELSE -90 END) % 360 + 360) % 360 AS rotation FROM pages_ WHERE rotation % 90 = 0"))
def k4(spark, d):
    return P.rotate(T.pages(spark, d).where(P.valid_rotation(F.col("rotation"))), F.col("doc") % 2 == 0).select("doc", "id", "rotation")


@register("k5_work_to_do", sql("pages files", f"SELECT doc, id, {NAME} AS name FROM pages_ WHERE ({NAME}) NOT IN (SELECT name FROM files)"))
def k5(spark, d):
    """Outputs that pages need and that aren't there yet."""
    needed = T.pages(spark, d).select("doc", "id", N.processed_name(F.col("id"), F.col("mode"), F.col("quad_version")).alias("name"))
    return needed.join(T.files(spark, d).select("name"), "name", "left_anti").select("doc", "id", "name")


@register("k7_unrotate_turns", sql("pages", "SELECT doc, id, ((4 - rotation // 90) % 4)::INTEGER AS turns FROM pages_ WHERE rotation % 90 = 0"))
def k7(spark, d):
    return T.pages(spark, d).where(P.valid_rotation(F.col("rotation"))).select("doc", "id", P.unrotate_turns(F.col("rotation")).alias("turns"))


@register("k8_view_keys", sql("pages", "SELECT doc, id, (manual_rotation + CASE WHEN has_quad AND colored IS NOT NULL THEN rotation ELSE 0 END) % 360 AS total, manual_rotation AS manual, mode, quad_version FROM pages_ WHERE rotation % 90 = 0"))
def k8(spark, d):
    """What a view of a page depends on, and its rotation in all: manual, plus the photo's where there is metadata."""
    pages = T.pages(spark, d).where(P.valid_rotation(F.col("rotation")))
    base = F.when(F.col("quad").isNotNull() & F.col("colored").isNotNull(), F.col("rotation"))
    return pages.select("doc", "id", P.total_rotation(F.col("manual_rotation"), base).alias("total"), F.col("manual_rotation").alias("manual"), "mode", "quad_version")


@register("k10_export_plan", sql("pages files", """SELECT doc, id, quality, CASE WHEN quality = 'LOW' THEN 'recompress' WHEN quality = 'HIGH' AND mode IS NOT NULL AND quad_version > 0 AND (doc, id || '.jpg') IN (SELECT doc, name FROM files) THEN 'reprocess' ELSE 'stored' END AS action,
  CASE quality WHEN 'LOW' THEN 60 WHEN 'HIGH' THEN 80 ELSE 75 END AS jpeg, CASE quality WHEN 'LOW' THEN 1000000 WHEN 'HIGH' THEN 4000000 ELSE 2000000 END AS budget
  FROM pages_, (VALUES ('LOW'), ('BALANCED'), ('HIGH')) q(quality)"""))
def k10(spark, d):
    return P.export_plan(T.pages(spark, d), T.files(spark, d)).select("doc", "id", "quality", "action", "jpeg", "budget")


@register("k13_stale_files", sql("pages files", "SELECT doc, name FROM files WHERE 100000 - mtime > 86400 OR (name LIKE '%-90.jpg' AND 100000 - mtime > 3600)"))
def k13(spark, d):
    """Retention: a day for all, an hour for one kind; strictly older goes."""
    age = 100_000 - F.col("mtime")
    return T.files(spark, d).where((age > 86_400) | (F.col("name").endswith("-90.jpg") & (age > 3_600))).select("doc", "name")


@register("b3_export_sizes", sql("pages files", "SELECT doc, count(*) AS pages, sum(bytes)::BIGINT AS bytes, (sum(bytes) // 1024)::BIGINT AS kb FROM files GROUP BY doc"))
def b3(spark, d):
    total = F.sum("bytes")
    return T.files(spark, d).groupBy("doc").agg(F.count("*").alias("pages"), total.alias("bytes"), F.floor(total / 1024).alias("kb"))


@register("b6_collision_names", sql("pages", """, wanted AS (SELECT doc, position, CASE WHEN position % 5 = 2 THEN 'f(1).pdf' ELSE 'f.pdf' END AS want, row_number() OVER (PARTITION BY doc ORDER BY position) AS i FROM pages_),
walk AS (
  SELECT doc, position, i, want AS name, [want] AS taken FROM wanted WHERE i = 1
  UNION ALL
  SELECT w.doc, w.position, w.i, n.name, list_append(k.taken, n.name) FROM walk k JOIN wanted w ON w.doc = k.doc AND w.i = k.i + 1,
    LATERAL (SELECT list_filter(list_concat([w.want], list_transform(range(1, w.i + 1), lambda c: replace(w.want, '.pdf', '') || '(' || c || ').pdf')), lambda c: NOT list_contains(k.taken, c))[1] AS name) n)
SELECT doc, position, name FROM walk""").replace("WITH ", "WITH RECURSIVE ", 1))
def b6(spark, d):
    """Files copied one after the other into a folder for each document, some wanting a name that another was given."""
    wanted = F.when(F.col("position") % 5 == 2, "f(1).pdf").otherwise("f.pdf")
    return P.free_names(T.pages(spark, d).select("doc", "position", wanted.alias("want")), ["doc"], "want", "position").select("doc", "position", "name")


@register("b7_rename_set", sql("pages files", "SELECT doc, name, CASE WHEN count(*) OVER (PARTITION BY doc) = 1 THEN 'scan.jpg' ELSE 'scan_' || row_number() OVER (PARTITION BY doc ORDER BY name) || '.jpg' END AS target FROM files"))
def b7(spark, d):
    w = Window.partitionBy("doc")
    target = F.when(F.count("*").over(w) == 1, "scan.jpg").otherwise(F.concat(F.lit("scan_"), F.row_number().over(w.orderBy("name")).cast("string"), F.lit(".jpg")))
    return T.files(spark, d).select("doc", "name", target.alias("target"))


@register("f28_file_names", "SELECT o_orderkey, CASE WHEN lower(n) LIKE '%.pdf' THEN n ELSE n || '.pdf' END AS name FROM (SELECT o_orderkey, coalesce(nullif(trim(CASE WHEN o_orderkey % 5 = 0 THEN '  ' ELSE o_orderpriority END), ''), 'Scan') || CASE o_orderkey % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.txt' ELSE '' END AS n FROM orders)")
def f28(spark, d):
    key = F.col("o_orderkey")
    base = N.or_default(F.when(key % 5 == 0, "  ").otherwise(F.col("o_orderpriority")), "Scan")
    name = F.concat(base, F.when(key % 3 == 0, ".PDF").when(key % 3 == 1, ".txt").otherwise(""))
    return T.table(spark, d, "orders").select("o_orderkey", N.with_extension(name).alias("name"))


@register("a11_settings", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'JPEG' WHEN '2-HIGH' THEN 'PDF' ELSE 'PDF' END AS format FROM orders")
def a11(spark, d):
    """A preference by name; null and unknown values mean the default."""
    value = F.when(F.col("o_orderpriority") == "1-URGENT", "JPEG").when(F.col("o_orderpriority") == "2-HIGH", "PDF")
    return T.table(spark, d, "orders").select("o_orderkey", F.coalesce(value, F.lit("PDF")).alias("format"))


@register("b4_document_json", sql("pages", """SELECT doc, position, id, rotation, manual_rotation, quad_version, mode, colored::INTEGER AS colored, CASE WHEN has_quad THEN round(10.0 + position % 50 + 1, 4) END AS quad_x,
  CASE WHEN has_user_quad THEN round(10.0 + doc % 50 + 1, 4) END AS user_x, focal_length::DOUBLE AS focal, sensor_width::DOUBLE AS sensor, subject_distance::DOUBLE AS distance, source_width, source_height FROM pages_"""))
def b4(spark, d):
    """Documents written as versioned JSON and read back: nothing is lost."""
    pages = T.pages(spark, d)
    place = pages.select("doc", "id", F.col("position").alias("at"))
    got = P.read_documents(P.write_documents(pages)).drop("position").join(place, ["doc", "id"])
    x = lambda c: F.round(F.col(c)["topLeft"]["x"], 4)
    return got.select(
        "doc", F.col("at").alias("position"), "id", "rotation", "manual_rotation", "quad_version", "mode", F.col("colored").cast("int").alias("colored"), x("quad").alias("quad_x"), x("user_quad").alias("user_x"), F.col("focal_length").cast("double").alias("focal"),
        F.col("sensor_width").cast("double").alias("sensor"), F.col("subject_distance").cast("double").alias("distance"), "source_width", "source_height",
    )


@register("k1_load_documents", sql("pages files", f"""SELECT doc, id FROM pages_ WHERE doc % 5 <> 4 AND (doc, {NAME}) IN (SELECT doc, name FROM files) AND (NOT has_quad OR colored IS NULL OR rotation % 90 = 0)
UNION ALL SELECT DISTINCT doc, CASE WHEN strpos(name, '-') > 0 THEN array_to_string(list_slice(string_split(replace(name, '.jpg', ''), '-'), 1, -2), '-') ELSE replace(name, '.jpg', '') END FROM files WHERE doc % 5 = 4"""))
def k1(spark, d):
    """Documents written as versioned JSON and read back strictly, against the files there are; of one in five the JSON is broken."""
    stored = P.write_documents(T.pages(spark, d)).withColumn("json", F.when(F.col("doc") % 5 == 4, F.concat(F.lit("x"), "json")).otherwise(F.col("json")))
    return P.load_documents(stored, T.files(spark, d)).select("doc", "id")
