"""Offline evaluation: image and document lists, confusion counts, accuracy, grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import metrology as M
from vellum.functions import names as N
from vellum.plans.registry import register
from vellum.plans.views import sql
from vellum.sources import tables as T

CASES = "SELECT i.img, i.doc_id, d.colored AS expected, i.detected FROM images i JOIN last_docs d USING (doc_id)"


def cases(spark, d):
    """Images with the colour their document is listed with; of a repeated document the last row."""
    documents = T.newest_first(T.evaluation_documents(spark, d), ["doc_id"], ["row"])
    return T.evaluation_images(spark, d).join(documents.select("doc_id", F.col("colored").alias("expected")), "doc_id").select("img", "doc_id", "expected", "detected")


@register("d3_images_documents", sql("images docs", CASES))
def d3(spark, d):
    return cases(spark, d)


@register("e1_confusion_matrix", sql("images docs", f"SELECT expected, detected, count(*) AS n FROM ({CASES}) GROUP BY ALL"))
def e1(spark, d):
    return cases(spark, d).groupBy("expected", "detected").agg(F.count("*").alias("n"))


@register("e2_accuracy", sql("images docs", f"SELECT count(*) AS total, round(1 - sum((expected <> detected)::INTEGER)::DOUBLE / nullif(count(*), 0), 9) AS accuracy FROM ({CASES})"))
def e2(spark, d):
    """Null where there is nothing to evaluate."""
    wrong = F.sum((F.col("expected") != F.col("detected")).cast("long"))
    return cases(spark, d).agg(F.count("*").alias("total"), F.round(1 - F.try_divide(wrong, F.count("*")), 9).alias("accuracy"))


STEM = r"regexp_replace({}, '\.[^.]*$', '')"


def _masks(spark, d, by):
    rows = T.table(spark, d, "labels").where(F.col("doc_id") % by != 0)
    return rows.select(F.concat(F.lit("img"), F.col("doc_id").cast("string"), F.lit(".png")).alias("mask"))


@register("d1_image_mask", sql("images", f"SELECT i.img, m.mask FROM images i JOIN (SELECT 'img' || doc_id || '.png' AS mask FROM labels WHERE doc_id % 7 <> 0) m ON {STEM.format('i.img')} = {STEM.format('m.mask')}"))
def d1(spark, d):
    images, masks = T.evaluation_images(spark, d), _masks(spark, d, 7)
    return images.join(masks, N.stem(F.col("img")) == N.stem(F.col("mask"))).select("img", "mask")


@register("d2_image_two_masks", sql("images", f"SELECT i.img, a.mask AS mask_a, b.mask AS mask_b FROM images i JOIN (SELECT 'img' || doc_id || '.png' AS mask FROM labels WHERE doc_id % 7 <> 0) a ON {STEM.format('i.img')} = {STEM.format('a.mask')} JOIN (SELECT 'img' || doc_id || '.png' AS mask FROM labels WHERE doc_id % 5 <> 0) b ON {STEM.format('i.img')} = {STEM.format('b.mask')}"))
def d2(spark, d):
    key = lambda rows, c, n: rows.select(F.col(c).alias(n), N.stem(F.col(c)).alias("stem"))
    images = key(T.evaluation_images(spark, d), "img", "img")
    return images.join(key(_masks(spark, d, 7), "mask", "mask_a"), "stem").join(key(_masks(spark, d, 5), "mask", "mask_b"), "stem").drop("stem")


@register("d4_both_files_exist", sql("images", f"SELECT img FROM images WHERE doc_id IN (SELECT doc_id FROM labels WHERE doc_id % 3 <> 0) AND {STEM.format('img')} IN (SELECT 'img' || doc_id FROM labels WHERE doc_id % 7 <> 0)"))
def d4(spark, d):
    images = T.evaluation_images(spark, d).withColumn("stem", N.stem(F.col("img")))
    listed = T.table(spark, d, "labels").where("doc_id % 3 <> 0").select("doc_id")
    masks = _masks(spark, d, 7).select(N.stem(F.col("mask")).alias("stem"))
    return images.join(listed, "doc_id", "left_semi").join(masks, "stem", "left_semi").select("img")


@register("a1_image_scan", sql("images", r"SELECT img FROM images WHERE lower(regexp_extract(img, '\.([^.]*)$', 1)) IN ('jpg', 'jpeg')"))
def a1(spark, d):
    return T.evaluation_images(spark, d).where(N.is_image(F.col("img"))).select("img")


@register("a2_jpg_scan", sql("images", r"SELECT img FROM images WHERE lower(regexp_extract(img, '\.([^.]*)$', 1)) = 'jpg'"))
def a2(spark, d):
    return T.evaluation_images(spark, d).where(N.is_image(F.col("img"), ("jpg",))).select("img")


@register("a7_list_files", "SELECT 'img' || doc_id || '.jpg' AS img_name, doc_id::VARCHAR AS doc_id, doc_id % 3 = 0 AS colored FROM labels")
def a7(spark, d):
    """Lines of list files by position: blanks about values go, and quotes mean nothing."""
    key = F.col("doc_id").cast("string")
    told = F.when(F.col("doc_id") % 3 == 0, "True").otherwise("no")
    lines = T.table(spark, d, "labels").select(F.concat(F.lit(" img"), key, F.lit(".jpg ,"), key, F.lit(" , "), told).alias("line"))
    return lines.select(*N.list_fields(F.col("line"), ["img_name", "doc_id", "colored"])).withColumn("colored", F.lower("colored") == "true")


@register("a3_case_sensitive_glob", sql("images", "SELECT img FROM images WHERE img LIKE '%.jpg'"))
def a3(spark, d):
    return T.evaluation_images(spark, d).where(F.col("img").endswith(".jpg")).select("img").orderBy("img")


GRID = "(VALUES ('LOW', 60), ('BALANCED', 75), ('HIGH', 80)) q(quality, jpeg)"


@register("d7_export_grid", sql("images", f"SELECT img, quality, jpeg, budget FROM images, {GRID}, (VALUES (1500000), (2000000), (4000000)) b(budget)"))
def d7(spark, d):
    """Every image with each quality and pixel budget: nine fixed combinations for a row."""
    qualities = F.array(*(F.struct(F.lit(n).alias("quality"), F.lit(j).alias("jpeg")) for n, j, _ in M.EXPORT_QUALITIES))
    budgets = F.array(*map(F.lit, (1_500_000, 2_000_000, 4_000_000)))
    return T.evaluation_images(spark, d).select("img", F.explode(qualities).alias("q"), F.lit(0)).select("img", "q.*", F.explode(budgets).alias("budget"))


LANGS = "(VALUES ('en', 'eng'), ('fr', 'fra'), ('de', 'deu'), ('it', 'ita')) t(lang, code)"


def _codes(spark):
    return spark.createDataFrame([("en", "eng"), ("fr", "fra"), ("de", "deu"), ("it", "ita")], "lang string, code string")


@register("d6_languages_missing", f"SELECT code FROM {LANGS} WHERE lang NOT IN (SELECT lang FROM documents WHERE lang IS NOT NULL)")
def d6(spark, d):
    return _codes(spark).join(T.table(spark, d, "documents").select("lang").distinct(), "lang", "left_anti").select("code")


@register("i8_languages_enabled", f"SELECT lang FROM {LANGS} INTERSECT SELECT lang FROM documents")
def i8(spark, d):
    return _codes(spark).select("lang").intersect(T.table(spark, d, "documents").select("lang"))


@register("i9_languages_difference", f"SELECT lang FROM documents EXCEPT SELECT lang FROM {LANGS}")
def i9(spark, d):
    return T.table(spark, d, "documents").select("lang").exceptAll(_codes(spark).select("lang")).distinct().join(_codes(spark), "lang", "left_anti")


@register("a12_installed_languages", f"SELECT DISTINCT code FROM {LANGS} JOIN documents USING (lang)")
def a12(spark, d):
    return _codes(spark).join(T.table(spark, d, "documents"), "lang", "left_semi").select("code").distinct()


@register("e16_language_label", f"SELECT source, string_agg(DISTINCT code, '+' ORDER BY code) AS label FROM documents JOIN {LANGS} USING (lang) GROUP BY source")
def e16(spark, d):
    rows = T.table(spark, d, "documents").join(F.broadcast(_codes(spark)), "lang")  # four constant rows
    return rows.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("code")), "+").alias("label"))


@register("c5_confident_words", sql("words", "SELECT doc_id, pos, word FROM words WHERE confidence > 50"))
def c5(spark, d):
    return T.words(spark, d).where("confidence > 50").select("doc_id", "pos", "word")


@register("f5_word_rects", sql("words", 'SELECT doc_id, pos, round(("left"::FLOAT * (595::FLOAT/1000::FLOAT))::DOUBLE + 0.00123, 2) AS x, round((842::FLOAT - bottom::FLOAT * (842::FLOAT/60000::FLOAT))::DOUBLE + 0.00123, 2) AS y, round((("right" - "left")::FLOAT * (595::FLOAT/1000::FLOAT))::DOUBLE + 0.00123, 2) AS w FROM words WHERE confidence > 50'))
def f5(spark, d):
    """Boxes of confident words, on a page that is 60 000 pixels long."""
    c = F.col
    rect = M.pdf_rect(c("left"), c("top"), c("right"), c("bottom"), F.lit(1000), F.lit(60000), F.lit(595), F.lit(842))
    rows = T.words(spark, d).where("confidence > 50").withColumn("rect", rect)
    return rows.select("doc_id", "pos", *(F.round(F.col(f"rect.{n}").cast("double") + 0.00123, 2).alias(n) for n in "xyw"))


@register("f6_text_layer", sql("words", """SELECT doc_id, pos, round(0.8*24*0.5, 4) AS font_size, round(100*("right"-"left") / (length(word)*0.8*24*0.5/2), 3) AS h_scale,
  round(842 - line_bottom*0.5 + 0.2*0.8*24*0.5, 4) AS baseline FROM words WHERE confidence > 50"""))
def f6(spark, d):
    c = F.col
    t = M.text_operators(c("word"), (c("right") - c("left")).cast("double"), c("line_height"), c("line_bottom"), F.lit(0.5), F.lit(842.0))
    rows = T.words(spark, d).where("confidence > 50").withColumn("t", t)
    return rows.select("doc_id", "pos", F.round("t.font_size", 4).alias("font_size"), F.round("t.h_scale", 3).alias("h_scale"), F.round("t.baseline", 4).alias("baseline"))
