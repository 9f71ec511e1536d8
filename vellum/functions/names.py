"""File-name and language-name rules as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def processed_name(page_id: Column, mode: Column, quad_version: Column) -> Column:
    """id, then the colour mode and the quad's version where there are any."""
    return F.concat(page_id, F.coalesce(F.concat(F.lit("."), F.lower(mode)), F.lit("")), F.when(quad_version > 0, F.concat(F.lit(".q"), quad_version.cast("string"))).otherwise(""), F.lit(".jpg"))


def stem(name: Column) -> Column:
    """Name without its last extension."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def page_id_of(name: Column) -> Column:
    """Id in a legacy file name: without .jpg, cut at the last dash."""
    base = F.regexp_replace(name, r"\.jpg$", "")
    return F.regexp_replace(base, r"-[^-]*$", "")


def with_extension(name: Column, extension: str = ".pdf") -> Column:
    return F.when(F.lower(name).endswith(extension), name).otherwise(F.concat(name, F.lit(extension)))


def belongs_to(name: Column, page_id: Column) -> Column:
    """Whether a file is one of a page's: the id, then a dot or a dash."""
    return name.startswith(F.concat(page_id, F.lit("."))) | name.startswith(F.concat(page_id, F.lit("-")))


def is_image(name: Column, extensions: tuple[str, ...] = ("jpg", "jpeg")) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).isin(*extensions)


def or_default(text: Column, default: str) -> Column:
    """Trimmed text, or the default where nothing is left."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(default))


def list_fields(line: Column, names: list[str]) -> list[Column]:
    """Trimmed values of a line by position; null where the line has fewer."""
    return [F.trim(F.get(F.split(line, ","), F.lit(i))).alias(n) for i, n in enumerate(names)]


#: Language tags of OCR codes that aren't the code's part before "_".
LANGUAGE_TAGS = {
    "bod": "bo", "ces": "cs", "cym": "cy", "deu": "de", "ell": "el", "eus": "eu", "fas": "fa", "fra": "fr", "hye": "hy", "isl": "is", "kat": "ka", "kmr": "ku", "mkd": "mk", "mri": "mi",
    "msa": "ms", "mya": "my", "nld": "nl", "ron": "ro", "slk": "sk", "sqi": "sq", "chi_sim": "zh-CN", "chi_tra": "zh-TW", "chi_sim_vert": "zh-CN-vertical", "chi_tra_vert": "zh-TW-vertical",
    "jpn_vert": "ja-vertical", "kor_vert": "ko-vertical", "aze_cyrl": "az-Cyrl", "uzb_cyrl": "uz-Cyrl", "srp_latn": "sr-Latn", "deu_latf": "de-1901",
}


def language_tag(code: Column) -> Column:
    """Language tag of an OCR language code."""
    known = F.create_map(*(F.lit(x) for pair in LANGUAGE_TAGS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, code), F.substring_index(code, "_", 1))
