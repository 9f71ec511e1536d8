"""Queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import alignment, fixity, language, lines, manifest, minhash, mixing, neighbours, packing, tokens, topk, toxicity, vectors
from vellum.llm.tables import table


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(rows, rows.where(F.col("vec_id") % 100 == 0), k=10)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op3_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.marked_lines(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages together, with models fitted on the documents' languages."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    rows = language.document_rows(docs)
    model = language.train(rows)
    null = F.lit(None).cast("long")
    both = rows.withColumn("page_id", null).unionByName(language.page_rows(pages).withColumn("page_id", F.col("id")).withColumn("id", null))
    return language.identify(both, model, ["page_id"]).withColumnRenamed("id", "doc_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return fixity.audit(fixity.archive_records(pages), fixity.archive_records(fixity.damaged_replica(pages)))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.audit(table(spark, sf_dir, "documents"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.where(F.col("vec_id") % 20 == 0), k=20)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_top_k": op1_exact_top_k,
        "op2_token_counts": op2_token_counts,
        "op3_fuzzy_line_dedup": op3_fuzzy_line_dedup,
        "op4_source_mixing": op4_source_mixing,
        "op5_minhash_near_dedup": op5_minhash_near_dedup,
        "op6_language_id": op6_language_id,
        "op7_toxicity": op7_toxicity,
        "op8_packing": op8_packing,
        "op9_merkle_fixity": op9_merkle_fixity,
        "op10_embedding_near_dedup": op10_embedding_near_dedup,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_nearest_neighbours": op12_nearest_neighbours,
        "op13_token_alignment": op13_token_alignment,
    }


OP5_SQL = r"""
WITH RECURSIVE
words AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
rows AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM rows a JOIN rows b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id, doc_id AS c FROM documents
  UNION
  SELECT p.a AS doc_id, r.c FROM reach r JOIN pairs p ON p.b = r.doc_id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, r.c AS component_id, s.doc_id = r.c AS kept
FROM sets s JOIN (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id) r USING (doc_id)
"""


OP1_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score
  FROM vectors q JOIN vectors v ON q.vec_id <> v.vec_id AND len(q.x) = len(v.x) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 10
"""

OP10_SQL = """
WITH RECURSIVE
vectors AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_inner_product(a.x, b.x) >= 0.9 * sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))),
reach AS (
  SELECT vec_id, vec_id AS c FROM embeddings
  UNION
  SELECT l.a AS vec_id, r.c FROM reach r JOIN links l ON l.b = r.vec_id)
SELECT r.vec_id, coalesce(l.n, 0)::BIGINT AS n_links, r.c AS component_id, r.vec_id = r.c AS kept
FROM (SELECT vec_id, min(c) AS c FROM reach GROUP BY vec_id) r LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = r.vec_id
"""


OP9_SQL = """
WITH RECURSIVE
replicas AS (
  SELECT 'a' AS side, page_id, url, coalesce(html, '') AS block FROM pages WHERE page_id IS NOT NULL
  UNION ALL
  SELECT 'b', page_id, url, coalesce(
    CASE page_id % 97 WHEN 13 THEN html || chr(0) WHEN 41 THEN translate(html, 'e', '3') ELSE html END, '')
  FROM pages WHERE page_id IS NOT NULL AND page_id % 97 <> 67),
texts AS (
  SELECT side, page_id, replace('WARC/1.0|WARC-Type: response|WARC-Target-URI: ', '|', chr(13) || chr(10)) || regexp_replace(coalesce(url, ''), '[\r\n]', ' ', 'g')
    || chr(13) || chr(10) || 'Content-Length: ' || strlen(block) || chr(13) || chr(10) || chr(13) || chr(10) || block || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM replicas),
records AS (
  SELECT side, page_id // 4096 AS archive, page_id % 4096 AS node, sha256(record) AS digest, strlen(record) AS n FROM texts),
placed AS (
  SELECT side, archive, node, digest, sum(n) OVER w - n AS "offset", sum(n) OVER w AS "end" FROM records
  WINDOW w AS (PARTITION BY side, archive ORDER BY node)),
b0 AS (SELECT *, min("offset") OVER (PARTITION BY side, archive, node // 16) AS base FROM placed),
l1 AS (SELECT side, archive, node // 16 AS node, sha256(string_agg(node || '=' || digest || '@' || ("offset" - base) || '-' || ("end" - base), ',' ORDER BY node)) AS digest,
  min("offset") AS "offset", max("end") AS "end" FROM b0 GROUP BY side, archive, node // 16),
b1 AS (SELECT *, min("offset") OVER (PARTITION BY side, archive, node // 16) AS base FROM l1),
l2 AS (SELECT side, archive, node // 16 AS node, sha256(string_agg(node || '=' || digest || '@' || ("offset" - base) || '-' || ("end" - base), ',' ORDER BY node)) AS digest,
  min("offset") AS "offset", max("end") AS "end" FROM b1 GROUP BY side, archive, node // 16),
b2 AS (SELECT *, min("offset") OVER (PARTITION BY side, archive, node // 16) AS base FROM l2),
l3 AS (SELECT side, archive, node // 16 AS node, sha256(string_agg(node || '=' || digest || '@' || ("offset" - base) || '-' || ("end" - base), ',' ORDER BY node)) AS digest,
  min("offset") AS "offset", max("end") AS "end" FROM b2 GROUP BY side, archive, node // 16),
nodes AS (SELECT 0 AS level, * FROM placed UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 2, * FROM l2 UNION ALL SELECT 3, * FROM l3),
a AS (SELECT * FROM nodes WHERE side = 'a'), b AS (SELECT * FROM nodes WHERE side = 'b')
SELECT archive, level, node::INTEGER AS node,
  CASE WHEN a.digest IS NULL THEN 'missing_a' WHEN b.digest IS NULL THEN 'missing_b' ELSE 'changed' END AS status,
  a."offset"::BIGINT AS offset_a, a."end"::BIGINT AS end_a, b."offset"::BIGINT AS offset_b, b."end"::BIGINT AS end_b
FROM a FULL JOIN b USING (archive, level, node) WHERE a.digest IS DISTINCT FROM b.digest
"""


#: crc32 of a decimal id: eight shifts a byte, the polynomial where a 1 falls out.
OP11_SQL = """
WITH RECURSIVE
docs AS MATERIALIZED (
  SELECT *, row_number() OVER () AS r, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
      lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) END AS crc FROM documents),
texts AS (SELECT r, false AS harmed, * EXCLUDE (r) FROM docs UNION ALL SELECT r, true, * EXCLUDE (r) REPLACE (replace(text, chr(10), '') AS text) FROM docs WHERE crc & 1 = 0),
hashes AS MATERIALIZED (
  SELECT r, harmed, source, doc_id, sha256(list_reduce(list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text],
    lambda v: coalesce(strlen(v) || ':' || v, '-')), lambda a, b: a || b)) AS leaf FROM texts),
leaves AS MATERIALIZED (
  SELECT h.source, h.doc_id, h.leaf, coalesce(t.leaf, h.leaf) AS now,
    row_number() OVER (PARTITION BY h.source ORDER BY h.doc_id NULLS FIRST, h.leaf) - 1 AS i, count(*) OVER (PARTITION BY h.source) AS n
  FROM hashes h LEFT JOIN hashes t ON t.r = h.r AND t.harmed WHERE NOT h.harmed),
nodes AS (
  SELECT source, 0 AS level, i, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT source, level + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY source, level, i // 3),
sides AS MATERIALIZED (
  SELECT source, level, i, n, digest, coalesce(lag(digest, 2) OVER w, '') || coalesce(lag(digest, 1) OVER w, '') AS l,
    coalesce(lead(digest, 1) OVER w, '') || coalesce(lead(digest, 2) OVER w, '') AS r
  FROM nodes WINDOW w AS (PARTITION BY source, level, i // 3 ORDER BY i)),
subroots AS MATERIALIZED (
  SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM sides WHERE n = 1),
tops AS (
  SELECT 0 AS level, i, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 3),
top_sides AS MATERIALIZED (
  SELECT level, i, n, digest, coalesce(lag(digest, 2) OVER w, '') || coalesce(lag(digest, 1) OVER w, '') AS l,
    coalesce(lead(digest, 1) OVER w, '') || coalesce(lead(digest, 2) OVER w, '') AS r
  FROM tops WINDOW w AS (PARTITION BY level, i // 3 ORDER BY i)),
paths AS (
  SELECT source, doc_id, leaf, i AS place, 0 AS level, i, now AS folded, '' AS siblings FROM leaves
  UNION ALL
  SELECT p.source, p.doc_id, p.leaf, p.place, p.level + 1, p.i // 3, sha256(s.l || p.folded || s.r), p.siblings || s.l || s.r
  FROM paths p JOIN sides s ON s.source IS NOT DISTINCT FROM p.source AND s.level = p.level AND s.i = p.i WHERE s.n > 1),
low AS MATERIALIZED (
  SELECT p.*, s.i AS root_place, s.digest AS subroot FROM (SELECT * FROM paths QUALIFY row_number() OVER (PARTITION BY source, place ORDER BY level DESC) = 1) p
  JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source),
high AS (
  SELECT source, doc_id, leaf, subroot, place, 0 AS level, root_place AS i, folded, siblings FROM low
  UNION ALL
  SELECT p.source, p.doc_id, p.leaf, p.subroot, p.place, p.level + 1, p.i // 3, sha256(s.l || p.folded || s.r), p.siblings || s.l || s.r
  FROM high p JOIN top_sides s ON s.level = p.level AND s.i = p.i WHERE s.n > 1)
SELECT h.doc_id, h.leaf, h.subroot, t.digest AS root, sha256(h.siblings) AS proof_sha256, h.folded AS folded_root, h.folded = t.digest AS verified
FROM (SELECT * FROM high QUALIFY row_number() OVER (PARTITION BY source, place ORDER BY level DESC) = 1) h JOIN top_sides t ON t.n = 1
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_top_k": OP1_SQL,
        "op5_minhash_near_dedup": OP5_SQL,
        "op9_merkle_fixity": OP9_SQL,
        "op10_embedding_near_dedup": OP10_SQL,
        "op11_merkle_manifest": OP11_SQL,
    }
