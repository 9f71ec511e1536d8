"""The derived views of vellum.sources.tables as DuckDB common table expressions."""

Q = """10.0 + {q} AS tlx, 12.0 + 200 * {d} AS tly, 600.0 - {q} AS trx, 10.0 + 300 * {t} AS try_,
 620.0 - 100 * {d} AS brx, 460.0 - {q} AS bry, 15.0 + 100 * {t} AS blx, 450.0 - 200 * {d} AS bly"""

CTE = {
    "quads": "quads AS (SELECT l_orderkey, l_linenumber, " + Q.format(q="l_quantity", d="l_discount", t="l_tax") + " FROM lineitem)",
    "keyed": "keyed AS (SELECT o_orderkey, " + Q.format(q="(o_orderkey % 50 + 1)", d="((o_orderkey % 11) / 100.0::DOUBLE)", t="((o_orderkey % 9) / 100.0::DOUBLE)") + " FROM orders)",
    "pixels": """tiles AS (SELECT vec_id, list_transform(embedding, lambda e: greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5 + e::DOUBLE))) AS v FROM embeddings),
pixels AS (SELECT vec_id, (i % 8)::INTEGER AS x, (i // 8)::INTEGER AS y, v[i + 1] AS p, floor(255 * v[i + 1])::INTEGER AS b,
  floor(255 * v[(i + 21) % 64 + 1])::INTEGER AS g, floor(255 * v[(i + 42) % 64 + 1])::INTEGER AS r FROM tiles, range(64) AS t(i))""",
    "frames": "frames AS (SELECT user_id AS session, ts, event_id AS seq, event_type, CASE WHEN event_type <> 'error' THEN value % 40 END AS dx FROM events)",
    "pages": """pages_ AS (SELECT conv_id AS doc, turn AS position, conv_id || '_' || turn AS id,
  CASE role WHEN 'user' THEN 'COLOR' WHEN 'assistant' THEN 'GRAYSCALE' END AS mode,
  CASE WHEN (conv_id + turn) % 29 = 0 THEN 42 ELSE 90 * (turn % 4) END::INTEGER AS rotation, (turn % 3)::INTEGER AS quad_version,
  (1200 + 100 * (turn % 5))::INTEGER AS source_width, (1600 + 100 * (conv_id % 7))::INTEGER AS source_height,
  (90 * (conv_id % 4))::INTEGER AS manual_rotation, turn % 6 <> 5 AS has_quad, turn % 2 = 0 AS has_user_quad, CASE WHEN conv_id % 8 <> 7 THEN role = 'user' END AS colored,
  CASE WHEN turn % 3 > 0 THEN (turn % 3)::FLOAT END AS focal_length, CASE WHEN conv_id % 2 > 0 THEN 2.0::FLOAT END AS sensor_width, CASE WHEN turn % 4 > 0 THEN (turn * 100)::FLOAT END AS subject_distance FROM conversations)""",
    "files": """files AS (SELECT *, length(name) * 1000 + mtime AS bytes FROM (SELECT doc, id || '.jpg' AS name, ((doc * 1000 + position) * 7919 % 100000) AS mtime FROM pages_ WHERE (doc * 1000 + position) % 10 <> 3
  UNION ALL SELECT doc, id || CASE WHEN (doc * 1000 + position) % 8 = 1 THEN '-90' ELSE '-270' END || '.jpg', ((doc * 1000 + position) * 104729 % 100000)
  FROM pages_ WHERE (doc * 1000 + position) % 4 = 1))""",
    "words": r"""split AS (SELECT doc_id, regexp_split_to_array(text, '[ \n\t]+') AS w FROM documents),
placed AS (SELECT doc_id, (i - 1)::INTEGER AS pos, w[i] AS word FROM split, range(1, len(w) + 1) AS t(i) WHERE w[i] <> ''),
words AS (SELECT doc_id, pos, word, 20 + (pos % 12) * 80 AS "left", 30 + (pos // 12) * 40 AS top, 20 + (pos % 12) * 80 + least(length(word) * 7, 75) AS "right",
  54 + (pos // 12) * 40 AS bottom, 24 AS line_height, 52 + (pos // 12) * 40 AS line_bottom, (13 * length(word) + pos) % 101 AS confidence FROM placed)""",
    "images": """images AS (SELECT 'img' || doc_id || '.jpg' AS img, doc_id, toxic = 1 AS detected FROM labels
  UNION ALL SELECT 'lost' || doc_id || '.JPG', -doc_id - 1, true FROM labels WHERE doc_id % 10 = 5)""",
    "docs": """docs AS (SELECT doc_id, 0 AS row, quality = 1 AS colored FROM labels UNION ALL SELECT doc_id, 1, quality = 0 FROM labels WHERE doc_id % 10 = 0),
last_docs AS (SELECT doc_id, arg_max(colored, row) AS colored FROM docs GROUP BY doc_id)""",
    "contours": """shapes AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 4 THEN 4 ELSE 48 END AS per, CASE c_custkey % 5
    WHEN 1 THEN [{x: tlx + 60, y: tly}, {x: trx, y: try_}, {x: brx, y: bry}, {x: blx, y: bly}, {x: tlx, y: tly + 60}]
    WHEN 2 THEN [{x: tlx, y: tly}, {x: (tlx + trx) / 2, y: (tly + try_) / 2 - 14}, {x: trx, y: try_}, {x: brx, y: bry}, {x: blx, y: bly}]
    WHEN 3 THEN [{x: tlx, y: tly}, {x: trx, y: try_}, {x: trx + 30, y: 235.0}, {x: brx, y: bry}, {x: blx, y: bly}, {x: 2.0, y: 230.0}]
    ELSE [{x: tlx, y: tly}, {x: trx, y: try_}, {x: brx, y: bry}, {x: blx, y: bly}] END AS c
  FROM (SELECT c_custkey, """ + Q.format(q="(c_custkey % 50 + 1)", d="((c_custkey % 11) / 100.0::DOUBLE)", t="((c_custkey % 9) / 100.0::DOUBLE)") + """ FROM customer)),
contours AS MATERIALIZED (SELECT c_custkey, flatten(list_transform(c, lambda a, j: list_transform(range(per), lambda i:
    {x: round(a.x + (i / per::DOUBLE) * (c[j % len(c) + 1].x - a.x)), y: round(a.y + (i / per::DOUBLE) * (c[j % len(c) + 1].y - a.y))}))) AS p FROM shapes)""",
    "sizes": """sizes AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'Ratio' ELSE 'Physical' END AS kind, 100 + 4.0::DOUBLE * p_size AS width,
  (100 + 4.0::DOUBLE * p_size) * (1 + (p_partkey % 70) / 100.0::DOUBLE) AS height FROM part)""",
}


def sql(views: str, body: str) -> str:
    """A query over the named views."""
    return "WITH " + ",\n".join(CTE[v] for v in views.split()) + "\n" + body.strip()
