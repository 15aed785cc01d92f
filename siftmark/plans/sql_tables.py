"""The bindings of ``bindings`` once more as ANSI SQL, for side-by-side checks."""

from __future__ import annotations

SCORES = """
raw_scores AS (
  SELECT l_linestatus AS dataset,
         'tax' || CAST(CAST(round(l_tax * 100) AS INTEGER) AS VARCHAR) AS category,
         CAST(year(l_shipdate) AS INTEGER) AS seed,
         CASE WHEN l_linenumber = 1 THEN 'val'
              WHEN l_linenumber = 2 AND l_linestatus = 'O' THEN 'calib'
              WHEN l_linenumber = 2 THEN 'val' ELSE 'test' END AS split,
         'tax' || CAST(CAST(round(l_tax * 100) AS INTEGER) AS VARCHAR) || '/' ||
         CASE l_returnflag WHEN 'A' THEN 'train/good' WHEN 'N' THEN 'test/good' ELSE 'test/defect' END || '/' ||
         concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) || '.png' AS path,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
         (CAST(l_quantity AS INTEGER) * 3 + CAST(round(l_discount * 100) AS INTEGER) * 10
           + CASE WHEN l_returnflag = 'R' THEN 40 ELSE 0 END)::DOUBLE / 47.0::DOUBLE - 2.0::DOUBLE AS v0,
         l_linenumber, l_discount, l_tax,
         1.0::DOUBLE + l_tax * 10 AS pos_weight,
         CAST(day(l_shipdate) AS INTEGER) AS day, l_linenumber AS line_no, l_quantity / 7.0::DOUBLE AS quantity, l_extendedprice / 7.0::DOUBLE AS price,
         l_discount / 7.0::DOUBLE AS discount
  FROM lineitem),
scores AS (
  SELECT *, v0 + (l_linenumber - 4)::DOUBLE / 8.0::DOUBLE AS v1, v0 - l_discount AS v2, v0 + l_tax AS v3,
         (v0 + (v0 - l_discount)) / 2.0::DOUBLE AS two_view
  FROM raw_scores)
"""

DOCS = """
docs AS (
  SELECT d.doc_id, d.lang AS category, d.source, 1 - l.quality AS label,
         floor(ln((length(text) - length(replace(text, ' ', ''))) + 1.0::DOUBLE) * 20.0::DOUBLE) / 20.0::DOUBLE - 5.0::DOUBLE AS score,
         d.lang || '/' || d.source || '/' || CAST(d.doc_id AS VARCHAR) AS path
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
"""

FILES = """
files AS (
  SELECT l_linestatus || CAST(year(l_shipdate) AS VARCHAR) || '/' ||
         CASE l_returnflag WHEN 'A' THEN 'train/good' WHEN 'N' THEN 'test/good' ELSE 'test/type' || CAST(l_linenumber AS VARCHAR) END || '/' ||
         concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) || '.png' AS path,
         CAST(trunc(l_extendedprice) AS BIGINT) AS length
  FROM lineitem),
records AS (
  SELECT path, split_part(path, '/', 1) AS category, split_part(path, '/', 2) AS folder, split_part(path, '/', 3) AS type,
         CASE WHEN split_part(path, '/', 3) = 'good' THEN 0 ELSE 1 END AS label,
         split_part(path, '/', 2) AS split
  FROM files)
"""

FEATURES = """
features AS (
  SELECT vec_id, CAST(floor(label / 2) AS INTEGER) AS category, CAST(label % 2 AS INTEGER) AS label, embedding FROM embeddings)
"""

GRIDS = """
grids AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor((v::DOUBLE + 1.0::DOUBLE) * 127.5::DOUBLE) AS INTEGER)) AS grid FROM embeddings)
"""


def r6(expression: str) -> str:
    """Six digits, and no negative zero."""
    return f"(round({expression}, 6) + 0.0)"


def curve(source: str, keys: str, score: str = "score") -> str:
    """CTEs ``tallied`` and ``curve``: distinct scores with tp and fp at or above them."""
    return f"""
tallied AS (SELECT {keys}, {score} AS score, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM {source} GROUP BY ALL),
curve AS (
  SELECT {keys}, score, pos, neg,
         sum(pos) OVER (PARTITION BY {keys} ORDER BY score DESC) AS tp, sum(neg) OVER (PARTITION BY {keys} ORDER BY score DESC) AS fp,
         sum(pos) OVER (PARTITION BY {keys}) AS p, sum(neg) OVER (PARTITION BY {keys}) AS n
  FROM tallied)
"""


AUROC_OF_CURVE = "CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum(pos * ((n - fp) + neg / 2.0::DOUBLE)) / (max(p) * max(n)) END"
AP_OF_CURVE = "CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum(pos * (tp / (tp + fp))) / max(p) END"


LATENCY = """
latency AS (
  SELECT CASE l_linenumber WHEN 1 THEN 'ours:net' WHEN 2 THEN 'ours:net+compile' WHEN 3 THEN 'ours:net+full' WHEN 4 THEN 'ours:net+full[x2]'
              WHEN 5 THEN 'rival+full' ELSE 'rival' END AS model,
         CAST(round(l_tax * 100) AS INTEGER) * 32 + 96 AS image_size, CASE l_linestatus WHEN 'O' THEN 'fp32' ELSE 'fp16' END AS precision,
         CASE l_returnflag WHEN 'R' THEN 'FAILED' ELSE 'ok' END AS status, l_extendedprice / 1000.0::DOUBLE AS ms, year(l_shipdate) < 1998 AS legacy
  FROM lineitem)
"""
