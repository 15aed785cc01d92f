"""Operating points at the conformal line, and the metric family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.functions.scoring import two_view_score
from siftmark.operators import conformal, metrics
from siftmark.plans import bindings as B
from siftmark.plans.catalogue import query
from siftmark.plans.sql_tables import SCORES

KEYS = B.GROUP


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round to ``digits`` and drop the sign of zero, so that equal results compare equal."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in df.columns])


LINES_SQL = """
kept AS (
  SELECT dataset, category, seed, split, label, two_view AS score, path FROM scores
  WHERE NOT (dataset = 'F' AND split = 'test' AND label = 0 AND '/' || path NOT LIKE '%/test/good/%')),
threshold_rows AS (
  SELECT k.dataset, k.category, k.seed, k.score, k.split, k.label FROM kept k
  JOIN (SELECT dataset, category, seed,
               CASE WHEN sum(CASE WHEN split = 'calib' THEN 1 ELSE 0 END) > 0 THEN 'calib' ELSE 'val' END AS chosen
        FROM kept GROUP BY ALL) c
    ON k.dataset = c.dataset AND k.category = c.category AND k.seed = c.seed AND k.split = c.chosen),
ranked AS (
  SELECT dataset, category, seed, split, score,
         CASE WHEN label = 0 THEN row_number() OVER (PARTITION BY dataset, category, seed, label ORDER BY score) END AS rk,
         sum(1 - label) OVER (PARTITION BY dataset, category, seed) AS n,
         sum(label) OVER (PARTITION BY dataset, category, seed) AS n_def
  FROM threshold_rows),
lines AS (
  SELECT dataset, category, seed,
         max(CASE WHEN rk = CAST(ceil((n + 1)::DOUBLE * 0.95::DOUBLE) AS BIGINT) THEN score END) AS line,
         CAST(max(n) AS BIGINT) AS n_normals, CAST(max(n_def) AS BIGINT) AS n_defects, max(split) AS threshold_split
  FROM ranked GROUP BY ALL),
test_ranked AS (
  SELECT dataset, category, seed, label, score,
         rank() OVER (PARTITION BY dataset, category, seed ORDER BY score)
         + (count(*) OVER (PARTITION BY dataset, category, seed, score) - 1) / 2.0::DOUBLE AS rk
  FROM kept WHERE split = 'test'),
points AS (
  SELECT t.dataset, t.category, t.seed, max(line) AS line, max(n_normals) AS n_normals, max(n_defects) AS n_defects,
         CASE WHEN max(line) IS NOT NULL THEN avg(CASE WHEN label = 0 THEN (score > line)::INTEGER::DOUBLE END) END AS false_alarms,
         CASE WHEN max(line) IS NOT NULL THEN avg(CASE WHEN label = 1 THEN (score > line)::INTEGER::DOUBLE END) END AS recall,
         CASE WHEN sum(label) > 0 AND sum(1 - label) > 0 THEN
           (sum(CASE WHEN label = 1 THEN rk END) - sum(label)::DOUBLE * (sum(label) + 1)::DOUBLE / 2.0::DOUBLE)
           / (sum(label)::DOUBLE * sum(1 - label)::DOUBLE) END AS auroc
  FROM test_ranked t LEFT JOIN lines l
    ON t.dataset = l.dataset AND t.category = l.category AND t.seed = l.seed
  GROUP BY ALL)
"""


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = B.scores(spark, sf_dir).withColumn("score", two_view_score(F.col("views")))
    return conformal.like_for_like(scored, B.FOLDER_DATASETS)


@query(
    "conformal_headline",
    f"""WITH {SCORES}, {LINES_SQL}, by_category AS (
      SELECT dataset, category, avg(false_alarms) AS fa, avg(recall) AS rec, avg(auroc) AS auc FROM points GROUP BY ALL)
    SELECT dataset, round(avg(fa), 6) + 0.0 AS false_alarms, round(avg(rec), 6) + 0.0 AS recall,
           round(avg(auc), 6) + 0.0 AS auroc, count(fa) AS categories_with_line, count(*) AS categories
    FROM by_category GROUP BY dataset""",
)
def conformal_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = conformal.operating_points(_kept(spark, sf_dir), KEYS)
    return rounded(conformal.headline(points), "false_alarms", "recall", "auroc")


@query(
    "conformal_operating_points",
    f"""WITH {SCORES}, {LINES_SQL}
    SELECT dataset, category, seed, round(line, 6) + 0.0 AS line, n_normals, n_defects, round(false_alarms, 6) + 0.0 AS false_alarms,
           round(recall, 6) + 0.0 AS recall, round(auroc, 6) + 0.0 AS auroc,
           round(CASE WHEN false_alarms + recall > 0 THEN 0.05::DOUBLE * recall / (0.05::DOUBLE * recall + 0.95::DOUBLE * false_alarms) END, 6) + 0.0 AS precision_5
    FROM points""",
)
def conformal_operating_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = conformal.operating_points(_kept(spark, sf_dir), KEYS)
    return rounded(points, "line", "false_alarms", "recall", "auroc", "precision_5")


def _points_sql(alpha: str) -> str:
    lines = LINES_SQL.replace("0.95::DOUBLE", f"(1.0::DOUBLE - {alpha}::DOUBLE)")
    return f"""SELECT * FROM (WITH {SCORES}, {lines}
    SELECT {alpha}::DOUBLE AS alpha, dataset, category, seed, round(line, 6) + 0.0 AS line, n_normals, n_defects, round(false_alarms, 6) + 0.0 AS false_alarms,
           round(recall, 6) + 0.0 AS recall FROM points)"""


@query("operating_points_at_two_levels", f"{_points_sql('0.05')} UNION ALL {_points_sql('0.01')}")
def operating_points_at_two_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 % and the 1 % line of every group, from one placement of the scores."""
    points = conformal.operating_points_at(_kept(spark, sf_dir), KEYS, [0.05, 0.01])
    return rounded(points.drop("auroc", "precision_5"), "line", "false_alarms", "recall")
