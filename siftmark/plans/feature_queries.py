"""Probes, drift, grids, pooling, timing and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.functions import arrays as A
from siftmark.operators import blocks, conformal, grids, logistic, objectives, probes, scorers, timing, vectors
from siftmark.operators.joins import lookup
from siftmark.plans import bindings as B
from siftmark.plans.catalogue import query

from siftmark.plans.headline import LINES_SQL, rounded
from siftmark.plans.metric_queries import EPOCH_METRICS, EPOCH_STATS, FOLD, SELECTOR, trajectory
from siftmark.plans.sql_tables import FEATURES, GRIDS, LATENCY, SCORES, r6
from siftmark.session import scratch_dir
from siftmark.streaming import alarms, epochs

# Standardised features and leave-one-out scores, given a table ``zin`` (grp, id, label, x).
LOO = """
dims AS (SELECT grp, id, label, i, x[i]::DOUBLE AS v FROM zin, range(1, 65) t(i)),
mom AS (SELECT grp, i, avg(v) AS mu, stddev_pop(v) AS sd FROM dims GROUP BY ALL),
zs AS (SELECT d.grp, id, label, d.i, (v - mu) / (sd + 1e-9) AS z FROM dims d JOIN mom m ON d.grp = m.grp AND d.i = m.i),
"""


def loo_sql(zs: str, keys: str) -> str:
    """Probe scores from rows of standardised values (keys, id, label, i, z)."""
    on = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in keys.split(", "))
    mine = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""
  SELECT {keys}, id, label, sqrt(sum((z - m0) * (z - m0))) - sqrt(sum((z - m1) * (z - m1))) AS s FROM (
    SELECT {mine}, a.id, a.label, a.z, (s1 - z * a.label) / (n1 - a.label) AS m1, (s0 - z * (1 - a.label)) / (n0 - (1 - a.label)) AS m0
    FROM {zs} a JOIN (SELECT {keys}, i, sum(CASE WHEN label = 1 THEN z ELSE 0 END) AS s1, sum(CASE WHEN label = 0 THEN z ELSE 0 END) AS s0,
                             count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n0 FROM {zs} GROUP BY ALL) b
      ON {on} AND a.i = b.i)
  GROUP BY ALL"""


def auroc_sql(rows: str, keys: str, score: str = "s") -> str:
    return f"""
  SELECT {keys}, (sum(CASE WHEN label = 1 THEN rk END) - sum(label)::DOUBLE * (sum(label)::DOUBLE + 1) / 2) / (sum(label)::DOUBLE * sum(1 - label)::DOUBLE) AS auroc
  FROM (SELECT {keys}, label, rank() OVER (PARTITION BY {keys} ORDER BY {score}) + (count(*) OVER (PARTITION BY {keys}, {score}) - 1) / 2.0::DOUBLE AS rk FROM {rows})
  GROUP BY ALL HAVING sum(label) > 0 AND sum(1 - label) > 0"""


ZIN = "zin AS (SELECT category AS grp, vec_id AS id, label, embedding AS x FROM features)"


@query("loo_centroid_probe", f"WITH {FEATURES}, {ZIN}, {LOO} sc AS ({loo_sql('zs', 'grp')}), au AS ({auroc_sql('sc', 'grp')}) SELECT grp AS category, {r6('auroc')} AS auroc FROM au")
def loo_centroid_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(probes.loo_probe(B.feature_rows(spark, sf_dir), ["category"], "embedding"), "auroc")


N_PERM = 200


@query(
    "permutation_test",
    f"""WITH {FEATURES}, {ZIN}, {LOO} real AS ({loo_sql('zs', 'grp')}), ra AS ({auroc_sql('real', 'grp')}),
    shuffled AS (SELECT grp, id, perm, row_number() OVER (PARTITION BY grp, perm ORDER BY md5(perm || ':permute:' || id)) AS rk, n1
                 FROM zin JOIN (SELECT grp AS g, sum(label) AS n1 FROM zin GROUP BY ALL) ON grp = g, range({N_PERM}) p(perm)),
    zp AS (SELECT z.grp, p.perm, z.id, CASE WHEN rk <= n1 THEN 1 ELSE 0 END AS label, z.i, z.z FROM zs z JOIN shuffled p ON z.grp = p.grp AND z.id = p.id),
    ps AS ({loo_sql('zp', 'grp, perm')}), pa AS ({auroc_sql('ps', 'grp, perm')})
    SELECT pa.grp AS category, {r6('max(ra.auroc)')} AS probe_auroc, {r6(f'(1 + count(*) FILTER (WHERE pa.auroc >= ra.auroc)) / {N_PERM + 1}.0::DOUBLE')} AS p_high,
           {r6(f'(1 + count(*) FILTER (WHERE pa.auroc <= ra.auroc)) / {N_PERM + 1}.0::DOUBLE')} AS p_low
    FROM pa JOIN ra ON pa.grp = ra.grp GROUP BY pa.grp""",
)
def permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.feature_rows(spark, sf_dir)
    return rounded(probes.permutation_test(rows, ["category"], "vec_id", "embedding", n_perm=N_PERM), "probe_auroc", "p_high", "p_low")


@query(
    "negative_control",
    f"""WITH {FEATURES}, halves AS (SELECT category, vec_id, embedding, row_number() OVER (PARTITION BY category ORDER BY md5('0:control:' || vec_id)) AS rk,
        count(*) OVER (PARTITION BY category) AS n FROM features WHERE label = 0),
    zin AS (SELECT category AS grp, vec_id AS id, CASE WHEN rk <= floor(n / 2) THEN 1 ELSE 0 END AS label, embedding AS x FROM halves),
    {LOO} sc AS ({loo_sql('zs', 'grp')}), au AS ({auroc_sql('sc', 'grp')}) SELECT grp AS category, {r6('auroc')} AS auroc, abs(auroc - 0.5) > 0.15 AS control_failed FROM au""",
)
def negative_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(probes.negative_control(B.feature_rows(spark, sf_dir), ["category"], "vec_id", "embedding"), "auroc")


STATISTICS = ["quantity", "price", "discount"]


@query(
    "best_statistics",
    f"""WITH {SCORES}, long AS (SELECT dataset, category, label, 'quantity' AS statistic, quantity AS v FROM scores UNION ALL SELECT dataset, category, label, 'price', price FROM scores
      UNION ALL SELECT dataset, category, label, 'discount', discount FROM scores), au AS ({auroc_sql('long', 'dataset, category, statistic', 'v')})
    SELECT dataset, category, statistic, {r6('auroc')} AS auroc, {r6('abs(auroc - 0.5)')} AS strength,
           CAST(row_number() OVER (PARTITION BY dataset, category ORDER BY abs(auroc - 0.5) DESC, statistic DESC) AS INTEGER) AS rank
    FROM au QUALIFY rank <= 2""",
)
def best_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = probes.best_statistics(B.scores(spark, sf_dir), ["dataset", "category"], STATISTICS)
    return rounded(found, "auroc", "strength")


@query(
    "session_gaps",
    f"""WITH {SCORES}, s AS (SELECT dataset, category, CASE WHEN path LIKE '%/train/%' THEN 'train' ELSE 'test' END AS session, quantity, price, discount FROM scores WHERE label = 0),
    m AS (SELECT dataset, category, quantile_cont(price, 0.5) FILTER (WHERE session = 'test') AS bt, quantile_cont(price, 0.5) FILTER (WHERE session = 'train') AS br,
            quantile_cont(quantity, 0.5) FILTER (WHERE session = 'test') / (quantile_cont(quantity, 0.5) FILTER (WHERE session = 'train') + 1e-9) AS q,
            quantile_cont(discount, 0.5) FILTER (WHERE session = 'test') / (quantile_cont(discount, 0.5) FILTER (WHERE session = 'train') + 1e-12) AS d FROM s GROUP BY ALL)
    SELECT dataset, category, {r6('(bt / br - 1) * 100')} AS brightness_pct, abs(bt / br - 1) <= 0.2 AS inside_jitter, {r6('q')} AS quantity_ratio, {r6('d')} AS discount_ratio FROM m""",
)
def session_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.scores(spark, sf_dir).where("label = 0").withColumn("session", F.when(F.col("path").contains("/train/"), "train").otherwise("test"))
    found = probes.session_gaps(rows, ["dataset", "category"], "price", {"quantity": 1e-9, "discount": 1e-12})
    return rounded(found, "brightness_pct", "quantity_ratio", "discount_ratio")


JUDGED = f"""
judged AS (SELECT s.dataset, s.category, s.quantity, s.price, s.discount, CASE WHEN s.split = 'val' THEN 'val' WHEN s.two_view > l.line THEN 'alarm' ELSE 'other' END AS status
           FROM scores s LEFT JOIN lines l ON s.dataset = l.dataset AND s.category = l.category AND s.seed = l.seed
           WHERE s.label = 0 AND (s.split = 'val' OR (s.split = 'test' AND l.line IS NOT NULL AND s.path LIKE '%/test/%')))
"""


def _lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    scored = B.two_view_scores(spark, sf_dir)
    return scored, conformal.conformal_lines(conformal.like_for_like(scored, B.FOLDER_DATASETS), B.GROUP)


@query(
    "false_alarm_profile",
    f"""WITH {SCORES}, {LINES_SQL}, {JUDGED}, long AS (SELECT dataset, category, status, 'quantity' AS statistic, quantity AS v FROM judged
      UNION ALL SELECT dataset, category, status, 'price', price FROM judged UNION ALL SELECT dataset, category, status, 'discount', discount FROM judged),
    means AS (SELECT dataset, category, statistic, avg(v) FILTER (WHERE status = 'alarm') AS mean_alarm, avg(v) FILTER (WHERE status = 'other') AS mean_other,
                     avg(v) FILTER (WHERE status = 'val') AS mean_val FROM long GROUP BY ALL),
    t AS (SELECT *, CASE WHEN status = 'alarm' THEN 1 ELSE 0 END AS label FROM long WHERE status <> 'val'), au AS ({auroc_sql('t', 'dataset, category, statistic', 'v')})
    SELECT m.dataset, m.category, m.statistic, {r6('mean_alarm')} AS mean_alarm, {r6('mean_other')} AS mean_other, {r6('mean_val')} AS mean_val, {r6('auroc')} AS auroc
    FROM means m LEFT JOIN au a ON m.dataset = a.dataset AND m.category = a.category AND m.statistic = a.statistic""",
)
def false_alarm_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, lines = _lines(spark, sf_dir)
    judged = lookup(scored.where("label = 0"), lines.select(*B.GROUP, "line"), B.GROUP)
    tested = (F.col("split") == "test") & F.col("line").isNotNull() & F.col("path").contains("/test/")
    status = F.when(F.col("split") == "val", "val").when(tested & (F.col("score") > F.col("line")), "alarm").when(tested, "other")
    judged = judged.withColumn("status", status).where("status is not null")
    return rounded(probes.false_alarm_profile(judged, ["dataset", "category"], STATISTICS), "mean_alarm", "mean_other", "mean_val", "auroc")


ALARMS_SQL = f"""WITH {SCORES}, {LINES_SQL}
    SELECT s.dataset, s.category, s.seed, s.path, s.label, {r6('s.two_view')} AS score, {r6('l.line')} AS line, {r6('s.two_view - l.line')} AS margin
    FROM scores s JOIN lines l ON s.dataset = l.dataset AND s.category = l.category AND s.seed = l.seed
    WHERE s.split = 'test' AND s.two_view > l.line"""


@query("alarms_with_margin", ALARMS_SQL)
def alarms_with_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, lines = _lines(spark, sf_dir)
    found = conformal.alarms(scored.where("split = 'test'"), lines, B.GROUP)
    return rounded(found.select(*B.GROUP, "path", "label", "score", "line", "margin"), "score", "line", "margin")


# Newton steps of 25 fits on three standardised features; the 4 x 4 system is solved by its Cholesky factor.
LOGISTIC_SQL = f"""WITH RECURSIVE e AS (SELECT vec_id, CAST(label >= 5 AS INT) AS label, embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS x2, embedding[3]::DOUBLE AS x3 FROM embeddings),
    f AS (SELECT e.*, rep, (row_number() OVER (PARTITION BY rep, label ORDER BY md5(rep || ':fold:' || vec_id)) - 1) % 5 AS fold FROM e, range(5) r(rep)),
    t AS (SELECT f.*, k FROM f, range(5) q(k) WHERE fold <> k),
    m AS (SELECT rep, k, {', '.join(f'avg(x{i}) AS m{i}, stddev_pop(x{i}) + 1e-9 AS s{i}' for i in (1, 2, 3))} FROM t GROUP BY ALL),
    z AS (SELECT t.rep, t.k, label, 1.0::DOUBLE AS z0, {', '.join(f'(x{i} - m{i}) / s{i} AS z{i}' for i in (1, 2, 3))} FROM t JOIN m ON t.rep = m.rep AND t.k = m.k),
    w AS (SELECT 0 AS step, rep, k, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS w3 FROM m UNION ALL
      SELECT step + 1, rep, k, w0 - d0, w1 - d1, w2 - d2, w3 - d3 FROM (
        SELECT *, sqrt(h00) AS l00, h01 / l00 AS l10, h02 / l00 AS l20, h03 / l00 AS l30,
          sqrt(h11 + 1 - l10 * l10) AS l11, (h12 - l20 * l10) / l11 AS l21, (h13 - l30 * l10) / l11 AS l31,
          sqrt(h22 + 1 - l20 * l20 - l21 * l21) AS l22, (h23 - l30 * l20 - l31 * l21) / l22 AS l32, sqrt(h33 + 1 - l30 * l30 - l31 * l31 - l32 * l32) AS l33,
          g0 / l00 AS a0, (g1 + w1 - l10 * a0) / l11 AS a1, (g2 + w2 - l20 * a0 - l21 * a1) / l22 AS a2, (g3 + w3 - l30 * a0 - l31 * a1 - l32 * a2) / l33 AS a3,
          a3 / l33 AS d3, (a2 - l32 * d3) / l22 AS d2, (a1 - l21 * d2 - l31 * d3) / l11 AS d1, (a0 - l10 * d1 - l20 * d2 - l30 * d3) / l00 AS d0
        FROM (SELECT step, rep, k, w0, w1, w2, w3, {', '.join(f'0.5 * sum((p - label) * z{i}) AS g{i}' for i in range(4))},
                {', '.join(f'0.5 * sum(p * (1 - p) * z{i} * z{j}) AS h{i}{j}' for i in range(4) for j in range(i, 4))}
              FROM (SELECT w.*, z.* EXCLUDE (rep, k), 1 / (1 + exp(-(w0 + w1 * z1 + w2 * z2 + w3 * z3))) AS p FROM w JOIN z ON w.rep = z.rep AND w.k = z.k WHERE step < 12)
              GROUP BY step, rep, k, w0, w1, w2, w3))),
    o AS (SELECT f.rep, label, w0 + w1 * (x1 - m1) / s1 + w2 * (x2 - m2) / s2 + w3 * (x3 - m3) / s3 AS s
          FROM f JOIN m ON m.rep = f.rep AND m.k = fold JOIN w ON w.rep = f.rep AND w.k = fold AND step = 12),
    au AS ({auroc_sql('o', 'rep')}) SELECT {r6('avg(auroc)')} AS auroc FROM au"""


@query("logistic_probe", LOGISTIC_SQL)
def logistic_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = F.slice("embedding", 1, 3).alias("features")
    rows = B.table(spark, sf_dir, "embeddings").select("vec_id", few, (F.col("label") >= 5).cast("int").alias("label"))
    return rounded(logistic.logistic_probe(rows, [], "vec_id", "features"), "auroc")


@query(
    "centroid_drift",
    f"""WITH x AS (SELECT vec_id, CASE WHEN label < 5 THEN 'normal' WHEN label < 9 THEN 'anomaly' ELSE 'augmented' END AS role, i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i)),
    c AS (SELECT i, avg(v) FILTER (WHERE role = 'normal') AS cn, avg(v) FILTER (WHERE role = 'anomaly') AS ca FROM x GROUP BY i),
    d AS (SELECT vec_id, role, sqrt(sum((v - cn) * (v - cn))) AS dn, sqrt(sum((v - ca) * (v - ca))) AS da FROM x JOIN c USING (i) GROUP BY ALL),
    m AS (SELECT avg(dn) FILTER (WHERE role = 'augmented') AS dn, avg(da) FILTER (WHERE role = 'augmented') AS da, avg(dn) FILTER (WHERE role = 'normal') AS bn,
                 avg(da) FILTER (WHERE role = 'normal') AS ba FROM d)
    SELECT 'all' AS "run", {r6('dn / da')} AS drift_ratio, {r6('bn / ba')} AS baseline_ratio, dn / da <= 0.95 AS passed FROM m""",
)
def centroid_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("label") < 5, "normal").when(F.col("label") < 9, "anomaly").otherwise("augmented")
    rows = B.table(spark, sf_dir, "embeddings").select(F.lit("all").alias("run"), role.alias("role"), "embedding")
    return rounded(grids.centroid_drift(rows, ["run"], "embedding"), "drift_ratio", "baseline_ratio")


@query(
    "pairwise_variety",
    f"""WITH p AS (SELECT a.label, a.vec_id, b.vec_id, sqrt(list_sum(list_transform(range(1, 65), lambda i: power(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2)))) AS d
      FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id)
    SELECT e.label, e.n, {r6('avg(d)')} AS mean_distance, {r6('min(d)')} AS min_distance, avg(d) >= 0.02 AS passed FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label) e
    LEFT JOIN p ON p.label = e.label GROUP BY ALL""",
)
def pairwise_variety(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocks.pairwise_spread(B.table(spark, sf_dir, "embeddings"), ["label"], "vec_id", "embedding")
    return rounded(found, "mean_distance", "min_distance")


@query(
    "session_alignment",
    f"""WITH {FEATURES}, u AS (SELECT category, vec_id, embedding[1] > 0 AS t, i, embedding[i]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))) AS v
      FROM features, range(1, 65) r(i) WHERE label = 0),
    c AS (SELECT category, i, avg(v) AS m FROM u WHERE NOT t GROUP BY ALL),
    d AS (SELECT u.category, vec_id, sum((v - m) * (v - m)) AS d FROM u JOIN c ON u.category = c.category AND u.i = c.i WHERE t GROUP BY ALL)
    SELECT category, {r6('avg(d)')} AS alignment, count(*) AS n_aligned FROM d GROUP BY category""",
)
def session_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = objectives.session_alignment(B.feature_rows(spark, sf_dir), ["category"], "embedding", F.col("embedding")[0] > 0)
    return rounded(found, "alignment")


E64 = "list_transform(embedding, lambda v: v::DOUBLE)"


@query(
    "array_pooling",
    f"""WITH e AS (SELECT vec_id, {E64} AS x FROM embeddings),
    t AS (SELECT *, list_sum(x) / 64 AS avg_pool, list_max(x) AS max_pool,
            power(list_sum(list_transform(x, lambda v: power(greatest(v, 1e-6), 3.0::DOUBLE))) / 64, 1.0::DOUBLE / 3.0::DOUBLE) AS gem_pool,
            list_max(x) + (ln(list_sum(list_transform(x, lambda v: exp(2.0::DOUBLE * (v - list_max(x)))))) - ln(64.0::DOUBLE)) / 2.0::DOUBLE AS lse_pool,
            list_sum(list_transform(x, lambda v: v * exp(v - list_max(x)))) / list_sum(list_transform(x, lambda v: exp(v - list_max(x)))) AS attention_pool,
            list_sum(list_reverse_sort(x)[1:7]) / 7 AS top_mean FROM e)
    SELECT vec_id, {', '.join(r6(c) + ' AS ' + c for c in ('avg_pool', 'max_pool', 'gem_pool', 'lse_pool', 'attention_pool', 'top_mean'))}, {r6('(avg_pool + max_pool)')} AS avg_max_sum FROM t""",
)
def array_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = B.table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x"))
    v = F.col("x")
    both = A.pool("avgmax", v)
    out = rows.select(
        "vec_id",
        A.pool("avg", v).alias("avg_pool"),
        A.pool("max", v).alias("max_pool"),
        A.pool("gem", v, 3.0).alias("gem_pool"),
        A.pool("lse", v, 2.0).alias("lse_pool"),
        A.pool("attention", v, v).alias("attention_pool"),
        A.top_fraction_mean(v, 0.1).alias("top_mean"),
        (both[0] + both[1]).alias("avg_max_sum"),
    )
    return rounded(out, *[c for c in out.columns if c != "vec_id"])


@query(
    "pools_from_sql",
    f"""WITH e AS (SELECT vec_id, {E64} AS x FROM embeddings), t AS (SELECT *, list_max(x) AS top FROM e)
    SELECT vec_id, {r6('list_sum(x) / 64')} AS avg_pool, {r6('top')} AS max_pool, {r6('list_sum(x) / 64 + 2 * top')} AS avg_max_mix,
      {r6('power(list_sum(list_transform(x, lambda v: power(greatest(v, 1e-6), 3.0::DOUBLE))) / 64, 1.0::DOUBLE / 3.0::DOUBLE)')} AS gem_pool,
      {r6('list_sum(list_transform(x, lambda v: greatest(v, 1e-6))) / 64')} AS gem_of_one,
      {r6('top + (ln(list_sum(list_transform(x, lambda v: exp(2.0::DOUBLE * (v - top))))) - ln(64.0::DOUBLE)) / 2.0::DOUBLE')} AS lse_pool,
      {r6('list_sum(list_transform(x, lambda v: v * exp(v - top))) / list_sum(list_transform(x, lambda v: exp(v - top)))')} AS attention_pool
    FROM t""",
)
def pools_from_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six pools called from SQL text; an exponent below its range is held at one."""
    A.register_sql_functions(spark)
    rows = B.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    found = spark.sql(
        """SELECT vec_id, pool_avg(x) AS avg_pool, pool_max(x) AS max_pool, pool_avgmax(x)[0] + 2 * pool_avgmax(x)[1] AS avg_max_mix, pool_gem(x) AS gem_pool,
           pool_gem(x, 0.5D) AS gem_of_one, pool_lse(x, 2D) AS lse_pool, pool_attention(x, x) AS attention_pool FROM {rows}""",
        rows=rows,
    )
    return rounded(found, *[c for c in found.columns if c != "vec_id"])


@query(
    "standardised_features",
    f"""WITH x AS (SELECT label, vec_id, i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i)),
    m AS (SELECT label, i, avg(v) AS mu, stddev_pop(v) AS sd FROM x GROUP BY ALL),
    z AS (SELECT x.label, vec_id, x.i, (v - mu) / (sd + 1e-9) AS z FROM x JOIN m ON x.label = m.label AND x.i = m.i)
    SELECT label, vec_id, {r6('sqrt(sum(z * z))')} AS length, {r6('max(abs(z))')} AS largest FROM z GROUP BY ALL""",
)
def standardised_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")
    z = vectors.standardised(rows, ["label"], "embedding")
    largest = F.array_max(F.transform("z", lambda v: F.abs(v)))
    return rounded(z.select("label", "vec_id", A.norm(F.col("z")).alias("length"), largest.alias("largest")), "length", "largest")


def _lap(i: str) -> str:
    """Wrapping Laplacian of cell i (from 0) of an 8 x 8 grid."""
    row, col = f"({i} // 8)", f"({i} % 8)"
    cell = lambda r, c: f"grid[(({r} + 8) % 8) * 8 + (({c} + 8) % 8) + 1]"
    return f"(-4 * grid[{i} + 1] + {cell(row + ' - 1', col)} + {cell(row + ' + 1', col)} + {cell(row, col + ' - 1')} + {cell(row, col + ' + 1')})::DOUBLE"


GRID_STATS = f"""
cells AS (SELECT vec_id, label, i, grid[i + 1]::DOUBLE AS v, {_lap('i')} AS lap, (i // 32) * 2 + (i % 8) // 4 AS tile FROM grids, range(0, 64) t(i)),
whole AS (SELECT vec_id, avg(v) AS mean, stddev_pop(v) AS sd, var_pop(lap) AS energy FROM cells GROUP BY vec_id),
tiles AS (SELECT vec_id, avg(sd) AS contrast FROM (SELECT vec_id, tile, stddev_pop(v) AS sd FROM cells GROUP BY ALL) GROUP BY vec_id)
"""


@query(
    "grid_texture",
    f"WITH {GRIDS}, {GRID_STATS} SELECT vec_id, {r6('energy')} AS hf_energy, {r6('contrast')} AS local_contrast, {r6('sd')} AS single_tile FROM whole JOIN tiles USING (vec_id)",
)
def grid_texture(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("grid")
    out = B.grids(spark, sf_dir).select(
        "vec_id",
        grids.hf_energy(g, 8, 8).alias("hf_energy"),
        grids.local_contrast(g, 8, 8, 4).alias("local_contrast"),
        grids.local_contrast(g, 8, 8, 16).alias("single_tile"),
    )
    return rounded(out, "hf_energy", "local_contrast", "single_tile")


@query(
    "grid_descriptor",
    f"""WITH {GRIDS}, {GRID_STATS}, h AS (SELECT vec_id, CAST(least(floor(v / (255.0::DOUBLE / 16)), 15) AS INTEGER) AS b, count(*) AS c FROM cells WHERE v BETWEEN 0 AND 255 GROUP BY ALL),
    head AS (SELECT vec_id, [mean / 255.0::DOUBLE, sd / 255.0::DOUBLE, ln(1 + energy) / 10.0::DOUBLE, contrast / 255.0::DOUBLE] AS v FROM whole JOIN tiles USING (vec_id)),
    parts AS (SELECT vec_id, i AS place, v[i + 1] AS value FROM head, range(0, 4) t(i)
              UNION ALL SELECT w.vec_id, 4 + b.b, coalesce(c, 0) / (64 * (255.0::DOUBLE / 16)) FROM whole w CROSS JOIN range(0, 16) b(b) LEFT JOIN h ON h.vec_id = w.vec_id AND h.b = b.b)
    SELECT vec_id, CAST(place AS INTEGER) AS place, {r6('value')} AS value FROM parts""",
)
def grid_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.grids(spark, sf_dir).select("vec_id", grids.descriptor(F.col("grid"), 8, 8, 4).alias("d"))
    return rounded(rows.select("vec_id", F.posexplode("d").alias("place", "value")), "value")


@query(
    "otsu_threshold",
    f"""WITH {GRIDS}, counted AS (SELECT vec_id, CAST(least(v, 255) AS INTEGER) AS level, count(*) AS c FROM (SELECT vec_id, unnest(grid) AS v FROM grids) WHERE v BETWEEN 0 AND 256 GROUP BY ALL),
    cum AS (SELECT vec_id, level, sum(c) OVER w / sum(c) OVER p AS w, sum(c * level) OVER w / sum(c) OVER p AS mu, sum(c * level) OVER p / sum(c) OVER p AS mt
            FROM (SELECT vec_id, level, c::DOUBLE AS c FROM counted) WINDOW w AS (PARTITION BY vec_id ORDER BY level), p AS (PARTITION BY vec_id)),
    sb AS (SELECT *, CASE WHEN w * (1 - w) <> 0 THEN power(mt * w - mu, 2) / (w * (1 - w)) END AS b FROM cum)
    SELECT vec_id, CAST(arg_max(level, (b, -level)) FILTER (WHERE b IS NOT NULL) AS DOUBLE) AS threshold FROM sb GROUP BY vec_id""",
)
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.otsu(B.grids(spark, sf_dir), "vec_id", "grid")


# A grid blended with its mirror where it is bright, with the mask moved one cell along.
AFTER = """
moved AS (SELECT vec_id, list_transform(grid, lambda v: v > 150) AS m0, grid,
                 list_transform(range(0, 64), lambda i: CASE WHEN grid[i + 1] > 150 THEN 0.5::DOUBLE ELSE 0.0 END) AS blend FROM grids),
shifted AS (SELECT *, list_transform(range(0, 64), lambda i: CASE WHEN i % 8 > 0 THEN m0[i] ELSE false END) AS m1,
                   list_transform(range(0, 64), lambda i: grid[64 - i]::DOUBLE * blend[i + 1] + grid[i + 1]::DOUBLE * (1.0::DOUBLE - blend[i + 1])) AS after FROM moved),
rcells AS (SELECT vec_id, i, grid[i + 1]::DOUBLE AS b, after[i + 1] AS a, m0[i + 1] AS m0, m1[i + 1] AS m1 FROM shifted, range(0, 64) t(i)),
rstats AS (SELECT vec_id, abs(avg(b) FILTER (WHERE m0) - avg(b) FILTER (WHERE NOT m0)) AS c0, abs(avg(a) FILTER (WHERE m0) - avg(a) FILTER (WHERE NOT m0)) AS c1,
                  abs(avg(a) FILTER (WHERE m1) - avg(a) FILTER (WHERE NOT m1)) AS p1, count(*) FILTER (WHERE m0) AS n0, count(*) FILTER (WHERE m1) AS n1 FROM rcells GROUP BY vec_id)
"""


@query(
    "defect_retention",
    f"""WITH {GRIDS}, {AFTER}, alap AS (SELECT vec_id, grid, {_lap('i').replace('::DOUBLE', '')}::DOUBLE AS lap FROM (SELECT vec_id, after AS grid, i FROM shifted, range(0, 64) t(i))),
    ae AS (SELECT vec_id, var_pop(lap) AS e1 FROM alap GROUP BY vec_id),
    be AS (SELECT vec_id, var_pop(lap) AS e0 FROM (SELECT vec_id, {_lap('i')} AS lap FROM grids, range(0, 64) t(i)) GROUP BY vec_id),
    t AS (SELECT *, CASE WHEN n0 > 0 AND n0 < 64 THEN CASE WHEN c0 > 1e-6 THEN c1 / c0 ELSE 1.0 END ELSE CASE WHEN e0 > 1e-6 THEN e1 / e0 ELSE 1.0 END END AS ret,
            CASE WHEN n0 = 0 OR n1 = 0 THEN 0.0 ELSE CASE WHEN coalesce(c0, 0) > 1e-6 THEN coalesce(p1, 0) / c0 ELSE 1.0 END END AS pret,
            CASE WHEN n0 > 0 AND n1 > 0 THEN n1::DOUBLE / n0 END AS kept FROM rstats JOIN ae USING (vec_id) JOIN be USING (vec_id))
    SELECT vec_id, {r6('ret')} AS retention, {r6('pret')} AS paired_retention, {r6('kept')} AS area_kept, coalesce(n0 > 0 AND n1 > 0 AND pret >= 0.6 AND kept >= 0.5, false) AS passed FROM t""",
)
def defect_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.grids(spark, sf_dir).withColumn("m0", F.transform("grid", lambda v: v > 150))
    rows = rows.withColumn("m1", F.transform("m0", lambda m, i: F.when(i % 8 > 0, F.get(F.col("m0"), i - 1)).otherwise(F.lit(False))))
    blend = F.transform("m0", lambda m: F.when(m, F.lit(0.5)).otherwise(F.lit(0.0)))
    rows = rows.withColumn("after", A.composite(F.reverse("grid"), F.col("grid"), blend))
    before, after = F.col("grid"), F.col("after")
    paired = grids.paired_retention(before, after, F.col("m0"), F.col("m1"))
    out = rows.select("vec_id", grids.defect_retention(before, after, F.col("m0"), 8, 8).alias("retention"), paired.alias("p"))
    out = out.select("vec_id", "retention", F.col("p.retention").alias("paired_retention"), "p.area_kept", F.coalesce("p.passed", F.lit(False)).alias("passed"))
    return rounded(out, "retention", "paired_retention", "area_kept")


@query(
    "inside_object",
    f"""WITH {GRIDS}, m AS (SELECT vec_id, list_transform(grid, lambda v: v > 150) AS mask, list_transform(grid, lambda v: v > 90) AS fg FROM grids),
    c AS (SELECT vec_id, count(*) FILTER (WHERE mask[i + 1]) AS n, count(*) FILTER (WHERE mask[i + 1] AND i // 8 IN (0, 7)) AS o, bool_and(fg[i + 1]) AS f FROM m, range(0, 64) t(i) GROUP BY vec_id)
    SELECT vec_id, f OR n = 0 OR o::DOUBLE / n <= 0.1 AS inside FROM c""",
)
def inside_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.grids(spark, sf_dir).withColumn("mask", F.transform("grid", lambda v: v > 150))
    rows = rows.withColumn("outline", F.transform("grid", lambda v, i: F.floor(i / 8).isin(0, 7))).withColumn("fg", F.transform("grid", lambda v: v > 90))
    return rows.select("vec_id", grids.inside_object(F.col("mask"), F.col("outline"), F.col("fg")).alias("inside"))


@query(
    "prefix_norms",
    f"""WITH s AS (SELECT p_type AS run, p_brand AS layer, sum(p_retailprice * p_retailprice) AS sq FROM part GROUP BY ALL),
    u AS (SELECT * FROM s UNION ALL SELECT run, 'global', sum(sq) FROM s GROUP BY ALL) SELECT run, layer, {r6('sqrt(sq)')} AS norm FROM u""",
)
def prefix_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = B.table(spark, sf_dir, "part").select(
        F.col("p_type").alias("run"), F.concat_ws(".", "p_brand", F.col("p_partkey").cast("string")).alias("name"), F.col("p_retailprice").alias("value")
    )
    return rounded(objectives.prefix_norms(values, ["run"], "name", "value"), "norm")


LINEAR = [0.5, -1.0, 0.25, 2.0] + [0.125] * 60


@query(
    "multi_view_scoring",
    f"""WITH w AS (SELECT [0.5::DOUBLE, -1.0, 0.25, 2.0] || list_transform(range(0, 60), lambda i: 0.125::DOUBLE) AS w), x AS (SELECT vec_id, {E64} AS x FROM embeddings)
    SELECT vec_id, {r6('list_sum(list_transform(range(1, 65), lambda i: x[i] * w[i]))')} AS identity, {r6('list_sum(list_transform(range(1, 65), lambda i: x[65 - i] * w[i]))')} AS flipped,
           {r6('list_sum(list_transform(range(1, 65), lambda i: x[i] * w[i]))')} AS batch FROM x, w""",
)
def multi_view_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One linear model as JVM expressions over two views, and once more as an Arrow batch scorer."""
    weights = LINEAR

    def load():
        return lambda batch: batch @ weights

    rows = B.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("embedding"))
    views = scorers.linear_views(F.col("embedding"), weights, {"identity": lambda x: x, "flipped": F.reverse})
    scored = rows.withColumn("v", views)
    batch = scorers.batch_scores(scored, "embedding", load, ["vec_id", "v"])
    out = batch.select("vec_id", F.col("v")[0].alias("identity"), F.col("v")[1].alias("flipped"), F.col("score").alias("batch"))
    return rounded(out, "identity", "flipped", "batch")


@query(
    "latency_summary",
    f"""WITH t AS (SELECT event_type, value / 1000.0::DOUBLE AS s, 8.0::DOUBLE AS b FROM events)
    SELECT event_type, {r6('avg(s) * 1000')} AS ms_per_batch, {r6('stddev_pop(s) * 1000')} AS ms_per_batch_std, {r6('avg(s) / avg(b) * 1000')} AS ms_per_image,
           {r6('avg(b) / avg(s)')} AS throughput FROM t GROUP BY ALL""",
)
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "events").select("event_type", (F.col("value") / 1000.0).alias("s"), F.lit(8.0).alias("b"))
    return rounded(timing.latency_summary(rows, ["event_type"], "s", "b"), "ms_per_batch", "ms_per_batch_std", "ms_per_image", "throughput")


@query(
    "stage_quantiles",
    f"""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rk, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, max(n) AS n, {r6('quantile_cont(value, 0.5)')} AS median, {r6('max(CASE WHEN rk = floor(0.9::DOUBLE * (n - 1)) + 1 THEN value END)')} AS high FROM r GROUP BY ALL""",
)
def stage_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timing.stage_quantiles(B.table(spark, sf_dir, "events"), ["event_type"], "value"), "median", "high")


KEY_SQL = "CASE WHEN model LIKE '%[x2]' THEN 'ours two views' WHEN model LIKE 'ours%' THEN 'ours one view' ELSE split_part(model, '+', 1) END"
MS_SQL = "CASE WHEN legacy AND model LIKE '%[x2]' THEN ms * 2 ELSE ms END"
BEST = f"best AS (SELECT {KEY_SQL} AS key, min({MS_SQL}) AS best_ms FROM latency WHERE status = 'ok' AND model LIKE '%+full%' GROUP BY ALL)"


def _best(rows: DataFrame) -> DataFrame:
    ms = timing.corrected_ms(F.col("model"), F.col("ms"), F.col("legacy"))
    return timing.best_times(rows, timing.model_key(F.col("model")), ms)


@query("best_time", f"WITH {LATENCY}, {BEST} SELECT key, {r6('best_ms')} AS best_ms FROM best")
def best_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_best(B.latency_rows(spark, sf_dir)), "best_ms")


@query(
    "time_verdict",
    f"""WITH {LATENCY}, n AS (SELECT {KEY_SQL} AS key, min(ms) AS ms FROM latency WHERE status = 'ok' AND model LIKE '%+full%' AND precision = 'fp32' GROUP BY ALL),
    o AS (SELECT {KEY_SQL} AS key, min({MS_SQL}) AS ms FROM latency WHERE status = 'ok' AND model LIKE '%+full%' AND precision = 'fp16' GROUP BY ALL)
    SELECT n.key, {r6('n.ms')} AS new_ms, {r6('o.ms')} AS old_ms, {r6('(n.ms - o.ms) / o.ms')} AS change, abs((n.ms - o.ms) / o.ms) <= 0.15 AS passed FROM n JOIN o ON n.key = o.key""",
)
def time_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.latency_rows(spark, sf_dir)
    new = _best(rows.where("precision = 'fp32'").withColumn("legacy", F.lit(False)))
    return rounded(timing.time_verdict(new, _best(rows.where("precision = 'fp16'"))), "new_ms", "old_ms", "change")


@query(
    "ratio_and_order_verdict",
    f"""WITH {LATENCY}, {BEST}, b AS (SELECT best_ms AS base FROM best WHERE key = 'ours one view')
    SELECT key, {r6('best_ms / base')} AS ratio, 1.0::DOUBLE AS expected, abs(best_ms / base - 1.0) <= 0.2 AS passed,
           (SELECT max(best_ms) FILTER (WHERE key = 'ours one view') < max(best_ms) FILTER (WHERE key = 'rival') FROM best) AS in_order
    FROM best, b WHERE key <> 'ours one view'""",
)
def ratio_and_order_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _best(B.latency_rows(spark, sf_dir))
    expected = best.select("key", F.lit(1.0).alias("expected"))
    order = timing.order_verdict(best, ["ours one view", "rival"])
    found = timing.ratio_verdict(best, "ours one view", expected)
    return rounded(found.withColumn("in_order", order.scalar()), "ratio")


@query(
    "matched_cells",
    f"""WITH {LATENCY}, c AS (SELECT model, image_size, precision, status, avg(ms) AS ms FROM latency GROUP BY ALL)
    SELECT o.image_size, o.precision, o.model, {r6('o.ms')} AS ms, {r6('r.ms')} AS reference_ms, {r6('r.ms / o.ms')} AS ratio
    FROM c o JOIN c r ON o.image_size = r.image_size AND o.precision = r.precision AND r.model = 'rival' AND r.status = 'ok' WHERE o.status = 'ok' AND o.model <> 'rival'""",
)
def matched_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timing.matched_cells(_cells(spark, sf_dir), ["image_size", "precision"], "rival"), "ms", "reference_ms", "ratio")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.latency_rows(spark, sf_dir).groupBy("model", "image_size", "precision", "status").agg(F.avg("ms").alias("ms"))


@query(
    "compiled_gain",
    f"""WITH {LATENCY}, c AS (SELECT model, image_size, precision, avg(ms) AS ms FROM latency WHERE status = 'ok' GROUP BY ALL)
    SELECT e.image_size, e.precision, e.model, {r6('e.ms')} AS ms, {r6('k.ms')} AS compiled_ms, {r6('100.0::DOUBLE * (k.ms - e.ms) / e.ms')} AS change_pct
    FROM c e JOIN c k ON k.model = 'ours:net+compile' AND e.model = 'ours:net' AND e.image_size = k.image_size AND e.precision = k.precision""",
)
def compiled_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timing.compiled_gain(_cells(spark, sf_dir), ["image_size", "precision"]), "ms", "compiled_ms", "change_pct")


@query(
    "latency_knee",
    f"""WITH {LATENCY}, c AS (SELECT model, image_size, precision, min(ms) AS ms FROM latency WHERE status = 'ok' GROUP BY ALL),
    f AS (SELECT *, first_value(ms) OVER (PARTITION BY model, precision ORDER BY image_size) AS base, count(*) OVER (PARTITION BY model, precision) AS n FROM c)
    SELECT model, precision, CAST(min(CASE WHEN ms > base * 1.15::DOUBLE THEN image_size END) AS DOUBLE) AS knee FROM f WHERE n >= 2 GROUP BY ALL""",
)
def latency_knee(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = B.latency_rows(spark, sf_dir).where("status = 'ok'").groupBy("model", "image_size", "precision").agg(F.min("ms").alias("ms"))
    return timing.latency_knee(best, ["model", "precision"], "image_size", "ms").withColumn("knee", F.col("knee").cast("double"))


@query(
    "wait_share",
    """WITH t AS (SELECT user_id, sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) AS w, sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) AS c FROM events GROUP BY ALL)
    SELECT user_id, round(w, 6) + 0.0 AS wait_s, round(c, 6) + 0.0 AS compute_s, CASE WHEN w + c > 0 THEN round(w / (w + c), 4) END AS wait_share FROM t""",
)
def wait_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(kind: str):
        return F.when(F.col("event_type") == kind, F.col("value")).otherwise(0.0)

    rows = B.table(spark, sf_dir, "events").select("user_id", of("view").alias("wait"), of("click").alias("compute"))
    return rounded(timing.wait_share(rows, ["user_id"], "wait", "compute"), "wait_s", "compute_s")


@query(
    "stream_best_epoch",
    f"""WITH RECURSIVE {SCORES}, {EPOCH_STATS}, {EPOCH_METRICS}, {FOLD}
    SELECT dataset || '/' || category || '/' || seed AS run, best_epoch, {r6('best')} AS best_value, tie_wins, epochs_ran,
           CASE WHEN stopped THEN 'patience' ELSE 'epoch_cap' END AS stop_reason FROM last_step""",
)
def stream_best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The epoch log written as JSON lines, read back as a stream, and folded in streaming state."""
    log, sink, state = (scratch_dir(spark, p) for p in ("epoch-log", "selection", "selection-state"))
    rows = trajectory(spark, sf_dir)
    rows.select(F.concat_ws("/", *B.GROUP).alias("run"), "epoch", "value", "secondary").write.mode("overwrite").json(log)
    own = spark.newSession()  # the state store is a setting of the session
    own.conf.set("spark.sql.streaming.stateStore.providerClass", epochs.ROCKSDB)
    stream = epochs.live_selection(epochs.read_epoch_log(own, log), **SELECTOR)
    alarms.run_to_end(stream, sink, state)
    latest = spark.read.schema(epochs.OUTPUT).parquet(sink).groupBy("run").agg(F.max_by(F.struct("*"), "epochs_ran").alias("s"))
    out = latest.select("run", "s.best_epoch", "s.best_value", "s.tie_wins", "s.epochs_ran", "s.stop_reason")
    return rounded(out, "best_value")


@query("stream_alarms", ALARMS_SQL)
def stream_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows of both classes written as a score log and streamed against lines set beforehand."""
    log, sink, state = (scratch_dir(spark, p) for p in ("score-log", "alarms", "alarm-state"))
    scored, lines = _lines(spark, sf_dir)
    test = scored.where("split = 'test'")
    test.select("dataset", "category", F.col("seed").cast("int").alias("seed"), "path", "label", "score").write.mode("overwrite").parquet(log)
    line_table = scratch_dir(spark, "lines")
    lines.write.mode("overwrite").parquet(line_table)
    stream = alarms.live_alarms(alarms.read_scores(spark, log), spark.read.parquet(line_table), B.GROUP)
    alarms.run_to_end(stream.select(*B.GROUP, "path", "label", "score", "line", "margin"), sink, state)
    return rounded(spark.read.parquet(sink), "score", "line", "margin")


@query(
    "grey_values",
    f"""SELECT vec_id, {r6('0.299::DOUBLE * embedding[1] + 0.587::DOUBLE * embedding[2] + 0.114::DOUBLE * embedding[3]')} AS luminance,
    {r6('(embedding[1]::DOUBLE + embedding[2]::DOUBLE + embedding[3]::DOUBLE) / 3.0::DOUBLE')} AS gray FROM embeddings""",
)
def grey_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luminance and plain grey of three channels."""
    channels = [F.get("embedding", i).cast("double") for i in range(3)]
    rows = B.table(spark, sf_dir, "embeddings").select("vec_id", grids.luminance(*channels).alias("luminance"), grids.gray(*channels).alias("gray"))
    return rounded(rows, "luminance", "gray")
