"""Resampling, run comparison, settings, reliability and report queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.operators import compare, metrics, profile, reliability, resample, selection, settings, weights
from siftmark.functions.arrays import has_random_step
from siftmark.plans import bindings as B
from siftmark.plans.catalogue import query
from siftmark.plans.headline import rounded
from siftmark.plans.metric_queries import (
    COLLAPSE, EPOCH_KEYS, EPOCH_METRICS, EPOCH_SPLIT_METRICS, EPOCH_STATS, FOLD, SELECTOR, collapsed_runs, numbered, trajectory,
)
from siftmark.plans.sql_tables import AP_OF_CURVE, AUROC_OF_CURVE, DOCS, SCORES, r6

N_BOOT, ALPHA = 1000, 0.05
NOTE = "CASE WHEN n_pos = 0 OR n_pos = n THEN 'single-class test split' END"
SPREAD_AUROC = """
  SELECT category, rep, arm, CASE WHEN sum(label) > 0 AND sum(1 - label) > 0 THEN
           (sum(CASE WHEN label = 1 THEN rk END) - sum(label)::DOUBLE * (sum(label)::DOUBLE + 1) / 2) / (sum(label)::DOUBLE * sum(1 - label)::DOUBLE) END AS value
  FROM (SELECT category, rep, arm, label, rank() OVER (PARTITION BY category, rep, arm ORDER BY score)
               + (count(*) OVER (PARTITION BY category, rep, arm, score) - 1) / 2.0::DOUBLE AS rk FROM drawn)
  GROUP BY ALL
"""
MASK = 4294967295


def mixed_sql(source: str, a: str, b: str, i: str, name: str) -> str:
    """``source`` with ``name``, the 32 bits that ``weights.mixed`` makes of the columns a, b and i."""

    def spread(inner: str) -> str:
        for shift, factor in ((16, weights.FIRST), (13, weights.SECOND)):
            inner = f"SELECT * REPLACE ((xor(x, x >> {shift}) * {factor}) & {MASK} AS x) FROM ({inner})"
        return f"SELECT * REPLACE (xor(x, x >> 16) AS x) FROM ({inner})"

    first = spread(f"SELECT *, ({a} + ({i}::UBIGINT * {weights.STEP}) & {MASK}) & {MASK} AS x FROM ({source})")
    return f"SELECT * RENAME (x AS {name}) FROM ({spread(f'SELECT * REPLACE (xor(x, {b}) AS x) FROM ({first})')})"


def halves_sql(text: str, low: str, high: str) -> str:
    return ", ".join(f"('0x' || substr(md5({text}), {start}, 8))::UBIGINT AS {name}" for start, name in ((1, low), (9, high)))


MEAN = f"greatest(0.0::DOUBLE, 1.0::DOUBLE - {weights.MARGIN}::DOUBLE / sqrt(size::DOUBLE))"
SHARES = [" + ".join(f"exp(-{MEAN}) * pow({MEAN}, {i}) / {math.factorial(i)}::DOUBLE" for i in range(k + 1)) for k in range(weights.MOST + 1)]
POISSON = " + ".join(f"(bits >= ceil(({share}) * 4294967296.0::DOUBLE))::BIGINT" for share in SHARES)
REPLICATES = f"range({N_BOOT}) t(rep)"
ONE = mixed_sql("SELECT *, rep::UBIGINT AS r FROM open_draws, range(missing) s(slot)", "class_low", "class_high", "r", "one")
TWO = mixed_sql(ONE, "class_high", "class_low", "r", "two")
SLOTS = mixed_sql(mixed_sql(TWO, "one", "two", "slot", "upper_bits"), "two", "one", "slot", "lower_bits")
DRAWN = f"""
pos AS (SELECT *, score + label * 0.35::DOUBLE AS score_b, row_number() OVER (PARTITION BY category, label ORDER BY md5('0:slot:' || path)) - 1 AS pos,
               count(*) OVER (PARTITION BY category, label) AS size FROM docs),
hashed AS (SELECT category, label, pos, size, {halves_sql("'0:boot:' || category || '/' || label || '/' || pos", 'low', 'high')} FROM pos),
base AS (SELECT category, label, rep, pos, size, {POISSON} AS times FROM ({mixed_sql(f'SELECT * FROM hashed, {REPLICATES}', 'low', 'high', 'rep', 'bits')})),
open_draws AS (SELECT category, label, rep, size, size - sum(times)::BIGINT AS missing, {halves_sql("'0:draws:' || category || '/' || label", 'class_low', 'class_high')}
               FROM base GROUP BY category, label, rep, size),
draws AS (SELECT category, label, rep, pos FROM base, range(times) t(i)
          UNION ALL SELECT category, label, rep, ((upper_bits * 4294967296 + lower_bits) % size::UBIGINT)::BIGINT AS pos FROM ({SLOTS})),
drawn AS (SELECT d.category, d.rep, p.label, arm, CASE WHEN arm = 'a' THEN score ELSE score_b END AS score
          FROM draws d JOIN pos p ON d.category = p.category AND d.label = p.label AND d.pos = p.pos, (VALUES ('a'), ('b')) v(arm)),
vals AS ({SPREAD_AUROC}),
points AS (SELECT category, 0 AS rep, arm, label, CASE WHEN arm = 'a' THEN score ELSE score_b END AS score FROM pos, (VALUES ('a'), ('b')) v(arm)),
point_values AS ({SPREAD_AUROC.replace('FROM drawn', 'FROM points')}),
sizes AS (SELECT category, count(*) AS n, sum(label)::BIGINT AS n_pos FROM docs GROUP BY category)
"""


def iqm_sql(source: str, value: str) -> str:
    return f"""SELECT category, avg(v) AS iqm FROM (
      SELECT category, {value} AS v, row_number() OVER (PARTITION BY category ORDER BY {value}) AS rk, count(*) OVER (PARTITION BY category) AS c FROM {source})
      WHERE rk > floor(c * 0.25::DOUBLE) AND rk <= ceil(c * 0.75::DOUBLE) GROUP BY category"""


@query(
    "bootstrap_interval",
    f"""WITH {DOCS}, {DRAWN}, a AS (SELECT * FROM vals WHERE arm = 'a'), q AS ({iqm_sql('a', 'value')}),
    ci AS (SELECT category, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM a GROUP BY category)
    SELECT s.category, n, n_pos, CASE WHEN n_pos > 0 AND n_pos < n THEN {r6('v.value')} END AS point, CASE WHEN n_pos > 0 AND n_pos < n THEN {r6('iqm')} END AS iqm, CASE WHEN n_pos > 0 AND n_pos < n THEN {r6('lo')} END AS lo, CASE WHEN n_pos > 0 AND n_pos < n THEN {r6('hi')} END AS hi, CASE WHEN n_pos > 0 AND n_pos < n THEN {r6('hi - lo')} END AS width, {NOTE} AS note
    FROM sizes s LEFT JOIN q ON s.category = q.category LEFT JOIN ci ON s.category = ci.category
    LEFT JOIN point_values v ON v.category = s.category AND v.arm = 'a'""",
)
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.bootstrap_interval(B.document_scores(spark, sf_dir), ["category"], n_boot=N_BOOT, alpha=ALPHA)
    return rounded(found, "point", "iqm", "lo", "hi", "width")


@query(
    "bootstrap_interval_aupr",
    f"""WITH {DOCS}, {DRAWN},
    ap AS (SELECT category, rep, sum(CASE WHEN label = 1 THEN hits::DOUBLE / place END) / max(p) AS value FROM (
      SELECT category, rep, label, row_number() OVER w AS place, sum(label) OVER w AS hits, sum(label) OVER (PARTITION BY category, rep)::DOUBLE AS p
      FROM drawn WHERE arm = 'a' WINDOW w AS (PARTITION BY category, rep ORDER BY score DESC, label DESC ROWS UNBOUNDED PRECEDING)) GROUP BY ALL),
    pt AS (SELECT category, sum(CASE WHEN label = 1 THEN hits::DOUBLE / place END) / max(p) AS value FROM (
      SELECT category, label, row_number() OVER w AS place, sum(label) OVER w AS hits, sum(label) OVER (PARTITION BY category)::DOUBLE AS p
      FROM docs WINDOW w AS (PARTITION BY category ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING)) GROUP BY ALL),
    ci AS (SELECT category, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM ap GROUP BY category)
    SELECT s.category, CASE WHEN n_pos > 0 AND n_pos < n THEN {r6('pt.value')} END AS point, CASE WHEN n_pos > 0 AND n_pos < n THEN {r6('lo')} END AS lo,
      CASE WHEN n_pos > 0 AND n_pos < n THEN {r6('hi')} END AS hi FROM sizes s LEFT JOIN pt USING (category) LEFT JOIN ci USING (category)""",
)
def bootstrap_interval_aupr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision: point in row order among ties, replicates with positives first."""
    rows = B.document_scores(spark, sf_dir).withColumn("place", F.element_at(F.split("path", "/"), -1).cast("long"))
    found = resample.bootstrap_interval(rows, ["category"], "aupr", n_boot=N_BOOT, alpha=ALPHA, position="place")
    return rounded(found.select("category", "point", "lo", "hi"), "point", "lo", "hi")


def _shifted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("score", F.col("score") + F.col("label") * F.lit(0.35))


PAIRED = f"""
deltas AS (SELECT category, rep, max(CASE WHEN arm = 'b' THEN value END) - max(CASE WHEN arm = 'a' THEN value END) AS delta FROM vals GROUP BY ALL),
diqm AS ({iqm_sql('deltas', 'delta')}),
dci AS (SELECT category, quantile_cont(delta, 0.025) AS lo, quantile_cont(delta, 0.975) AS hi, avg(CASE WHEN delta > 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS p_improve
        FROM deltas GROUP BY category),
pv AS (SELECT category, max(CASE WHEN arm = 'a' THEN value END) AS a, max(CASE WHEN arm = 'b' THEN value END) AS b FROM point_values GROUP BY category),
paired AS (SELECT s.category, n, n_pos, a, b, b - a AS delta, iqm AS delta_iqm, lo, hi, p_improve, lo > 0 OR hi < 0 AS resolved
           FROM sizes s LEFT JOIN pv ON s.category = pv.category LEFT JOIN diqm ON s.category = diqm.category LEFT JOIN dci ON s.category = dci.category)
"""


@query(
    "paired_bootstrap",
    f"""WITH {DOCS}, {DRAWN}, {PAIRED} SELECT category, n, n_pos, CASE WHEN n_pos > 0 AND n_pos < n THEN {r6('a')} END AS a, CASE WHEN n_pos > 0 AND n_pos < n THEN {r6('b')} END AS b, CASE WHEN n_pos > 0 AND n_pos < n THEN {r6('delta')} END AS delta, CASE WHEN n_pos > 0 AND n_pos < n THEN {r6('delta_iqm')} END AS delta_iqm, CASE WHEN n_pos > 0 AND n_pos < n THEN {r6('lo')} END AS lo, CASE WHEN n_pos > 0 AND n_pos < n THEN {r6('hi')} END AS hi, CASE WHEN n_pos > 0 AND n_pos < n THEN {r6('p_improve')} END AS p_improve,
    CASE WHEN n_pos > 0 AND n_pos < n THEN resolved END AS resolved, {NOTE} AS note FROM paired""",
)
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_paired(spark, sf_dir), "a", "b", "delta", "delta_iqm", "lo", "hi", "p_improve")


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.document_scores(spark, sf_dir).select("category", "path", "label", "score")
    return resample.paired_bootstrap(rows, _shifted(rows), ["category"], n_boot=N_BOOT, alpha=ALPHA)


@query(
    "comparison_roll_up",
    f"""WITH {DOCS}, {DRAWN}, {PAIRED}, one AS (SELECT 'all' AS category, * EXCLUDE (category) FROM paired WHERE n_pos > 0 AND n_pos < n), i AS ({iqm_sql('one', 'delta_iqm')})
    SELECT 'all' AS "run", count(*) FILTER (WHERE resolved AND delta_iqm > 0) AS better, count(*) FILTER (WHERE resolved AND delta_iqm < 0) AS worse,
           count(*) FILTER (WHERE NOT resolved) AS unresolved, (SELECT {r6('iqm')} FROM i) AS iqm_of_deltas, {r6('quantile_cont(hi - lo, 0.5)')} AS median_width
    FROM one""",
)
def comparison_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = resample.comparison_roll_up(_paired(spark, sf_dir).withColumn("run", F.lit("all")), ["run"])
    return rounded(rolled, "iqm_of_deltas", "median_width")


G = "dataset, category, seed"
SEED_AUROC = f"""
tcurve AS (SELECT {G}, score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY {G}) AS p, sum(neg) OVER (PARTITION BY {G}) AS n
           FROM (SELECT {G}, two_view AS score, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM scores WHERE split = 'test' GROUP BY ALL)
           WINDOW w AS (PARTITION BY {G} ORDER BY score DESC)),
per_seed AS (SELECT {G}, {AUROC_OF_CURVE} AS auroc, {AP_OF_CURVE} AS aupr FROM tcurve GROUP BY ALL),
bands AS (SELECT dataset, category, count(auroc) AS n, avg(auroc) AS mean, stddev_samp(auroc) AS std, min(auroc) AS min, max(auroc) AS max,
                 stddev_samp(auroc) / sqrt(count(auroc)::DOUBLE) AS sem, CASE WHEN count(auroc) >= 2 THEN max(auroc) - min(auroc) END AS range
          FROM per_seed GROUP BY ALL)
"""


def _per_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = B.two_view_scores(spark, sf_dir).where("split = 'test'")
    return metrics.curve(test, B.GROUP).groupBy(*B.GROUP).agg(
        metrics.auroc_of_curve().alias("auroc"), metrics.average_precision_of_curve().alias("aupr")
    )


@query(
    "noise_band",
    f"WITH {SCORES}, {SEED_AUROC} SELECT dataset, category, n, {', '.join(r6(c) + ' AS ' + c for c in ('mean', 'std', 'min', 'max', 'sem', 'range'))} FROM bands",
)
def noise_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resample.noise_band(_per_seed(spark, sf_dir), ["dataset", "category"], "auroc"), "mean", "std", "min", "max", "sem", "range")


@query(
    "delta_verdict",
    f"""WITH {SCORES}, {SEED_AUROC}, j AS (SELECT o.category, o.mean - f.mean AS delta, o.std AS sa, f.std AS sb, o.n AS na, f.n AS nb
      FROM bands o JOIN bands f ON o.category = f.category AND o.dataset = 'O' AND f.dataset = 'F')
    SELECT category, {r6('delta')} AS delta, CASE WHEN sa IS NULL THEN 'NO BAND (fewer than 2 seeds)' WHEN sqrt(sa * sa / na + sb * sb / nb) <= 0 THEN 'NO BAND (zero spread)'
      WHEN abs(delta) / sqrt(sa * sa / na + sb * sb / nb) > 2 THEN 'REAL' ELSE 'NOT DISTINGUISHABLE' END AS verdict FROM j""",
)
def delta_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = resample.noise_band(_per_seed(spark, sf_dir), ["dataset", "category"], "auroc").select("dataset", "category", "n", "mean", "std")

    def side(dataset: str, suffix: str) -> DataFrame:
        here = bands.where(F.col("dataset") == dataset)
        return here.select("category", *[F.col(c).alias(f"{c}_{suffix}") for c in ("n", "mean", "std")])

    joined = side("O", "a").join(side("F", "b"), "category").withColumn("delta", F.col("mean_a") - F.col("mean_b"))
    verdict = resample.delta_verdict(F.col("delta"), F.col("std_a"), F.col("n_a"), F.col("std_b"), F.col("n_b"))
    return rounded(joined.select("category", "delta", verdict.alias("verdict")), "delta")


@query(
    "rerun_compare",
    f"""WITH {SCORES} SELECT {G}, split, count(*) AS n_files, true AS same_files,
      {r6("max(CASE WHEN dataset = 'F' AND label = 1 THEN abs((v1 + 0.001::DOUBLE) - v1) ELSE 0.0 END)")} AS max_abs_diff,
      max(CASE WHEN dataset = 'F' AND label = 1 THEN abs((v1 + 0.001::DOUBLE) - v1) ELSE 0.0 END) <= 0.0001 AS passed
    FROM scores GROUP BY ALL""",
)
def rerun_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two copies of the run, with every defect of one dataset moved by a thousandth in one view."""
    old = B.scores(spark, sf_dir).select(*B.GROUP, "split", "path", "label", "views")
    planted = (F.col("dataset") == "F") & (F.col("label") == 1)
    moved = F.transform("views", lambda v, i: F.when(planted & (i == 1), v + F.lit(0.001)).otherwise(v))
    found = compare.rerun_compare(old.withColumn("views", moved), old, [*B.GROUP, "split"], 1e-4)
    return rounded(found, "max_abs_diff")


@query(
    "same_test_set",
    f"""WITH {SCORES}, flipped AS (SELECT *, CASE WHEN category = 'tax8' AND day = 1 THEN 1 - label ELSE label END AS label_b FROM scores WHERE split = 'test')
    SELECT {G}, count(*) AS n_a, count(*) AS n_b, bool_and(label = label_b) AS same FROM flipped GROUP BY ALL""",
)
def same_test_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = B.two_view_scores(spark, sf_dir).where("split = 'test'").select(*B.GROUP, "path", "label", "score", "day")
    b = a.withColumn("label", F.when((F.col("category") == "tax8") & (F.col("day") == 1), 1 - F.col("label")).otherwise(F.col("label")))
    return compare.same_test_set(resample.pair_scores(a, b, B.GROUP), B.GROUP)


@query(
    "run_metadata_equal",
    f"""WITH {SCORES}, m AS (SELECT dataset, category, seed, count(*) FILTER (WHERE split = 'val') AS n_val, max(day) AS last_epoch,
        count(DISTINCT line_no) AS n_lines FROM scores GROUP BY ALL),
    j AS (SELECT coalesce(a.category, b.category) AS category, coalesce(a.seed, b.seed) AS seed, a.n_val AS va, b.n_val AS vb, a.last_epoch AS ea, b.last_epoch AS eb, a.n_lines AS la, b.n_lines AS lb
          FROM (SELECT * FROM m WHERE dataset = 'O') a FULL JOIN (SELECT * FROM m WHERE dataset = 'F') b ON a.category = b.category AND a.seed = b.seed),
    t AS (SELECT category, seed, concat_ws(',', CASE WHEN va IS DISTINCT FROM vb THEN 'n_val' END, CASE WHEN ea IS DISTINCT FROM eb THEN 'last_epoch' END,
            CASE WHEN la IS DISTINCT FROM lb THEN 'n_lines' END) AS differing FROM j)
    SELECT *, differing = '' AS equal FROM t""",
)
def run_metadata_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.scores(spark, sf_dir).groupBy(*B.GROUP).agg(
        F.count_if(F.col("split") == "val").alias("n_val"), F.max("day").alias("last_epoch"), F.count_distinct("line_no").alias("n_lines")
    )
    a, b = found.where("dataset = 'O'"), found.where("dataset = 'F'")
    return compare.fields_equal(a, b, ["category", "seed"], ["n_val", "last_epoch", "n_lines"])


@query(
    "metric_compare",
    f"""WITH {SCORES}, {SEED_AUROC}, long AS (SELECT {G}, 'auroc' AS metric, auroc AS v FROM per_seed UNION ALL SELECT {G}, 'aupr', aupr FROM per_seed),
    j AS (SELECT coalesce(a.category, b.category) AS category, coalesce(a.seed, b.seed) AS seed, coalesce(a.metric, b.metric) AS metric, a.v AS value_a, b.v AS value_b
          FROM (SELECT * FROM long WHERE dataset = 'O') a FULL JOIN (SELECT * FROM long WHERE dataset = 'F') b
            ON a.category = b.category AND a.seed = b.seed AND a.metric = b.metric)
    SELECT category, seed, metric, {r6('value_a')} AS value_a, {r6('value_b')} AS value_b, {r6('abs(value_a - value_b)')} AS gap,
           coalesce(abs(value_a - value_b) <= 0.02, value_a IS NULL AND value_b IS NULL) AS passed FROM j""",
)
def metric_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _per_seed(spark, sf_dir)
    a, b = found.where("dataset = 'O'"), found.where("dataset = 'F'")
    return rounded(compare.metric_compare(a, b, ["category", "seed"], ["auroc", "aupr"], 0.02), "value_a", "value_b", "gap")


REGISTRY = """
registry AS (SELECT p_partkey AS run, 'type' AS key, p_type AS value FROM part UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part
             UNION ALL SELECT p_partkey, 'bonus', p_name FROM part WHERE p_size > 40),
pairs AS (SELECT p_partkey AS run_a, first_value(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS run_b FROM part),
ka AS (SELECT run_a, run_b, key, value FROM pairs JOIN registry ON run = run_a),
kb AS (SELECT run_a, run_b, key, value FROM pairs JOIN registry ON run = run_b),
diffs AS (SELECT coalesce(a.run_a, b.run_a) AS run_a, coalesce(a.run_b, b.run_b) AS run_b, coalesce(a.key, b.key) AS key, a.value AS value_a, b.value AS value_b
          FROM ka a FULL JOIN kb b ON a.run_a = b.run_a AND a.run_b = b.run_b AND a.key = b.key WHERE a.value IS DISTINCT FROM b.value)
"""


def _registry(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Settings of every part as a run, each paired with the first run of its brand."""
    part = B.table(spark, sf_dir, "part")
    run = F.col("p_partkey").alias("run")
    registry = (
        part.select(run, F.lit("type").alias("key"), F.col("p_type").alias("value"))
        .unionByName(part.select(run, F.lit("size").alias("key"), F.col("p_size").cast("string").alias("value")))
        .unionByName(part.where("p_size > 40").select(run, F.lit("bonus").alias("key"), F.col("p_name").alias("value")))
    )
    first = part.groupBy("p_brand").agg(F.min("p_partkey").alias("run_b"))
    return registry, part.join(first, "p_brand").select(F.col("p_partkey").alias("run_a"), "run_b")


@query("settings_diff", f"WITH {REGISTRY} SELECT * FROM diffs")
def settings_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.settings_diff(*_registry(spark, sf_dir))


@query(
    "comparable_runs",
    f"""WITH {REGISTRY} SELECT p.run_a, p.run_b, count(d.key) AS n_differing, count(d.key) = 0 AS comparable
    FROM pairs p LEFT JOIN diffs d ON p.run_a = d.run_a AND p.run_b = d.run_b GROUP BY ALL""",
)
def comparable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry, pairs = _registry(spark, sf_dir)
    return compare.comparable_pairs(pairs, compare.settings_diff(registry, pairs))


@query(
    "protocol_fingerprint",
    """SELECT p_partkey AS run, '{' || concat_ws(',', '"anomaly_fraction":null', '"claim_seeds":["1","2","3"]', '"exploration_seeds":[]', '"floors_validated":null',
      '"injection_val_share":"' || CASE WHEN p_size > 25 THEN 'per-category (adaptive)' ELSE CAST(p_size AS VARCHAR) END || '"', '"injection_val_share_justification":null',
      '"metrics":["' || array_to_string(list_sort([p_type, p_brand]), '","') || '"]', '"name":"' || CASE WHEN p_size > 40 THEN p_brand ELSE 'unnamed' END || '"',
      '"num_train_anomalies":null', '"reporting":"per_category"', '"use_validation":null', '"val_anomaly_floor":null',
      '"val_share_bounds":["0.1","' || CAST(p_size AS VARCHAR) || '"]', '"val_share_mode":"' || CASE WHEN p_size > 25 THEN 'adaptive' ELSE 'fixed' END || '"',
      '"val_split":"' || CAST(p_size AS VARCHAR) || '"') || '}' AS fingerprint FROM part""",
)
def protocol_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    config = F.create_map(
        F.lit("val_split"), size,
        F.lit("metrics"), F.concat_ws(",", "p_type", "p_brand"),
        F.lit("val_share_mode"), F.when(F.col("p_size") > 25, "adaptive").otherwise("fixed"),
        F.lit("injection_val_share"), size,
        F.lit("val_share_min"), F.lit("0.1"),
        F.lit("claim_seeds"), F.lit("1,2,3"),
        F.lit("name"), F.when(F.col("p_size") > 40, F.col("p_brand")),
        F.lit("num_epochs"), F.col("p_name"),
    )
    return B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("run"), settings.fingerprint(config).alias("fingerprint"))


@query(
    "unknown_setting_keys",
    """SELECT p_brand AS dataset, p_type AS category, string_agg(DISTINCT CAST(p_size AS VARCHAR), ',' ORDER BY CAST(p_size AS VARCHAR)) AS "unknown"
    FROM part WHERE p_size NOT IN (SELECT n_nationkey FROM nation) GROUP BY ALL""",
)
def unknown_setting_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    overrides = B.table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("dataset"), F.col("p_type").alias("category"), F.col("p_size").cast("string").alias("key")
    )
    known = B.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("key"))
    return settings.unknown_keys(overrides, known)


@query(
    "resolved_seeds",
    """WITH runs AS (SELECT s_suppkey AS run, CASE WHEN s_nationkey < 8 THEN 'claim' WHEN s_nationkey < 16 THEN 'exploration' END AS tier,
        CASE WHEN s_acctbal > 0 THEN s_nationkey END AS seed FROM supplier),
    lists AS (SELECT run, coalesce(tier, 'exploration') AS seed_tier, CASE WHEN tier = 'claim' THEN [1, 2, 3] WHEN tier = 'exploration' THEN [coalesce(seed, 123)] ELSE [7, 8] END AS l FROM runs)
    SELECT run, seed_tier, CAST(i - 1 AS INTEGER) AS seed_no, l[i] AS run_seed FROM lists, range(1, 4) t(i) WHERE i <= len(l)""",
)
def resolved_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.col("s_nationkey")
    runs = B.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("run"),
        F.when(nation < 8, "claim").when(nation < 16, "exploration").alias("tier"),
        F.when(F.col("s_acctbal") > 0, nation).alias("seed"),
        F.array(F.lit(7), F.lit(8)).alias("seeds"),
        F.array(F.lit(1), F.lit(2), F.lit(3)).alias("claim_seeds"),
        F.lit(None).cast("array<int>").alias("exploration_seeds"),
    )
    return settings.resolve_seeds(runs)


@query(
    "run_grid",
    """SELECT s_suppkey AS run, backbone, image_size FROM supplier, (VALUES ('net_a'), ('net_b')) b(backbone), (VALUES (224), (256), (288)) s(image_size)""",
)
def run_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("run"))
    return settings.run_grid(base, {"backbone": ["net_a", "net_b"], "image_size": [224, 256, 288]})


@query(
    "random_steps",
    """SELECT p_partkey AS run, p_size > 25 OR p_size < 10 AS has_random FROM part""",
)
def random_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    steps = F.array(
        F.col("p_brand"),
        F.concat(F.when(size > 25, "Random").otherwise("Center"), F.lit("Crop")),
        F.concat(F.lit("Color"), F.when(size < 10, "Jitter").otherwise("Map")),
    )
    return B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("run"), has_random_step(steps).alias("has_random"))


REPORT = f"""
counts AS (SELECT {G}, count(*) FILTER (WHERE sp = 'train') AS train_rows, count(*) FILTER (WHERE sp = 'train' AND label = 1) AS train_anomaly,
             count(*) FILTER (WHERE sp = 'val') AS val_rows, count(*) FILTER (WHERE sp = 'val' AND label = 1) AS val_anomaly,
             count(*) FILTER (WHERE sp = 'test') AS test_rows, count(*) FILTER (WHERE sp = 'test' AND label = 1) AS test_anomaly
           FROM (SELECT *, CASE WHEN line_no = 3 THEN 'train' ELSE split END AS sp FROM scores) GROUP BY ALL),
flags AS (SELECT *, train_anomaly = 0 OR train_anomaly = train_rows AS single, CASE WHEN train_rows > 0 THEN train_anomaly::DOUBLE / train_rows ELSE 0.0 END AS ratio FROM counts),
report AS (
  SELECT f.dataset, f.category, f.seed, CASE f.dataset WHEN 'O' THEN 'native' ELSE 'injected' END AS tier, 'net' || f.seed AS backbone,
         train_rows, val_rows, test_rows, l.best_epoch, p.auroc, p.aupr,
         concat_ws(',', CASE WHEN test_anomaly < 15 THEN 'low_test_anomalies' END, CASE WHEN val_rows > 0 AND val_anomaly < 10 THEN 'low_val_anomalies' END,
           CASE WHEN (ratio < 0.05 OR ratio > 0.95) AND NOT single THEN 'severe_imbalance' END, CASE WHEN train_anomaly < 8 THEN 'low_train_anomalies' END,
           CASE WHEN p.auroc < 0.5 THEN 'inverted' END, CASE WHEN single THEN 'single_class_train' END, CASE WHEN val_rows = 0 THEN 'no_val' END) AS caveats,
         CASE WHEN c.n_epochs > 0 THEN c.triggered <> '' END AS collapsed, NOT (single OR l.best_epoch < 0 OR coalesce(c.n_epochs > 0 AND c.triggered <> '', false)) AS reportable
  FROM flags f JOIN per_seed p ON f.dataset = p.dataset AND f.category = p.category AND f.seed = p.seed
  JOIN last_step l ON f.dataset = l.dataset AND f.category = l.category AND f.seed = l.seed
  LEFT JOIN named c ON f.dataset = c.dataset AND f.category = c.category AND f.seed = c.seed)
"""


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run: split counts, selected epoch, test metrics, tier, caveats, collapse, reportability."""
    rows = B.scores(spark, sf_dir).withColumn("split", F.when(F.col("line_no") == 3, "train").otherwise(F.col("split")))
    flags = profile.split_flags(rows, B.GROUP)
    chosen = selection.best_epochs(trajectory(spark, sf_dir), B.GROUP, **SELECTOR).select(*B.GROUP, "best_epoch", "selection_failed")
    verdicts = collapsed_runs(spark, sf_dir, chosen).select(*B.GROUP, "collapsed")
    joined = flags.join(_per_seed(spark, sf_dir), B.GROUP).join(chosen, B.GROUP).join(verdicts, B.GROUP, "left")
    joined = joined.withColumn("inverted", reliability.inverted(F.col("auroc")))
    caveat_list = reliability.caveats(reliability.CAVEATS)
    return joined.select(
        *B.GROUP,
        reliability.dataset_tier(F.col("dataset"), B.TIERS).alias("tier"),
        F.concat(F.lit("net"), F.col("seed").cast("string")).alias("backbone"),
        "train_rows", "val_rows", "test_rows", "best_epoch", "auroc", "aupr",
        F.array_join(caveat_list, ",").alias("caveats"),
        "collapsed",
        reliability.reportable(caveat_list, F.col("collapsed"), F.col("selection_failed")).alias("reportable"),
    )


FULL_REPORT = f"{SCORES}, {EPOCH_STATS}, {EPOCH_METRICS}, {FOLD}, {COLLAPSE}, {SEED_AUROC}, {REPORT}"


@query(
    "report_table",
    f"""WITH RECURSIVE {FULL_REPORT} SELECT {G}, tier, backbone, train_rows, val_rows, test_rows, best_epoch, {r6('auroc')} AS auroc, {r6('aupr')} AS aupr, caveats, collapsed, reportable
    FROM report""",
)
def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report(spark, sf_dir), "auroc", "aupr")


@query(
    "run_summary",
    f"""WITH RECURSIVE {FULL_REPORT} SELECT tier, backbone, count(*) FILTER (WHERE NOT reportable) AS n_excluded, {r6('avg(auroc) FILTER (WHERE reportable)')} AS auroc,
    {r6('avg(aupr) FILTER (WHERE reportable)')} AS aupr, count(*) FILTER (WHERE reportable) AS n_categories FROM report GROUP BY ALL""",
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reliability.run_summary(report(spark, sf_dir)), "auroc", "aupr")


@query("tiered_means", f"WITH {SCORES}, {SEED_AUROC} SELECT CASE dataset WHEN 'O' THEN 'native' ELSE 'injected' END AS tier, 'net' || seed AS backbone, {r6('avg(auroc)')} AS auroc, {r6('avg(aupr)')} AS aupr, count(*) AS n_categories FROM per_seed GROUP BY dataset, seed")
def tiered_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _per_seed(spark, sf_dir).select(
        reliability.dataset_tier(F.col("dataset"), B.TIERS).alias("tier"), F.concat(F.lit("net"), F.col("seed").cast("string")).alias("backbone"), "auroc", "aupr"
    )
    return rounded(reliability.tiered_means(results), "auroc", "aupr")


@query(
    "reportable_scores",
    f"""WITH {SCORES}, summary AS (SELECT {G}, count(*) FILTER (WHERE split = 'val') >= 60 AS ok FROM scores GROUP BY ALL)
    SELECT s.dataset, s.category, s.seed, 'kept' AS state, count(*) AS n FROM scores s JOIN summary m ON s.dataset = m.dataset AND s.category = m.category AND s.seed = m.seed WHERE ok GROUP BY ALL
    UNION ALL SELECT {G}, 'excluded', 1 FROM summary WHERE NOT ok""",
)
def reportable_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.scores(spark, sf_dir)
    summaries = rows.groupBy(*B.GROUP).agg((F.count_if(F.col("split") == "val") >= 60).alias("reportable"))
    kept, excluded = reliability.reportable_scores(rows, summaries, B.GROUP)
    out = kept.groupBy(*B.GROUP).agg(F.count(F.lit(1)).alias("n")).withColumn("state", F.lit("kept"))
    return out.unionByName(excluded.select(*B.GROUP, F.lit(1).cast("bigint").alias("n"), F.lit("excluded").alias("state")))


@query(
    "mean_against_frozen",
    f"""WITH {SCORES}, {SEED_AUROC}, m AS (SELECT dataset, round(avg(auroc), 4) AS mean, count(auroc) AS n FROM per_seed GROUP BY dataset)
    SELECT dataset, mean, n, CASE dataset WHEN 'O' THEN 0.5::DOUBLE END AS frozen, mean IS NOT DISTINCT FROM CASE dataset WHEN 'O' THEN 0.5::DOUBLE END AS passed FROM m""",
)
def mean_against_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    frozen = spark.createDataFrame([("O", 0.5)], "dataset string, frozen double")
    return reliability.mean_against_frozen(_per_seed(spark, sf_dir), ["dataset"], "auroc", frozen)


@query("single_tier_mean", f"WITH {SCORES}, {SEED_AUROC} SELECT {r6('avg(auroc)')} AS auroc FROM per_seed")
def single_tier_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs declared in one tier; a second tier would end the job."""
    return rounded(reliability.single_tier_mean(_per_seed(spark, sf_dir).withColumn("tier", F.lit("native")), "auroc"), "auroc")


CAVEAT_CASES = " ".join(f"WHEN '{key}' THEN '{text}'" for key, text in reliability.CAVEAT_TEXT.items())


@query(
    "run_table",
    f"""WITH RECURSIVE {FULL_REPORT}, {EPOCH_SPLIT_METRICS},
    at_best AS (SELECT * FROM split_metrics WHERE split = 'test'),
    places AS (SELECT *, row_number() OVER (PARTITION BY {G} ORDER BY epoch) - 1 AS place FROM (SELECT DISTINCT {G}, epoch FROM epoch_rows))
    SELECT tier, backbone, r.dataset, r.category, r.seed, r.best_epoch, {', '.join(f"{r6('m.' + c)} AS {c}" for c in ('threshold', *metrics.METRIC_NAMES))},
      array_to_string(list_transform(list_filter(split(caveats, ','), lambda c: c <> ''), lambda c: CASE c {CAVEAT_CASES} END), '; ') AS caveat_line,
      CASE WHEN reportable THEN '' ELSE 'excluded' END AS mark
    FROM report r LEFT JOIN places e ON e.dataset = r.dataset AND e.category = r.category AND e.seed = r.seed AND e.place = r.best_epoch
    LEFT JOIN at_best m ON m.dataset = r.dataset AND m.category = r.category AND m.seed = r.seed AND m.epoch = e.epoch""",
)
def run_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per run: test metrics of the selected epoch at its validation threshold, caveats in words, a mark on excluded runs."""
    runs = report(spark, sf_dir).drop("auroc", "aupr", "train_rows", "val_rows", "test_rows", "collapsed")
    by_split = metrics.metric_set_by_split(B.epoch_scores(spark, sf_dir), EPOCH_KEYS).drop("loss")
    places = numbered(by_split.select(*EPOCH_KEYS).distinct().withColumn("logged", F.col("epoch"))).withColumnRenamed("epoch", "best_epoch")
    test = by_split.where("split = 'test'").drop("split").withColumnRenamed("epoch", "logged")
    selected = places.join(test, [*B.GROUP, "logged"])
    line = reliability.caveat_line(F.filter(F.split("caveats", ","), lambda c: c != ""))
    marked = runs.join(selected, [*B.GROUP, "best_epoch"], "left").select(
        "tier", "backbone", *B.GROUP, "best_epoch", "threshold", *metrics.METRIC_NAMES, line.alias("caveat_line"),
        F.when(F.col("reportable"), "").otherwise("excluded").alias("mark"),
    )
    return rounded(marked, "threshold", *metrics.METRIC_NAMES)
