"""Ranking, threshold and calibration metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftmark.operators import collapse, conformal, metrics, objectives, selection
from siftmark.plans import bindings as B
from siftmark.plans.catalogue import query
from siftmark.plans.headline import rounded
from siftmark.plans.sql_tables import AP_OF_CURVE, AUROC_OF_CURVE, DOCS, SCORES, curve, r6

G = "dataset, category, seed"
TEST = "test_rows AS (SELECT *, two_view AS score FROM scores WHERE split = 'test')"
VAL = "val_rows AS (SELECT *, two_view AS score FROM scores WHERE split = 'val')"


def _test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.two_view_scores(spark, sf_dir).where("split = 'test'")


def _val(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.two_view_scores(spark, sf_dir).where("split = 'val'")


@query(
    "auroc_by_group",
    f"""WITH {SCORES}, {TEST}, ranked AS (
      SELECT {G}, label, rank() OVER (PARTITION BY {G} ORDER BY score)
             + (count(*) OVER (PARTITION BY {G}, score) - 1) / 2.0::DOUBLE AS rk FROM test_rows)
    SELECT {G}, round(CASE WHEN sum(label) > 0 AND sum(1 - label) > 0 THEN
      (sum(CASE WHEN label = 1 THEN rk END) - sum(label)::DOUBLE * (sum(label)::DOUBLE + 1) / 2) / (sum(label)::DOUBLE * sum(1 - label)::DOUBLE)
      END, 6) + 0.0 AS auroc
    FROM ranked GROUP BY ALL""",
)
def auroc_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.auroc(_test(spark, sf_dir), B.GROUP), "auroc")


@query(
    "average_precision_tie_aware",
    f"WITH {SCORES}, {TEST}, {curve('test_rows', G)} SELECT {G}, {r6(AP_OF_CURVE)} AS aupr FROM curve GROUP BY ALL",
)
def average_precision_tie_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.average_precision(_test(spark, sf_dir), B.GROUP), "aupr")


@query(
    "average_precision_row_order",
    f"""WITH {DOCS}, ordered AS (
      SELECT category, label, row_number() OVER (PARTITION BY category ORDER BY score DESC, doc_id) AS rk,
             sum(label) OVER (PARTITION BY category ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) AS tp,
             sum(label) OVER (PARTITION BY category) AS p
      FROM docs)
    SELECT category, round(sum(CASE WHEN label = 1 THEN tp::DOUBLE / rk END) / max(p), 6) + 0.0 AS aupr_row_order
    FROM ordered GROUP BY ALL""",
)
def average_precision_row_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = B.document_scores(spark, sf_dir)
    return rounded(metrics.average_precision_row_order(scored, ["category"], "doc_id"), "aupr_row_order")


GS = f"{G}, split"


@query(
    "roc_points",
    f"""WITH {SCORES}, {curve('scores', GS, 'two_view')}
    SELECT {GS}, {r6('score')} AS threshold, CASE WHEN n > 0 THEN {r6('fp / n')} END AS fpr, CASE WHEN p > 0 THEN {r6('tp / p')} END AS tpr FROM curve""",
)
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.roc_points(B.two_view_scores(spark, sf_dir), [*B.GROUP, "split"]), "threshold", "fpr", "tpr")


@query(
    "pr_points",
    f"""WITH {SCORES}, {curve('scores', GS, 'two_view')}
    SELECT {GS}, {r6('score')} AS threshold, {r6('tp / (tp + fp)')} AS precision, CASE WHEN p > 0 THEN {r6('tp / p')} END AS recall FROM curve""",
)
def pr_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.pr_points(B.two_view_scores(spark, sf_dir), [*B.GROUP, "split"]), "threshold", "precision", "recall")


YOUDEN = f"""
youden AS (
  SELECT {G}, CASE WHEN max(p) > 0 AND max(n) > 0 THEN
           CASE WHEN max(tp / p - fp / n) > 0 THEN arg_max(score, (tp / p - fp / n, score)) ELSE 'infinity'::DOUBLE END
         ELSE 0.0 END AS threshold
  FROM curve GROUP BY ALL)
"""
F1_BEST = f"""
f1_rows AS (
  SELECT *, CASE WHEN tp > 0 THEN 2.0::DOUBLE * (tp / (tp + fp)) * (tp / p) / ((tp / (tp + fp)) + (tp / p)) ELSE 0.0 END AS f1 FROM curve),
f1_best AS (
  SELECT {G}, CASE WHEN max(p) > 0 AND max(n) > 0 THEN arg_max(score, (f1, -score)) ELSE 0.0 END AS threshold FROM f1_rows GROUP BY ALL)
"""


@query("youden_threshold", f"WITH {SCORES}, {VAL}, {curve('val_rows', G)}, {YOUDEN} SELECT {G}, {r6('threshold')} AS threshold FROM youden")
def youden_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.pick_threshold(_val(spark, sf_dir), B.GROUP, "youden"), "threshold")


@query("f1_threshold", f"WITH {SCORES}, {VAL}, {curve('val_rows', G)}, {F1_BEST} SELECT {G}, {r6('threshold')} AS threshold FROM f1_best")
def f1_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.pick_threshold(_val(spark, sf_dir), B.GROUP, "f1"), "threshold")


BIN_RIGHT = "CAST(greatest(list_sum(list_transform(range(1, 15), lambda i: CASE WHEN i / 15.0::DOUBLE < p THEN 1 ELSE 0 END)), 0) AS INTEGER)"
BIN_LEFT = "CAST(greatest(list_sum(list_transform(range(1, 15), lambda i: CASE WHEN i / 15.0::DOUBLE <= p THEN 1 ELSE 0 END)), 0) AS INTEGER)"


def ece_sql(source: str, probability: str, bin_sql: str, keys: str = G) -> str:
    return f"""
probs AS (SELECT {keys}, label, {probability} AS p FROM {source}),
binned AS (SELECT {keys}, {bin_sql} AS bin, count(*) AS c, abs(avg(label::DOUBLE) - avg(p)) AS gap FROM probs GROUP BY ALL),
eces AS (SELECT {keys}, sum(c * gap) / sum(c) AS ece FROM binned GROUP BY ALL)
"""


@query(
    "metrics_at_validation_threshold",
    f"""WITH {SCORES}, {VAL}, {TEST}, {curve('val_rows', G)}, {YOUDEN},
    tcurve AS (SELECT {G}, score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, pos, neg,
                 sum(pos) OVER (PARTITION BY {G}) AS p, sum(neg) OVER (PARTITION BY {G}) AS n
               FROM (SELECT {G}, score, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM test_rows GROUP BY ALL)
               WINDOW w AS (PARTITION BY {G} ORDER BY score DESC)),
    ranking AS (SELECT {G}, {AUROC_OF_CURVE} AS auroc, {AP_OF_CURVE} AS aupr FROM tcurve GROUP BY ALL),
    fired AS (SELECT t.*, y.threshold, t.score >= y.threshold AS hit FROM test_rows t LEFT JOIN youden y USING (dataset, category, seed)),
    confusion AS (
      SELECT {G}, max(threshold) AS threshold,
             sum(CASE WHEN hit AND label = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN hit AND label = 0 THEN 1 ELSE 0 END)::DOUBLE AS fp,
             sum(CASE WHEN NOT hit AND label = 1 THEN 1 ELSE 0 END)::DOUBLE AS fn
      FROM fired GROUP BY ALL),
    {ece_sql('test_rows', '1.0::DOUBLE / (1.0::DOUBLE + exp(-score))', BIN_RIGHT)}
    SELECT {G}, {r6('threshold')} AS threshold, {r6('auroc')} AS auroc, {r6('aupr')} AS aupr,
           CASE WHEN 2 * tp + fp + fn > 0 THEN {r6('2 * tp / (2 * tp + fp + fn)')} ELSE 0.0 END AS f1,
           CASE WHEN tp + fp > 0 THEN {r6('tp / (tp + fp)')} ELSE 0.0 END AS precision,
           CASE WHEN tp + fn > 0 THEN {r6('tp / (tp + fn)')} ELSE 0.0 END AS recall, {r6('ece')} AS ece
    FROM ranking JOIN confusion USING (dataset, category, seed) JOIN eces USING (dataset, category, seed)""",
)
def metrics_at_validation_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    thresholds = metrics.pick_threshold(_val(spark, sf_dir), B.GROUP)
    return rounded(metrics.metric_set(_test(spark, sf_dir), B.GROUP, thresholds), "threshold", *metrics.METRIC_NAMES)


@query(
    "ece_right_closed",
    f"WITH {DOCS}, {ece_sql('docs', '1.0::DOUBLE / (1.0::DOUBLE + exp(-score))', BIN_RIGHT, 'category')} SELECT category, {r6('ece')} AS ece FROM eces",
)
def ece_right_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.ece_right_closed(B.document_scores(spark, sf_dir), ["category"]), "ece")


@query(
    "ece_left_closed_prior_corrected",
    f"""WITH {SCORES}, {TEST}, {ece_sql('test_rows', '1.0::DOUBLE / (1.0::DOUBLE + exp(-(score - ln(pos_weight))))', BIN_LEFT)}
    SELECT {G}, {r6('ece')} AS ece FROM eces""",
)
def ece_left_closed_prior_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.ece_left_closed(_test(spark, sf_dir), B.GROUP, "pos_weight"), "ece")


@query(
    "like_for_like_counts",
    f"""WITH {SCORES}, t AS (SELECT *, label = 1 OR '/' || path LIKE '%/test/%' AS kept FROM scores WHERE split = 'test')
    SELECT {G}, count(*) AS n_all, count(*) FILTER (WHERE kept) AS n_kept, count(*) FILTER (WHERE kept AND label = 0) AS n_normals_kept,
           max(CASE WHEN kept THEN label END) > min(CASE WHEN kept THEN label END) AS both_classes
    FROM t GROUP BY ALL""",
)
def like_for_like_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conformal.like_for_like_counts(B.scores(spark, sf_dir), B.GROUP)


@query(
    "logit_loss",
    f"""WITH {SCORES}
    SELECT {G}, split, round(avg(CASE WHEN label = 1 THEN pos_weight * (ln(1 + exp(-abs(two_view))) + greatest(-two_view, 0.0))
                            ELSE ln(1 + exp(-abs(two_view))) + greatest(two_view, 0.0) END), 6) + 0.0 AS loss
    FROM scores GROUP BY ALL""",
)
def logit_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(objectives.mean_loss(B.two_view_scores(spark, sf_dir), [*B.GROUP, "split"], "pos_weight"), "loss")


@query(
    "view_disagreement",
    f"""WITH {SCORES} SELECT {G}, {r6('avg((v0 - v1) * (v0 - v1))')} AS disagreement FROM scores GROUP BY ALL""",
)
def view_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(objectives.view_disagreement(B.scores(spark, sf_dir), B.GROUP, "views", 1), "disagreement")


@query(
    "tail_margin",
    f"""WITH {SCORES}, {VAL}, sized AS (
      SELECT *, row_number() OVER (PARTITION BY {G}, label ORDER BY score DESC) AS rk,
             greatest(1, ceil(0.1::DOUBLE * count(*) FILTER (WHERE label = 0) OVER (PARTITION BY {G}))) AS k FROM val_rows),
    hard AS (SELECT {G}, score FROM sized WHERE label = 0 AND rk <= k),
    pairs AS (SELECT p.dataset, p.category, p.seed, avg(power(greatest(0.0, 1.0::DOUBLE - (p.score - h.score)), 2)) AS m
              FROM val_rows p JOIN hard h USING (dataset, category, seed) WHERE p.label = 1 GROUP BY ALL)
    SELECT g.dataset, g.category, g.seed, round(coalesce(m, 0.0), 6) + 0.0 AS tail_margin
    FROM (SELECT DISTINCT {G} FROM val_rows) g LEFT JOIN pairs USING (dataset, category, seed)""",
)
def tail_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(objectives.tail_margin(_val(spark, sf_dir), B.GROUP), "tail_margin")


EPOCH_STATS = f"""
epoch_rows AS (SELECT dataset, category, seed, day - 1 AS epoch, label, two_view AS score FROM scores),
stats AS (
  SELECT {G}, epoch, count(*) FILTER (WHERE label = 0) AS normal_count, avg(score) FILTER (WHERE label = 0) AS normal_mean,
         stddev_pop(score) FILTER (WHERE label = 0) AS normal_std, count(*) FILTER (WHERE label = 1) AS anomaly_count,
         avg(score) FILTER (WHERE label = 1) AS anomaly_mean, stddev_pop(score) FILTER (WHERE label = 1) AS anomaly_std,
         avg(score) FILTER (WHERE label = 1) - avg(score) FILTER (WHERE label = 0) AS gap
  FROM epoch_rows GROUP BY ALL)
"""
EPOCH_KEYS = [*B.GROUP, "epoch"]


@query(
    "class_gap_by_epoch",
    f"""WITH {SCORES}, {EPOCH_STATS} SELECT {G}, epoch, normal_count, {r6('normal_mean')} AS normal_mean, {r6('normal_std')} AS normal_std,
    anomaly_count, {r6('anomaly_mean')} AS anomaly_mean, {r6('anomaly_std')} AS anomaly_std, {r6('gap')} AS gap FROM stats""",
)
def class_gap_by_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = collapse.class_statistics(B.epoch_scores(spark, sf_dir), EPOCH_KEYS)
    return rounded(stats, "normal_mean", "normal_std", "anomaly_mean", "anomaly_std", "gap")


@query(
    "class_histogram",
    f"""WITH {SCORES}, edges AS (SELECT {G}, min(v0) AS lo, max(v0) AS hi FROM scores GROUP BY ALL),
    binned AS (SELECT {G}, CAST(least(CASE WHEN hi > lo THEN floor((v0 - lo) / ((hi - lo) / 30.0::DOUBLE)) ELSE 29 END, 29) AS INTEGER) AS bin,
                      count(*) FILTER (WHERE label = 0) AS normal, count(*) FILTER (WHERE label = 1) AS anomaly
               FROM scores JOIN edges USING (dataset, category, seed) GROUP BY ALL)
    SELECT e.dataset, e.category, e.seed, CAST(b.bin AS INTEGER) AS bin, round(lo + b.bin * ((hi - lo) / 30.0::DOUBLE), 6) + 0.0 AS edge,
           coalesce(normal, 0) AS normal, coalesce(anomaly, 0) AS anomaly
    FROM edges e CROSS JOIN range(30) b(bin) LEFT JOIN binned x
      ON x.dataset = e.dataset AND x.category = e.category AND x.seed = e.seed AND x.bin = b.bin""",
)
def class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(collapse.class_histogram(B.single_view_scores(spark, sf_dir), B.GROUP), "edge")


GES = f"{G}, epoch, split"
EPOCH_SPLIT_METRICS = f"""
split_rows AS (SELECT {G}, day - 1 AS epoch, split, label, two_view AS score FROM scores),
{curve('split_rows', GES)},
chosen AS (
  SELECT {G}, epoch, CASE WHEN max(p) > 0 AND max(n) > 0 THEN
           CASE WHEN max(tp / p - fp / n) > 0 THEN arg_max(score, (tp / p - fp / n, score)) ELSE 'infinity'::DOUBLE END
         ELSE 0.0 END AS threshold
  FROM curve WHERE split = 'val' GROUP BY ALL),
ranking AS (SELECT {GES}, {AUROC_OF_CURVE} AS auroc, {AP_OF_CURVE} AS aupr FROM curve GROUP BY ALL),
fired AS (SELECT r.*, c.threshold, r.score >= c.threshold AS hit FROM split_rows r LEFT JOIN chosen c USING (dataset, category, seed, epoch)),
confusion AS (
  SELECT {GES}, max(threshold) AS threshold,
         sum(CASE WHEN hit AND label = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN hit AND label = 0 THEN 1 ELSE 0 END)::DOUBLE AS fp,
         sum(CASE WHEN NOT hit AND label = 1 THEN 1 ELSE 0 END)::DOUBLE AS fn,
         avg(CASE WHEN label = 1 THEN ln(1 + exp(-abs(score))) + greatest(-score, 0.0) ELSE ln(1 + exp(-abs(score))) + greatest(score, 0.0) END) AS loss
  FROM fired GROUP BY ALL),
{ece_sql('split_rows', '1.0::DOUBLE / (1.0::DOUBLE + exp(-score))', BIN_RIGHT, GES)},
split_metrics AS (
  SELECT {GES}, threshold, auroc, aupr, CASE WHEN threshold IS NOT NULL THEN CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END END AS f1,
         CASE WHEN threshold IS NOT NULL THEN CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END END AS precision,
         CASE WHEN threshold IS NOT NULL THEN CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END END AS recall, ece, loss
  FROM ranking JOIN confusion USING (dataset, category, seed, epoch, split) JOIN eces USING (dataset, category, seed, epoch, split))
"""
SPLIT_METRICS = ["threshold", *metrics.METRIC_NAMES, "loss"]


@query(
    "epoch_metrics",
    f"""WITH {SCORES}, {EPOCH_SPLIT_METRICS} SELECT {GES}, {', '.join(f"{r6(c)} AS {c}" for c in SPLIT_METRICS)} FROM split_metrics""",
)
def epoch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric of every epoch on each split, at the threshold its validation rows give."""
    return rounded(metrics.metric_set_by_split(B.epoch_scores(spark, sf_dir), EPOCH_KEYS), *SPLIT_METRICS)


EPOCH_METRICS = f"""
ecurve AS (SELECT {G}, epoch, score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
             sum(pos) OVER (PARTITION BY {G}, epoch) AS p, sum(neg) OVER (PARTITION BY {G}, epoch) AS n
           FROM (SELECT {G}, epoch, score, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM epoch_rows GROUP BY ALL)
           WINDOW w AS (PARTITION BY {G}, epoch ORDER BY score DESC)),
emetrics AS (SELECT {G}, epoch, {r6(AUROC_OF_CURVE)} AS value FROM ecurve GROUP BY ALL),
elosses AS (SELECT {G}, epoch, {r6('avg(CASE WHEN label = 1 THEN ln(1 + exp(-abs(score))) + greatest(-score, 0.0) ELSE ln(1 + exp(-abs(score))) + greatest(score, 0.0) END)')} AS secondary
            FROM epoch_rows GROUP BY ALL),
trajectory AS (SELECT {G}, row_number() OVER (PARTITION BY {G} ORDER BY epoch) - 1 AS epoch, value, secondary
               FROM emetrics JOIN elosses USING (dataset, category, seed, epoch)),
numbered AS (SELECT *, epoch + 1 AS i FROM trajectory),
numbered_stats AS (SELECT * REPLACE (row_number() OVER (PARTITION BY {G} ORDER BY epoch) - 1 AS epoch) FROM stats)
"""
# The fold again, one epoch per recursion step.
FOLD = f"""
fold AS (
  SELECT {G}, 0::BIGINT AS i, NULL::DOUBLE AS best, -1 AS best_epoch, NULL::DOUBLE AS second, 0 AS counter, 0 AS tie_wins, FALSE AS stopped,
         0 AS epochs_ran, -1 AS epoch, FALSE AS is_best, FALSE AS tie_win
  FROM (SELECT DISTINCT {G} FROM trajectory)
  UNION ALL
  SELECT dataset, category, seed, i, CASE WHEN improved OR tied THEN value ELSE best END,
         CASE WHEN improved OR tied THEN epoch ELSE best_epoch END,
         CASE WHEN (improved OR tied) AND secondary IS NOT NULL THEN secondary ELSE second END,
         CASE WHEN improved THEN 0 ELSE counter + 1 END, tie_wins + CASE WHEN tied THEN 1 ELSE 0 END,
         CASE WHEN improved THEN 0 ELSE counter + 1 END >= 5 AND epoch + 1 >= 8, epochs_ran + 1, epoch, improved OR tied, tied
  FROM (
    SELECT f.dataset, f.category, f.seed, n.i, f.best, f.best_epoch, f.second, f.counter, f.tie_wins, f.epochs_ran, n.epoch, n.value, n.secondary,
           n.value IS NOT NULL AND (f.best IS NULL OR n.value > f.best) AS improved,
           n.value IS NOT NULL AND f.best IS NOT NULL AND NOT (n.value > f.best) AND abs(n.value - f.best) <= 1e-12
             AND n.secondary IS NOT NULL AND (f.second IS NULL OR n.secondary < f.second - 1e-12) AS tied
    FROM fold f JOIN numbered n ON n.dataset = f.dataset AND n.category = f.category AND n.seed = f.seed AND n.i = f.i + 1
    WHERE NOT f.stopped)),
last_step AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY {G} ORDER BY i DESC) = 1)
"""
SELECTOR = {"patience": 5, "min_epochs": 8}


def numbered(by_epoch: DataFrame) -> DataFrame:
    """Epochs of each run renumbered from 0 without gaps (a table with one row per run and day)."""
    place = F.row_number().over(Window.partitionBy(*B.GROUP).orderBy("epoch")) - 1
    return by_epoch.withColumn("epoch", place)


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run and epoch: AUROC as the monitored value and the loss as the tie-break."""
    by_epoch = metrics.curve(B.epoch_scores(spark, sf_dir), EPOCH_KEYS).groupBy(*EPOCH_KEYS).agg(
        metrics.auroc_of_curve().alias("value"), metrics.loss_of_curve().alias("secondary")
    )
    return numbered(rounded(by_epoch, "value", "secondary"))


@query(
    "best_epoch",
    f"""WITH RECURSIVE {SCORES}, {EPOCH_STATS}, {EPOCH_METRICS}, {FOLD}
    SELECT {G}, best_epoch, {r6('best')} AS best_value, tie_wins, epochs_ran,
           CASE WHEN stopped THEN 'patience' ELSE 'epoch_cap' END AS stop_reason, best_epoch < 0 AS selection_failed
    FROM last_step""",
)
def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.best_epochs(trajectory(spark, sf_dir), B.GROUP, **SELECTOR), "best_value")


@query(
    "selection_history",
    f"""WITH RECURSIVE {SCORES}, {EPOCH_STATS}, {EPOCH_METRICS}, {FOLD}
    SELECT {G}, epoch, is_best, tie_win, best_epoch, {r6('best')} AS best_value, greatest(5 - counter, 0) AS patience_left
    FROM fold WHERE i > 0""",
)
def selection_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.selection_history(trajectory(spark, sf_dir), B.GROUP, **SELECTOR), "best_value")


def collapsed_runs(spark: SparkSession, sf_dir: str, selected: DataFrame) -> DataFrame:
    """The verdict of every run on its selected epoch."""
    stats = numbered(collapse.class_statistics(B.epoch_scores(spark, sf_dir), EPOCH_KEYS))
    return collapse.detect_collapse(stats, B.GROUP, selected)


COLLAPSE = f"""
judged AS (
      SELECT s.*, l.best_epoch, s.gap IS NOT NULL AS known, sqrt((normal_std * normal_std + anomaly_std * anomaly_std) / 2) AS pooled
      FROM numbered_stats s JOIN last_step l ON s.dataset = l.dataset AND s.category = l.category AND s.seed = l.seed),
    runs AS (
      SELECT {G}, CAST(count(*) FILTER (WHERE known) AS INTEGER) AS n_epochs, max(abs(gap)) AS max_abs_gap,
             quantile_cont(abs(gap), 0.5) AS median_abs_gap, arg_max(gap, epoch) FILTER (WHERE known) AS final_gap,
             max(gap) FILTER (WHERE known AND epoch = best_epoch) AS selected_gap,
             max(CASE WHEN pooled > 1e-12 THEN abs(gap) / pooled END) FILTER (WHERE known AND epoch = best_epoch) AS d_prime,
             avg(CASE WHEN gap > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE known) AS sign_consistency
      FROM judged GROUP BY ALL),
    named AS (
      SELECT *, concat_ws('; ', CASE WHEN selected_gap IS NOT NULL AND abs(selected_gap) < 0.1 THEN 'selected gap below eps' END,
               CASE WHEN selected_gap IS NULL AND median_abs_gap < 0.1 THEN 'median gap below eps' END,
               CASE WHEN n_epochs >= 5 AND sign_consistency < 0.75 THEN 'gap changes sign' END,
               CASE WHEN d_prime < 0.35 THEN 'separation below its own spread' END) AS triggered
      FROM runs)
"""


@query(
    "collapse_flags",
    f"""WITH RECURSIVE {SCORES}, {EPOCH_STATS}, {EPOCH_METRICS}, {FOLD}, {COLLAPSE}
    SELECT {G}, n_epochs, {r6('max_abs_gap')} AS max_abs_gap, {r6('median_abs_gap')} AS median_abs_gap, {r6('final_gap')} AS final_gap,
           {r6('selected_gap')} AS selected_gap, {r6('d_prime')} AS d_prime, {r6('sign_consistency')} AS sign_consistency, triggered,
           CASE WHEN n_epochs > 0 THEN triggered <> '' END AS collapsed
    FROM named""",
)
def collapse_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapsed_runs(spark, sf_dir, selection.best_epochs(trajectory(spark, sf_dir), B.GROUP, **SELECTOR))
    return rounded(found, "max_abs_gap", "median_abs_gap", "final_gap", "selected_gap", "d_prime", "sign_consistency")


@query(
    "epoch_table",
    f"""WITH RECURSIVE {SCORES}, {EPOCH_STATS}, {EPOCH_METRICS}
    SELECT {G}, epoch, value, secondary, CASE WHEN epoch % 2 = 0 THEN {r6('value * 2')} END AS grad_norm FROM trajectory""",
)
def epoch_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs with the gradient norms of the epochs that logged them."""
    epochs = trajectory(spark, sf_dir)
    norms = rounded(epochs.where("epoch % 2 = 0").select(*B.GROUP, "epoch", (F.col("value") * 2).alias("grad_norm")), "grad_norm")
    return selection.epoch_table(epochs, norms, B.GROUP)
