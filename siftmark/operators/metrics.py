"""Ranking, threshold and calibration metrics of scored, labelled rows.

Everything that depends on the order of scores is read off one table, ``curve``: distinct scores in
descending order with the positives and negatives at or above each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.functions.scoring import left_closed_bin, logit_loss, prior_corrected, right_closed_bin, sigmoid
from siftmark.operators.joins import null_safe_lookup
from siftmark.operators.ranking import running_totals, tally

# Metric names in reporting order.
METRIC_NAMES = ["auroc", "aupr", "f1", "precision", "recall", "ece"]


def class_counts(label: str = "label") -> dict[str, Column]:
    positive = F.when(F.col(label) == 1, 1).otherwise(0).cast("bigint")
    return {"pos": positive, "neg": F.lit(1).cast("bigint") - positive}


def curve_of(counted: DataFrame, keys: list[str], buckets: int | None = None, source: DataFrame | None = None) -> DataFrame:
    """Per distinct score: pos, neg, and tp / fp at a threshold equal to it, with group totals p and n.

    ``counted`` has one row per (keys, score) with the numbers of positives and negatives, which may be
    weights of a resample.
    """
    placed = running_totals(counted, keys, "score", ["pos", "neg"], descending=True, buckets=buckets, source=source)
    return placed.select(
        *keys,
        "score",
        "pos",
        "neg",
        F.col("pos_cum").alias("tp"),
        F.col("neg_cum").alias("fp"),
        F.col("pos_total").alias("p"),
        F.col("neg_total").alias("n"),
    )


def curve(
    scores: DataFrame, keys: list[str], score: str = "score", label: str = "label", buckets: int | None = None
) -> DataFrame:
    """``curve_of`` for plain rows."""
    rows = scores.select(*keys, F.col(score).alias("score"), F.col(label).alias("label"))
    return curve_of(tally(rows, keys, "score", class_counts()), keys, buckets, rows.select("score"))


def _two_classes(value: Column) -> Column:
    return F.when((F.max("p") > 0) & (F.max("n") > 0), value)


def auroc_of_curve() -> Column:
    """Mann-Whitney statistic with tied scores counted half; an aggregate over ``curve``."""
    below = (F.col("n") - F.col("fp")).cast("double") + F.col("neg") / F.lit(2.0)
    wins = F.sum(F.col("pos") * below)
    return _two_classes(F.try_divide(wins, F.max("p").cast("double") * F.max("n").cast("double")))


def average_precision_of_curve() -> Column:
    """Step sum over distinct thresholds; tied scores enter together."""
    gain = F.sum(F.col("pos") * (F.col("tp").cast("double") / (F.col("tp") + F.col("fp")).cast("double")))
    return _two_classes(F.try_divide(gain, F.max("p").cast("double")))


def harmonic_gap(n: Column, more: Column) -> Column:
    """H(n + more) - H(n) of harmonic numbers: sixteen terms by themselves, the rest by their asymptotic series."""
    n, more = n.cast("double"), more.cast("double")
    first = F.aggregate(F.sequence(F.lit(1), F.lit(16)), F.lit(0.0), lambda acc, i: acc + 1.0 / (n + i) - 1.0 / (n + more + i))
    low, high = n + 16.0, n + more + 16.0
    rest = F.log1p(more / low)
    for power, factor in ((1, 1 / 2), (2, -1 / 12), (4, 1 / 120), (6, -1 / 252), (8, 1 / 240)):
        rest = rest + F.lit(factor) * (F.pow(high, F.lit(-power)) - F.pow(low, F.lit(-power)))
    return first + rest


def average_precision_positives_first() -> Column:
    """Average precision when, among equal scores, the positives are listed before the negatives.

    A tie of m positives below t hits and f false alarms adds the sum of (t + j) / (t + f + j) for j = 1..m, which is
    m - f * (H(t + f + m) - H(t + f)); so no tie becomes an array.
    """
    above = F.col("tp") - F.col("pos")
    false_above = F.col("fp") - F.col("neg")
    gain = F.col("pos").cast("double") - false_above.cast("double") * harmonic_gap(above + false_above, F.col("pos"))
    return F.try_divide(F.sum(F.when(F.col("pos") > 0, gain)), F.max("p").cast("double"))


def loss_of_curve() -> Column:
    """Mean unweighted logit loss; an aggregate over ``curve``."""
    loss = F.col("pos") * logit_loss(F.col("score"), F.lit(1)) + F.col("neg") * logit_loss(F.col("score"), F.lit(0))
    return F.sum(loss) / F.sum(F.col("pos") + F.col("neg"))


# Metrics a resample may ask for by name, as aggregates over ``curve_of``.
RESAMPLE_METRICS = {"auroc": auroc_of_curve, "aupr": average_precision_positives_first}


def youden_of_curve() -> Column:
    """Highest threshold with the largest tpr - fpr; above every score if none beats zero."""
    gap = F.try_divide(F.col("tp").cast("double"), F.col("p")) - F.try_divide(F.col("fp").cast("double"), F.col("n"))
    usable = F.when((F.col("p") > 0) & (F.col("n") > 0), F.struct(gap.alias("gap"), F.col("score").alias("score")))
    best = F.max(usable)
    return F.when(best["gap"] > 0, best["score"]).when(best["gap"].isNotNull(), F.lit(float("inf")))


def f1_of_curve() -> Column:
    """Lowest threshold with the largest F1."""
    precision = F.col("tp").cast("double") / (F.col("tp") + F.col("fp"))
    recall = F.try_divide(F.col("tp").cast("double"), F.col("p"))
    f1 = F.when(precision + recall > 0, F.lit(2.0) * precision * recall / (precision + recall)).otherwise(0.0)
    usable = F.when((F.col("p") > 0) & (F.col("n") > 0), F.struct(f1.alias("f1"), (-F.col("score")).alias("low")))
    return -F.max(usable)["low"]


def auroc(scores: DataFrame, keys: list[str], score: str = "score", label: str = "label", buckets: int | None = None) -> DataFrame:
    """AUROC per group; NULL for a group with one class."""
    return curve(scores, keys, score, label, buckets).groupBy(*keys).agg(auroc_of_curve().alias("auroc"))


def average_precision(
    scores: DataFrame, keys: list[str], score: str = "score", label: str = "label", buckets: int | None = None
) -> DataFrame:
    """Average precision per group with ties merged."""
    return curve(scores, keys, score, label, buckets).groupBy(*keys).agg(average_precision_of_curve().alias("aupr"))


def average_precision_row_order(
    scores: DataFrame, keys: list[str], position: str, score: str = "score", label: str = "label", buckets: int | None = None
) -> DataFrame:
    """Average precision per group where tied rows keep their order by ``position`` (a unique number).

    Two nested running totals: over distinct scores, then over positions among rows of one score, so
    that neither a large group nor a large tie ends up in one task.
    """
    above = curve(scores, keys, score, label, buckets).select(
        *keys, "score", (F.col("tp") - F.col("pos")).alias("tp_above"), (F.col("fp") - F.col("neg")).alias("fp_above"), "p"
    )
    rows = scores.select(*keys, F.col(score).alias("score"), F.col(position).alias("position"), *[
        c.alias(name) for name, c in class_counts(label).items()
    ])
    in_tie = running_totals(rows, [*keys, "score"], "position", ["pos", "neg"], buckets=buckets).where("pos = 1")
    joined = null_safe_lookup(in_tie, above, [*keys, "score"], "inner")
    hits = F.col("tp_above") + F.col("pos_cum")
    rank = hits + F.col("fp_above") + F.col("neg_cum")
    found = joined.groupBy(*keys).agg((F.sum(hits.cast("double") / rank) / F.max("p")).alias("aupr_row_order"))
    groups = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return null_safe_lookup(groups, found, keys).select(*keys, "aupr_row_order")


def roc_points(scores: DataFrame, keys: list[str], score: str = "score", label: str = "label", buckets: int | None = None) -> DataFrame:
    """False and true positive rate at every distinct score."""
    return curve(scores, keys, score, label, buckets).select(
        *keys,
        F.col("score").alias("threshold"),
        F.try_divide(F.col("fp").cast("double"), F.col("n")).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.col("p")).alias("tpr"),
    )


def pr_points(scores: DataFrame, keys: list[str], score: str = "score", label: str = "label", buckets: int | None = None) -> DataFrame:
    """Precision and recall at every distinct score."""
    return curve(scores, keys, score, label, buckets).select(
        *keys,
        F.col("score").alias("threshold"),
        (F.col("tp").cast("double") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.try_divide(F.col("tp").cast("double"), F.col("p")).alias("recall"),
    )


def pick_threshold(
    scores: DataFrame,
    keys: list[str],
    strategy: str = "youden",
    score: str = "score",
    label: str = "label",
    buckets: int | None = None,
) -> DataFrame:
    """The decision threshold of each group; 0 for a group with one class."""
    if strategy not in ("youden", "f1"):
        raise ValueError(f"unknown threshold strategy {strategy!r}")
    best = youden_of_curve() if strategy == "youden" else f1_of_curve()
    return curve(scores, keys, score, label, buckets).groupBy(*keys).agg(F.coalesce(best, F.lit(0.0)).alias("threshold"))


def confusion_metrics(
    scores: DataFrame, keys: list[str], threshold: str = "threshold", score: str = "score", label: str = "label"
) -> DataFrame:
    """Precision, recall and F1 of ``score >= threshold``; 0 where a denominator is 0."""
    fired, positive = F.col(score) >= F.col(threshold), F.col(label) == 1
    tp, fp, fn = F.count_if(fired & positive), F.count_if(fired & ~positive), F.count_if(~fired & positive)

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top.cast("double"), bottom), F.lit(0.0))

    return scores.groupBy(*keys).agg(
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(tp * 2, tp * 2 + fp + fn).alias("f1"),
    )


def _binned_gap(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Weighted mean of |accuracy - confidence| over the ``bin`` column."""
    bins = rows.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("rows"),
        F.abs(F.avg(F.col(label).cast("double")) - F.avg("probability")).alias("gap"),
    )
    return bins.groupBy(*keys).agg((F.sum(F.col("rows") * F.col("gap")) / F.sum("rows")).alias("ece"))


def ece_right_closed(
    scores: DataFrame, keys: list[str], score: str = "score", label: str = "label", bins: int = 15
) -> DataFrame:
    """Expected calibration error with bins (lo, hi], on the plain sigmoid."""
    rows = scores.select(*keys, label, sigmoid(F.col(score)).alias("probability"))
    return _binned_gap(rows.withColumn("bin", right_closed_bin(F.col("probability"), bins)), keys, label)


def ece_left_closed(
    scores: DataFrame, keys: list[str], pos_weight: str, score: str = "score", label: str = "label", bins: int = 15
) -> DataFrame:
    """Expected calibration error with bins [lo, hi), on the prior-corrected sigmoid."""
    corrected = sigmoid(prior_corrected(F.col(score), F.col(pos_weight)))
    rows = scores.select(*keys, label, corrected.alias("probability"))
    return _binned_gap(rows.withColumn("bin", left_closed_bin(F.col("probability"), bins)), keys, label)


def metric_set(
    scores: DataFrame,
    keys: list[str],
    thresholds: DataFrame | None = None,
    strategy: str = "youden",
    score: str = "score",
    label: str = "label",
    buckets: int | None = None,
) -> DataFrame:
    """Threshold, AUROC, average precision, F1, precision, recall and calibration error per group.

    Without ``thresholds`` (keys + ``threshold``) each group's own threshold is used; with it, a
    threshold chosen elsewhere is applied unchanged.
    """
    placed = curve(scores, keys, score, label, buckets)
    if thresholds is None:
        best = youden_of_curve() if strategy == "youden" else f1_of_curve()
        thresholds = placed.groupBy(*keys).agg(F.coalesce(best, F.lit(0.0)).alias("threshold"))
    return _metrics_of(null_safe_lookup(placed, thresholds.select(*keys, "threshold"), keys), keys).drop("loss")


def metric_set_by_split(
    scores: DataFrame,
    keys: list[str],
    choose_on: str = "val",
    strategy: str = "youden",
    score: str = "score",
    label: str = "label",
    buckets: int | None = None,
) -> DataFrame:
    """``metric_set`` of every split, and its mean loss, at the threshold that the split ``choose_on`` gives its group.

    One curve over (keys, split) serves thresholds and metrics of all splits. A group without rows in ``choose_on``
    has no threshold: its confusion metrics are NULL, the others are not.
    """
    placed = curve(scores, [*keys, "split"], score, label, buckets)
    best = youden_of_curve() if strategy == "youden" else f1_of_curve()
    chosen = placed.where(F.col("split") == choose_on).groupBy(*keys).agg(F.coalesce(best, F.lit(0.0)).alias("threshold"))
    found = _metrics_of(null_safe_lookup(placed, chosen, keys), [*keys, "split"])
    confusion = [F.when(F.col("threshold").isNotNull(), F.col(c)).alias(c) for c in ("f1", "precision", "recall")]
    return found.select(*keys, "split", "threshold", "auroc", "aupr", *confusion, "ece", "loss")


def _metrics_of(placed: DataFrame, keys: list[str]) -> DataFrame:
    """All metrics from a curve that carries its threshold. Everything is a sum over distinct scores: one pass."""
    rows = F.col("pos") + F.col("neg")
    probability = sigmoid(F.col("score"))
    fired = F.col("score") >= F.col("threshold")
    below = (F.col("n") - F.col("fp")).cast("double") + F.col("neg") / F.lit(2.0)
    losses = F.col("pos") * logit_loss(F.col("score"), F.lit(1)) + F.col("neg") * logit_loss(F.col("score"), F.lit(0))
    binned = (
        placed.withColumn("bin", right_closed_bin(probability))
        .groupBy(*keys, "bin")
        .agg(
            F.max("threshold").alias("threshold"),
            F.max("p").alias("p"),
            F.max("n").alias("n"),
            F.sum(F.col("pos") * below).alias("wins"),
            F.sum(F.col("pos") * (F.col("tp").cast("double") / (F.col("tp") + F.col("fp")))).alias("gain"),
            F.sum(F.when(fired, F.col("pos")).otherwise(0)).alias("hit"),
            F.sum(F.when(fired, F.col("neg")).otherwise(0)).alias("miss"),
            F.sum(rows).alias("rows"),
            F.abs(F.sum("pos") - F.sum(rows * probability)).alias("gap"),
            F.sum(losses).alias("loss"),
        )
    )
    p, n, hit, miss = F.max("p").cast("double"), F.max("n").cast("double"), F.sum("hit").cast("double"), F.sum("miss")

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    return binned.groupBy(*keys).agg(
        F.max("threshold").alias("threshold"),
        _two_classes(F.try_divide(F.sum("wins"), p * n)).alias("auroc"),
        _two_classes(F.try_divide(F.sum("gain"), p)).alias("aupr"),
        ratio(hit * 2, hit + miss + p).alias("f1"),
        ratio(hit, hit + miss).alias("precision"),
        ratio(hit, p).alias("recall"),
        (F.sum("gap") / F.sum("rows")).alias("ece"),
        (F.sum("loss") / F.sum("rows")).alias("loss"),
    )
