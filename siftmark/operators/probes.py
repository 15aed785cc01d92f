"""Probes for shortcut cues: can simple statistics tell two sessions apart?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.functions.arrays import norm
from siftmark.functions.draws import order_key
from siftmark.operators.joins import lookup
from siftmark.operators.metrics import auroc
from siftmark.operators.ranking import hash_cuts, quantiles, taken, top_k
from siftmark.operators.shuffles import permutation_aurocs
from siftmark.operators.vectors import standardised, sums
from siftmark.session import written

# The twelve image statistics in column order, those fixed by per-image standardisation, the
# guards of the session ratios, the jitter band and how far a negative control may stray.
IMAGE_STATISTICS = [
    "meanR", "meanG", "meanB", "stdR", "stdG", "stdB", "lum_p05", "lum_p50", "lum_p95", "sat_mean", "sharpness", "edge_density",
]
CONSTANT_WHEN_NORMALISED = ["meanR", "meanG", "meanB", "stdR", "stdG", "stdB"]
JITTER_BAND = 0.2
CONTROL_TOLERANCE = 0.15


def loo_scores(rows: DataFrame, keys: list[str], label: str = "label", z: str = "z") -> DataFrame:
    """Leave-one-out score per row: distance to the other class mean minus distance to its own side's.

    Class sums are aggregated once; each row subtracts itself from its own class, so no row meets another.
    """
    by_class = sums(rows, [*keys, label], z)

    def of_class(value: int, column: str) -> Column:
        return F.first(F.when(F.col(label) == value, F.col(column)), ignorenulls=True)

    classes = by_class.groupBy(*keys).agg(
        of_class(1, "sum").alias("_s1"), of_class(0, "sum").alias("_s0"), of_class(1, "n").alias("_n1"), of_class(0, "n").alias("_n0")
    )
    joined = lookup(rows, classes, keys)
    own1 = F.col(label).cast("double")
    own0 = F.lit(1.0) - own1

    def away(total: str, count: str, own: Column) -> Column:
        centre_gap = F.zip_with(F.col(z), F.col(total), lambda x, s: x - F.try_divide(s - x * own, F.col(count) - own))
        return norm(centre_gap)

    return joined.withColumn("probe_score", away("_s0", "_n0", own0) - away("_s1", "_n1", own1)).drop("_s0", "_s1", "_n0", "_n1")


def loo_probe(rows: DataFrame, keys: list[str], features: str, label: str = "label") -> DataFrame:
    """AUROC of the leave-one-out nearest-mean probe per group."""
    scored = loo_scores(standardised(rows, keys, features), keys, label)
    return auroc(scored, keys, "probe_score", label)


def permutation_test(
    rows: DataFrame, keys: list[str], item: str, features: str, label: str = "label", n_perm: int = 200, seed: int = 0
) -> DataFrame:
    """Probe AUROC with two-sided permutation p-values; permuted labels keep the class sizes."""
    z = standardised(rows, keys, features).select(*keys, item, "z", F.col(label).alias("label"))
    found = written(permutation_aurocs(z, keys, item, n_perm, seed), "permutations")
    real = found.where("perm = -1").select(*keys, F.col("auroc").alias("probe_auroc"))
    joined = found.where("perm >= 0").join(real, keys)
    return joined.groupBy(*keys).agg(
        F.max("probe_auroc").alias("probe_auroc"),
        ((F.count_if(F.col("auroc") >= F.col("probe_auroc")) + 1) / F.lit(float(n_perm + 1))).alias("p_high"),
        ((F.count_if(F.col("auroc") <= F.col("probe_auroc")) + 1) / F.lit(float(n_perm + 1))).alias("p_low"),
    )


def negative_control(rows: DataFrame, keys: list[str], item: str, features: str, label: str = "label", seed: int = 0) -> DataFrame:
    """The probe on two random halves of the label-0 rows; it must stay near one half."""
    halves = rows.where(F.col(label) == 0).withColumn("order_key", order_key("control", item, seed))
    cuts = hash_cuts(halves, keys, "order_key", {"half": F.floor(F.col("n") / 2)})
    marked = lookup(halves, cuts.select(*keys, "half_cut"), keys).withColumn("half", taken("order_key", "half").cast("int"))
    out = loo_probe(marked.select(*keys, features, "half"), keys, features, "half")
    return out.withColumn("control_failed", F.abs(F.col("auroc") - 0.5) > CONTROL_TOLERANCE)


def long_statistics(rows: DataFrame, keep: list[str], statistics: list[str]) -> DataFrame:
    """One row per item and statistic."""
    return rows.select(*keep, *[F.col(s).cast("double").alias(s) for s in statistics]).unpivot(keep, statistics, "statistic", "value")


def best_statistics(rows: DataFrame, keys: list[str], statistics: list[str], label: str = "label", k: int = 2) -> DataFrame:
    """The ``k`` single statistics that separate the classes best, in either direction."""
    long = long_statistics(rows, [*keys, label], statistics)
    found = auroc(long, [*keys, "statistic"], "value", label).withColumn("strength", F.abs(F.col("auroc") - 0.5))
    return top_k(found, keys, [F.col("strength").desc_nulls_last(), F.col("statistic").desc()], k)


def session_gaps(
    rows: DataFrame, keys: list[str], brightness: str, ratios: dict[str, float], session: str = "session"
) -> DataFrame:
    """Median of each statistic in the test session over that in the training session.

    ``session`` holds ``train`` and ``test``; ``ratios`` maps further statistics to the guard added to
    the training median.
    """
    statistics = [brightness, *ratios]
    long = long_statistics(rows, [*keys, session], statistics)
    medians = quantiles(long, [*keys, session, "statistic"], "value", {"median": 0.5})

    def median(name: str, where: str) -> Column:
        return F.max(F.when((F.col("statistic") == name) & (F.col(session) == where), F.col("median")))

    change = F.try_divide(median(brightness, "test"), median(brightness, "train")) - 1
    parts = [F.try_divide(median(s, "test"), median(s, "train") + F.lit(eps)).alias(f"{s}_ratio") for s, eps in ratios.items()]
    return medians.groupBy(*keys).agg((change * 100).alias("brightness_pct"), (F.abs(change) <= JITTER_BAND).alias("inside_jitter"), *parts)


def false_alarm_profile(judged: DataFrame, keys: list[str], statistics: list[str]) -> DataFrame:
    """Per statistic: its mean over alarms, other normals and validation normals, and how well it marks alarms.

    ``judged`` has a ``status`` of alarm, other or val.
    """
    long = long_statistics(judged, [*keys, "status"], statistics)
    grain = [*keys, "statistic"]
    means = long.groupBy(*grain).agg(
        *[F.avg(F.when(F.col("status") == s, F.col("value"))).alias(f"mean_{s}") for s in ("alarm", "other", "val")]
    )
    test = long.where("status in ('alarm', 'other')").withColumn("is_alarm", (F.col("status") == "alarm").cast("int"))
    return means.join(auroc(test, grain, "value", "is_alarm"), grain, "left")
