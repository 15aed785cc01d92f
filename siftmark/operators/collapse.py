"""Class separation over epochs: means, histograms, and the test for runs that never separated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.operators.joins import lookup


def class_statistics(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Count, mean and population deviation of each class, and the gap of the means."""
    parts = []
    for name, label in (("normal", 0), ("anomaly", 1)):
        value = F.when(F.col("label") == label, F.col("score"))
        parts += [
            F.count(value).alias(f"{name}_count"),
            F.avg(value).alias(f"{name}_mean"),
            F.stddev_pop(value).alias(f"{name}_std"),
        ]
    return scores.groupBy(*keys).agg(*parts).withColumn("gap", F.col("anomaly_mean") - F.col("normal_mean"))


def class_histogram(scores: DataFrame, keys: list[str], bins: int = 30) -> DataFrame:
    """Counts per class and bin with edges shared by both classes; empty bins are present."""
    edges = scores.groupBy(*keys).agg(F.min("score").alias("low"), F.max("score").alias("high"))
    placed = lookup(scores, edges, keys)
    width = (F.col("high") - F.col("low")) / F.lit(float(bins))
    position = F.try_divide(F.col("score") - F.col("low"), width)
    bin_of = F.least(F.coalesce(F.floor(position), F.lit(bins - 1)), F.lit(bins - 1)).cast("int")
    counted = placed.withColumn("bin", bin_of).groupBy(*keys, "bin").agg(
        F.count_if(F.col("label") == 0).alias("normal"), F.count_if(F.col("label") == 1).alias("anomaly")
    )
    every = edges.select(*keys, "low", "high", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    step = (F.col("high") - F.col("low")) / F.lit(float(bins))
    return every.join(counted, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("low") + F.col("bin") * step).alias("edge"),
        F.coalesce("normal", F.lit(0)).cast("bigint").alias("normal"),
        F.coalesce("anomaly", F.lit(0)).cast("bigint").alias("anomaly"),
    )


def detect_collapse(
    statistics: DataFrame, keys: list[str], selected: DataFrame | None = None,
    eps: float = 0.1, sign_min: float = 0.75, d_prime_min: float = 0.35,
) -> DataFrame:
    """Did the selected epoch separate the classes?

    ``statistics`` is ``class_statistics`` per run and epoch, ``selected`` the best epoch per run.
    ``collapsed`` is NULL for a run without an epoch that has both classes.
    """
    known = statistics.withColumn("known", F.col("gap").isNotNull())
    if selected is None:
        known = known.withColumn("best_epoch", F.lit(None).cast("int"))
    else:
        known = lookup(known, selected.select(*keys, "best_epoch"), keys)
    at_best = F.col("known") & (F.col("epoch") == F.col("best_epoch"))
    pooled = F.sqrt((F.col("normal_std") * F.col("normal_std") + F.col("anomaly_std") * F.col("anomaly_std")) / 2)
    gap = F.when(F.col("known"), F.col("gap"))
    runs = known.groupBy(*keys).agg(
        F.count_if("known").cast("int").alias("n_epochs"),
        F.max(F.abs(gap)).alias("max_abs_gap"),
        F.percentile(F.abs(gap), F.lit(0.5)).alias("median_abs_gap"),
        F.max_by("gap", F.when(F.col("known"), F.col("epoch"))).alias("final_gap"),
        F.max(F.when(at_best, F.col("gap"))).alias("selected_gap"),
        F.max(F.when(at_best & (pooled > 1e-12), F.abs(F.col("gap")) / pooled)).alias("d_prime"),
        F.avg(F.when(F.col("known"), (F.col("gap") > 0).cast("double"))).alias("sign_consistency"),
    )
    has_selected = F.col("selected_gap").isNotNull()
    reasons = F.array_compact(
        F.array(
            F.when(has_selected & (F.abs("selected_gap") < eps), "selected gap below eps"),
            F.when(~has_selected & (F.col("median_abs_gap") < eps), "median gap below eps"),
            F.when((F.col("n_epochs") >= 5) & (F.col("sign_consistency") < sign_min), "gap changes sign"),
            F.when(F.col("d_prime") < d_prime_min, "separation below its own spread"),
        )
    )
    return runs.withColumn("triggered", F.array_join(reasons, "; ")).withColumn(
        "collapsed", F.when(F.col("n_epochs") > 0, F.size(reasons) > 0)
    )
