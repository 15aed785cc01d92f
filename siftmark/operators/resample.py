"""Stratified and paired bootstrap, and the noise band over seeds.

Class sizes are kept exactly in every replicate, and the weights of a replicate are computed where the rows lie (``weights``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.operators import weights
from siftmark.operators.metrics import RESAMPLE_METRICS, average_precision_row_order, curve
from siftmark.operators.weights import multiplicities  # noqa: F401


def replicate_metric(
    rows: DataFrame, keys: list[str], arms: dict[str, str], metric: str, n_boot: int, seed: int = 0
) -> DataFrame:
    """One metric value per group, replicate and arm; all arms use the same draws."""
    if metric not in RESAMPLE_METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {sorted(RESAMPLE_METRICS)}")
    return weights.replicate_metric(rows, keys, arms, metric, n_boot, seed)


def interquartile_mean(value: str) -> Column:
    """Mean of the middle half of a bounded list of values, as an aggregate."""
    ordered = F.array_sort(F.collect_list(value))
    n = F.size(ordered)
    low, high = F.floor(n * 0.25).cast("int"), F.ceil(n * 0.75).cast("int")
    core = F.slice(ordered, low + 1, F.greatest(high - low, F.lit(1)))
    return F.try_divide(F.aggregate(core, F.lit(0.0), lambda acc, v: acc + v), F.size(core))


def percentile_interval(value: str, alpha: float) -> tuple[Column, Column]:
    """Lower and upper end of the percentile interval over replicates."""
    return F.percentile(value, F.lit(alpha / 2)), F.percentile(value, F.lit(1 - alpha / 2))


def class_sizes(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("label") == 1).alias("n_pos"),
        F.count_if(F.col("label") == 0).alias("n_neg"),
    )


def point_values(scores: DataFrame, keys: list[str], metric: str, position: str | None) -> DataFrame:
    """The metric of the rows themselves, ``value``. Average precision takes tied rows in the order of ``position``, a unique number."""
    if metric != "aupr":
        return curve(scores, keys).groupBy(*keys).agg(RESAMPLE_METRICS[metric]().alias("value"))
    if position is None:
        raise ValueError("average precision needs the column that numbers the rows")
    return average_precision_row_order(scores, keys, position).withColumnRenamed("aupr_row_order", "value")


def bootstrap_interval(
    scores: DataFrame, keys: list[str], metric: str = "auroc", n_boot: int = 1000, alpha: float = 0.05, seed: int = 0, position: str | None = None
) -> DataFrame:
    """Point value, interquartile mean and percentile interval per group; single-class groups are noted."""
    values = replicate_metric(scores, keys, {"a": "score"}, metric, n_boot, seed)
    low, high = percentile_interval("value", alpha)
    spread = values.groupBy(*keys).agg(interquartile_mean("value").alias("iqm"), low.alias("lo"), high.alias("hi"))
    point = point_values(scores, keys, metric, position).withColumnRenamed("value", "point")
    sizes = class_sizes(scores, keys)
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    joined = sizes.join(point, keys, "left").join(spread, keys, "left")
    return joined.select(
        *keys,
        "n",
        "n_pos",
        *[F.when(both, F.col(c)).alias(c) for c in ("point", "iqm", "lo", "hi")],
        F.when(both, F.col("hi") - F.col("lo")).alias("width"),
        F.when(~both, "single-class test split").alias("note"),
    )


def pair_scores(a: DataFrame, b: DataFrame, keys: list[str], path: str = "path", position: str | None = None) -> DataFrame:
    """Both runs' scores per item of the groups both cover; a full join, so one-sided items stay visible."""
    left = a.select(*keys, path, *[position] * bool(position), F.col("label").alias("label_a"), F.col("score").alias("score_a"))
    right = b.select(*keys, path, F.col("label").alias("label_b"), F.col("score").alias("score_b"))
    return left.join(right, [*keys, path], "full")


def paired_bootstrap(
    a: DataFrame, b: DataFrame, keys: list[str], metric: str = "auroc", n_boot: int = 1000, alpha: float = 0.05, seed: int = 0, position: str | None = None
) -> DataFrame:
    """B against A on the same draws; groups whose test sets differ or hold one class are noted, not scored."""
    pairs = pair_scores(a, b, keys, position=position)
    shared = pairs.groupBy(*keys).agg(
        F.max(F.col("label_a").isNotNull()).alias("in_a"),
        F.max(F.col("label_b").isNotNull()).alias("in_b"),
        F.bool_and(F.col("label_a").eqNullSafe(F.col("label_b"))).alias("same"),
        F.count_if(F.col("label_a") == 1).alias("n_pos"),
        F.count_if(F.col("label_a") == 0).alias("n_neg"),
    ).where("in_a and in_b")
    note = F.when(~F.col("same"), "test splits differ").when((F.col("n_pos") == 0) | (F.col("n_neg") == 0), "single-class test split")
    shared = shared.withColumn("note", note)
    rows = pairs.withColumnRenamed("label_a", "label").where("label is not null and label_b is not null")
    values = replicate_metric(rows, keys, {"a": "score_a", "b": "score_b"}, metric, n_boot, seed)
    deltas = values.groupBy(*keys, "replicate").agg(
        (F.max(F.when(F.col("arm") == "b", F.col("value"))) - F.max(F.when(F.col("arm") == "a", F.col("value")))).alias("delta")
    )
    low, high = percentile_interval("delta", alpha)
    spread = deltas.groupBy(*keys).agg(
        interquartile_mean("delta").alias("delta_iqm"),
        low.alias("lo"),
        high.alias("hi"),
        F.avg((F.col("delta") > 0).cast("double")).alias("p_improve"),
    )
    arms = F.array(F.struct(F.lit("a").alias("arm"), F.col("score_a").alias("score")), F.struct(F.lit("b").alias("arm"), F.col("score_b").alias("score")))
    numbered = [position] * bool(position)
    long = rows.select(*keys, "label", *numbered, F.explode(arms).alias("s")).select(*keys, "label", *numbered, "s.arm", "s.score")
    points = point_values(long, [*keys, "arm"], metric, position)
    points = points.groupBy(*keys).agg(
        F.max(F.when(F.col("arm") == "a", F.col("value"))).alias("a"), F.max(F.when(F.col("arm") == "b", F.col("value"))).alias("b")
    ).withColumn("delta", F.col("b") - F.col("a"))
    scored = F.col("note").isNull()
    joined = shared.join(points, keys, "left").join(spread, keys, "left")
    resolved = (F.col("lo") > 0) | (F.col("hi") < 0)
    return joined.select(
        *keys,
        (F.col("n_pos") + F.col("n_neg")).alias("n"),
        "n_pos",
        *[F.when(scored, F.col(c)).alias(c) for c in ("a", "b", "delta", "delta_iqm", "lo", "hi", "p_improve")],
        F.when(scored, resolved).alias("resolved"),
        "note",
    )


def comparison_roll_up(paired: DataFrame, keys: list[str]) -> DataFrame:
    """How many groups resolved better, worse or not, and the interquartile mean of their deltas."""
    ok = paired.where("note is null")
    return ok.groupBy(*keys).agg(
        F.count_if(F.col("resolved") & (F.col("delta_iqm") > 0)).alias("better"),
        F.count_if(F.col("resolved") & (F.col("delta_iqm") < 0)).alias("worse"),
        F.count_if(~F.col("resolved")).alias("unresolved"),
        interquartile_mean("delta_iqm").alias("iqm_of_deltas"),
        F.percentile(F.col("hi") - F.col("lo"), F.lit(0.5)).alias("median_width"),
    )


def noise_band(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Spread over seeds: the sample deviation, undefined (not zero) for fewer than two seeds."""
    found = values.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    several = F.col("n") >= 2
    return found.withColumn("sem", F.col("std") / F.sqrt(F.col("n").cast("double"))).withColumn(
        "range", F.when(several, F.col("max") - F.col("min"))
    )


def delta_verdict(delta: Column, band_a: Column, n_a: Column, band_b: Column, n_b: Column, k: float = 2.0) -> Column:
    """Is a difference of two seed means larger than ``k`` standard errors?"""
    other = F.coalesce(band_b, band_a)
    error = F.sqrt(band_a * band_a / n_a + other * other / n_b)
    z = F.try_divide(F.abs(delta), error)
    weak = F.when(F.abs(delta) > band_a, "REAL (raw deviation)").otherwise("NOT DISTINGUISHABLE (raw deviation)")
    counted = (F.coalesce(n_a, F.lit(0)) > 0) & (F.coalesce(n_b, F.lit(0)) > 0)
    return (
        F.when(band_a.isNull(), "NO BAND (fewer than 2 seeds)")
        .when(~counted, weak)
        .when(error <= 0, "NO BAND (zero spread)")
        .when(z > k, "REAL")
        .otherwise("NOT DISTINGUISHABLE")
    )
