"""Latency tables: statistics, quantiles, best times, matched comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftmark.operators.ranking import order_statistics, quantiles

# Tolerances of the timing checks and the rise that ends a flat latency curve.
TIME_TOLERANCE, RATIO_TOLERANCE, KNEE_FACTOR = 0.15, 0.20, 1.15
TWO_VIEW_SUFFIX = "[x2]"


def corrected_ms(model: Column, ms: Column, legacy: Column) -> Column:
    """Two-view rows of old files hold half the batch time."""
    return F.when(legacy & model.endswith(TWO_VIEW_SUFFIX), ms * 2).otherwise(ms)


def model_key(model: Column) -> Column:
    """The name under which the best time of a model is kept."""
    return (
        F.when(model.endswith(TWO_VIEW_SUFFIX), "ours two views")
        .when(model.startswith("ours"), "ours one view")
        .otherwise(F.substring_index(model, "+", 1))
    )


def best_times(timings: DataFrame, key: Column, ms: Column, marker: str = "+full") -> DataFrame:
    """The least time per key among successful rows of fully optimised models."""
    return timings.where((F.col("status") == "ok") & F.col("model").contains(marker)).groupBy(key.alias("key")).agg(F.min(ms).alias("best_ms"))


def latency_summary(timings: DataFrame, keys: list[str], seconds: str, batch: str) -> DataFrame:
    """Mean and population deviation per batch, per-image time and throughput."""
    mean = F.avg(seconds)
    return timings.groupBy(*keys).agg(
        (mean * 1000).alias("ms_per_batch"),
        (F.stddev_pop(seconds) * 1000).alias("ms_per_batch_std"),
        (mean / F.avg(batch) * 1000).alias("ms_per_image"),
        F.try_divide(F.avg(batch), mean).alias("throughput"),
    )


def stage_quantiles(timings: DataFrame, keys: list[str], ms: str, p: float = 0.9) -> DataFrame:
    """Median, and the value at index ``int(p * (n - 1))`` of the sorted times."""
    medians = quantiles(timings, keys, ms, {"median": 0.5})
    high = order_statistics(timings, keys, ms, {"high": F.floor(F.lit(float(p)) * (F.col("n") - 1)) + 1})
    return medians.join(high.select(*keys, "high"), keys)


def matched_cells(timings: DataFrame, cell: list[str], reference: str) -> DataFrame:
    """Every other model against the reference model in the same cell: the ratio of their times."""
    ok = timings.where("status = 'ok'")
    base = ok.where(F.col("model") == reference).select(*cell, F.col("ms").alias("reference_ms"))
    other = ok.where(F.col("model") != reference)
    return other.join(base, cell).select(*cell, "model", "ms", "reference_ms", F.try_divide("reference_ms", "ms").alias("ratio"))


def compiled_gain(timings: DataFrame, cell: list[str], suffix: str = "+compile") -> DataFrame:
    """Percent change of the compiled run of a model against its eager run in the same cell."""
    ok = timings.where("status = 'ok'")
    base_name = F.regexp_replace("model", F.lit("\\" + suffix), F.lit(""))
    compiled = ok.where(F.col("model").contains(suffix)).select(*cell, base_name.alias("model"), F.col("ms").alias("compiled_ms"))
    eager = ok.where(~F.col("model").contains(suffix))
    change = F.lit(100.0) * F.try_divide(F.col("compiled_ms") - F.col("ms"), F.col("ms"))
    return eager.join(compiled, [*cell, "model"]).select(*cell, "model", "ms", "compiled_ms", change.alias("change_pct"))


def latency_knee(timings: DataFrame, keys: list[str], size: str, ms: str, factor: float = KNEE_FACTOR) -> DataFrame:
    """The first size slower than ``factor`` times the smallest size; NULL if the curve stays flat.

    Needs two sizes. Sizes of a model are few, so one window per model is small.
    """
    by_size = Window.partitionBy(*keys).orderBy(size)
    marked = timings.withColumn("_base", F.first(ms).over(by_size)).withColumn("_sizes", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    risen = F.when(F.col(ms) > F.col("_base") * factor, F.col(size))
    return marked.where("_sizes >= 2").groupBy(*keys).agg(F.min(risen).alias("knee"))


def time_verdict(new: DataFrame, old: DataFrame, tolerance: float = TIME_TOLERANCE) -> DataFrame:
    """Relative change of each key's time and whether it stays within the tolerance."""
    joined = new.select("key", F.col("best_ms").alias("new_ms")).join(old.select("key", F.col("best_ms").alias("old_ms")), "key")
    change = F.try_divide(F.col("new_ms") - F.col("old_ms"), F.col("old_ms"))
    return joined.withColumn("change", change).withColumn("passed", F.abs(F.col("change")) <= tolerance)


def ratio_verdict(times: DataFrame, base: str, expected: DataFrame, tolerance: float = RATIO_TOLERANCE) -> DataFrame:
    """Each key's time over the base key's, against an expected ratio."""
    own = times.where(F.col("key") == base).select(F.col("best_ms").alias("base_ms"))
    joined = times.where(F.col("key") != base).join(expected, "key").withColumn("base_ms", own.scalar())
    ratio = F.try_divide("best_ms", "base_ms")
    return joined.select("key", ratio.alias("ratio"), "expected").withColumn(
        "passed", F.abs(F.col("ratio") - F.col("expected")) / F.col("expected") <= tolerance
    )


def order_verdict(times: DataFrame, expected_order: list[str]) -> DataFrame:
    """True if the named keys are strictly faster in the given order (a list of a few names)."""
    place = F.array_position(F.array(*[F.lit(k) for k in expected_order]), F.col("key"))
    known = times.where(F.col("key").isin(expected_order)).withColumn("place", place)
    step = F.col("best_ms") > F.lag("best_ms").over(Window.orderBy("place"))
    return known.withColumn("step_ok", F.coalesce(step, F.lit(True))).agg(
        (F.bool_and("step_ok") & (F.count(F.lit(1)) == len(expected_order))).alias("in_order")
    )


def wait_share(stages: DataFrame, keys: list[str], wait: str, compute: str) -> DataFrame:
    """Seconds waited and computed, and the waiting share (NULL if neither)."""
    sums = stages.groupBy(*keys).agg(F.sum(wait).alias("wait_s"), F.sum(compute).alias("compute_s"))
    return sums.withColumn("wait_share", F.round(F.try_divide(F.col("wait_s"), F.col("wait_s") + F.col("compute_s")), 4))
