"""Row-by-row comparison of two runs, and of their settings and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.functions.arrays import max_abs_difference
from siftmark.operators.joins import require


def same_test_set(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: items on each side and whether both hold the same items with the same labels."""
    return pairs.groupBy(*keys).agg(
        F.count("label_a").alias("n_a"),
        F.count("label_b").alias("n_b"),
        F.bool_and(F.col("label_a").eqNullSafe(F.col("label_b"))).alias("same"),
    )


def rerun_compare(new: DataFrame, old: DataFrame, keys: list[str], tolerance: float = 0.0, path: str = "path") -> DataFrame:
    """Per group: same files and labels, and the largest difference over all views within the tolerance."""
    left = new.select(*keys, path, F.col("label").alias("label_a"), F.col("views").alias("views_a"))
    right = old.select(*keys, path, F.col("label").alias("label_b"), F.col("views").alias("views_b"))
    both = left.join(right, [*keys, path], "full")
    found = both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.bool_and(F.col("label_a").eqNullSafe(F.col("label_b"))).alias("same_files"),
        F.max(max_abs_difference(F.col("views_a"), F.col("views_b"))).alias("max_abs_diff"),
    )
    return found.withColumn("passed", F.col("same_files") & (F.coalesce("max_abs_diff", F.lit(0.0)) <= tolerance))


def fields_equal(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str], when: Column | None = None) -> DataFrame:
    """Per key whether the named fields of two tables agree (missing equals missing)."""
    left = a.select(*keys, *[F.col(f).alias(f"{f}_a") for f in fields])
    right = b.select(*keys, *[F.col(f).alias(f"{f}_b") for f in fields])
    joined = left.join(right, keys, "full")
    differing = F.array_compact(F.array(*[F.when(~F.col(f"{f}_a").eqNullSafe(F.col(f"{f}_b")), f) for f in fields]))
    if when is not None:
        differing = F.when(when, differing).otherwise(F.array().cast("array<string>"))
    return joined.select(*keys, F.array_join(differing, ",").alias("differing"), (F.size(differing) == 0).alias("equal"))


def metric_compare(a: DataFrame, b: DataFrame, keys: list[str], metrics: list[str], tolerance: float) -> DataFrame:
    """One row per key and metric: both values, their gap, and whether it is within the tolerance."""

    def long(df: DataFrame, side: str) -> DataFrame:
        return df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(keys, metrics, "metric", side)

    joined = long(a, "value_a").join(long(b, "value_b"), [*keys, "metric"], "full")
    gap = F.abs(F.col("value_a") - F.col("value_b"))
    both_missing = F.col("value_a").isNull() & F.col("value_b").isNull()
    return joined.withColumn("gap", gap).withColumn("passed", F.coalesce(F.col("gap") <= tolerance, both_missing))


def settings_diff(registry: DataFrame, pairs: DataFrame) -> DataFrame:
    """Keys whose values differ between the two runs of each pair.

    ``registry`` has (run, key, value), ``pairs`` (run_a, run_b). A key only one run sets differs too.
    """
    a = pairs.join(registry.withColumnRenamed("run", "run_a"), "run_a").select("run_a", "run_b", "key", F.col("value").alias("value_a"), F.lit(1).alias("has_a"))
    b = pairs.join(registry.withColumnRenamed("run", "run_b"), "run_b").select("run_a", "run_b", "key", F.col("value").alias("value_b"), F.lit(1).alias("has_b"))
    joined = a.join(b, ["run_a", "run_b", "key"], "full")
    differs = ~F.col("value_a").eqNullSafe(F.col("value_b")) | F.col("has_a").isNull() | F.col("has_b").isNull()
    return joined.where(differs).select("run_a", "run_b", "key", "value_a", "value_b")


def comparable_pairs(pairs: DataFrame, diff: DataFrame, strict: bool = False) -> DataFrame:
    """Pairs with the number of differing keys; ``strict`` fails on the first pair that differs."""
    counts = diff.groupBy("run_a", "run_b").agg(F.count(F.lit(1)).alias("n_differing"))
    out = pairs.join(counts, ["run_a", "run_b"], "left").withColumn("n_differing", F.coalesce("n_differing", F.lit(0)).cast("bigint"))
    out = out.withColumn("comparable", F.col("n_differing") == 0)
    if strict:
        message = F.concat(F.lit("runs differ in settings: "), F.col("run_a").cast("string"), F.lit(" and "), F.col("run_b").cast("string"))
        out = require(out, F.col("comparable"), message)
    return out
