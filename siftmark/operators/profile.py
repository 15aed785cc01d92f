"""Profiles of splits: counts, flags, warnings, class weights, multipliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Floors below which counts make a number noisy, and the bounds of a balanced ratio.
TEST_FLOOR, VAL_FLOOR, TRAIN_FLOOR = 15, 10, 8
RATIO_LOW, RATIO_HIGH = 0.05, 0.95
SPLITS = ["train", "val", "test"]


def split_profile(records: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, normals, anomalies and anomaly ratio per group and split."""
    return (
        records.groupBy(*keys, "split")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("label").cast("bigint").alias("anomaly"))
        .select(*keys, "split", "rows", (F.col("rows") - F.col("anomaly")).alias("normal"), "anomaly",
                F.coalesce(F.try_divide(F.col("anomaly").cast("double"), F.col("rows")), F.lit(0.0)).alias("anomaly_ratio"))
    )


def split_flags(
    records: DataFrame,
    keys: list[str],
    use_validation: bool = True,
    test_floor: int = TEST_FLOOR,
    val_floor: int = VAL_FLOOR,
    train_floor: int = TRAIN_FLOOR,
) -> DataFrame:
    """One row per group with the counts of each split and what they make doubtful."""
    counts = []
    for split in SPLITS:
        here = F.col("split") == split
        counts.append(F.count_if(here).alias(f"{split}_rows"))
        counts.append(F.count_if(here & (F.col("label") == 1)).alias(f"{split}_anomaly"))
    wide = records.groupBy(*keys).agg(*counts)
    ratio = F.coalesce(F.try_divide(F.col("train_anomaly").cast("double"), F.col("train_rows")), F.lit(0.0))
    single = (F.col("train_anomaly") == 0) | (F.col("train_anomaly") == F.col("train_rows"))
    has_val = F.lit(use_validation) & (F.col("val_rows") > 0)
    return wide.select(
        "*",
        ratio.alias("train_ratio"),
        single.alias("single_class_train"),
        (F.lit(use_validation) & (F.col("val_rows") == 0)).alias("no_val"),
        (((ratio < RATIO_LOW) | (ratio > RATIO_HIGH)) & ~single).alias("severe_imbalance"),
        (F.col("train_anomaly") < train_floor).alias("low_train_anomalies"),
        (F.col("test_anomaly") < test_floor).alias("low_test_anomalies"),
        (has_val & (F.col("val_anomaly") < val_floor)).alias("low_val_anomalies"),
    )


def profile_warnings(flags: DataFrame, category: str, class_weights: bool = False, oversampling: bool = False,
                     test_floor: int = TEST_FLOOR, val_floor: int = VAL_FLOOR) -> DataFrame:
    """Warning texts of each group; the imbalance text says what already counters it."""
    countered = "class weights are on" if class_weights else "oversampling is on" if oversampling else "nothing counters it"
    name = F.col(category).cast("string")
    texts = F.array(
        F.when(F.col("single_class_train"), F.format_string("[%s] training holds a single class", name)),
        F.when(F.col("no_val"), F.format_string("[%s] no validation rows", name)),
        F.when(F.col("severe_imbalance"), F.format_string(f"[%s] severe imbalance, ratio %.3f; {countered}", name, F.col("train_ratio"))),
        F.when(F.col("low_test_anomalies"), F.format_string(f"[%s] %d test anomalies, floor {test_floor}", name, F.col("test_anomaly"))),
        F.when(F.col("low_val_anomalies"), F.format_string(f"[%s] %d validation anomalies, floor {val_floor}", name, F.col("val_anomaly"))),
    )
    return flags.withColumn("warnings", F.array_compact(texts))


def single_class(records: DataFrame, keys: list[str]) -> DataFrame:
    return records.groupBy(*keys).agg((F.max("label") == F.min("label")).alias("single_class"))


def regime(records: DataFrame, keys: list[str], min_defects: int) -> DataFrame:
    """Rich or scarce by the number of training defects; a scarce group keeps no calibration split."""
    counts = records.groupBy(*keys).agg(F.count_if((F.col("split") == "train") & (F.col("label") == 1)).alias("train_defects"))
    return counts.withColumn("rich", F.col("train_defects") >= min_defects)


def apply_regime(records: DataFrame, keys: list[str], regimes: DataFrame) -> DataFrame:
    """Return the calibration rows of scarce groups to training."""
    from siftmark.operators.joins import lookup

    placed = lookup(records, regimes.select(*keys, "rich"), keys)
    back = (F.col("split") == "calib") & ~F.col("rich")
    return placed.withColumn("split", F.when(back, "train").otherwise(F.col("split"))).select(*records.columns)


def class_weight(
    counts: DataFrame,
    mode: str = "neg_over_total",
    multiplier: float = 1.0,
    cap: float | None = None,
    enabled: bool = True,
    oversampling: bool = False,
    allow_both: bool = False,
    rich: Column | None = None,
) -> DataFrame:
    """Add ``pos_weight`` to rows with ``pos`` and ``neg``; NULL if off, single-class or already oversampled."""
    if mode not in ("neg_over_total", "neg_over_pos"):
        raise ValueError(f"unknown class weight mode {mode!r}")
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    near_neutral = F.try_divide(neg, pos + neg)
    value = near_neutral if mode == "neg_over_total" else neg / F.greatest(pos, F.lit(1.0))
    if rich is not None:
        value = F.when(rich, value).otherwise(near_neutral)
    value = value * F.lit(float(multiplier))
    if cap is not None:
        value = F.least(value, F.lit(float(cap)))
    active = enabled and (allow_both or not oversampling)
    usable = F.lit(active) & (pos > 0) & (neg > 0)
    return counts.withColumn("pos_weight", F.when(usable, value))


def multiplier(count: Column, target: int, cap: int = 10) -> Column:
    """Copies of each anomaly that reach ``target``, at least 1 and at most ``cap``."""
    wanted = F.ceil(F.try_divide(F.lit(float(target)), count))
    return F.when(F.coalesce(count, F.lit(0)) <= 0, F.lit(1)).otherwise(
        F.greatest(F.lit(1), F.least(F.lit(cap), wanted))
    ).cast("bigint")


def multiplier_table(counts: DataFrame, count: str, target: int, cap: int = 10, validated: bool = False) -> DataFrame:
    """The multiplier of each row of counts with the evidence behind it."""
    n = multiplier(F.col(count), target, cap)
    wanted = F.ceil(F.lit(float(target)) / F.greatest(F.col(count), F.lit(1)))
    table = counts.withColumn("multiplier", n)
    return (
        table.withColumn("effective", F.col(count) * F.col("multiplier"))
        .withColumn("capped", (F.col("multiplier") == cap) & (wanted > cap))
        .withColumn("provisional", F.lit(not validated) | (F.col("multiplier") == cap))
        .withColumn("shortfall", F.greatest(F.lit(0), F.lit(target) - F.col("effective")))
    )


def resolved_counts(live: DataFrame, census: DataFrame, keys: list[str]) -> DataFrame:
    """The census count where there is one, else the live count."""
    joined = live.join(census.select(*keys, F.col("anomalies").alias("census")), keys, "left")
    return joined.withColumn("resolved", F.coalesce("census", "anomalies")).withColumn(
        "basis", F.when(F.col("census").isNotNull(), "census").otherwise("live")
    )
