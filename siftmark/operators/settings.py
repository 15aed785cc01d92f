"""Run settings as rows: fingerprints, unknown keys, seeds and run grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.operators.joins import require

# The settings that define how a run is evaluated, with their defaults, and those that are lists.
PROTOCOL_KEYS = [
    "name",
    "val_split",
    "anomaly_fraction",
    "num_train_anomalies",
    "val_share_mode",
    "val_share_bounds",
    "val_anomaly_floor",
    "floors_validated",
    "injection_val_share",
    "injection_val_share_justification",
    "use_validation",
    "metrics",
    "exploration_seeds",
    "claim_seeds",
    "reporting",
]
DEFAULTS = {"name": "unnamed", "reporting": "per_category"}
LISTS = ["metrics", "exploration_seeds", "claim_seeds"]
SORTED_LISTS = ["metrics"]
ADAPTIVE_TEXT = "per-category (adaptive)"


def fingerprint(settings: Column) -> Column:
    """A map of all settings reduced to the protocol keys, as JSON with sorted keys and absent values as null.

    Lists whose order means nothing are sorted. In adaptive mode the resolved share differs by category under the
    same rule, so a fixed text stands for it; the bounds of the rule are kept in either mode.
    """

    def of(key: str) -> Column:
        return F.try_element_at(settings, F.lit(key))

    def listed(key: str) -> Column:
        items = F.when(F.coalesce(of(key), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(of(key), ","))
        return F.array_sort(items) if key in SORTED_LISTS else items

    def value(key: str) -> Column:
        if key == "val_share_bounds":
            return F.array(of("val_share_min"), of("injection_val_share"))
        if key == "injection_val_share":
            return F.when(F.coalesce(of("val_share_mode") == "adaptive", F.lit(False)), ADAPTIVE_TEXT).otherwise(of(key))
        if key in LISTS:
            return listed(key)
        return F.coalesce(of(key), F.lit(DEFAULTS[key])) if key in DEFAULTS else of(key)

    return F.to_json(F.struct(*[value(k).alias(k) for k in sorted(PROTOCOL_KEYS)]), {"ignoreNullFields": "false"})


def unknown_keys(overrides: DataFrame, known: DataFrame, strict: bool = False) -> DataFrame:
    """Per-category overrides of settings that do not exist, per (dataset, category); with ``strict`` one is an error."""
    found = (
        overrides.join(known.select("key").distinct(), "key", "left_anti")
        .groupBy("dataset", "category")
        .agg(F.array_join(F.array_sort(F.collect_set("key")), ",").alias("unknown"))
    )
    return require(found, F.lit(False), F.concat(F.lit("unknown settings of "), "dataset", F.lit("/"), "category", F.lit(": "), "unknown")) if strict else found


def resolve_seeds(runs: DataFrame) -> DataFrame:
    """One row per run and seed: the seeds of its tier, else its list of seeds, else its single seed."""
    tier = F.coalesce("tier", F.lit("exploration"))
    single = F.array(F.coalesce(F.col("seed"), F.lit(123)))
    by_tier = F.when(F.col("tier").isNull(), F.coalesce("seeds", single)).when(
        F.col("tier") == "claim", F.coalesce("claim_seeds", single)
    ).otherwise(F.coalesce("exploration_seeds", single))
    return runs.select("run", tier.alias("seed_tier"), F.posexplode(by_tier).alias("seed_no", "run_seed"))


def run_grid(base: DataFrame, axes: dict[str, list]) -> DataFrame:
    """Every combination of the given axes for each row of ``base``."""
    out = base
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out
