"""Tiers, caveats, reportability, and means that never mix tiers or models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.operators.joins import require
from siftmark.operators.metrics import METRIC_NAMES

# Caveat keys in reporting order; only these travel with a result.
CAVEATS = [
    "low_test_anomalies",
    "low_val_anomalies",
    "severe_imbalance",
    "low_train_anomalies",
    "inverted",
    "single_class_train",
    "no_val",
]
INVALIDATING = "single_class_train"
# What a reader of a report is told for each caveat.
CAVEAT_TEXT = {
    "low_test_anomalies": "few test anomalies -> test metrics are noisy",
    "low_val_anomalies": "few val anomalies -> model selection is noisy",
    "severe_imbalance": "severe class imbalance in train",
    "low_train_anomalies": "few DISTINCT train anomalies -> the model may never see enough defect variety, regardless of class ratio",
    "inverted": "AUROC BELOW CHANCE -> the model ranks defects below normals; this is a sign inversion, not noise, and the number is not a weak result",
    "single_class_train": "train is single-class (result invalid)",
    "no_val": "no validation split (selection would fall back to test)",
}


def inverted(auroc: Column) -> Column:
    """True for an AUROC strictly below one half; an undefined one is not inverted."""
    return F.coalesce(auroc < 0.5, F.lit(False))


def caveats(flags: list[str]) -> Column:
    """The names of the true flags among the known caveats."""
    known = [c for c in CAVEATS if c in flags]
    return F.array_compact(F.array(*[F.when(F.col(c), c) for c in known]))


def caveat_line(caveat_list: Column) -> Column:
    """The texts of the caveats in their order, as one line; a key without a text stands for itself, no caveat gives an empty line."""
    texts = F.create_map(*[F.lit(x) for pair in CAVEAT_TEXT.items() for x in pair])
    return F.array_join(F.transform(caveat_list, lambda c: F.coalesce(F.try_element_at(texts, c), c)), "; ")


def reportable(caveat_list: Column, collapsed: Column, selection_failed: Column) -> Column:
    """False if collapsed, not selected, or trained on a single class; noise alone does not disqualify."""
    return ~(
        F.coalesce(collapsed, F.lit(False))
        | F.coalesce(selection_failed, F.lit(False))
        | F.array_contains(caveat_list, INVALIDATING)
    )


def dataset_tier(dataset: Column, tiers: dict[str, str]) -> Column:
    """The tier a dataset is declared in; an undeclared dataset ends the job."""
    known = F.create_map(*[F.lit(x) for pair in tiers.items() for x in pair])
    missing = F.raise_error(F.concat(F.lit("dataset without a reliability tier: "), dataset)).cast("string")
    return F.coalesce(F.try_element_at(known, dataset), missing)


def reportable_scores(scores: DataFrame, summaries: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Scores of reportable groups and the groups left out; a group without a summary is reportable."""
    excluded = summaries.where(~F.coalesce(F.col("reportable"), F.lit(True))).select(*keys).distinct()
    return scores.join(excluded, keys, "left_anti"), scores.select(*keys).distinct().join(excluded, keys, "left_semi")


def tiered_means(results: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Mean of each metric per tier and model; missing values are skipped metric by metric."""
    names = [m for m in (metrics or METRIC_NAMES) if m in results.columns]
    return results.groupBy("tier", "backbone").agg(*[F.avg(m).alias(m) for m in names], F.count(F.lit(1)).alias("n_categories"))


def single_tier_mean(results: DataFrame, metric: str) -> DataFrame:
    """The mean over all results; results of two tiers end the job."""
    found = results.agg(F.count_distinct("tier").alias("tiers"), F.avg(metric).alias(metric))
    return require(found, F.col("tiers") <= 1, "refusing a mean across reliability tiers").select(metric)


def run_summary(results: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Means of the reportable results per tier and model, with the number left out of them."""
    groups = results.groupBy("tier", "backbone").agg(F.count_if(~F.col("reportable")).alias("n_excluded"))
    return groups.join(tiered_means(results.where("reportable"), metrics), ["tier", "backbone"], "left").fillna({"n_categories": 0})


def mean_against_frozen(results: DataFrame, keys: list[str], metric: str, frozen: DataFrame, digits: int = 4) -> DataFrame:
    """Rounded mean per key next to the value it is held to."""
    found = results.groupBy(*keys).agg(F.round(F.avg(metric), digits).alias("mean"), F.count(metric).alias("n"))
    return found.join(frozen, keys, "left").withColumn("passed", F.col("mean").eqNullSafe(F.col("frozen")))
