"""Scalar functions on raw scores (logits)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_if_nan(value: Column) -> Column:
    """Undefined numbers are NULL everywhere in this package."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def sigmoid(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def prior_corrected(score: Column, pos_weight: Column | float | None) -> Column:
    """Undo the shift a class weight puts on the logit; no weight or zero means no shift."""
    weight = pos_weight if isinstance(pos_weight, Column) else F.lit(pos_weight).cast("double")
    return score - F.log(F.coalesce(F.nullif(weight, F.lit(0.0)), F.lit(1.0)))


def two_view_score(views: Column) -> Column:
    """Mean of the identity view (0) and the rotated view (2)."""
    return (views[0] + views[2]) / F.lit(2.0)


def conformal_rank(n: Column, alpha: float) -> Column:
    """1-based rank of the split-conformal line among ``n`` sorted normal scores."""
    return F.ceil((n + F.lit(1)).cast("double") * F.lit(1.0 - float(alpha))).cast("bigint")


def precision_at_prevalence(recall: Column, alarm_rate: Column, prevalence: float = 0.05) -> Column:
    """Expected precision if ``prevalence`` of the images were defective; NULL when nothing alarms."""
    hit = F.lit(float(prevalence)) * recall
    return F.try_divide(hit, hit + F.lit(1.0 - float(prevalence)) * alarm_rate)


def logit_loss(score: Column, label: Column, pos_weight: Column | float = 1.0) -> Column:
    """Weighted binary cross-entropy on a logit, in the form that does not overflow."""
    weight = pos_weight if isinstance(pos_weight, Column) else F.lit(float(pos_weight))
    softplus_neg = F.log1p(F.exp(-F.abs(score))) + F.greatest(-score, F.lit(0.0))
    softplus_pos = F.log1p(F.exp(-F.abs(score))) + F.greatest(score, F.lit(0.0))
    return F.when(label == 1, weight * softplus_neg).otherwise(softplus_pos)


def right_closed_bin(probability: Column, bins: int = 15) -> Column:
    """0-based bin of a probability where bin i is (i/bins, (i+1)/bins] and the first also holds 0."""
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    return F.size(F.filter(edges, lambda edge: edge < probability))


def left_closed_bin(probability: Column, bins: int = 15) -> Column:
    """0-based bin of a probability where bin i is [i/bins, (i+1)/bins) and the last also holds 1."""
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    return F.size(F.filter(edges, lambda edge: edge <= probability))
