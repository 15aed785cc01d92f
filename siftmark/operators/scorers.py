"""Batch scoring: a model over rows gives one logit per item, or one per view."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[np.ndarray], np.ndarray]


def ml_scores(model, rows: DataFrame, keep: list[str]) -> DataFrame:
    """Logits of a fitted Spark ML classifier, keyed by the kept columns."""
    return model.transform(rows).select(*keep, vector_to_array("rawPrediction")[1].alias("score"))


def batch_scores(rows: DataFrame, features: str, load: Callable[[], Scorer], keep: list[str]) -> DataFrame:
    """Logits of any scorer; ``load`` runs once per task, the scorer once per Arrow batch."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = load()
        for part in parts:
            yield pd.Series(np.asarray(scorer(np.stack(part.to_numpy())), dtype=float))

    return rows.select(*keep, score(F.col(features)).alias("score"))


def linear_views(features: Column, weights: list[float], views: dict[str, Callable[[Column], Column]]) -> Column:
    """One linear logit per view as an array; a view is a function of the feature array."""
    coefficients = F.array(*[F.lit(float(w)) for w in weights])

    def logit(values: Column) -> Column:
        return F.aggregate(F.zip_with(values, coefficients, lambda x, w: x.cast("double") * w), F.lit(0.0), lambda acc, v: acc + v)

    return F.array(*[logit(view(features)) for view in views.values()])
