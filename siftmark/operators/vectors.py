"""Column-wise statistics of array features, aggregated by Spark ML's vector summaries."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.operators.joins import lookup

STD_EPS = 1e-9


def as_vector(features: str) -> Column:
    return array_to_vector(F.transform(F.col(features), lambda v: v.cast("double")))


def means(rows: DataFrame, keys: list[str], features: str, name: str = "centroid") -> DataFrame:
    """Element-wise mean and row count per group."""
    return rows.groupBy(*keys).agg(
        vector_to_array(Summarizer.mean(as_vector(features))).alias(name), F.count(F.lit(1)).alias(f"{name}_n")
    )


def sums(rows: DataFrame, keys: list[str], features: str) -> DataFrame:
    return rows.groupBy(*keys).agg(vector_to_array(Summarizer.sum(as_vector(features))).alias("sum"), F.count(F.lit(1)).alias("n"))


def standardised(
    rows: DataFrame, keys: list[str], features: str, name: str = "z", fit_on: Column | None = None
) -> DataFrame:
    """Add the features minus the group mean, over the group's population deviation.

    ``fit_on`` restricts the rows the mean and deviation are taken from.
    """
    summary = Summarizer.metrics("mean", "variance", "count").summary(as_vector(features))
    fitted = rows if fit_on is None else rows.where(fit_on)
    stats = fitted.groupBy(*keys).agg(summary.alias("s")).select(
        *keys, vector_to_array("s.mean").alias("_mu"), vector_to_array("s.variance").alias("_var"), F.col("s.count").alias("_n")
    )
    population = F.transform("_var", lambda v: F.sqrt(v * (F.col("_n") - 1) / F.col("_n")))
    stats = stats.select(*keys, "_mu", population.alias("_sd"))
    joined = lookup(rows, stats, keys)
    centred = F.zip_with(F.col(features), F.col("_mu"), lambda x, m: x.cast("double") - m)
    return joined.withColumn(name, F.zip_with(centred, "_sd", lambda c, s: c / (s + F.lit(STD_EPS)))).drop("_mu", "_sd")
