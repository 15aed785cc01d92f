"""Joins against derived tables whose size is not known when the query is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(rows: DataFrame, table: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join a large table with a derived one, for every size by the same plan.

    The derived table ends in an aggregate, so AQE knows its size when it joins: it is broadcast up to
    ``spark.sql.autoBroadcastJoinThreshold``, and beyond that both sides are shuffled and hot keys split.
    """
    return rows.join(table, on, how)


def null_safe_lookup(rows: DataFrame, table: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """``lookup`` in which a NULL key meets a NULL key: keys are compared as one struct, whose NULL fields are equal."""
    keyed = table.select(F.struct(*on).alias("_on"), *[c for c in table.columns if c not in on])
    return lookup(rows.withColumn("_on", F.struct(*on)), keyed, ["_on"], how).drop("_on")


def require(df: DataFrame, ok: Column, message: Column | str) -> DataFrame:
    """Pass rows on while ``ok`` holds; the first row that breaks it ends the job with ``message``."""
    text = F.lit(message) if isinstance(message, str) else message
    checked = F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(text).cast("boolean"))
    return df.where(checked)
