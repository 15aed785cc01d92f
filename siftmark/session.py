"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Session settings the operators assume. AQE re-plans joins from measured sizes and splits skewed
# partitions; the forced variant also splits a skewed join whose result feeds an aggregate on the same keys.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "siftmark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with ``DEFAULTS``; ``conf`` entries use ``__`` where Spark uses a dot."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Give an existing session the skew handling of ``DEFAULTS`` where it can still be set."""
    for key in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled", "spark.sql.adaptive.forceOptimizeSkewedJoin"):
        spark.conf.set(key, DEFAULTS[key])
    return spark


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder path below ``spark.checkpoint.dir``, the folder every executor can reach.

    A machine-local folder is used only where the cluster names none and Spark runs in local mode.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = os.path.join(tempfile.gettempdir(), "siftmark")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table in the scratch folder: computed once, safe from lost executors, of known size.

    Used where several later steps read the same result, which Spark would otherwise compute anew for
    each. The folder belongs to the cluster's scratch space and is cleared with it.
    """
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
