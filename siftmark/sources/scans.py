"""Scans of inventories, score tables, logs and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.functions.paths import last_parts, relative_to, word_label
from siftmark.functions.scoring import null_if_nan
from siftmark.operators.joins import require
from siftmark.operators.records import inventory
from siftmark.sources import schemas as S


def file_listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path and length of every file below ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length")


def folder_inventory(spark: SparkSession, root: str, pattern: str = "*.png") -> DataFrame:
    """Records of a ``category/split/type/file`` tree, ordered columns as in ``inventory``."""
    return inventory(file_listing(spark, root, pattern))


def split_csv(spark: SparkSession, path: str, category: str | None = None, split: str | None = None) -> DataFrame:
    """Records of a split table with the label word encoded; both filters reach the scan."""
    rows = spark.read.schema(S.SPLIT_CSV).csv(path, header=True)
    if category is not None:
        rows = rows.where(F.col("object") == category)
    if split is not None:
        rows = rows.where(F.col("split") == split)
    return rows.select(F.col("object").alias("category"), "split", F.col("image").alias("path"), word_label(F.col("label")).alias("label"))


def subset_csv(spark: SparkSession, path: str, items: DataFrame) -> DataFrame:
    """The items named by a (category, session, path) list."""
    wanted = spark.read.schema(S.SUBSET_CSV).csv(path, header=True)
    return items.join(wanted.select("category", "path").distinct(), ["category", "path"], "left_semi")


def score_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(S.SCORE_CSV).csv(path, header=True)
    return rows.withColumnRenamed("file", "path").withColumn("score", null_if_nan(F.col("score_two_view")))


def images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images: path, height, width, channels and bytes in blue-green-red order."""
    rows = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(root)
    return rows.select(
        F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data"
    )


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per JSON file."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per non-blank line; a path that matches nothing gives an empty table."""
    try:
        return spark.read.schema(schema).json(path)
    except Exception as problem:  # noqa: BLE001 - only a missing path is expected
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], schema)


def stage_rows(spark: SparkSession, path: str, stage: str) -> DataFrame:
    return json_lines(spark, path, S.STAGE).where(F.col("stage") == stage)


def newest_file(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The lexicographically last file of that name below ``root``; NULL if there is none."""
    return file_listing(spark, root, name).agg(F.max("path").alias("path"))


def census_counts(census: DataFrame) -> DataFrame:
    """(dataset, category, anomalies) of the training split, over both shapes a census may have."""
    injected = census.select(F.explode("injected").alias("category", "r")).select(
        F.lit("injected").alias("dataset"), "category", F.col("r.splits_at_locked_fraction")["train"]["anomaly"].alias("anomalies")
    )
    native = census.select(F.explode("native").alias("category", "r")).where("r.error is null").select(
        F.lit("native").alias("dataset"), "category", F.col("r.splits")["train"]["anomaly"].alias("anomalies")
    )
    return injected.unionByName(native).where("anomalies is not null")


def score_files(spark: SparkSession, root: str) -> DataFrame:
    """Stored scores with their group taken from the folders below ``root``, never from a file's own name."""
    rows = spark.read.schema(S.SCORES).parquet(root)
    return rows.withColumn("key", F.concat_ws("/", "dataset", "backbone", "category"))


def view_scores(rows: DataFrame, views: int = 4) -> DataFrame:
    """Multi-view rows keyed by the last three path parts; a row with another number of views is an error."""
    checked = require(rows, F.size("views") == views, F.concat(F.lit(f"expected {views} views: "), F.col("path")))
    return checked.withColumn("path", last_parts(F.col("path"), 3))


def view_score_files(spark: SparkSession, root: str, views: int = 4) -> DataFrame:
    """Stored multi-view scores, each with its array of views."""
    return view_scores(spark.read.schema(S.VIEW_SCORES).parquet(root), views)


def timing_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Usable rows of several timing files."""
    rows = spark.read.schema(S.TIMING_CSV).csv(paths, header=True)
    return rows.where("status = 'ok'").withColumn("peak_mem_mb", null_if_nan(F.col("peak_mem_mb")))


def relative_keys(files: DataFrame, root: str) -> DataFrame:
    """Group key of each file: its folder relative to ``root``."""
    rel = relative_to(F.col("path"), root)
    return files.withColumn("key", F.regexp_replace(rel, r"/[^/]*$", ""))
