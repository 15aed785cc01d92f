"""The given tables read as the logical tables the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = ["dataset", "category", "seed"]
# Which datasets use only test-folder normals, and the reliability tier of each.
FOLDER_DATASETS = ["F"]
TIERS = {"O": "native", "F": "injected"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as per-item scores of several runs: dataset, category, seed, split, path, label, views."""
    cents = F.round(F.col("l_discount") * 100).cast("int")
    base = (F.col("l_quantity").cast("int") * 3 + cents * 10 + F.when(F.col("l_returnflag") == "R", 40).otherwise(0)) / F.lit(47.0) - F.lit(2.0)
    folder = F.when(F.col("l_returnflag") == "A", "train/good").when(F.col("l_returnflag") == "N", "test/good").otherwise("test/defect")
    stem = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    category = F.concat(F.lit("tax"), F.round(F.col("l_tax") * 100).cast("int").cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("dataset"),
        category.alias("category"),
        F.year("l_shipdate").alias("seed"),
        F.when(F.col("l_linenumber") == 1, "val")
        .when((F.col("l_linenumber") == 2) & (F.col("l_linestatus") == "O"), "calib")
        .when(F.col("l_linenumber") == 2, "val")
        .otherwise("test")
        .alias("split"),
        F.concat_ws("/", category, folder, F.concat(stem, F.lit(".png"))).alias("path"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.array(
            base,
            base + (F.col("l_linenumber") - 4) / F.lit(8.0),
            base - F.col("l_discount"),
            base + F.col("l_tax"),
        ).alias("views"),
        (F.lit(1.0) + F.col("l_tax") * 10).alias("pos_weight"),
        F.dayofmonth("l_shipdate").alias("day"),
        F.col("l_linenumber").alias("line_no"),
        (F.col("l_quantity") / 7.0).alias("quantity"),
        (F.col("l_extendedprice") / 7.0).alias("price"),
        (F.col("l_discount") / 7.0).alias("discount"),
    )


def two_view_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = F.col("views")
    return scores(spark, sf_dir).withColumn("score", (views[0] + views[2]) / F.lit(2.0))


def single_view_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).withColumn("score", F.col("views")[0])


def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with ``labels`` as scored items: the label is bad quality, the score a word count."""
    words = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    score = F.floor(F.log(words + F.lit(1.0)) * 20.0) / F.lit(20.0) - F.lit(5.0)
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.lit(1) - F.col("quality")).alias("label"))
    return table(spark, sf_dir, "documents").join(labels, "doc_id").select(
        "doc_id", F.col("lang").alias("category"), "source", "label", score.alias("score"),
        F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"),
    )


def file_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as the file listing of an inventory tree: category / split / type / file."""
    folder = (
        F.when(F.col("l_returnflag") == "A", "train/good")
        .when(F.col("l_returnflag") == "N", "test/good")
        .otherwise(F.concat(F.lit("test/type"), F.col("l_linenumber").cast("string")))
    )
    category = F.concat("l_linestatus", F.year("l_shipdate").cast("string"))
    stem = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("/", category, folder, F.concat(stem, F.lit(".png"))).alias("path"),
        F.col("l_extendedprice").cast("bigint").alias("length"),
    )


def epoch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores again, with the day of the month as the epoch they were logged in."""
    return two_view_scores(spark, sf_dir).withColumn("epoch", (F.col("day") - 1).cast("int"))


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as features of two sessions per category (even and odd labels)."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.floor(F.col("label") / 2).cast("int").alias("category"), (F.col("label") % 2).cast("int").alias("label"), "embedding"
    )


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as 8 x 8 grids of grey levels, with the original label."""
    level = F.transform("embedding", lambda v: F.floor((v.cast("double") + F.lit(1.0)) * F.lit(127.5)).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", level.alias("grid"))


def latency_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as a timing table: model, image_size, precision, status, ms."""
    model = (
        F.when(F.col("l_linenumber") == 1, "ours:net")
        .when(F.col("l_linenumber") == 2, "ours:net+compile")
        .when(F.col("l_linenumber") == 3, "ours:net+full")
        .when(F.col("l_linenumber") == 4, "ours:net+full[x2]")
        .when(F.col("l_linenumber") == 5, "rival+full")
        .otherwise("rival")
    )
    return table(spark, sf_dir, "lineitem").select(
        model.alias("model"),
        (F.round(F.col("l_tax") * 100).cast("int") * 32 + 96).alias("image_size"),
        F.when(F.col("l_linestatus") == "O", "fp32").otherwise("fp16").alias("precision"),
        F.when(F.col("l_returnflag") == "R", "FAILED").otherwise("ok").alias("status"),
        (F.col("l_extendedprice") / 1000.0).alias("ms"),
        (F.year("l_shipdate") < 1998).alias("legacy"),
    )
