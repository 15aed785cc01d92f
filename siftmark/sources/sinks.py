"""Sinks: CSV and Markdown tables, append-only JSON lines, partitioned scores, summaries, manifests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an archive of a run leaves out.
EXCLUDED_SUFFIXES = [".pt", ".pth", ".ckpt"]


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def markdown_line(columns: list[str]) -> Column:
    """A row as a line of a Markdown table; missing cells stay empty."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def write_markdown(df: DataFrame, path: str, order_by: list[str]) -> None:
    """A table as Markdown lines in the order of ``order_by``, header first.

    Lines are dealt to files by ranges of the order, so no task holds the whole table: the files read by name, one after
    the other, are the report. The header sorts before every row and so opens the first file.
    """
    order = {f"_order_{i}": c for i, c in enumerate(order_by)}
    body = df.select(F.lit(2).alias("_place"), *[F.col(c).alias(o) for o, c in order.items()], markdown_line(df.columns).alias("value"))
    titles = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    blank = [F.lit(None).cast(body.schema[o].dataType).alias(o) for o in order]
    head = df.sparkSession.range(2).select(
        F.col("id").cast("int").alias("_place"), *blank, F.when(F.col("id") == 0, titles[0]).otherwise(titles[1]).alias("value")
    )
    lines = head.unionByName(body).orderBy("_place", *order)
    lines.select("value").write.mode("overwrite").text(path)


def append_json_lines(df: DataFrame, path: str, by: tuple[str, ...] = ("run", "category", "stream")) -> None:
    df.write.mode("append").partitionBy(*by).json(path)


def write_scores(df: DataFrame, path: str, by: tuple[str, ...] = ("dataset", "backbone", "category", "split")) -> None:
    """Scores partitioned by group; rows of a partition are brought together so that files stay few."""
    df.repartition(*by).write.mode("append").partitionBy(*by).parquet(path)


def write_epoch_scores(df: DataFrame, path: str) -> None:
    """Per-epoch scores in long form, appended epoch by epoch."""
    df.write.mode("append").partitionBy("run", "epoch").parquet(path)


def write_summary(df: DataFrame, path: str) -> None:
    """One JSON document per row."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def manifest(files: DataFrame, keys: list[str], excluded: list[str] | None = None) -> DataFrame:
    """Count and bytes of the files an archive keeps and leaves out."""
    suffixes = EXCLUDED_SUFFIXES if excluded is None else excluded
    left_out = F.lit(False)
    for suffix in suffixes:
        left_out = left_out | F.col("path").endswith(suffix)
    return files.groupBy(*keys, F.when(left_out, "excluded").otherwise("kept").alias("side")).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("length").cast("bigint").alias("bytes")
    )


def upsert(index: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The index with rows of the same key replaced by the new ones."""
    return index.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def not_archived(candidates: DataFrame, archived: DataFrame) -> DataFrame:
    """Files whose base name is not archived yet."""
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    return candidates.withColumn("name", name).join(archived.select(name.alias("name")), "name", "left_anti")


class Recorder:
    """Where the stages of a run are recorded; the base class records nothing."""

    def record(self, stream: str, df: DataFrame) -> None:
        return None


class FolderRecorder(Recorder):
    """Appends every stream below one folder."""

    def __init__(self, path: str, writer: Callable[[DataFrame, str], None] = append_json_lines) -> None:
        self.path, self.writer = path, writer

    def record(self, stream: str, df: DataFrame) -> None:
        self.writer(df.withColumn("stream", F.lit(stream)), self.path)
