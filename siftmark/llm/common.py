"""Helpers the operators of this folder share."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftmark.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(UPPER, LOWER)
MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table in the shared scratch folder, which cuts the lineage."""
    return written(df, f"llm-{purpose}")


def released(*tables: DataFrame) -> None:
    """Delete tables that ``checkpointed`` wrote, once what was made of them is itself written.

    The driver also collects its garbage, as Spark keeps the shuffle files of ended jobs until their plans are collected.
    """
    for df in tables:
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            if os.path.basename(folder).startswith("llm-"):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)
        df.sparkSession._jvm.System.gc()


def shielded(
    docs: DataFrame, operate: Callable[[DataFrame], DataFrame], adds: tuple[str, ...] = (), needed: tuple[str, ...] = ("doc_id", "text")
) -> DataFrame:
    """``operate`` on ``docs``, whose columns outside ``needed`` go under names that no operator uses and come back after it.

    So an extra column may have any name. The result has the columns of ``docs`` in their order, then ``adds``; a column
    of ``docs`` that is named like one of ``adds`` gives way to it.
    """
    given = docs.drop(*adds)
    inside = [c if c in needed else f"kept column {i}" for i, c in enumerate(given.columns)]
    out = operate(given.toDF(*inside))
    return out.select(*[F.col(f"`{name}`").alias(c) for name, c in zip(inside, given.columns)], *adds)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_key(docs: DataFrame, text: str = "text") -> list[Column]:
    """Two columns that tell documents apart; rows equal in id and text are the same document."""
    return [F.col("doc_id"), F.xxhash64(text_or_empty(text)).alias("_text_key")]


def spread(df: DataFrame, least: int = 1) -> DataFrame:
    """Small inputs arrive as one split; Python stages then get one task per core at least."""
    spark = df.sparkSession
    return df.repartition(max(least, spark.sparkContext.defaultParallelism))


def numbered(rows: DataFrame, order: list[Column], group: str | None = None, name: str = "_place", total: str | None = None) -> DataFrame:
    """``rows`` with their place (from 0) in ``order``, within each value of the column ``group`` if one is named.

    A column ``total`` holds how many rows the group has.

    Rows are dealt by ranges of (group, order) and sorted there; a place is that inside its range plus the rows of the same
    group in earlier ranges. So no group is one task, and the table of ranges has a row for each range and group that met.
    The ranged rows are written, as every later step must see the same ranges.
    """
    keys = ([F.col(group).asc_nulls_first()] if group else []) + order
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = placed.withColumns({"_range": F.spark_partition_id(), "_here": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    placed = checkpointed(placed, "ranges")
    by = [group] if group else []
    ranges = placed.groupBy(*by, "_range").agg(F.count("*").alias("_rows"), F.min("_here").alias("_first"))
    alike = Window.partitionBy(*by or [F.lit(0)])
    before = F.sum("_rows").over(alike.orderBy("_range")) - F.col("_rows") - F.col("_first")
    starts = ranges.select("_range", *[F.col(group).alias("_of") for _ in by], before.alias("_shift"), F.sum("_rows").over(alike).alias("_all"))
    same = placed["_range"] == starts["_range"]
    if group:
        same &= placed[group].eqNullSafe(starts["_of"])
    return placed.join(starts, same, "left").select(*[placed[c] for c in rows.columns], (F.col("_here") + F.col("_shift")).alias(name), *[F.col("_all").alias(total) for _ in range(bool(total))])


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, text: bytes | None) -> np.ndarray:
        """Hashes of a UTF-8 text's words: runs without ASCII white space, A-Z in lower case."""
        words = (text or b"").lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit numbers (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def _multipliers(n: int) -> list[np.uint64]:
    return [np.uint64(xxhash.xxh64_intdigest(str(i).encode(), seed=n) | 1) for i in range(n)]


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit hash for each run of ``n`` word hashes; a shorter sequence counts as one run."""
    if len(words) == 0:
        return np.empty(0, np.uint64)
    n_here = min(n, len(words))
    size = len(words) - n_here + 1
    total = np.full(size, np.uint64(n_here), np.uint64)
    for i, factor in enumerate(_multipliers(n)[:n_here]):
        total += words[i : i + size] * factor
    return mix(total)


def arrow_rows(batches: Iterable[pa.RecordBatch], names: list[str], most: int = 512) -> Iterator[tuple[list, ...]]:
    """Column lists of at most ``most`` rows each, so that a batch of long texts is not held twice."""
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            part = batch.slice(start, most)
            yield tuple(part.column(part.schema.get_field_index(n)).to_pylist() for n in names)


def resource(name: str) -> str:
    """A file of the public tokenizers, whose folder ``PUBLIC_TOKENIZERS`` may replace."""
    folder = os.environ.get("PUBLIC_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
