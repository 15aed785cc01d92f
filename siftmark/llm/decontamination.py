"""Benchmark decontamination: token windows of documents against a broadcast set of benchmark n-grams.

Only DataFrame functions are used. A document is exploded into word positions; the hash of the four words
at a position is looked up in a broadcast set of the windows' first words, which leaves a small share of
positions. Those take their whole window, which is compared word by word with the benchmark's windows.
Documents are never shuffled as text: what moves is a row per hit and a row of counts per document.

Defined results: null and empty texts have no words and no hits; items without words have no window; rows
equal in id and text are one document and get equal results, each its own row; null ids are kept; an empty
benchmark hits nothing; more columns of either table are ignored (``decontaminate`` passes them on).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.llm.common import LOWER, UPPER, row_key, shielded, text_or_empty

WINDOW = 13
ANCHOR = 4
# Windows of the benchmark up to this many are broadcast (some 300 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 500_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), "")


def _positions(last: Column) -> Column:
    """Indexes 0..last; none if ``last`` is negative."""
    return F.explode(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")))


def _anchor(words: str, at: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(F.col(words), at + i) for i in range(length)])


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Each distinct window with its length, the hash of its first words and the items it occurs in."""
    items = benchmark.select("item_id", words_of(text_or_empty()).alias("_w")).where(F.size("_w") > 0)
    at = items.select("item_id", "_w", _positions(F.greatest(F.size("_w") - n, F.lit(0))).alias("_at"))
    windows = at.select("item_id", F.slice("_w", F.col("_at") + 1, n).alias("window"))
    return (
        windows.groupBy("window")
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))
        .select("window", "items", F.size("window").alias("length"), F.least(F.size("window"), F.lit(ANCHOR)).alias("anchor_words"))
    )


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def window_hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Occurrences of benchmark windows: document key, first word, length, items."""
    windows = benchmark_windows(benchmark, n)
    shapes = windows.groupBy("anchor_words").count().collect()  # four rows at most
    total = sum(r["count"] for r in shapes)
    texts = docs.select(*row_key(docs), words_of(text_or_empty()).alias("_w"))
    parts = []
    for length in sorted(r["anchor_words"] for r in shapes):
        mine = windows.where(F.col("anchor_words") == length)
        anchors = mine.select(_anchor("window", F.lit(0), length).alias("_anchor"), "length").groupBy("_anchor").agg(F.collect_set("length").alias("_lengths"))
        at = texts.select("doc_id", "_text_key", "_w", _positions(F.size("_w") - length).alias("_at"))
        keyed = at.withColumn("_anchor", _anchor("_w", F.col("_at"), length))
        near = keyed.join(_small(anchors, total), "_anchor").select("doc_id", "_text_key", "_w", "_at", F.explode("_lengths").alias("length"))
        whole = near.where(F.col("_at") + F.col("length") <= F.size("_w")).select(
            "doc_id", "_text_key", "_at", "length", F.expr("slice(_w, _at + 1, length)").alias("window")
        )
        parts.append(whole.join(_small(mine.select("window", "items"), total), "window").drop("window"))
    if not parts:
        none = texts.where(F.lit(False))
        return none.select("doc_id", "_text_key", F.lit(0).alias("_at"), F.lit(0).alias("length"), F.array().cast("array<bigint>").alias("items"))
    return reduce(DataFrame.unionByName, parts)


def _covered(spans: Column) -> Column:
    """Words inside any of the spans (at, length), which are sorted."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, span: Column) -> Column:
        end = span["_at"] + span["length"]
        new = F.greatest(end - F.greatest(span["_at"], acc["end"]), F.lit(0))
        return F.struct(F.greatest(end, acc["end"]).alias("end"), (acc["n"] + new).alias("n"))

    return F.aggregate(spans, zero, step)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Per document row: doc_id, _text_key, n_words, n_hit, n_items, items (sorted as text), spans, contaminated."""
    hits = (
        window_hits(docs, benchmark, n)
        .groupBy("doc_id", "_text_key")
        .agg(F.sort_array(F.collect_set(F.struct("_at", "length"))).alias("spans"), F.collect_set("items").alias("_items"))
        .select(
            F.col("doc_id").alias("_id"),
            F.col("_text_key").alias("_key"),
            "spans",
            F.sort_array(F.array_distinct(F.transform(F.flatten("_items"), lambda i: i.cast("string")))).alias("items"),
        )
    )
    rows = docs.select(*row_key(docs), F.size(words_of(text_or_empty())).cast("long").alias("n_words"))
    joined = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<_at:int,length:int>>"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    out = joined.select("doc_id", "_text_key", "n_words", _covered(spans).alias("n_hit"), items.alias("items"), spans.alias("spans"))
    return out.withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """The document rows, whole and unchanged, that are not contaminated; extra columns of any name stay."""
    return shielded(docs, lambda given: _clean(given, benchmark, n))


def _clean(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    bad = contamination(docs, benchmark, n).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("_text_key").alias("_key")).distinct()
    keyed = docs.withColumn("_text_key", F.xxhash64(text_or_empty()))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key"))
    return keyed.join(bad, same, "left_anti").drop("_text_key")
