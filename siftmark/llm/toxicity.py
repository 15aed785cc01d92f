"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Every text, lower-cased, is read as overlapping 3-, 4- and 5-grams of characters, hashed into buckets. For
each bucket the log ratio of its document shares among toxic and other labelled rows is counted. Buckets with
a clear ratio are the features; a document's feature value is that ratio where the n-gram occurs. A logistic
regression on them gives the weights. The classifier is fitted on a bounded sample of the labelled training
rows: at most ``fit_rows`` ids, the first by hash, which are few enough to be broadcast, so that no text is
shuffled. Every document is scored in its scan task from the broadcast weights, whose size is fixed by ``BITS``.

Defined results: null and empty texts are scored by the intercept; documents with null id are scored and held out of
training; of several labels of one id the largest counts, null labels are dropped; without labels of both
kinds every score is the share of toxic rows (0 without labels); an id trains once, on its longest text; more columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.llm.common import checkpointed, text_or_empty

ORDERS = (3, 4, 5)
BITS = 20
FIT_ROWS = 20_000
LEAST_DOCS = 4
LEAST_RATIO = 1.2
THRESHOLD = 0.3


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def buckets(text: str | None, bits: int = BITS) -> np.ndarray:
    """Bucket of every n-gram of the text, repeats included."""
    codes = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out, n = [], len(codes)
    for order in ORDERS:
        size = n - order + 1
        if size <= 0:
            continue
        h = np.full(size, np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF))
        for i in range(order):
            h ^= codes[i : i + size]
            h *= np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        out.append((h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def labelled_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Training rows: id, text and label of at most ``fit_rows`` ids, without the held-out quarter."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    wanted = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    found = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(wanted), "doc_id")
    longest = F.max(F.struct(F.length("text").alias("n"), "text")).alias("s")
    return found.groupBy("doc_id", "_toxic").agg(longest).select("doc_id", "_toxic", F.col("s.text").alias("text"))


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document counts by bucket and label of one partition."""
    counts, rows = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("_toxic")):
            label = int(toxic.as_py() > 0)
            rows[label] += 1
            counts[label, np.unique(buckets(text.as_py()))] += 1
    used = np.flatnonzero(counts.sum(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array([-1, *used.tolist()], pa.int32()), pa.array([rows[1], *counts[1, used]], pa.int64()), pa.array([rows[0], *counts[0, used]], pa.int64())],
        ["bucket", "toxic", "other"],
    )


def log_count_ratios(rows: DataFrame) -> tuple[np.ndarray, float, float]:
    """Ratio by bucket (0 where it is no feature), and the numbers of toxic and of other rows.

    Partitions send one count per bucket; sums that cannot be a feature stay in Spark.
    """
    sums = checkpointed(rows.mapInArrow(_tally, "bucket int, toxic long, other long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")), "tox-counts")
    totals = sums.where("bucket = -1").collect()
    ratios = np.zeros(1 << BITS, np.float32)
    if not totals:
        return ratios, 0.0, 0.0
    n1, n0 = float(totals[0]["toxic"]), float(totals[0]["other"])
    ratio = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("other") + 0.5) / (n0 + 1))
    # one float for each of at most 2**BITS buckets
    clear = sums.where("bucket >= 0").withColumn("r", ratio).where((F.abs("r") >= LEAST_RATIO) & (F.col("toxic") + F.col("other") >= LEAST_DOCS)).select("bucket", "r").toPandas()
    ratios[clear["bucket"].to_numpy()] = clear["r"].to_numpy(np.float32)
    return ratios, n1, n0


def features(text: str | None, known: np.ndarray) -> np.ndarray:
    """The distinct buckets of a text that are features."""
    found = buckets(text)
    return np.unique(found[known[found]])


def _fit(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, steps: int = 300, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on ratio-scaled presence, by Adam steps over all rows."""
    used = np.unique(np.concatenate(rows)) if rows else np.empty(0, np.int64)
    column = np.searchsorted(used, np.concatenate(rows)) if len(used) else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    value = ratios[used][column].astype(np.float64)
    w, b = np.zeros(len(used)), float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        z = np.bincount(row, value * w[column], minlength=len(rows)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(labels)
        g = np.bincount(column, value * error[row], minlength=len(used)) + decay * w
        gb = error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        scale = 0.03 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        w -= scale * m / (np.sqrt(v) + 1e-9)
        b -= scale * mb / (np.sqrt(vb) + 1e-9)
    out = np.zeros(len(ratios), np.float32)
    out[used] = (w * ratios[used]).astype(np.float32)
    return out, b


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, float]:
    """Weight by bucket and intercept, from a sample of at most ``fit_rows`` labelled ids."""
    rows = checkpointed(labelled_rows(docs, labels, fit_rows), "tox-labelled")
    ratios, n1, n0 = log_count_ratios(rows)
    if n1 == 0 or n0 == 0:
        share = n1 / max(n1 + n0, 1)
        return np.zeros(1 << BITS, np.float32), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    known = rows.sparkSession.sparkContext.broadcast(ratios != 0)

    def of_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py(), known.value).astype(np.int32).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("_toxic").cast(pa.int32()), pa.array(found, pa.binary())], ["toxic", "found"])

    got = rows.mapInArrow(of_sample, "toxic int, found binary").collect()
    found = [np.frombuffer(r["found"], np.int32) for r in got]
    return _fit(found, np.array([float(r["toxic"] > 0) for r in got]), ratios)


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """All columns of ``docs`` and ``_score``; a text is read once, in its scan task."""
    weights, intercept = train(docs, labels, fit_rows)
    sent = docs.sparkSession.sparkContext.broadcast((weights, weights != 0, intercept))

    @F.pandas_udf("double")
    def toxic_score(texts):
        import pandas as pd

        weight, known, start = sent.value
        z = np.array([weight[features(t, known)].sum(dtype=np.float64) + start for t in texts])
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -35, 35))))

    return docs.withColumn("_score", toxic_score(text_or_empty()))
