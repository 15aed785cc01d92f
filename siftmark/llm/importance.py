"""Target-distribution importance resampling: documents drawn by how much their n-grams look like a target's.

1. A 256-byte table lower-cases A-Z and blanks every other ASCII byte that is no digit or letter; ``bytes.split`` then yields the
   words of a UTF-8 text. ``zlib.crc32`` of a word seeds that of the pair it begins, and this that of the triple, so runs of
   1 to 3 words are hashed without being joined. Counters reduce them to counts by bucket, one row for each task and bucket.
2. From the counts of the corpus and of the target each of the 10,000 buckets has a gain, a smoothed log ratio in thousandths; these
   few numbers are the model that goes to all tasks.
3. A second scan sums the gains of each document and adds Gumbel noise, which depends on the seed and the id alone: the highest
   sums are a draw without replacement by importance. Their ranks come from ranges of the scores, not from one sorted task.

Defined results: null, empty and wordless texts have no features and weight 0, and are never drawn; a null id is hashed as no
characters; ties go to the smaller id (null first), and of rows that also share the id an arbitrary one goes first, which no
result column shows; repeated rows count and are drawn each on its own; extra columns are ignored; an empty table gives an
empty result, and an empty target counts no features.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.llm.common import arrow_rows, checkpointed, numbered

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
SCALE = 1000
HASHES = 1 << 32

KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
TABLE = bytes(b if b in KEPT else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def bucket_runs(text: str | None) -> list[list[int]]:
    """Hashes of the runs of one, two and three words of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()
    spaced = [b" " + w for w in words]
    runs = [list(map(zlib.crc32, words))]
    for n in range(1, LONGEST):
        runs.append(list(map(zlib.crc32, spaced[n:], runs[-1])))
    return runs


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences by bucket in one task."""
    totals = Counter()
    for (texts,) in arrow_rows(batches, ["text"]):
        for text in texts:
            for run in bucket_runs(text):
                totals.update(h % BUCKETS for h in run)
    yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(list(totals.values()), pa.int64())], ["bucket", "n"])


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n) over all texts; tasks send at most one row for each bucket."""
    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket, in thousandths; the driver sees ``BUCKETS`` rows."""
    both = bucket_counts(corpus).withColumn("target", F.lit(0)).union(bucket_counts(target).withColumn("target", F.lit(1)))
    counts = [[0] * BUCKETS, [0] * BUCKETS]
    for row in both.collect():
        counts[row["target"]][row["bucket"]] = row["n"]
    s_all, t_all = (sum(c) for c in counts)
    return np.array([math.floor(SCALE * math.log((t + 1) * (s_all + BUCKETS) / ((s + 1) * (t_all + BUCKETS)))) for s, t in zip(*counts)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise of an id, in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / HASHES)))


def weights(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for ids, texts in arrow_rows(batches, ["doc_id", "text"]):
            rows = []
            for doc_id, text in zip(ids, texts):
                runs = bucket_runs(text)
                weight = sum(int(gain[np.asarray(run, np.int64) % BUCKETS].sum()) for run in runs)
                rows.append((doc_id, len(runs[0]), sum(map(len, runs)), weight, weight + noise(doc_id, seed)))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "n_words", "n_features", "weight", "score"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Each row of ``docs`` as (doc_id, n_words, n_features, weight, score, rank); the rank is null where a row is not drawn.

    Of the rows with ``least_words`` words at least, ``percent`` in a hundred are drawn, rounded down.
    """
    fit = (F.col("n_words") >= least_words).alias("fit")
    weighed = checkpointed(weights(docs, gains(docs, target), seed).withColumn("fit", fit), "importance-weights")
    placed = numbered(weighed, [F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first()])
    drawn = placed.where("fit").count() * percent // 100
    rank = F.when(F.col("fit") & (F.col("_place") < drawn), F.col("_place") + 1).cast("long")
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))
