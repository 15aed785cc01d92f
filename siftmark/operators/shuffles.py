"""Label permutations of the leave-one-out probe, all in one pass over the vectors.

A permutation is a bit for each row: its hash is at or below the cut that keeps the class size. A row carries its bits, so its vector is sent
once; class sums of all permutations are one matrix product for each batch, and scores need those sums only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmark.functions.draws import order_key
from siftmark.operators.joins import lookup
from siftmark.operators.metrics import auroc
from siftmark.operators.ranking import hash_cuts
from siftmark.session import written

ROWS_AT_ONCE = 64


def by_group(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """The key values of each group in a batch, and its rows."""
    rows: dict[tuple, list[int]] = {}
    columns = [batch.column(k).to_pylist() for k in keys]
    for i, key in enumerate(zip(*columns) if keys else [()] * batch.num_rows):
        rows.setdefault(key, []).append(i)
    for key, members in rows.items():
        yield key, np.array(members)


def matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """An array column whose values are all of one length, as rows of numbers."""
    return np.asarray(batch.column(column).flatten(), np.float64).reshape(batch.num_rows, -1)


def with_labels(z: DataFrame, keys: list[str], item: str, n_perm: int, seed: int) -> DataFrame:
    """(keys, z, bits): the label itself, then one bit for each permutation; every permutation keeps the class sizes."""
    perms = F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("perm")
    plan = z.groupBy(*keys).agg(F.sum("label").alias("n_pos")).select(*keys, "n_pos", perms)
    hashes = z.select(*keys, item, perms).withColumn("order_key", order_key("permute", item, F.col("perm") + seed))
    cuts = hash_cuts(hashes, [*keys, "perm"], "order_key", {"ones": F.col("n_pos")}, plan)
    lists = cuts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("perm", "ones_cut"))).alias("cuts"))

    def bit(cut):
        return F.coalesce(order_key("permute", item, cut["perm"] + seed) <= cut["ones_cut"], F.lit(False)).cast("int")

    bits = F.concat(F.array(F.col("label").cast("int")), F.transform("cuts", bit)).alias("bits")
    return lookup(z, lists, keys).select(*keys, "z", bits)


def _sums(keys: list[str]):
    """Sums of the vectors labelled 1, for the label and every permutation, of each group in one task; then of all vectors, and the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, np.ndarray] = {}
        kinds = []
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            z_all, bits_all = matrix(batch, "z"), matrix(batch, "bits")
            for key, rows in by_group(batch, keys):
                z, bits = z_all[rows], bits_all[rows]
                part = np.concatenate([(bits.T @ z).ravel(), z.sum(axis=0), bits.sum(axis=0), [len(rows)]])
                found[key] = found.get(key, 0) + part
        if found:
            own = [pa.array([key[i] for key in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(list(found.values()), pa.list_(pa.float64()))], [*keys, "sums"])

    return run


def _length(a: np.ndarray) -> np.ndarray:
    return np.sqrt((a * a).sum(axis=-1))


def _scores(keys: list[str], n_labels: int, state):
    """(keys, perm, label, probe_score) of each row and labelling, the row itself left out of its class; -1 is the true labelling."""
    names = [*keys, "perm", "label", "probe_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z_all, bits_all = matrix(batch, "z"), matrix(batch, "bits")
            width = z_all.shape[1]
            for key, members in by_group(batch, keys):
                sums = state.value[key]
                ones = sums[: n_labels * width].reshape(n_labels, width)
                every, n_ones, n = sums[n_labels * width : (n_labels + 1) * width], sums[(n_labels + 1) * width : -1], sums[-1]
                for start in range(0, len(members), ROWS_AT_ONCE):
                    rows = members[start : start + ROWS_AT_ONCE]
                    z, own = z_all[rows][:, None, :], bits_all[rows][:, :, None]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        one = (ones[None] - z * own) / (n_ones[None, :, None] - own)
                        other = (every - ones[None] - z * (1 - own)) / (n - n_ones[None, :, None] - (1 - own))
                        score = (_length(z - other) - _length(z - one)).ravel()
                    at = np.repeat(rows, n_labels)
                    values = [batch.column(k).take(pa.array(at)) for k in keys]
                    perm = np.tile(np.arange(-1, n_labels - 1, dtype=np.int32), len(rows))
                    kept = pa.array(score, mask=~np.isfinite(score))
                    yield pa.RecordBatch.from_arrays([*values, pa.array(perm), pa.array(bits_all[rows].ravel().astype(np.int32)), kept], names)

    return run


def permutation_aurocs(z: DataFrame, keys: list[str], item: str, n_perm: int, seed: int) -> DataFrame:
    """(keys, perm, auroc) of the leave-one-out probe on standardised rows (keys, item, z, label); perm -1 is the true labelling.

    The driver holds the class sums, ``n_perm`` vectors for each group.
    """
    spark, n_labels = z.sparkSession, n_perm + 1
    rows = written(with_labels(z, keys, item, n_perm, seed), "labelled-vectors")
    kinds = [rows.schema[k] for k in keys]
    parts = rows.mapInArrow(_sums(keys), T.StructType([*kinds, T.StructField("sums", T.ArrayType(T.DoubleType()))]))
    summed = parts.groupBy(*keys).agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
    state = spark.sparkContext.broadcast({tuple(r[k] for k in keys): np.array(r["sums"]) for r in summed.collect()})
    fields = [*kinds, T.StructField("perm", T.IntegerType()), T.StructField("label", T.IntegerType()), T.StructField("probe_score", T.DoubleType())]
    return auroc(rows.mapInArrow(_scores(keys, n_labels, state), T.StructType(fields)), [*keys, "perm"], "probe_score")
