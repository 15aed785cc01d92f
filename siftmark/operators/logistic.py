"""Cross-validated logistic probe: all folds of all repeats and groups are fitted together.

Every fit is a Newton iteration. One scan of the rows takes all fits one step further: a task adds up, for each fit, the gradient
and the Gram sums of the rows it trains on, Spark adds the tasks' sums, and the small systems are solved where their sums meet. The driver
loops over steps only and hands on the weights, ``folds * repeats`` short vectors for each group.
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

from siftmark.operators.metrics import auroc
from siftmark.operators.records import fold_assignment
from siftmark.operators.shuffles import by_group
from siftmark.operators.vectors import STD_EPS
from siftmark.session import written

# A step may change no weight by more, once the fits are done; steps are bounded as the loss is strictly convex.
TOLERANCE = 1e-10
MAX_STEPS = 25


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and the fold of each repeat."""
    n = batch.num_rows
    x = np.asarray(batch.column("x").flatten(), np.float64).reshape(n, -1)
    return x, np.asarray(batch.column("label"), np.float64), np.asarray(batch.column("folds").flatten(), np.int64).reshape(n, -1)


def _with_folds(rows: DataFrame, keys: list[str], item: str, features: str, label: str, folds: int, repeats: int) -> DataFrame:
    """(keys, item, x, label, folds): the fold of each row in each repeat; features travel once."""
    slim = rows.select(*keys, item, F.col(label).cast("int").alias("label"))
    assigned = fold_assignment(slim, keys, item, "label", folds, repeats)
    lists = assigned.groupBy(item).agg(F.array_sort(F.collect_list(F.struct("repeat", "fold"))).alias("pairs"))
    x = F.transform(F.col(features), lambda v: v.cast("double")).alias("x")
    own = rows.select(*keys, item, x, F.col(label).cast("int").alias("label"))
    return written(own.join(lists.select(item, F.col("pairs.fold").alias("folds")), item), "probe-rows")


def _scales(data: DataFrame, keys: list[str], folds: int, repeats: int) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """Mean and guarded population deviation of the training rows of each fit."""
    each = data.select(*keys, "x", F.posexplode("folds").alias("repeat", "fold"))
    moments = Summarizer.metrics("sum", "normL2", "count").summary(array_to_vector("x")).alias("s")
    sums = each.groupBy(*keys, "repeat", "fold").agg(moments)
    sums = sums.select(*keys, "repeat", "fold", vector_to_array("s.sum").alias("total"), vector_to_array("s.normL2").alias("norm"), F.col("s.count").alias("n"))
    found: dict[tuple, dict] = {}
    for row in sums.collect():  # one short vector for each fold, repeat and group
        found.setdefault(tuple(row[k] for k in keys), {})[row["repeat"], row["fold"]] = (row["n"], np.array(row["total"]), np.array(row["norm"]) ** 2)
    scales = {}
    for key, parts in found.items():
        zero = tuple(0 * v for v in next(iter(parts.values())))
        means, deviations = [], []
        for repeat in range(repeats):
            for fold in range(folds):
                n, total, squares = (sum(v) for v in zip(zero, *[p for (r, f), p in parts.items() if r == repeat and f != fold]))
                mean = total / max(n, 1)
                means.append(mean)
                deviations.append(np.sqrt(np.maximum(squares / max(n, 1) - mean**2, 0)) + STD_EPS)
        scales[key] = np.array(means), np.array(deviations)
    return scales


def _design(x: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(x), 1)), (x - mean) / deviation])


def _system(keys: list[str], folds: int, repeats: int, state):
    """The task of a step: gradient and Gram sums of every fit over the rows of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        kinds = []
        for batch in batches:
            kinds = [batch.schema.field(k) for k in keys]
            x_all, y_all, folds_all = _arrays(batch)
            for key, rows in by_group(batch, keys):
                (means, deviations), weights = state.value[key]
                x, y = x_all[rows], y_all[rows]
                for fit in range(folds * repeats):
                    train = folds_all[rows, fit // folds] != fit % folds
                    a = _design(x[train], means[fit], deviations[fit])
                    p = 1 / (1 + np.exp(-np.clip(a @ weights[fit], -500, 500)))
                    part = np.concatenate([a.T @ (p - y[train]), ((a * (p * (1 - p))[:, None]).T @ a).ravel()])
                    sums[key, fit] = sums.get((key, fit), 0) + part
        if sums:
            columns = [pa.array([key[i] for key, _ in sums], kind.type) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([fit for _, fit in sums], pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], [*keys, "fit", "sums"])

    return run


def _solve(keys: list[str], state, c: float):
    """Newton's change of the weights from the sums of all tasks; the intercept is not penalised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            changes = []
            key_rows = list(zip(*[batch.column(k).to_pylist() for k in keys])) if keys else [()] * batch.num_rows
            for key, fit, sums in zip(key_rows, batch.column("fit").to_pylist(), batch.column("sums").to_pylist()):
                w = state.value[key][1][fit]
                penalty = np.ones(len(w))
                penalty[0] = 0.0
                gradient = c * np.array(sums[: len(w)]) + penalty * w
                curvature = c * np.array(sums[len(w) :]).reshape(len(w), len(w)) + np.diag(penalty)
                changes.append(np.linalg.lstsq(curvature, gradient, rcond=None)[0].tolist())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], batch.column("fit"), pa.array(changes, pa.list_(pa.float64()))], [*keys, "fit", "change"])

    return run


def _held_out(keys: list[str], item: str, folds: int, repeats: int, state):
    """(keys, label, repeat, decision) of each row by the fit that did not see it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x_all, _, folds_all = _arrays(batch)
            for key, rows in by_group(batch, keys):
                (means, deviations), weights = state.value[key]
                for repeat in range(repeats):
                    fits = repeat * folds + folds_all[rows, repeat]
                    z = (x_all[rows] - means[fits]) / deviations[fits]
                    decision = weights[fits, 0] + (z * weights[fits, 1:]).sum(axis=1)
                    own = [batch.column(k).take(pa.array(rows)) for k in [*keys, "label"]]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(rows), repeat, np.int32)), pa.array(decision)], [*keys, "label", "repeat", "decision"])

    return run


def logistic_probe(rows: DataFrame, keys: list[str], item: str, features: str, label: str = "label", c: float = 0.5, folds: int = 5, repeats: int = 5, max_steps: int = MAX_STEPS) -> DataFrame:
    """Mean over repeats of the out-of-fold AUROC of an L2 logistic regression on standardised features, for each group.

    ``item`` is unique; every row has the same number of features. A group of one class has no AUROC (null).
    """
    spark = rows.sparkSession
    data = _with_folds(rows, keys, item, features, label, folds, repeats)
    scales = _scales(data, keys, folds, repeats)
    fits = {key: (scale, np.zeros((folds * repeats, scale[0].shape[1] + 1))) for key, scale in scales.items()}
    kinds = [data.schema[k] for k in keys]
    doubles = T.ArrayType(T.DoubleType())
    for _ in range(max_steps if fits else 0):
        state = spark.sparkContext.broadcast(fits)
        systems = data.mapInArrow(_system(keys, folds, repeats, state), T.StructType([*kinds, T.StructField("fit", T.IntegerType()), T.StructField("sums", doubles)]))
        summed = systems.groupBy(*keys, "fit").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
        solved = summed.mapInArrow(_solve(keys, state, c), T.StructType([*kinds, T.StructField("fit", T.IntegerType()), T.StructField("change", doubles)]))
        largest = 0.0
        for row in solved.collect():  # the weights of each fit
            change = np.array(row["change"])
            fits[tuple(row[k] for k in keys)][1][row["fit"]] -= change
            largest = max(largest, float(np.abs(change).max()))
        if largest <= TOLERANCE:
            break
    state = spark.sparkContext.broadcast(fits)
    kept = [*kinds, data.schema["label"], T.StructField("repeat", T.IntegerType()), T.StructField("decision", T.DoubleType())]
    scored = data.mapInArrow(_held_out(keys, item, folds, repeats, state), T.StructType(kept))
    return auroc(scored, [*keys, "repeat"], "decision").groupBy(*keys).agg(F.avg("auroc").alias("auroc"))
