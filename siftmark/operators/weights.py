"""Bootstrap weights computed where the rows lie, and metrics of the weighted rows.

A resample of a class of n rows is n draws with replacement. Here they come in two parts. Every row takes a Poisson
number for each replicate from the hash of its position, with a mean of ``1 - MARGIN / sqrt(n)``; given their total, these draws
fall evenly on the rows. What is missing to n, about ``MARGIN * sqrt(n)`` draws, is drawn by position. Together they are exactly n even draws.
A weight needs the row and the missing numbers of its class only, so no row is copied or sent for a replicate: tasks compute
weights again whenever they need them and give out sums, one number for each replicate.

Scores are put in order once, in ranges that cut through groups and ties alike. Of each range, the group totals of its first score, its last score
and everything between them are known first; with what lies above, the range then adds up its own part of the metric.

A class whose Poisson numbers add up to more than n, eight deviations away, ends the job; choose another seed then.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, factorial, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siftmark.functions.draws import order_key
from siftmark.operators.joins import lookup, require
from siftmark.operators.metrics import harmonic_gap
from siftmark.operators.ranking import hash_positions, partitions_of
from siftmark.operators.shuffles import by_group
from siftmark.session import written

MARGIN = 8.0
# Poisson numbers above this have a probability below one in 2**32.
MOST = 12
# Weights held at once.
CELLS = 1 << 20
# Rows of a class that ``multiplicities`` writes out in one task.
BLOCK = 4096
# The 32-bit golden ratio and the multipliers of a well-known 32-bit finaliser.
STEP, FIRST, SECOND = 0x9E3779B9, 0x85EBCA6B, 0xC2B2AE35


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(FIRST)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(SECOND)
    return x ^ (x >> np.uint32(16))


def mixed(a: np.ndarray, b: np.ndarray, i: np.ndarray) -> np.ndarray:
    """32 even bits for the number ``i`` of the stream (a, b); all are arrays of 32-bit numbers."""
    return _spread(_spread(a + i * np.uint32(STEP)) ^ b)


def thresholds(n: int) -> np.ndarray:
    """A hash takes as many draws as there are thresholds at or below it."""
    mean = max(0.0, 1.0 - MARGIN / sqrt(n))
    shares = np.cumsum([exp(-mean) * mean**k / factorial(k) for k in range(MOST + 1)])
    cuts = np.ceil(shares * 2.0**32)
    return cuts[cuts < 2.0**32].astype(np.uint32)


def base_draws(low: np.ndarray, high: np.ndarray, n: int, replicates: np.ndarray) -> np.ndarray:
    """Poisson numbers, rows by replicates."""
    bits = mixed(low[:, None], high[:, None], replicates.astype(np.uint32)[None, :])
    found = np.zeros(bits.shape, np.int64)
    for cut in thresholds(n):
        found += bits >= cut
    return found


def missing_draws(low: int, high: int, n: int, missing: np.ndarray, replicates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the draws that the Poisson numbers leave open, and the index of the replicate of each."""
    most = int(missing.max(initial=0))
    a, b = np.array([low], np.uint32), np.array([high], np.uint32)
    replicate = replicates.astype(np.uint32)
    one, two = mixed(a, b, replicate)[None, :], mixed(b, a, replicate)[None, :]
    slot = np.arange(most, dtype=np.uint32)[:, None]
    wide = (mixed(one, two, slot).astype(np.uint64) << np.uint64(32)) | mixed(two, one, slot).astype(np.uint64)
    kept, index = np.nonzero(np.arange(most)[:, None] < missing[None, :])
    return (wide[kept, index] % np.uint64(n)).astype(np.int64), index


def _numbers(table: pa.Table, column: str, kind) -> np.ndarray:
    return table.column(column).to_numpy().astype(kind)


def weighted(rows: pa.Table, classes: pa.Table, n_boot: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(replicates, weights of the rows) until all replicates are through; ``classes`` holds the classes of the rows."""
    labels, pos = _numbers(rows, "label", np.int64), _numbers(rows, "pos", np.int64)
    low, high = _numbers(rows, "low", np.uint32), _numbers(rows, "high", np.uint32)
    parts = []
    for c in classes.to_pylist():
        own = np.flatnonzero(labels == c["label"])
        parts.append((c, own[np.argsort(pos[own])], np.array(c["missing"], np.int64)))
    wide = max([len(pos), 1, *[int(missing.max(initial=0)) for _, _, missing in parts]])
    step = max(1, CELLS // wide)
    for start in range(0, n_boot, step):
        replicates = np.arange(start, min(start + step, n_boot))
        out = np.zeros((len(pos), len(replicates)), np.int64)
        for c, own, missing in parts:
            if not len(own):
                continue
            out[own] = base_draws(low[own], high[own], c["n"], replicates)
            drawn, index = missing_draws(c["class_low"], c["class_high"], c["n"], missing[replicates], replicates)
            at = np.searchsorted(pos[own], drawn)
            here = (at < len(own)) & (pos[own][np.minimum(at, len(own) - 1)] == drawn)
            np.add.at(out, (own[at[here]], index[here]), 1)
        yield replicates, out


def _base_totals(keys: list[str], n_boot: int):
    """For each class in a task, the sums of its Poisson numbers."""
    grain = [*keys, "label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, np.ndarray] = {}
        kinds = []
        step = max(1, CELLS // n_boot)
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in grain]
            low, high, size = (batch.column(c).to_numpy() for c in ("low", "high", "pos_size"))
            for key, members in by_group(batch, grain):
                for start in range(0, len(members), step):
                    at = members[start : start + step]
                    drawn = base_draws(low[at].astype(np.uint32), high[at].astype(np.uint32), int(size[at[0]]), np.arange(n_boot))
                    found[key] = found.get(key, 0) + drawn.sum(axis=0)
        if found:
            own = [pa.array([key[i] for key in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(list(found.values()), pa.list_(pa.int64()))], [*grain, "totals"])

    return run


def _halves(digest: Column) -> tuple[Column, Column]:
    part = lambda start: F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")
    return part(1), part(9)


def _hash_of(purpose: str, keys: list[str], *more: str, seed: int) -> Column:
    return order_key(purpose, F.concat_ws("/", *[F.col(k).cast("string") for k in (*keys, "label", *more)]), seed)


def positioned(rows: DataFrame, keys: list[str], path: str, seed: int) -> DataFrame:
    """The rows with ``pos``, their place in the hash order of their class, ``pos_size`` and the two halves of their hash; written once."""
    keyed = rows.withColumn("order_key", order_key("slot", path, seed))
    placed = hash_positions(keyed, [*keys, "label"], "order_key").drop("order_key")
    low, high = _halves(_hash_of("boot", keys, "pos", seed=seed))
    return written(placed.withColumn("low", low).withColumn("high", high), "resample-rows")


def classes_of(placed: DataFrame, keys: list[str], n_boot: int, seed: int) -> DataFrame:
    """(keys, label, n, missing, class_low, class_high): the draws that each replicate of a class still needs; written once."""
    grain = [*keys, "label"]
    fields = [placed.schema[k] for k in grain]
    sums = placed.select(*grain, "pos_size", "low", "high").mapInArrow(
        _base_totals(keys, n_boot), T.StructType([*fields, T.StructField("totals", T.ArrayType(T.LongType()))])
    )
    totals = sums.select(*grain, F.posexplode("totals").alias("replicate", "total")).groupBy(*grain, "replicate").agg(F.sum("total").alias("total"))
    listed = totals.groupBy(*grain).agg(F.array_sort(F.collect_list(F.struct("replicate", "total"))).alias("t"))
    sizes = placed.groupBy(*grain).agg(F.max("pos_size").alias("n"))
    low, high = _halves(_hash_of("draws", keys, seed=seed))
    open_draws = lookup(listed, sizes, grain, "inner").select(
        *grain, "n", F.transform("t", lambda t: F.col("n") - t["total"]).alias("missing"), low.alias("class_low"), high.alias("class_high")
    )
    return written(require(open_draws, F.array_min("missing") >= 0, "a replicate drew more rows than its class has; choose another seed"), "resample-classes")


def _written_out(n_boot: int):
    def run(key: tuple, rows: pa.Table, classes: pa.Table) -> pa.Table:
        payload = [c for c in rows.column_names if c not in ("pos", "pos_size", "low", "high", "block")]
        parts = []
        for replicates, found in weighted(rows, classes, n_boot):
            at, index = np.nonzero(found)
            part = rows.select(payload).take(pa.array(at))
            part = part.append_column("replicate", pa.array(replicates[index].astype(np.int32)))
            parts.append(part.append_column("times", pa.array(found[at, index])))
        return pa.concat_tables(parts)

    return run


def multiplicities(rows: DataFrame, keys: list[str], n_boot: int, path: str = "path", label: str = "label", seed: int = 0) -> DataFrame:
    """The rows with ``replicate`` and ``times``, how often a replicate drew them (rows never drawn are left out).

    As many rows as rows times replicates come out; the metrics below do not use it.
    """
    rows = rows.withColumnRenamed(label, "label")
    placed = positioned(rows, keys, path, seed)
    classes = classes_of(placed, keys, n_boot, seed)
    grain = [*keys, "label", "block"]
    blocks = placed.withColumn("block", F.floor(F.col("pos") / BLOCK))
    info = written(lookup(blocks.select(*grain).distinct(), classes, [*keys, "label"], "inner"), "resample-blocks")
    schema = T.StructType([*rows.schema.fields, T.StructField("replicate", T.IntegerType()), T.StructField("times", T.LongType())])
    out = blocks.groupBy(*grain).cogroup(info.groupBy(*grain)).applyInArrow(_written_out(n_boot), schema)
    return out.withColumnRenamed("label", label)


def _strata(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of falling scores, where each distinct score starts, the distinct scores, and which rows are positive (in that order)."""
    score = _numbers(rows, "score", np.float64)
    order = np.argsort(-score, kind="stable")
    falling = score[order]
    starts = np.flatnonzero(np.concatenate([[True], falling[1:] != falling[:-1]]))
    return order, starts, falling[starts], (_numbers(rows, "label", np.int64) == 1)[order][:, None]


def _by_score(rows: pa.Table, classes: pa.Table, n_boot: int):
    """(replicates, positives, negatives) by distinct score, highest first."""
    order, starts, _, positive = _strata(rows)
    for replicates, found in weighted(rows, classes, n_boot):
        found = found[order]
        yield replicates, np.add.reduceat(found * positive, starts, axis=0), np.add.reduceat(found * ~positive, starts, axis=0)


def _totals(n_boot: int, names: list[str]):
    """Sums of a range's highest score, of its lowest, and of the scores between them (kind 1, bound by the highest)."""

    def run(key: tuple, rows: pa.Table, classes: pa.Table) -> pa.Table:
        scores = _strata(rows)[2]
        last = len(scores) - 1
        spans = [(float(scores[0]), 0, slice(0, 1))]
        if last > 0:
            spans.append((float(scores[last]), 0, slice(last, last + 1)))
        if last > 1:
            spans.append((float(scores[0]), 1, slice(1, last)))
        sums = np.zeros((2, len(spans), n_boot), np.int64)
        for replicates, pos, neg in _by_score(rows, classes, n_boot):
            for i, (_, _, span) in enumerate(spans):
                sums[0, i, replicates] = pos[span].sum(axis=0)
                sums[1, i, replicates] = neg[span].sum(axis=0)
        own = [pa.array([k.as_py()] * len(spans), k.type) for k in key]
        bound, kind = pa.array([s[0] for s in spans], pa.float64()), pa.array([s[1] for s in spans], pa.int32())
        lists = [pa.array(list(part), pa.list_(pa.int64())) for part in sums]
        return pa.Table.from_arrays([*own, bound, kind, *lists], names)

    return run


def _harmonic_gap(n: np.ndarray, more: np.ndarray) -> np.ndarray:
    """``harmonic_gap`` of the metrics, for arrays."""
    first = sum(1.0 / (n + i) - 1.0 / (n + more + i) for i in range(1, 17))
    low, high = n + 16.0, n + more + 16.0
    rest = np.log1p(more / low)
    for power, factor in ((1, 1 / 2), (2, -1 / 12), (4, 1 / 120), (6, -1 / 252), (8, 1 / 240)):
        rest = rest + factor * (high**-power - low**-power)
    return first + rest


def _auroc_gain(pos, neg, tp, fp, n):
    return pos * (n - fp + neg / 2.0)


def _aupr_gain(pos, neg, tp, fp, n):
    false_above = fp - neg
    return pos - false_above * _harmonic_gap(tp - pos + false_above, pos)


ARRAY_GAINS = {"auroc": _auroc_gain, "aupr": _aupr_gain}


def _node_gain(metric: str) -> Column:
    """What the rows of one score add to the metric; positives come first among equal scores in average precision."""
    pos, neg, tp, fp, n = (F.col(c).cast("double") for c in ("pos", "neg", "tp", "fp", "n"))
    if metric == "auroc":
        return pos * (n - fp + neg / F.lit(2.0))
    false_above = fp - neg
    return F.when(pos > 0, pos - false_above * harmonic_gap(tp - pos + false_above, pos)).otherwise(F.lit(0.0))


def _inner_gains(metric: str, n_boot: int, names: list[str]):
    """What the scores between the first and the last of a range add, given the positives and negatives above them."""
    gain = ARRAY_GAINS[metric]

    def run(key: tuple, rows: pa.Table, info: pa.Table) -> pa.Table:
        above = info.slice(0, 1).to_pylist()[0] if info.num_rows else None
        if above is None or above["tp_above"] is None:
            return pa.Table.from_arrays([pa.array([], k.type) for k in key] + [pa.array([], pa.list_(pa.float64()))], names)
        sums = np.zeros(n_boot)
        tp_above, fp_above, n = (np.array(above[c], np.float64) for c in ("tp_above", "fp_above", "n_total"))
        for replicates, pos, neg in _by_score(rows, info, n_boot):
            pos, neg = pos[1:-1].astype(np.float64), neg[1:-1].astype(np.float64)
            tp = np.cumsum(pos, axis=0) + tp_above[replicates]
            fp = np.cumsum(neg, axis=0) + fp_above[replicates]
            sums[replicates] = gain(pos, neg, tp, fp, n[replicates]).sum(axis=0)
        own = [pa.array([k.as_py()], k.type) for k in key]
        return pa.Table.from_arrays([*own, pa.array([sums], pa.list_(pa.float64()))], names)

    return run


def replicate_metric(rows: DataFrame, keys: list[str], arms: dict[str, str], metric: str, n_boot: int, seed: int = 0) -> DataFrame:
    """(keys, replicate, arm, value): the metric of every replicate and arm; all arms use the same draws. A missing score is the lowest."""
    if not keys:
        return replicate_metric(rows.withColumn("all_rows", F.lit(0)), ["all_rows"], arms, metric, n_boot, seed).drop("all_rows")
    placed = positioned(rows.select(*keys, "path", F.col("label").cast("bigint").alias("label"), *arms.values()), keys, "path", seed)
    classes = classes_of(placed, keys, n_boot, seed)
    lowest = F.lit(float("-inf"))
    scores = [F.struct(F.lit(arm).alias("arm"), F.coalesce(F.col(c).cast("double"), lowest).alias("score")) for arm, c in arms.items()]
    long = placed.select(*keys, "label", "pos", "low", "high", F.explode(F.array(*scores)).alias("s")).select(
        *keys, "label", "pos", "low", "high", "s.arm", "s.score"
    )
    ranges = long.repartitionByRange(partitions_of(rows), *keys, "arm", F.col("score").desc(), "low", "high")
    ordered = written(ranges.withColumn("range", F.spark_partition_id()), "resample-ranges")
    grain, own = ["range", *keys, "arm"], [*keys, "arm"]
    info = written(lookup(ordered.select(*grain).distinct(), classes, keys, "inner"), "resample-ranges-classes")
    kinds = [ordered.schema[c] for c in grain]
    counts = T.ArrayType(T.LongType())
    schema = T.StructType(
        [*kinds, T.StructField("bound", T.DoubleType()), T.StructField("kind", T.IntegerType()), T.StructField("pos", counts), T.StructField("neg", counts)]
    )
    sums = ordered.groupBy(*grain).cogroup(info.groupBy(*grain)).applyInArrow(_totals(n_boot, schema.names), schema)
    nodes = (
        sums.select(*grain, "bound", "kind", F.posexplode(F.arrays_zip("pos", "neg")).alias("replicate", "w"))
        .groupBy(*own, "replicate", "bound", "kind")
        .agg(F.max("range").alias("range"), F.sum("w.pos").alias("pos"), F.sum("w.neg").alias("neg"))
    )
    group = Window.partitionBy(*own, "replicate")
    down = group.orderBy(F.col("bound").desc(), "kind").rowsBetween(Window.unboundedPreceding, 0)
    placed_nodes = written(
        nodes.select(
            "*", *[F.sum(a).over(down).alias(b) for a, b in (("pos", "tp"), ("neg", "fp"))], *[F.sum(a).over(group).alias(b) for a, b in (("pos", "p"), ("neg", "n"))]
        ),
        "resample-nodes",
    )
    above = F.struct("replicate", (F.col("tp") - F.col("pos")).alias("tp"), (F.col("fp") - F.col("neg")).alias("fp"), "n")
    listed = placed_nodes.where("kind = 1").groupBy(*grain).agg(F.array_sort(F.collect_list(above)).alias("a"))
    offsets = listed.select(*grain, *[F.col(f"a.{c}").alias(name) for c, name in (("tp", "tp_above"), ("fp", "fp_above"), ("n", "n_total"))])
    gain_schema = T.StructType([*kinds, T.StructField("gains", T.ArrayType(T.DoubleType()))])
    inner = (
        ordered.groupBy(*grain)
        .cogroup(written(lookup(info, offsets, grain), "resample-offsets").groupBy(*grain))
        .applyInArrow(_inner_gains(metric, n_boot, gain_schema.names), gain_schema)
        .select(*own, F.posexplode("gains").alias("replicate", "gain"), F.lit(None).cast("bigint").alias("p"), F.lit(None).cast("bigint").alias("n"))
    )
    outer = placed_nodes.where("kind = 0").select(*own, "replicate", _node_gain(metric).alias("gain"), "p", "n")
    p, n = F.max("p").cast("double"), F.max("n").cast("double")
    value = F.when((p > 0) & (n > 0), F.try_divide(F.sum("gain"), p * n)) if metric == "auroc" else F.try_divide(F.sum("gain"), p)
    return outer.unionByName(inner).groupBy(*keys, "replicate", "arm").agg(value.alias("value"))
