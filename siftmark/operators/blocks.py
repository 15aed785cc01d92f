"""Work over pairs of rows without emitting the pairs.

Rows are put into blocks of bounded size and blocks meet by an equality join on block numbers. A task
holds two blocks, works on them with numpy, and emits only what survives: sums, or the best few.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftmark.operators.joins import lookup

BLOCK_ROWS = 8192
# Rows of one block that meet the other block in one matrix product.
STEP_ROWS = 256


def _numbered(rows: DataFrame, keys: list[str], item: str, block_rows: int) -> DataFrame:
    """Add ``_block`` (a hash of the item) and ``_blocks``, enough for about ``block_rows`` rows each."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block_rows))).cast("int").alias("_blocks"))
    return lookup(rows, sizes, keys, "inner").withColumn("_block", F.pmod(F.xxhash64(item), F.col("_blocks")).cast("int"))


def _distances(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[int, float, float]:
    """Number, sum and smallest of the distances between two blocks; ``same``: each pair of the one block once.

    Squares come from a product of matrices, ``STEP_ROWS`` rows at a time. Where rounding could matter, which is where a
    square is tiny beside the lengths it was made of, the difference itself is taken.
    """
    centre = a.mean(axis=0)
    a, b = a - centre, b - centre
    lengths = (b * b).sum(axis=1)
    pairs, total, smallest = 0, 0.0, np.inf
    for start in range(0, len(a), STEP_ROWS):
        part = a[start : start + STEP_ROWS]
        scale = (part * part).sum(axis=1)[:, None] + lengths
        squares = scale - 2.0 * (part @ b.T)
        valid = np.arange(len(b)) > (start + np.arange(len(part)))[:, None] if same else np.ones(squares.shape, bool)
        i, j = np.nonzero(valid & (squares <= 1e-6 * scale))
        for at in range(0, len(i), 4 * STEP_ROWS):
            p, q = i[at : at + 4 * STEP_ROWS], j[at : at + 4 * STEP_ROWS]
            squares[p, q] = ((part[p] - b[q]) ** 2).sum(axis=1)
        found = np.sqrt(np.maximum(squares[valid], 0.0))
        if len(found):
            pairs, total, smallest = pairs + len(found), total + float(found.sum()), min(smallest, float(found.min()))
    return pairs, total, smallest


def pairwise_spread(
    rows: DataFrame, keys: list[str], item: str, features: str, block_rows: int = BLOCK_ROWS, least_mean: float = 0.02
) -> DataFrame:
    """Mean and smallest distance over all pairs of a group, and whether the mean is at least ``least_mean``; NULL for a single row.

    A row is sent once to each block of its group, so its copies are the group's rows divided by ``block_rows``.
    """
    numbered = _numbered(rows, keys, item, block_rows)
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    met = numbered.select(*keys, features, "_block", other.alias("_other")).select(
        *keys, features, "_block", F.least("_block", "_other").alias("_lo"), F.greatest("_block", "_other").alias("_hi")
    )
    # A block meets itself once: both ends of that pair are the same rows.
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", pairs bigint, total double, smallest double"

    def spread(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = key[-2], key[-1]
        a = np.stack(pdf.loc[pdf["_block"] == lo, features].to_numpy()).astype(float) if (pdf["_block"] == lo).any() else None
        b = a if lo == hi else (np.stack(pdf.loc[pdf["_block"] == hi, features].to_numpy()).astype(float) if (pdf["_block"] == hi).any() else None)
        if a is None or b is None:
            return pd.DataFrame([[*key[:-2], 0, 0.0, None]], columns=[*keys, "pairs", "total", "smallest"])
        pairs, total, smallest = _distances(a, b, lo == hi)
        return pd.DataFrame([[*key[:-2], pairs, total, smallest if pairs else None]], columns=[*keys, "pairs", "total", "smallest"])

    parts = met.groupBy(*keys, "_lo", "_hi").applyInPandas(spread, schema)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    found = parts.groupBy(*keys).agg(
        F.try_divide(F.sum("total"), F.sum("pairs")).alias("mean_distance"), F.min("smallest").alias("min_distance")
    )
    return sizes.join(found, keys, "left").withColumn("passed", F.col("mean_distance") >= F.lit(float(least_mean)))


def best_hosts(
    donors: DataFrame, hosts: DataFrame, keys: list[str], most: int, block_rows: int = 4096, donor_block: int = 64
) -> DataFrame:
    """For each donor the hosts with the lowest context cost, as many as its ``need``, ranked from 0.

    ``most`` is the largest ``need``; as a constant it lets Spark cut each donor's list before the shuffle.

    The cost is the mean absolute difference over the donor's ``ring`` (0 for an empty ring); ties go to
    the smaller host name. ``donors``: keys, donor_idx, need, ring array<boolean>, pixels; ``hosts``: keys, host,
    pixels. Hosts move once, in blocks; donors are copied to every block; a block keeps only its best.
    """
    plan = _numbered(hosts.withColumnRenamed("pixels", "host_pixels"), keys, "host", block_rows)
    chunked = donors.withColumn("_chunk", F.floor(F.col("donor_idx") / donor_block).cast("int"))
    chunks = chunked.groupBy(*keys).agg((F.max("_chunk") + 1).alias("_chunks"))
    host_side = lookup(plan, chunks, keys, "inner").withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    block_counts = plan.select(*keys, "_blocks").distinct()
    donor_side = lookup(chunked, block_counts, keys, "inner").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    types = dict(hosts.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", donor_idx int, need int, host {types['host']}, cost double"

    def match(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=[*keys, "donor_idx", "need", "host", "cost"])
        right = right.sort_values("host", kind="stable")
        pixels = np.stack(right["host_pixels"].to_numpy()).astype(float)
        names = right["host"].to_numpy()
        out = []
        for donor in left.itertuples(index=False):
            ring = np.asarray(donor.ring, dtype=bool)
            own = np.asarray(donor.pixels, dtype=float)
            cost = np.abs(pixels[:, ring] - own[ring]).mean(axis=1) if ring.any() else np.zeros(len(names))
            best = np.argsort(cost, kind="stable")[: int(donor.need)]
            out.append(pd.DataFrame({"donor_idx": int(donor.donor_idx), "need": int(donor.need), "host": names[best], "cost": cost[best]}))
        found = pd.concat(out, ignore_index=True)
        for i, k in enumerate(keys):
            found[k] = key[i]
        return found[[*keys, "donor_idx", "need", "host", "cost"]]

    grain = [*keys, "_block", "_chunk"]
    # Aliased, since donors and hosts may be cut from the same table.
    left = donor_side.select(*[F.col(c).alias(c) for c in (*grain, "donor_idx", "need", "ring", "pixels")])
    right = host_side.select(*[F.col(c).alias(c) for c in (*grain, "host", "host_pixels")])
    near = left.groupBy(*grain).cogroup(right.groupBy(*grain)).applyInPandas(match, schema)
    order = Window.partitionBy(*keys, "donor_idx").orderBy("cost", "host")
    ranked = near.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= most) & (F.col("rank") <= F.col("need")))
    return ranked.withColumn("host_rank", F.col("rank") - 1).drop("need", "rank")
