"""Hash-ordered draws.

Every random choice is an order by ``md5(seed:purpose:path)``: sizes and invariants follow the drawing
rule, membership is reproducible on any cluster layout and survives a recomputed partition.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(purpose: str, path: Column | str, seed: Column | int = 0) -> Column:
    """The text key that orders rows for one draw."""
    path = F.col(path) if isinstance(path, str) else path
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat_ws(":", seed.cast("string"), F.lit(purpose), path.cast("string")))


def hash_slot(purpose: str, slot: Column, size: Column, seed: Column | int = 0) -> Column:
    """A 0-based position below ``size`` for one slot of a draw with replacement, from 60 bits of the hash."""
    head = F.conv(F.substring(order_key(purpose, slot, seed), 1, 15), 16, 10).cast("bigint")
    return F.pmod(head, size.cast("bigint"))


def half_even(value: Column) -> Column:
    """Round half to even, to a whole number."""
    return F.bround(value, 0).cast("bigint")


def take_size(n: Column, fraction: float | None = None, fixed: int = 0) -> Column:
    """Rows to draw from a type of ``n`` rows: a share rounded up (at least one), or a fixed count."""
    if fraction:
        return F.greatest(F.lit(1), F.ceil(F.lit(float(fraction)) * n)).cast("bigint")
    return F.lit(int(fixed)).cast("bigint")


def validation_part(drawn: Column, share: Column | float) -> Column:
    """How many of ``drawn`` rows go to validation; training always keeps at least one."""
    share = F.lit(float(share)) if not isinstance(share, Column) else share
    part = F.least(half_even(drawn * share), drawn - 1)
    return F.when(drawn > 1, F.greatest(part, F.lit(0))).otherwise(F.lit(0)).cast("bigint")
