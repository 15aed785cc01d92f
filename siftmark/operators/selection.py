"""Best-epoch selection and early stopping over per-epoch metrics.

The rule depends on every earlier epoch, so a run is folded in epoch order. A run has at most as many
rows as the trainer's epoch cap; the fold never sees per-item data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: two metric values this close are a tie.
TIE_EPS = 1e-12

STATE = (
    "struct<best_value:double,best_epoch:int,best_secondary:double,counter:int,tie_wins:int,"
    "stopped:boolean,epochs_ran:int,history:array<struct<epoch:int,is_best:boolean,tie_win:boolean,"
    "best_epoch:int,best_value:double,patience_left:int>>>"
)


def _merge(acc: Column, row: Column, patience: int, min_delta: float, tiebreak: bool, min_epochs: int, stop_early: bool) -> Column:
    value, secondary, best = row["value"], row["secondary"], acc["best_value"]
    improved = value.isNotNull() & (best.isNull() | (value > best + F.lit(min_delta)))
    tied = value.isNotNull() & best.isNotNull() & (F.abs(value - best) <= TIE_EPS) & secondary.isNotNull()
    lower = acc["best_secondary"].isNull() | (secondary < acc["best_secondary"] - F.lit(TIE_EPS))
    tie_win = F.lit(tiebreak) & ~improved & tied & lower
    keep = improved | tie_win
    counter = F.when(improved, F.lit(0)).otherwise(acc["counter"] + 1)
    best_value = F.when(keep, value).otherwise(best)
    best_epoch = F.when(keep, row["epoch"]).otherwise(acc["best_epoch"])
    step = F.struct(
        row["epoch"].alias("epoch"),
        keep.alias("is_best"),
        tie_win.alias("tie_win"),
        best_epoch.alias("best_epoch"),
        best_value.alias("best_value"),
        F.greatest(F.lit(patience) - counter, F.lit(0)).alias("patience_left"),
    )
    stops = F.lit(stop_early) & (counter >= patience) & (row["epoch"] + 1 >= min_epochs)
    after = F.struct(
        best_value.alias("best_value"),
        best_epoch.alias("best_epoch"),
        F.when(keep & secondary.isNotNull(), secondary).otherwise(acc["best_secondary"]).alias("best_secondary"),
        counter.alias("counter"),
        (acc["tie_wins"] + F.when(tie_win, 1).otherwise(0)).alias("tie_wins"),
        stops.alias("stopped"),
        (acc["epochs_ran"] + 1).alias("epochs_ran"),
        F.array_append(acc["history"], step).alias("history"),
    ).cast(STATE)
    return F.when(acc["stopped"], acc).otherwise(after)


def _folded(
    epochs: DataFrame, keys: list[str], value: str, secondary: str | None, mode: str, patience: int,
    min_delta: float, tiebreak: bool, min_epochs: int, stop_early: bool,
) -> DataFrame:
    if mode not in ("max", "min"):
        raise ValueError(f"unknown mode {mode!r}")
    sign = 1.0 if mode == "max" else -1.0
    second = F.lit(None).cast("double") if secondary is None else F.nanvl(F.col(secondary).cast("double"), F.lit(None).cast("double"))
    row = F.struct(
        F.col("epoch").cast("int").alias("epoch"),
        (F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")) * F.lit(sign)).alias("value"),
        second.alias("secondary"),
    )
    start = F.expr(
        "named_struct('best_value', cast(null as double), 'best_epoch', -1, 'best_secondary', cast(null as double), "
        "'counter', 0, 'tie_wins', 0, 'stopped', false, 'epochs_ran', 0, 'history', array())"
    ).cast(STATE)
    rows = epochs.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return rows.select(
        *keys,
        F.aggregate("rows", start, lambda acc, r: _merge(acc, r, patience, min_delta, tiebreak, min_epochs, stop_early)).alias("state"),
    ).withColumn("sign", F.lit(sign))


def best_epochs(
    epochs: DataFrame, keys: list[str], value: str = "value", secondary: str | None = "secondary", mode: str = "max",
    patience: int = 10, min_delta: float = 0.0, tiebreak: bool = True, min_epochs: int = 0, stop_early: bool = True,
) -> DataFrame:
    """Per run: the selected epoch (-1 if none), epochs run, why it stopped and whether selection failed."""
    folded = _folded(epochs, keys, value, secondary, mode, patience, min_delta, tiebreak, min_epochs, stop_early)
    s = F.col("state")
    return folded.select(
        *keys,
        s["best_epoch"].alias("best_epoch"),
        (s["best_value"] * F.col("sign")).alias("best_value"),
        s["tie_wins"].alias("tie_wins"),
        s["epochs_ran"].alias("epochs_ran"),
        F.when(s["stopped"], "patience").otherwise("epoch_cap").alias("stop_reason"),
        (s["best_epoch"] < 0).alias("selection_failed"),
    )


def selection_history(
    epochs: DataFrame, keys: list[str], value: str = "value", secondary: str | None = "secondary", mode: str = "max",
    patience: int = 10, min_delta: float = 0.0, tiebreak: bool = True, min_epochs: int = 0, stop_early: bool = True,
) -> DataFrame:
    """Per run and epoch up to the stop: best flag, tie flag, best so far and patience left."""
    folded = _folded(epochs, keys, value, secondary, mode, patience, min_delta, tiebreak, min_epochs, stop_early)
    steps = folded.select(*keys, "sign", F.explode("state.history").alias("h"))
    return steps.select(*keys, "h.epoch", "h.is_best", "h.tie_win", "h.best_epoch", (F.col("h.best_value") * F.col("sign")).alias("best_value"), "h.patience_left")


def epoch_table(epochs: DataFrame, grad_norms: DataFrame, keys: list[str]) -> DataFrame:
    """Epoch rows with their gradient norms where those were logged."""
    return epochs.join(grad_norms, [*keys, "epoch"], "left")
