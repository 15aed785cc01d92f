"""The epoch selector as a streaming query: state per run, the same rule as the batch fold."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, replace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siftmark.operators.selection import TIE_EPS

EPOCH_LOG = "run string, epoch int, value double, secondary double"
OUTPUT = "run string, epoch int, best_epoch int, best_value double, tie_wins int, epochs_ran int, stop_reason string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_epoch_log(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The append-only epoch log as a stream."""
    reader = spark.readStream.schema(EPOCH_LOG)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


@dataclass(frozen=True)
class Progress:
    """What is kept of a run: the epoch that comes next, and the selection so far."""

    next: int = 0
    best_epoch: int = -1
    best_value: float | None = None
    best_secondary: float | None = None
    counter: int = 0
    tie_wins: int = 0
    stopped: bool = False


class EpochSelector(StatefulProcessor):
    """Applies epochs strictly in order; an epoch that arrives early waits in state for its predecessors."""

    def __init__(self, patience: int, min_delta: float = 0.0, tiebreak: bool = True, min_epochs: int = 0) -> None:
        self.patience, self.min_delta, self.tiebreak, self.min_epochs = patience, min_delta, tiebreak, min_epochs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.progress = handle.getValueState(
            "progress", "next int, best_epoch int, best_value double, best_secondary double, counter int, tie_wins int, stopped boolean"
        )
        self.waiting = handle.getMapState("waiting", "epoch int", "value double, secondary double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = Progress(*self.progress.get()) if self.progress.exists() else Progress()
        if state.stopped:  # later epochs of a stopped run are not kept
            return
        for part in rows:
            for row in part.itertuples(index=False):
                if row.epoch >= state.next:
                    self.waiting.updateValue((int(row.epoch),), (_number(row.value), _number(row.secondary)))
        first = state.next
        while not state.stopped and self.waiting.containsKey((state.next,)):
            epoch = (state.next,)
            state = self.step(state, *self.waiting.getValue(epoch))
            self.waiting.removeKey(epoch)
        if state.stopped:
            self.waiting.clear()
        self.progress.update(astuple(state))
        if state.next > first:
            yield pd.DataFrame(
                {
                    "run": [key[0]], "epoch": [state.next - 1], "best_epoch": [state.best_epoch], "best_value": [state.best_value],
                    "tie_wins": [state.tie_wins], "epochs_ran": [state.next], "stop_reason": ["patience" if state.stopped else "epoch_cap"],
                }
            )

    def step(self, state: Progress, value: float | None, secondary: float | None) -> Progress:
        """The progress after one more epoch: a better value wins and resets the patience, a tie with a lower secondary only wins."""
        beats, ties = self.compare(state, value)
        lower = secondary is not None and (state.best_secondary is None or secondary < state.best_secondary - TIE_EPS)
        wins_tie = self.tiebreak and ties and lower
        misses = 0 if beats else state.counter + 1
        done = misses >= self.patience and state.next + 1 >= self.min_epochs
        after = replace(state, next=state.next + 1, counter=misses, tie_wins=state.tie_wins + wins_tie, stopped=done)
        if not (beats or wins_tie):
            return after
        return replace(after, best_epoch=state.next, best_value=value, best_secondary=state.best_secondary if secondary is None else secondary)

    def compare(self, state: Progress, value: float | None) -> tuple[bool, bool]:
        """Whether a value beats the best so far, and whether it ties with it."""
        if value is None:
            return False, False
        if state.best_value is None or value > state.best_value + self.min_delta:
            return True, False
        return False, abs(value - state.best_value) <= TIE_EPS

    def close(self) -> None:
        pass


def _number(value: float) -> float | None:
    return None if value is None or pd.isna(value) else float(value)


def live_selection(epochs: DataFrame, patience: int, min_delta: float = 0.0, tiebreak: bool = True, min_epochs: int = 0) -> DataFrame:
    """A row per run whenever epochs were applied; the last row of a run is its selection so far.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    return epochs.groupBy("run").transformWithStateInPandas(
        statefulProcessor=EpochSelector(patience, min_delta, tiebreak, min_epochs),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="None",
    )
