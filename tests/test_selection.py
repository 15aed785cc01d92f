"""The epoch selector, in batch and as a stream."""

import json
import math

import pandas as pd
import pytest

from siftmark.operators import selection
from siftmark.streaming import alarms, epochs


def run(spark, values, secondary=None, **kw):
    secondary = secondary or [None] * len(values)
    rows = [("r", e, v, s) for e, (v, s) in enumerate(zip(values, secondary))]
    df = spark.createDataFrame(rows, "run string, epoch int, value double, secondary double")
    return selection.best_epochs(df, ["run"], **kw).first()


def test_late_epoch_wins_a_tie_on_lower_secondary(spark):
    got = run(spark, [0.5, 1.0, 1.0, 1.0], [0.9, 0.5, 0.4, 0.6])
    assert (got["best_epoch"], got["tie_wins"]) == (2, 1)
    assert run(spark, [0.5, 1.0, 1.0, 1.0], [0.9, 0.5, 0.4, 0.6], tiebreak=False)["best_epoch"] == 1


def test_tie_win_does_not_reset_patience(spark):
    got = run(spark, [1.0] * 10, [1.0 - e / 100 for e in range(10)], patience=3)
    assert (got["best_epoch"], got["epochs_ran"], got["stop_reason"]) == (3, 4, "patience")


def test_nan_never_wins(spark):
    got = run(spark, [math.nan, 0.4, math.nan, 0.3])
    assert got["best_epoch"] == 1 and not got["selection_failed"]
    assert run(spark, [math.nan, None])["selection_failed"]


def test_minimum_epochs_delay_the_stop(spark):
    flat = [0.5] + [0.1] * 7
    assert run(spark, flat, patience=1)["epochs_ran"] == 2
    assert run(spark, flat, patience=1, min_epochs=5)["epochs_ran"] == 5
    assert run(spark, flat, patience=1, stop_early=False)["stop_reason"] == "epoch_cap"


def test_min_mode_and_min_delta(spark):
    got = run(spark, [3.0, 2.0, 1.95, 1.0], mode="min", min_delta=0.1)
    assert (got["best_epoch"], got["best_value"]) == (3, 1.0)
    assert run(spark, [3.0, 2.0, 1.95], mode="min", min_delta=0.1)["best_epoch"] == 1
    with pytest.raises(ValueError):
        run(spark, [1.0], mode="median")


def test_history_marks_each_epoch(spark):
    rows = [("r", e, v, s) for e, (v, s) in enumerate([(0.5, 0.3), (0.4, 0.3), (0.5, 0.2)])]
    df = spark.createDataFrame(rows, "run string, epoch int, value double, secondary double")
    got = [tuple(r) for r in selection.selection_history(df, ["run"], patience=4).orderBy("epoch").select("is_best", "tie_win", "best_epoch", "patience_left").collect()]
    assert got == [(True, False, 0, 4), (False, False, 0, 3), (True, True, 2, 2)]


def test_stream_with_late_epochs_agrees_with_the_batch_fold(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    trajectories = {"a": [0.1, 0.6, 0.6, 0.2, 0.3, 0.9], "b": [0.5, None, 0.4, 0.3, 0.2, 0.1], "c": [0.2, 0.3, 0.4, 0.5, 0.6, 0.7]}
    rows = [{"run": r, "epoch": e, "value": v, "secondary": 1.0 - e / 10} for r, vs in trajectories.items() for e, v in enumerate(vs)]
    # Later files hold earlier epochs: each must wait for its predecessors.
    for i, part in enumerate((rows[3::4], rows[1::4], rows[0::4], rows[2::4])):
        (log / f"{i}.json").write_text("\n".join(json.dumps(r) for r in part))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", epochs.ROCKSDB)
    stream = epochs.live_selection(epochs.read_epoch_log(spark, str(log), files_per_batch=1), patience=3)
    alarms.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    found = spark.read.schema(epochs.OUTPUT).parquet(str(tmp_path / "out")).toPandas()
    last = found.sort_values("epochs_ran").groupby("run").last()
    batch = selection.best_epochs(spark.createDataFrame([tuple(r.values()) for r in rows], epochs.EPOCH_LOG), ["run"], patience=3).toPandas().set_index("run")
    for name in ("best_epoch", "tie_wins", "epochs_ran", "stop_reason"):
        assert last[name].to_dict() == batch[name].to_dict()
    assert batch.loc["b", "stop_reason"] == "patience"


def test_a_stopped_run_keeps_no_epochs():
    class Values:
        def __init__(self):
            self.now = None

        def exists(self):
            return self.now is not None

        def get(self):
            return self.now

        def update(self, now):
            self.now = now

    class Waiting(dict):
        def updateValue(self, key, value):
            self[key] = value

        def containsKey(self, key):
            return key in self

        def getValue(self, key):
            return self[key]

        def removeKey(self, key):
            del self[key]

    selector = epochs.EpochSelector(patience=1)
    selector.progress, selector.waiting = Values(), Waiting()

    def feed(*numbers):
        part = pd.DataFrame({"run": "r", "epoch": numbers, "value": [1.0 - n / 10 for n in numbers], "secondary": 0.0})
        return list(selector.handleInputRows(("r",), iter([part]), None))

    assert not feed(5, 6, 1) and len(selector.waiting) == 3
    assert feed(0)[0]["stop_reason"].tolist() == ["patience"] and not selector.waiting
    assert not feed(2, 7) and not selector.waiting
