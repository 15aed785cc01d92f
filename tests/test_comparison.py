"""Resampling and run comparison."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siftmark.operators import compare, probes, reliability, resample, timing


@pytest.fixture(scope="module")
def run_a(spark):
    rng = np.random.default_rng(3)
    rows = [(c, f"{c}/{i}", int(i < 12), float(round(rng.normal() + (i < 12) * 0.7, 1))) for c in ("x", "y") for i in range(50)]
    return spark.createDataFrame(rows, "category string, path string, label int, score double").cache()


@pytest.mark.parametrize("metric", ["auroc", "aupr"])
def test_a_run_against_itself_gives_zero(run_a, metric):
    numbered = run_a.withColumn("place", F.substring_index("path", "/", -1).cast("long"))
    for row in resample.paired_bootstrap(numbered, numbered, ["category"], metric, n_boot=30, position="place").collect():
        assert (row["delta"], row["lo"], row["hi"], row["p_improve"], row["resolved"]) == (0.0, 0.0, 0.0, 0.0, False)


def test_point_of_average_precision_is_in_row_order(run_a):
    rows = run_a.withColumn("place", F.substring_index("path", "/", -1).cast("long"))
    with pytest.raises(ValueError):
        resample.bootstrap_interval(run_a, ["category"], "aupr", n_boot=2)
    local = rows.toPandas()
    for row in resample.bootstrap_interval(rows, ["category"], "aupr", n_boot=5, position="place").collect():
        d = local[local.category == row["category"]].sort_values(["score", "place"], ascending=[False, True])
        hits = d.label.cumsum()
        assert row["point"] == pytest.approx((hits / np.arange(1, len(d) + 1))[d.label == 1].sum() / d.label.sum())


def test_harmonic_gap(spark):
    from siftmark.operators.metrics import harmonic_gap

    for n, more in ((0, 1), (0, 50), (3, 4), (100, 1), (10**6, 3)):
        got = spark.range(1).select(harmonic_gap(F.lit(n), F.lit(more))).first()[0]
        assert got == pytest.approx(math.fsum(1 / (n + i) for i in range(1, more + 1)), rel=1e-11)


def test_a_planted_shift_resolves_upward(run_a):
    better = run_a.withColumn("score", F.col("score") + F.col("label") * 3.0)
    for row in resample.paired_bootstrap(run_a, better, ["category"], n_boot=60).collect():
        assert row["resolved"] and row["lo"] > 0 and row["p_improve"] == 1.0


def test_different_test_sets_are_not_scored(run_a):
    other = run_a.withColumn("label", F.when(F.col("path") == "x/0", 0).otherwise(F.col("label")))
    got = {r["category"]: r for r in resample.paired_bootstrap(run_a, other, ["category"], n_boot=5).collect()}
    assert got["x"]["note"] == "test splits differ" and got["x"]["delta"] is None and got["y"]["note"] is None


def test_resamples_keep_class_sizes(run_a):
    drawn = resample.multiplicities(run_a, ["category"], 20)
    sizes = drawn.groupBy("category", "replicate", "label").agg(F.sum("times").alias("n")).toPandas()
    assert (sizes[sizes.label == 1].n == 12).all() and (sizes[sizes.label == 0].n == 38).all() and len(sizes) == 80


@pytest.mark.parametrize("metric", ["auroc", "aupr"])
def test_weighted_metric_equals_the_expanded_resample(run_a, metric):
    values = resample.replicate_metric(run_a, ["category"], {"a": "score"}, metric, 4).toPandas()
    drawn = resample.multiplicities(run_a, ["category"], 4).toPandas()
    for row in values.itertuples():
        d = drawn[(drawn.category == row.category) & (drawn.replicate == row.replicate)]
        y, s = np.repeat(d.label, d.times).to_numpy(), np.repeat(d.score, d.times).to_numpy()
        if metric == "auroc":
            pos, neg = s[y == 1], s[y == 0]
            want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
        else:
            order = np.lexsort((-y, -s))
            hits = np.cumsum(y[order])
            want = (hits / np.arange(1, len(y) + 1))[y[order] == 1].sum() / y.sum()
        assert row.value == pytest.approx(want)


def test_single_class_group_is_noted(run_a):
    got = resample.bootstrap_interval(run_a.where("category = 'x' or label = 0"), ["category"], n_boot=5)
    rows = {r["category"]: r for r in got.collect()}
    assert rows["y"]["note"] and rows["y"]["point"] is None and rows["x"]["lo"] <= rows["x"]["hi"]


def test_interval_aggregates(spark):
    values = [0.1, 0.4, 0.2, 0.9, 0.5, 0.3, 0.8]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    low, high = resample.percentile_interval("v", 0.1)
    row = df.agg(resample.interquartile_mean("v").alias("iqm"), low.alias("lo"), high.alias("hi")).first()
    core = sorted(values)[int(7 * 0.25): math.ceil(7 * 0.75)]
    assert row["iqm"] == pytest.approx(np.mean(core)) and row["lo"] == pytest.approx(np.percentile(values, 5)) and row["hi"] == pytest.approx(np.percentile(values, 95))


def test_noise_band_of_one_seed_is_undefined(spark):
    df = spark.createDataFrame([("a", 0.9), ("a", 0.8), ("a", None), ("b", 0.7)], "run string, value double")
    got = {r["run"]: r for r in resample.noise_band(df, ["run"]).collect()}
    assert got["a"]["n"] == 2 and got["a"]["std"] == pytest.approx(np.std([0.9, 0.8], ddof=1)) and got["b"]["std"] is None and got["b"]["range"] is None


def test_delta_verdicts(spark):
    rows = [(0.1, 0.01, 3, 0.01, 3), (0.001, 0.01, 3, 0.01, 3), (0.1, None, 1, 0.01, 3), (0.1, 0.0, 3, 0.0, 3), (0.1, 0.01, None, None, None)]
    df = spark.createDataFrame(rows, "d double, a double, na int, b double, nb int")
    got = [r[0] for r in df.select(resample.delta_verdict(*[F.col(c) for c in ("d", "a", "na", "b", "nb")])).collect()]
    assert got == ["REAL", "NOT DISTINGUISHABLE", "NO BAND (fewer than 2 seeds)", "NO BAND (zero spread)", "REAL (raw deviation)"]


def test_rerun_check_catches_a_thousandth(spark):
    rows = [("c", f"{i}", i % 2, [float(i), 1.0, 2.0, 3.0]) for i in range(10)]
    old = spark.createDataFrame(rows, "category string, path string, label int, views array<double>")
    assert compare.rerun_compare(old, old, ["category"]).first()["passed"]
    moved = old.withColumn("views", F.when(F.col("path") == "3", F.transform("views", lambda v: v + 1e-3)).otherwise(F.col("views")))
    got = compare.rerun_compare(moved, old, ["category"], 1e-4).first()
    assert not got["passed"] and got["same_files"] and got["max_abs_diff"] == pytest.approx(1e-3)
    assert not compare.rerun_compare(old.where("path <> '3'"), old, ["category"], 1.0).first()["same_files"]


def test_missing_equals_missing(spark):
    a = spark.createDataFrame([("k", None, 1.0)], "k string, m double, n double")
    b = spark.createDataFrame([("k", None, 1.2)], "k string, m double, n double")
    got = {r["metric"]: r["passed"] for r in compare.metric_compare(a, b, ["k"], ["m", "n"], 0.1).collect()}
    assert got == {"m": True, "n": False}


def test_strict_settings_comparison_fails(spark):
    registry = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "a", "x")], "run int, key string, value string")
    for other, ok in ((2, False), (3, True)):
        pairs = spark.createDataFrame([(1, other)], "run_a int, run_b int")
        diff = compare.settings_diff(registry, pairs)
        assert compare.comparable_pairs(pairs, diff).first()["comparable"] is ok
        if not ok:
            with pytest.raises(PySparkException, match="differ in settings"):
                compare.comparable_pairs(pairs, diff, strict=True).collect()


def test_tiers(spark):
    df = spark.createDataFrame([("a", 0.4, True), ("b", 0.6, False)], "dataset string, auroc double, single_class_train boolean")
    tiers = {"a": "native", "b": "injected"}
    tiered = df.withColumn("tier", reliability.dataset_tier(F.col("dataset"), tiers))
    assert {r["tier"] for r in tiered.collect()} == {"native", "injected"}
    with pytest.raises(PySparkException, match="refusing"):
        reliability.single_tier_mean(tiered, "auroc").collect()
    assert reliability.single_tier_mean(tiered.where("dataset = 'a'"), "auroc").first()[0] == 0.4
    with pytest.raises(PySparkException, match="without a reliability tier"):
        df.select(reliability.dataset_tier(F.col("dataset"), {"a": "native"})).collect()
    listed = tiered.withColumn("inverted", reliability.inverted(F.col("auroc"))).withColumn("c", reliability.caveats(["inverted", "single_class_train"]))
    got = listed.select("dataset", "c", reliability.reportable(F.col("c"), F.lit(None).cast("boolean"), F.lit(False)).alias("ok")).orderBy("dataset").collect()
    assert got[0]["c"] == ["inverted", "single_class_train"] and not got[0]["ok"] and got[1]["c"] == [] and got[1]["ok"]


def test_probe_finds_a_cue_and_the_control_does_not(spark):
    rng = np.random.default_rng(2)
    rows = [("c", i, i % 2, (rng.normal(size=5) + (i % 2) * 1.5).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "category string, id long, label int, f array<double>")
    x, y = np.array([r[3] for r in rows]), np.array([r[2] for r in rows])
    z = (x - x.mean(0)) / (x.std(0) + 1e-9)
    out = []
    for i in range(len(y)):
        others = np.arange(len(y)) != i
        m1, m0 = z[others & (y == 1)].mean(0), z[others & (y == 0)].mean(0)
        out.append(np.linalg.norm(z[i] - m0) - np.linalg.norm(z[i] - m1))
    out = np.array(out)
    want = (out[y == 1][:, None] > out[y == 0]).mean()
    found = probes.permutation_test(df, ["category"], "id", "f", n_perm=19).first()
    assert found["probe_auroc"] == pytest.approx(want) and found["p_high"] == pytest.approx(1 / 20)
    control = probes.negative_control(df, ["category"], "id", "f").first()
    assert abs(control["auroc"] - 0.5) < abs(want - 0.5)


def test_timing_rules(spark):
    df = spark.createDataFrame([("ours:a+full[x2]", 2.0, True), ("ours:a+full", 3.0, True), ("rival+full", 9.0, False), ("rival", 1.0, False), ("ours:a", 1.0, False)], "model string, ms double, legacy boolean")
    ok = df.withColumn("status", F.lit("ok"))
    best = timing.best_times(ok, timing.model_key(F.col("model")), timing.corrected_ms(F.col("model"), F.col("ms"), F.col("legacy")))
    assert {r["key"]: r["best_ms"] for r in best.collect()} == {"ours two views": 4.0, "ours one view": 3.0, "rival": 9.0}
    assert timing.order_verdict(best, ["ours two views", "rival"]).first()["in_order"]
    assert not timing.order_verdict(best, ["rival", "ours two views"]).first()["in_order"]
    slower = best.withColumn("best_ms", F.col("best_ms") * 1.2)
    assert not timing.time_verdict(slower, best).where("passed").count() and timing.time_verdict(best, best).where("not passed").count() == 0
    values = [5.0, 1.0, 4.0, 2.0, 3.0, 9.0]
    stages = spark.createDataFrame([("s", v) for v in values], "stage string, ms double")
    got = timing.stage_quantiles(stages, ["stage"], "ms").first()
    assert got["median"] == 3.5 and got["high"] == sorted(values)[int(0.9 * 5)]


def test_caveat_line(spark):
    df = spark.createDataFrame([(["no_val", "severe_imbalance"],), ([],), (["odd"],)], "c array<string>")
    got = [r[0] for r in df.select(reliability.caveat_line(F.col("c"))).collect()]
    assert got == ["no validation split (selection would fall back to test); severe class imbalance in train", "", "odd"]
    assert list(reliability.CAVEAT_TEXT) == reliability.CAVEATS
