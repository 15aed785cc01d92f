"""Bootstrap weights: exact sizes, an even spread, and metrics that equal those of the written-out resample."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmark.operators import resample, weights


@pytest.fixture(scope="module")
def scored(spark):
    """A group of 3,000 rows of which a third share one score, and a small one."""
    rng = np.random.default_rng(5)
    rows = []
    for name, n in (("hot", 3000), ("small", 7)):
        for i in range(n):
            label = int(i % 5 == 0)
            score = 0.5 if i % 3 == 0 else float(round(rng.normal() + 0.4 * label, 2))
            rows.append((name, f"{name}/{i}", label, score, score + label * 0.2))
    return spark.createDataFrame(rows, "category string, path string, label bigint, score double, other double").cache()


@pytest.fixture(scope="module")
def drawn(scored):
    return resample.multiplicities(scored, ["category"], 30).toPandas()


def expected(y, s, metric):
    if metric == "auroc":
        pos, neg = s[y == 1], np.sort(s[y == 0])
        below, upto = np.searchsorted(neg, pos, "left"), np.searchsorted(neg, pos, "right")
        return (below + upto).sum() / 2 / (len(pos) * len(neg))
    order = np.lexsort((-y, -s))
    hits = np.cumsum(y[order])
    return (hits / np.arange(1, len(y) + 1))[y[order] == 1].sum() / y.sum()


def test_sizes_are_exact_and_draws_even(drawn):
    sizes = drawn.groupby(["category", "label", "replicate"]).times.sum()
    assert (sizes["hot"][1] == 600).all() and (sizes["hot"][0] == 2400).all()
    assert (sizes["small"][1] == 2).all() and (sizes["small"][0] == 5).all() and len(sizes) == 120
    hot = drawn[drawn.category == "hot"]
    assert hot.groupby("replicate").path.nunique().mean() / 3000 == pytest.approx(1 - np.exp(-1), abs=0.01)
    times = hot.pivot_table(index="path", columns="replicate", values="times", fill_value=0).reindex(columns=range(30)).fillna(0).to_numpy()
    missed = 3000 - len(times)
    assert missed <= 1
    assert times.var() == pytest.approx(1.0, abs=0.05)
    correlation = np.corrcoef(times.T)
    assert np.abs(correlation[~np.eye(30, dtype=bool)]).max() < 0.1


@pytest.mark.parametrize("metric", ["auroc", "aupr"])
def test_metrics_equal_the_written_out_resample(scored, drawn, metric):
    got = resample.replicate_metric(scored, ["category"], {"a": "score", "b": "other"}, metric, 30).toPandas()
    assert len(got) == 120
    for row in got.itertuples():
        d = drawn[(drawn.category == row.category) & (drawn.replicate == row.replicate)]
        y = np.repeat(d.label, d.times).to_numpy()
        s = np.repeat(d.score if row.arm == "a" else d.other, d.times).to_numpy()
        assert row.value == pytest.approx(expected(y, s, metric), rel=1e-12)


def test_ranges_do_not_change_the_result(spark, scored):
    def values():
        got = resample.replicate_metric(scored, ["category"], {"a": "score"}, "auroc", 5).toPandas()
        return got.sort_values(["category", "replicate"]).value.to_numpy()

    eight = values()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert np.array_equal(eight, values())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_one_class_and_missing_scores(scored):
    one = scored.where("category = 'small' and label = 0")
    assert resample.replicate_metric(one, ["category"], {"a": "score"}, "auroc", 3).where("value is not null").count() == 0
    lowest = scored.where("category = 'small'").withColumn("score", F.when(F.col("label") == 1, F.col("score")))
    assert {r["value"] for r in resample.replicate_metric(lowest, [], {"a": "score"}, "auroc", 3).collect()} == {1.0}


def test_thresholds():
    assert len(weights.thresholds(64)) == 0
    million = weights.thresholds(10**6).astype(float) / 2**32
    assert million[0] == pytest.approx(np.exp(-0.992), abs=1e-9) and (np.diff(million) > 0).all()
