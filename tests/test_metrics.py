"""Metrics against brute force and hand-computed values; each check has a case that must differ."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftmark.functions import arrays as A
from siftmark.functions import scoring as S
from siftmark.operators import collapse, conformal, metrics, objectives, profile


def frame(spark, labels, scores):
    return spark.createDataFrame([("a", i, int(y), float(s)) for i, (y, s) in enumerate(zip(labels, scores))], "g string, id long, label int, score double")


def brute(y, s):
    y, s = np.array(y), np.array(s, float)
    pos, neg = s[y == 1], s[y == 0]
    out = {"auroc": None, "aupr": None, "youden": 0.0, "f1": 0.0}
    if len(pos) and len(neg):
        out["auroc"] = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
        cuts = sorted(set(s), reverse=True)
        tp = np.array([(pos >= c).sum() for c in cuts])
        fp = np.array([(neg >= c).sum() for c in cuts])
        recall, precision = tp / len(pos), tp / (tp + fp)
        out["aupr"] = float(np.sum(np.diff(np.r_[0, recall]) * precision))
        gap = tp / len(pos) - fp / len(neg)
        out["youden"] = cuts[int(np.argmax(gap))] if gap.max() > 0 else math.inf
        f1 = np.where(tp > 0, 2 * precision * recall / np.maximum(precision + recall, 1e-300), 0)[::-1]
        out["f1"] = cuts[::-1][int(np.argmax(f1))]
    order = np.argsort(-s, kind="stable")
    hits = np.cumsum(y[order])
    out["row_order"] = float(np.sum((hits / np.arange(1, len(y) + 1))[y[order] == 1]) / y.sum()) if y.sum() else None
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(-3, 3)), min_size=1, max_size=25))
def test_rank_metrics_match_brute_force(spark, items):
    y, s = [i[0] for i in items], [i[1] / 2 for i in items]
    df, want = frame(spark, y, s), brute(y, s)
    got = metrics.curve(df, ["g"]).groupBy("g").agg(
        metrics.auroc_of_curve().alias("auroc"), metrics.average_precision_of_curve().alias("aupr"),
        F.coalesce(metrics.youden_of_curve(), F.lit(0.0)).alias("youden"), F.coalesce(metrics.f1_of_curve(), F.lit(0.0)).alias("f1"),
    ).first()
    for name in ("auroc", "aupr", "youden", "f1"):
        assert (got[name] is None) == (want[name] is None)
        if want[name] is not None:
            assert got[name] == pytest.approx(want[name], abs=1e-12)
    row_order = metrics.average_precision_row_order(df, ["g"], "id").first()["aupr_row_order"]
    assert row_order == (None if want["row_order"] is None else pytest.approx(want["row_order"]))


def test_two_average_precisions_differ_under_ties(spark):
    df = frame(spark, [1, 0, 1, 0], [1.0, 1.0, 1.0, 0.0])
    merged = metrics.average_precision(df, ["g"]).first()["aupr"]
    by_row = metrics.average_precision_row_order(df, ["g"], "id").first()["aupr_row_order"]
    assert merged == pytest.approx(2 / 3) and by_row == pytest.approx((1 + 2 / 3) / 2)


def test_threshold_is_inclusive_and_line_exclusive(spark):
    df = frame(spark, [1, 0], [2.0, 1.0]).withColumn("threshold", F.lit(2.0))
    assert metrics.confusion_metrics(df, ["g"]).first()["recall"] == 1.0
    lines = df.select("g").distinct().withColumn("line", F.lit(2.0))
    assert conformal.alarms(df, lines, ["g"]).count() == 0
    assert conformal.alarms(df.withColumn("score", F.col("score") + 0.5), lines, ["g"]).count() == 1


def test_unknown_threshold_strategy_is_an_error(spark):
    with pytest.raises(ValueError):
        metrics.pick_threshold(frame(spark, [1, 0], [1, 0]), ["g"], "median")


def test_calibration_error_bins(spark):
    rng = np.random.default_rng(0)
    s, y = rng.normal(size=200), rng.integers(0, 2, 200)
    df = frame(spark, y, s).withColumn("w", F.lit(4.0))
    edges = np.linspace(0, 1, 16)
    for got, p, right in (
        (metrics.ece_right_closed(df, ["g"]), 1 / (1 + np.exp(-s)), True),
        (metrics.ece_left_closed(df, ["g"], "w"), 1 / (1 + np.exp(-(s - math.log(4)))), False),
    ):
        want = 0.0
        for i in range(15):
            m = ((p > edges[i]) & (p <= edges[i + 1])) if right else ((p >= edges[i]) & (p < edges[i + 1]))
            if m.any():
                want += m.mean() * abs(p[m].mean() - y[m].mean())
        assert got.first()["ece"] == pytest.approx(want)


def scores(spark, val, test, calib=()):
    rows = [("d", "c", 1, "val", f"c/train/good/{i}.png", 0, float(s)) for i, s in enumerate(val)]
    rows += [("d", "c", 1, "calib", f"c/train/good/k{i}.png", 0, float(s)) for i, s in enumerate(calib)]
    rows += [("d", "c", 1, "test", f"c/test/{'defect' if y else 'good'}/{i}.png", y, float(s)) for i, (y, s) in enumerate(test)]
    return spark.createDataFrame(rows, "dataset string, category string, seed int, split string, path string, label int, score double")


KEYS = ["dataset", "category", "seed"]


def test_one_planted_alarm(spark):
    val = np.linspace(-3, -1, 20)
    clean = [(0, -2.0), (0, -2.5), (0, -1.5), (0, -1.2), (0, -3.0), (1, 0.5)]
    for planted, want in ((clean, 0), ([(0, 2.0), *clean[1:]], 1)):
        df = scores(spark, val, planted)
        lines = conformal.conformal_lines(df, KEYS)
        assert conformal.alarms(df.where("split = 'test' and label = 0"), lines, KEYS).count() == want


def test_line_needs_nineteen_normals(spark):
    enough = conformal.conformal_lines(scores(spark, range(19), [(0, 1), (1, 2)]), KEYS).first()
    few = conformal.operating_points(scores(spark, range(12), [(0, 1), (1, 2)]), KEYS).first()
    assert enough["line"] == 18.0
    assert few["line"] is None and few["false_alarms"] is None and few["recall"] is None and few["auroc"] == 1.0


def test_calibration_normals_replace_validation_normals(spark):
    got = conformal.conformal_lines(scores(spark, range(40), [(0, 1), (1, 2)], calib=range(100, 130)), KEYS).first()
    assert got["threshold_split"] == "calib" and got["line"] == 129.0


def test_headline_skips_undefined_seeds(spark):
    a = scores(spark, range(20), [(0, 100.0), (1, 200.0)])
    b = scores(spark, range(12), [(0, 1.0), (1, 2.0)]).withColumn("seed", F.lit(2))
    got = conformal.headline(conformal.operating_points(a.unionByName(b), KEYS)).first()
    assert got["false_alarms"] == 1.0 and got["categories_with_line"] == 1


def test_like_for_like_drops_only_foreign_normals(spark):
    df = scores(spark, [0.0], [(0, 1.0), (1, 2.0)])
    foreign = df.where("split = 'test' and label = 0").withColumn("path", F.lit("c/train/good/9.png"))
    both = df.unionByName(foreign)
    assert conformal.like_for_like(both, ["d"]).count() == df.count()
    assert conformal.like_for_like(both, ["other"]).count() == both.count()


def test_tail_margin_hand_values(spark):
    labels = [1, 0, 0, 0, 0]

    def value(scored, marks=labels):
        return objectives.tail_margin(frame(spark, marks, scored), ["g"], beta=0.25).first()["tail_margin"]

    assert value([2, -1, -2, 1.5, -3]) == pytest.approx(0.25)
    assert value([5, -1, -2, 1.5, -3]) == 0.0
    assert value([2, -1, -2, 1.5, -3], [0] * 5) == 0.0


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(-4, 4)), min_size=2, max_size=20), st.sampled_from([0.1, 0.5, 1.0]))
def test_tail_margin_equals_all_pairs(spark, items, beta):
    y, s = np.array([i[0] for i in items]), np.array([i[1] / 2 for i in items])
    pos, neg = s[y == 1], np.sort(s[y == 0])[::-1]
    want = 0.0
    if len(pos) and len(neg):
        hard = neg[: max(1, math.ceil(beta * len(neg)))]
        want = np.mean([max(0.0, 1 - (p - n)) ** 2 for p in pos for n in hard])
    got = objectives.tail_margin(frame(spark, y, s), ["g"], beta=beta).first()["tail_margin"]
    assert got == pytest.approx(want, abs=1e-9)


def test_view_and_session_terms(spark):
    views = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [-1.0, -1.0]), ("a", [0.5, 1.5])], "g string, views array<double>")
    assert objectives.view_disagreement(views, ["g"], "views", 1).first()["disagreement"] == pytest.approx(2 / 3)
    rows = [("g", 0, [1.0, 0.0], False), ("g", 0, [1.0, 0.0], False), ("g", 0, [0.0, 1.0], True), ("g", 1, [5.0, 5.0], True)]
    df = spark.createDataFrame(rows, "g string, label int, f array<double>, test boolean")
    got = objectives.session_alignment(df, ["g"], "f", F.col("test")).first()
    assert got["alignment"] == pytest.approx(2.0) and got["n_aligned"] == 1


def test_pooling_values(spark):
    df = spark.createDataFrame([([float(i) for i in range(81)],)], "x array<double>")
    x = F.col("x")
    row = df.select(
        A.top_fraction_mean(x, 0.1).alias("top"), A.top_fraction_mean(x, 1.0).alias("all"), A.pool("avg", x).alias("avg"),
        A.pool("lse", x, 50.0).alias("lse"), A.pool("gem", x, 1.0).alias("gem"), A.norm(A.unit(x)).alias("one"),
    ).first()
    assert row["top"] == pytest.approx(np.mean(range(72, 81))) and row["all"] == pytest.approx(40.0) == row["avg"]
    assert row["lse"] == pytest.approx(80 - math.log(81) / 50) and row["gem"] == pytest.approx(40.0) and row["one"] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        A.pool("median", x)


def test_pooling_from_sql(spark):
    A.register_sql_functions(spark)
    row = spark.sql("select pool_avg(array(1D, 2D, 6D)) a, pool_max(array(1D, 2D, 6D)) m").first()
    assert (row["a"], row["m"]) == (3.0, 6.0)


def test_class_weight_values(spark):
    def weight(neg, pos, **kw):
        return profile.class_weight(spark.createDataFrame([(neg, pos)], "neg long, pos long"), **kw).first()["pos_weight"]

    assert weight(166, 6) == pytest.approx(166 / 172) and weight(166, 6, mode="neg_over_pos") == pytest.approx(166 / 6)
    assert weight(221, 10, mode="neg_over_pos") == pytest.approx(22.1)
    assert weight(221, 10, mode="neg_over_pos", cap=10.0) == 10
    assert weight(221, 10, mode="neg_over_pos", cap=20.0, multiplier=0.5) == pytest.approx(11.05)
    assert weight(221, 10, cap=10.0) == pytest.approx(221 / 231)
    assert weight(221, 0) is None and weight(5, 5, enabled=False) is None and weight(5, 5, oversampling=True) is None
    assert weight(5, 5, oversampling=True, allow_both=True) == 0.5
    assert weight(30, 10, mode="neg_over_pos", rich=F.lit(False)) == 0.75
    with pytest.raises(ValueError):
        weight(1, 1, mode="balanced")


def test_prior_correction_shifts_and_keeps_order(spark):
    df = spark.createDataFrame([(2.0,), (-1.0,), (0.5,), (-3.0,)], "x double")
    got = [r[0] for r in df.select(S.prior_corrected(F.col("x"), 16.0)).collect()]
    assert got == pytest.approx([v - math.log(16) for v in (2.0, -1.0, 0.5, -3.0)])
    assert [r[0] for r in df.select(S.prior_corrected(F.col("x"), None)).collect()] == [2.0, -1.0, 0.5, -3.0]


def test_multiplier_floor_and_cap(spark):
    df = spark.createDataFrame([(0,), (3,), (7,), (100,), (None,)], "n long")
    assert [r[0] for r in df.select(profile.multiplier(F.col("n"), 30)).collect()] == [1, 10, 5, 1, 1]


def epochs(spark, gaps, std=1.0):
    rows = [("r", e, s) for e, s in enumerate(gaps)]
    df = spark.createDataFrame(rows, "run string, epoch int, gap double")
    return df.select("run", "epoch", "gap", F.lit(std).alias("normal_std"), F.lit(std).alias("anomaly_std"))


def test_collapse_reasons(spark):
    def judge(gaps, best, std=1.0):
        chosen = spark.createDataFrame([("r", best)], "run string, best_epoch int")
        return collapse.detect_collapse(epochs(spark, gaps, std), ["run"], chosen).first()

    assert judge([1.0, 2.0, 3.0, 4.0, 5.0], 4)["collapsed"] is False
    assert "selected gap" in judge([1.0, 2.0, 0.01, 4.0, 5.0], 2)["triggered"]
    assert "sign" in judge([1.0, -2.0, 3.0, -4.0, 5.0], 4)["triggered"]
    assert "spread" in judge([1.0, 1.0, 1.0], 1, std=10.0)["triggered"]
    assert "median" in judge([0.01, 0.02, 0.03], 9)["triggered"]
    assert judge([None, None], 0)["collapsed"] is None


def test_histogram_with_equal_scores_uses_the_last_bin(spark):
    got = collapse.class_histogram(frame(spark, [0, 1, 1], [2.0, 2.0, 2.0]), ["g"]).toPandas().sort_values("bin")
    assert len(got) == 30 and got.iloc[29][["normal", "anomaly"]].tolist() == [1, 2] and got.normal.sum() == 1


def test_metrics_of_every_split_use_the_validation_threshold(spark):
    rng = np.random.default_rng(4)
    data = [("a" if i % 3 else "b", ("val", "test")[i % 2] if i % 3 else "test", int(rng.random() < 0.4), float(np.round(rng.normal(), 1))) for i in range(300)]
    df = spark.createDataFrame(data, "g string, split string, label int, score double")
    got = {(r["g"], r["split"]): r for r in metrics.metric_set_by_split(df, ["g"]).collect()}
    assert set(got) == {("a", "val"), ("a", "test"), ("b", "test")}
    chosen = metrics.pick_threshold(df.where("split = 'val'"), ["g"])
    for split in ("val", "test"):
        want = metrics.metric_set(df.where(F.col("split") == split).where("g = 'a'"), ["g"], chosen).first()
        assert all(got["a", split][m] == pytest.approx(want[m]) for m in ("threshold", *metrics.METRIC_NAMES))
    alone = got["b", "test"]
    assert alone["threshold"] is None and alone["f1"] is None and alone["auroc"] is not None and alone["loss"] > 0


def test_every_pool_from_sql_equals_its_column_form(spark):
    assert A.register_sql_functions(spark) == sorted(f"pool_{name}" for name in A.POOLS)
    df = spark.createDataFrame([([0.5, -2.0, 3.0],), ([1000.0, 999.0],), ([4.0],)], "x array<double>")
    x = F.col("x")
    columns = {"avg": A.pool("avg", x), "max": A.pool("max", x), "avgmax": A.pool("avgmax", x), "gem": A.pool("gem", x), "lse": A.pool("lse", x), "attention": A.pool("attention", x, x)}
    both = df.select("*", *[c.alias(n) for n, c in columns.items()], *[
        F.expr(f"pool_{n}(x{', x' if n == 'attention' else ''})").alias(f"sql_{n}") for n in columns
    ])
    for row in both.collect():
        for name in columns:
            assert row[f"sql_{name}"] == pytest.approx(row[name])
