"""Results do not depend on how groups are cut, with a third of all rows in one group."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftmark.functions.draws import hash_slot, order_key
from siftmark.operators import blocks, conformal, metrics, objectives, ranking, records


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    groups = ["hot"] * 1200 + [f"g{i % 40}" for i in range(2400)]
    data = [
        (g, i, f"{g}/{i}", int(rng.random() < 0.3), round(rng.gauss(0, 1), 1) if rng.random() < 0.9 else 0.0, rng.choice(["val", "calib", "test"]))
        for i, g in enumerate(groups)
    ]
    return spark.createDataFrame(data, "g string, id long, path string, label int, score double, split string").cache()


def same(a, b):
    left, right = (df.toPandas() for df in (a, b))
    columns = sorted(left.columns)
    assert columns == sorted(right.columns)
    left, right = (p[columns].sort_values(columns).reset_index(drop=True) for p in (left, right))
    pd.testing.assert_frame_equal(left, right, check_exact=False, rtol=1e-12, check_dtype=False)


@pytest.mark.parametrize("buckets", [2, 7, 64])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_equal_a_plain_window(rows, buckets, descending):
    counted = ranking.tally(rows, ["g"], "score", {"n": F.lit(1), "pos": F.col("label")})
    got = ranking.running_totals(counted, ["g"], "score", ["n", "pos"], descending=descending, buckets=buckets)
    order = F.col("score").desc() if descending else F.col("score").asc()
    window = Window.partitionBy("g").orderBy(order)
    want = counted.select(
        "*",
        F.sum("n").over(window).alias("n_cum"),
        F.sum("pos").over(window).alias("pos_cum"),
        F.sum("n").over(Window.partitionBy("g")).alias("n_total"),
        F.sum("pos").over(Window.partitionBy("g")).alias("pos_total"),
    )
    same(got, want)


def test_buckets_split_the_hot_group(rows):
    distinct = rows.select("g", "id").withColumn("x", F.col("id").cast("double"))
    parts = ranking.range_bucketed(distinct, distinct, "x", 16)
    sizes = parts.where("g = 'hot'").groupBy("_bucket").count().toPandas()["count"]
    assert sizes.max() <= 3600 / 16 * 1.5
    assert parts.groupBy("_bucket").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).toPandas().sort_values("_bucket").lo.is_monotonic_increasing


METRICS = {
    "auroc": lambda r: metrics.auroc(r, ["g"]),
    "aupr": lambda r: metrics.average_precision(r, ["g"]),
    "row_order": lambda r: metrics.average_precision_row_order(r, ["g"], "id"),
    "youden": lambda r: metrics.pick_threshold(r, ["g"], "youden"),
    "f1": lambda r: metrics.pick_threshold(r, ["g"], "f1"),
    "points": lambda r: conformal.operating_points(r, ["g"]),
    "tail": lambda r: objectives.tail_margin(r, ["g"]),
    "quantiles": lambda r: ranking.quantiles(r, ["g"], "score", {"q1": 0.1, "q5": 0.5, "q9": 0.95}),
    "hold_out": lambda r: records.hold_out(_as_records(r), 0.2),
    "stratified": lambda r: records.stratified_split(_as_records(r), 0.3),
    "cap": lambda r: records.cap_preserving_classes(_as_records(r), ["category"], 25),
    "folds": lambda r: records.fold_assignment(_as_records(r), ["category"], "path", "label", 5, 2),
    "positions": lambda r: ranking.hash_positions(r.withColumn("k", order_key("p", "path")), ["g"], "k"),
}


def _as_records(r):
    return r.select("path", F.col("g").alias("category"), "label", F.lit("train").alias("split"))


@pytest.mark.parametrize("name", METRICS)
def test_results_do_not_depend_on_the_number_of_parts(rows, spark, name):
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in ("1", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found.append(METRICS[name](rows).toPandas())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    same(*[spark.createDataFrame(f) for f in found])


def test_groups_are_cut_at_any_size(rows):
    plan = metrics.auroc(rows, ["g"])._jdf.queryExecution().toString()
    assert "_bucket" in plan and "percentile_approx" in plan


def test_draws_beyond_32_bits(spark):
    slots = spark.range(2000).select(hash_slot("t", F.col("id").cast("string"), F.lit(10**10)).alias("pos")).toPandas()["pos"]
    assert slots.max() > 2**32 and 0 <= slots.min() and 0.45 < (slots < 5 * 10**9).mean() < 0.55


def test_repeated_keys_at_a_cut_are_an_error(spark):
    paths = spark.createDataFrame([("g", p) for p in "aabbccdd"], "g string, k string")
    with pytest.raises(Exception, match="repeat at a cut"):
        ranking.hash_cuts(paths, ["g"], "k", {"few": F.lit(1)}).collect()
    even = ranking.hash_cuts(paths, ["g"], "k", {"few": F.lit(2)})
    assert paths.join(even, "g").where(ranking.taken("k", "few")).count() == 2


def test_one_pass_split_equals_the_steps(spark):
    paths = [(f"{c}/{i}", c, "good" if i % 5 else f"t{i % 3}", int(i % 5 == 0), "test" if i % 5 == 0 else "train") for c in "ab" for i in range(400)]
    base = spark.createDataFrame(paths, "path string, category string, type string, label int, split string")
    cuts = records.injection_cuts(base.where("split = 'test' and label = 1"), 0.3)
    steps = records.calibrate(records.hold_out(records.inject(base, cuts), 0.1), count=40, min_train=50)
    same(records.split_in_one_pass(base, cuts, 0.1, records.calibration_size(count=40, min_train=50)), steps)
    takes = lambda types: records.injection_takes(types, 0.3)
    same(records.split_by_counts(base, takes, 0.1, records.calibration_size(count=40, min_train=50)), steps)
    uncut = records.inject(base, cuts)
    same(records.split_by_counts(base, takes, 0.0, records.calibration_size()), uncut)
    same(records.split_by_counts(base, takes, 1.0, records.calibration_size(count=40, min_train=50)), records.hold_out(uncut, 1.0))
    same(records.split_by_counts(base, takes, 0.0, records.calibration_size(fraction=1.0)), records.calibrate(uncut, fraction=1.0))


def test_split_by_counts_reads_the_inventory_four_times(spark):
    paths = [(f"{c}/{i}", c, "good" if i % 3 else "dent", int(i % 3 == 0), "test" if i % 3 == 0 else "train") for c in "ab" for i in range(60)]
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(path):
        reads.add(1)
        return path

    base = spark.createDataFrame(paths, "path string, category string, type string, label int, split string").withColumn("path", seen("path"))
    split = records.split_by_counts(base, lambda types: records.injection_takes(types, 0.3), 0.1, records.calibration_size(fraction=0.1))
    assert len(split.collect()) == 120 and reads.value == 4 * 120


def test_split_by_counts_refuses_repeated_keys_at_a_cut(spark):
    rows = [("same", "c", "good", 0, "train")] * 20
    base = spark.createDataFrame(rows, "path string, category string, type string, label int, split string")
    with pytest.raises(PySparkException, match="order keys repeat"):
        records.split_by_counts(base, lambda types: records.injection_takes(types, 0.3), 0.1, records.calibration_size()).count()


def test_cap_takes_the_first_rows_by_path(spark):
    rows = [(f"p{i:04d}.png", "c", int(i % 4 == 0)) for i in range(200)] + [("q", "d", 1), ("r", "d", 1), ("s", "d", 1)]
    got = records.cap_preserving_classes(spark.createDataFrame(rows, "path string, category string, label int"), ["category"], 20)
    found = {(r["category"], r["path"]) for r in got.collect()}
    ones, zeros = [p for p, c, y in rows if c == "c" and y], [p for p, c, y in rows if c == "c" and not y]
    assert found == {("c", p) for p in ones[:5] + zeros[:15]} | {("d", p) for p in "qrs"}


def test_hash_cut_takes_exactly_the_asked_number(rows):
    keyed = rows.withColumn("k", order_key("draw", "path"))
    cuts = ranking.hash_cuts(keyed, ["g"], "k", {"few": F.lit(7), "all": F.col("n"), "none": F.lit(0), "more": F.col("n") + 5})
    joined = keyed.join(cuts, "g")
    counts = joined.groupBy("g").agg(
        F.max("n").alias("n"), *[F.count_if(ranking.taken("k", t)).alias(t) for t in ("few", "all", "none", "more")]
    ).toPandas()
    assert (counts["few"] == 7).all() and (counts["all"] == counts["n"]).all()
    assert (counts["none"] == 0).all() and (counts["more"] == counts["n"]).all()


@pytest.mark.parametrize("block_rows", [512, 16])
def test_pairwise_spread_equals_all_pairs(spark, block_rows):
    rng = np.random.default_rng(0)
    data = [("hot", i, rng.normal(size=4).tolist()) for i in range(90)] + [("cold", 100 + i, rng.normal(size=4).tolist()) for i in range(3)] + [("one", 999, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(data, "g string, id long, x array<double>")
    got = blocks.pairwise_spread(df, ["g"], "id", "x", block_rows).toPandas().set_index("g")
    for g in ("hot", "cold"):
        x = np.array([d[2] for d in data if d[0] == g])
        pairs = [np.linalg.norm(x[i] - x[j]) for i in range(len(x)) for j in range(i + 1, len(x))]
        assert got.loc[g, "mean_distance"] == pytest.approx(np.mean(pairs))
        assert got.loc[g, "min_distance"] == pytest.approx(np.min(pairs))
    assert pd.isna(got.loc["one", "mean_distance"])


@pytest.mark.parametrize("block_rows,donor_block", [(4096, 64), (8, 2)])
def test_best_hosts_equals_the_full_cost_table(spark, block_rows, donor_block):
    rng = np.random.default_rng(1)
    hosts = [("c", f"h{i:03d}", rng.integers(0, 4, 9).tolist()) for i in range(60)]
    donors = [("c", d, 3, (rng.random(9) < 0.5).tolist() if d else [False] * 9, rng.integers(0, 4, 9).tolist()) for d in range(5)]
    got = blocks.best_hosts(
        spark.createDataFrame(donors, "category string, donor_idx int, need int, ring array<boolean>, pixels array<int>"),
        spark.createDataFrame(hosts, "category string, host string, pixels array<int>"),
        ["category"], 3, block_rows, donor_block,
    ).toPandas()
    for _, d, need, ring, pixels in donors:
        ring = np.array(ring)
        cost = [np.abs(np.array(h[2])[ring] - np.array(pixels)[ring]).mean() if ring.any() else 0.0 for h in hosts]
        want = [hosts[i][1] for i in np.argsort(cost, kind="stable")[:need]]
        assert got[got.donor_idx == d].sort_values("host_rank").host.tolist() == want


NULLABLE = {name: METRICS[name] for name in ("auroc", "aupr", "row_order", "youden", "f1", "points", "quantiles", "positions")}


@pytest.mark.parametrize("name", NULLABLE)
def test_a_null_group_is_a_group(rows, name):
    """The result for rows whose key is NULL equals that of the same rows under a name."""
    nameless = rows.withColumn("g", F.when(F.col("g") != "g7", F.col("g")))
    got, want = NULLABLE[name](nameless), NULLABLE[name](rows)
    assert got.where("g is null").count() == want.where("g = 'g7'").count() > 0
    same(got.withColumn("g", F.coalesce("g", F.lit("g7"))), want)


def test_cuts_of_a_null_group(spark):
    paths = spark.createDataFrame([(g, f"{i:03d}") for g in ("a", None) for i in range(50)], "g string, k string")
    cuts = ranking.hash_cuts(paths, ["g"], "k", {"few": F.lit(7)})
    assert {(r["g"], r["n"], r["few_cut"]) for r in cuts.collect()} == {("a", 50, "006"), (None, 50, "006")}


def test_two_levels_equal_each_level_alone(rows):
    both = conformal.operating_points_at(rows, ["g"], [0.05, 0.2])
    for alpha in (0.05, 0.2):
        same(both.where(F.col("alpha") == alpha).drop("alpha"), conformal.operating_points(rows, ["g"], alpha))


def test_distances_keep_tiny_gaps(spark):
    """Vectors far from the origin that differ in the ninth digit: squares from a product alone would lose them."""
    base = np.array([1e4, -3e4, 2e4])
    data = [("g", i, (base + [1e-5 * i, 0, 0]).tolist()) for i in range(40)] + [("g", 40, (-base).tolist())]
    got = blocks.pairwise_spread(spark.createDataFrame(data, "g string, id long, x array<double>"), ["g"], "id", "x").first()
    x = np.array([d[2] for d in data])
    pairs = [np.linalg.norm(x[i] - x[j]) for i in range(41) for j in range(i + 1, 41)]
    assert got["min_distance"] == pytest.approx(min(pairs), rel=1e-6) and got["mean_distance"] == pytest.approx(np.mean(pairs))


def test_spread_verdict(spark):
    data = [("near", i, [0.001 * i, 0.0]) for i in range(5)] + [("far", i, [float(i), 0.0]) for i in range(5)] + [("one", 0, [0.0, 0.0])]
    got = blocks.pairwise_spread(spark.createDataFrame(data, "g string, id long, x array<double>"), ["g"], "id", "x").collect()
    assert {r["g"]: r["passed"] for r in got} == {"near": False, "far": True, "one": None}


def test_cuts_are_looked_up_without_a_shuffle_of_the_rows(spark):
    rows = spark.range(3_000).select(
        F.concat(F.lit("p"), "id").alias("path"),
        F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("category"),
        F.lit("t").alias("type"),
        (F.col("id") % 2).cast("int").alias("label"),
        F.when(F.col("id") % 5 < 3, "train").otherwise("test").alias("split"),
    ).where("category is not null")
    types = rows.where("split = 'test' and label = 1")
    for moved in (records.keep_anomalies(rows, 20), records.swap(rows, 0.5), records.inject(rows, records.injection_cuts(types, 0.1))):
        plan = moved._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    kept = records.keep_anomalies(rows, 20).where("split = 'train' and label = 1").groupBy("category").count().collect()
    assert {r["category"]: r["count"] for r in kept} == {"a": 20, "b": 20}


def test_cuts_with_null_keys_and_several_takes(spark):
    rows = spark.createDataFrame([(None if i % 2 else "g", None if i < 2 else f"{i:04x}") for i in range(300)], "g string, k string")
    got = {r["g"]: r for r in ranking.hash_cuts(rows, ["g"], "k", {"one": F.lit(1), "some": F.lit(40), "none": F.lit(0), "all": F.lit(900)}, digits=3).collect()}
    for g, first in (("g", 0), (None, 1)):
        r = got[g]
        assert (r["n"], r["one"], r["some"], r["none"], r["all"]) == (150, 1, 40, 0, 150)
        assert r["one_cut"] is None and r["none_cut"] is None and r["some_cut"] == f"{first + 78:04x}" and r["all_cut"] == f"{first + 298:04x}"
