"""Splits, draws, top-ups and audits; sizes are exact, and each planted fault is caught."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siftmark.functions import paths as P
from siftmark.functions.draws import take_size
from siftmark.operators import checks, expansion, leaks, profile, records, settings

# Recorded split sizes of three inventories (10 % of each defect type, floor of 10 validation defects).
RECORDED = {
    "bottle": (0.6, 10, {"broken_large": (20, 2, 2), "broken_small": (22, 2, 4), "contamination": (21, 2, 4)}),
    "toothbrush": (0.65, 4, {"defective": (30, 2, 4)}),
    "grid": (0.5, 10, {"bent": (12, 2, 2), "broken": (12, 2, 2), "glue": (11, 2, 2), "metal_contamination": (11, 2, 2), "thread": (11, 2, 2)}),
}


def tree(spark, category, types, train=40, good=20):
    paths = [f"{category}/train/good/{i:03d}.png" for i in range(train)] + [f"{category}/test/good/{i:03d}.png" for i in range(good)]
    paths += [f"{category}/test/{t}/{i:03d}.png" for t, n in types.items() for i in range(n)]
    paths += [f"{category}/ground_truth/{t}/{i:03d}_mask.png" for t, n in types.items() for i in range(n)]
    return spark.createDataFrame([(p,) for p in paths], "path string")


def counts(df, *keys):
    return {tuple(r[k] for k in keys): r["count"] for r in df.groupBy(*keys).count().collect()}


@pytest.mark.parametrize("category", RECORDED)
def test_recorded_split_sizes(spark, category):
    share, n_val, types = RECORDED[category]
    rows = records.inventory(tree(spark, category, {t: v[0] for t, v in types.items()})).withColumn("split", F.col("folder"))
    anomalies = rows.where("label = 1")
    sizes = anomalies.groupBy("category", "type").agg(F.count(F.lit(1)).alias("n"))
    shares = records.adaptive_shares(sizes, take_size(F.col("n"), 0.1), 0.5, 0.65, 10)
    got = shares.first()
    assert (got["val_share"], got["val_anomalies"], got["floor_met"]) == (share, n_val, n_val >= 10)
    cuts = records.injection_cuts(anomalies, 0.1, shares=shares)
    found = {r["type"]: (r["available"], r["train"], r["val"]) for r in records.coverage(cuts, strict=True).collect()}
    assert found == types
    moved = counts(records.inject(rows, cuts), "type", "split")
    for name, (available, train, val) in types.items():
        assert (moved.get((name, "train"), 0), moved.get((name, "val"), 0)) == (train, val)
        assert moved[(name, "test")] == available - train - val
    assert moved[("good", "train")] == 40 and moved[("good", "test")] == 20


def test_a_type_without_training_sample_is_an_error(spark):
    broken = spark.createDataFrame([("c", "dent", 5, 2, 2)], "category string, type string, n int, drawn int, n_val int")
    assert records.coverage(broken).count() == 1
    with pytest.raises(PySparkException, match="no training sample"):
        records.coverage(broken, strict=True).collect()


def base(spark, train=201, good=60):
    rows = records.inventory(tree(spark, "c", {"dent": 20}, train, good)).withColumn("split", F.col("folder"))
    return rows


def test_swap_keeps_every_size(spark):
    rows = base(spark)
    got = counts(records.swap(rows, 0.5), "label", "split")
    assert got[(0, "test")] == 60 and got[(0, "val")] == 10 and got[(0, "train")] == 191 and got[(1, "test")] == 20
    folders = counts(records.swap(rows, 0.5), "label", "split", "folder")
    assert folders[(0, "test", "train")] == 30 and folders[(0, "train", "test")] == 20 and folders[(0, "val", "test")] == 10
    assert counts(records.swap(rows, 0.0), "split") == counts(rows, "split")


def test_calibration_floor_and_exclusivity(spark):
    assert counts(records.calibrate(base(spark, 220), count=110), "split")[("calib",)] == 110
    assert ("calib",) not in counts(records.calibrate(base(spark, 209), count=110), "split")
    assert counts(records.calibrate(base(spark, 201), fraction=0.1), "split")[("calib",)] == 21
    with pytest.raises(ValueError):
        records.calibrate(base(spark), fraction=0.1, count=10)


def test_stratified_quota_and_draws_depend_on_the_seed(spark):
    rows = [("c", f"{i}", int(i < 23), "train") for i in range(100)]
    df = spark.createDataFrame(rows, "category string, path string, label int, split string")
    a, b, c = (records.stratified_split(df, 0.25, seed) for seed in (0, 0, 1))
    assert counts(a, "split") == {("val",): 25, ("train",): 75}
    assert counts(a, "label", "split")[(1, "val")] in (5, 6)
    val = [{r["path"] for r in x.where("split = 'val'").collect()} for x in (a, b, c)]
    assert val[0] == val[1] != val[2]


def test_keeping_more_anomalies_than_exist_is_an_error(spark):
    rows = base(spark).withColumn("split", F.lit("train"))
    assert counts(records.keep_anomalies(rows, 6), "label")[(1,)] == 6
    with pytest.raises(PySparkException, match="fewer than 21"):
        records.keep_anomalies(rows, 21).collect()


def test_cap_keeps_both_classes(spark):
    rows = [("c", f"{i}", int(i < 2)) for i in range(500)]
    df = spark.createDataFrame(rows, "category string, path string, label int")
    assert counts(records.cap_preserving_classes(df, ["category"], 50), "label") == {(0,): 49, (1,): 1}
    assert records.cap_preserving_classes(df, ["category"], 900).count() == 500


def test_path_functions(spark):
    rows = ["/d/c/test/dent/007.png", "/d/c/train/good/1.png", "/d/c/ground_truth/dent/007_mask.png", "odd.png", "a/b.png"]
    df = spark.createDataFrame([(p,) for p in rows], "path string")
    p = F.col("path")
    got = df.select(P.mask_path(p), P.group_label(p), P.file_index(p), P.last_parts(p), P.relative_to(p, "/d/")).collect()
    assert got[0][0] == "/d/c/ground_truth/dent/007_mask.png" and got[1][0] == rows[1]
    assert [r[1] for r in got] == ["defect", "train_good", None, None, None]
    assert [r[2] for r in got] == [7, 1, 7, None, None]
    assert got[0][3] == "test/dent/007.png" and got[3][3] == "odd.png" and got[0][4] == "c/test/dent/007.png" and got[4][4] == "a/b.png"


def test_leak_check_finds_each_planted_overlap(spark):
    clean = [("c", f"{s}{i}", s) for s in ("train", "val", "test", "calib") for i in range(3)]
    schema = "category string, path string, split string"
    assert leaks.leak_counts(spark.createDataFrame(clean, schema), ["category"]).count() == 0
    assert leaks.assert_no_leak(spark.createDataFrame(clean, schema), ["category"]).count() == 12
    for a, b in leaks.PAIRS:
        planted = spark.createDataFrame([*clean, ("c", f"{a}0", b)], schema)
        assert leaks.leak_counts(planted, ["category"]).first()["pair"] == f"{a}+{b}"
        with pytest.raises(PySparkException, match="two splits"):
            leaks.assert_no_leak(planted, ["category"]).collect()


def donors(spark, n=3, hosts=10):
    rows = [("c", f"d{i}", 1) for i in range(n)] + [("c", f"h{i}", 0) for i in range(hosts)]
    return spark.createDataFrame(rows, "category string, path string, label int")


def test_duplicate_top_up_is_round_robin(spark):
    out, plan = expansion.top_up(donors(spark), ["category"], "duplicate")
    assert counts(out.where("tag = 'duplicate'"), "path") == {("d0",): 15, ("d1",): 15, ("d2",): 15}
    assert plan.first()["applied"]
    with pytest.raises(ValueError):
        expansion.top_up(donors(spark), ["category"], "mosaic")


def test_random_top_up_reuses_hosts_only_when_short(spark):
    def hosts(n):
        out, _ = expansion.top_up(donors(spark, 3, n), ["category"], "random")
        return counts(out.where("tag is not null"), "path")

    plenty, few = hosts(60), hosts(4)
    assert len(plenty) == 45 and set(plenty.values()) == {1}
    assert sum(few.values()) == 45 and len(few) <= 4


def test_rich_and_empty_groups_are_left_alone(spark):
    for n, reason in ((25, "rich regime"), (0, "no donor")):
        out, plan = expansion.top_up(donors(spark, n), ["category"], "duplicate")
        assert plan.first()["reason"] == reason and out.count() == n + 10


@pytest.mark.parametrize("d,h,n", [(2, 5, 4), (3, 2, 11), (1, 3, 7), (5, 4, 3)])
def test_slots_follow_the_stated_rule(spark, d, h, n):
    rows = donors(spark, d, h)
    groups = expansion.scarce_groups(rows, ["category"], d + n, None)
    ranked = spark.createDataFrame([("c", i, f"h{(r + i) % h}", r) for i in range(d) for r in range(h)], "category string, donor_idx int, host string, host_rank int")
    got = expansion.matched_top_up(groups, ["category"], ranked).orderBy("slot").collect()
    used, want = [[] for _ in range(d)], []
    for j in range(n):
        i = j % d
        if len(used[i]) == h:
            used[i] = []
        host = next(f"h{(r + i) % h}" for r in range(h) if f"h{(r + i) % h}" not in used[i])
        used[i].append(host)
        want.append((i, host))
    assert [(r["donor_idx"], r["path"]) for r in got] == want


def test_donor_audit_reports_a_foreign_host(spark):
    rows = spark.createDataFrame(
        [("c", "d0", 1, "train"), ("c", "h0", 0, "train"), ("c", "t0", 0, "test")], "category string, path string, label int, split string"
    )
    planned = spark.createDataFrame([("c", 1)], "category string, planned long")
    for host, ok in (("h0", True), ("t0", False)):
        synthetic = spark.createDataFrame([("c", host, "d0")], "category string, host string, donor string")
        assert leaks.donor_audit(rows, synthetic, planned, ["category"]).first()["ok"] is ok


def test_expansion_scenarios(spark):
    rows = donors(spark, 3, 10)
    assert expansion.expand(rows, ["category"], "oversample", 4).count() == 22
    assert expansion.expand(rows, ["category"], "cutpaste").where("tag = 'cutpaste' and label = 1").count() == 3
    assert expansion.expand(rows, ["category"], "original").count() == 13
    none = rows.where("label = 0")
    assert expansion.expand(none, ["category"], "cutpaste", ratio=2.0).where("label = 1").count() == 2


def test_label_integrity_catches_a_flip_and_a_duplicate_normal(spark):
    before = donors(spark)
    good = expansion.expand(before, ["category"], "oversample", 3)
    flipped = good.withColumn("label", F.when(F.col("path") == "h0", 1).otherwise(F.col("label")))
    doubled = good.unionByName(good.where("label = 0"))
    assert [leaks.label_integrity(before, x, ["category"]).first()["passed"] for x in (good, flipped, doubled)] == [True, False, False]


def test_regime_returns_calibration_rows(spark):
    rows = [("c", f"{i}", 0, "calib") for i in range(5)] + [("c", "x", 1, "train")]
    df = spark.createDataFrame(rows, "category string, path string, label int, split string")
    scarce = profile.apply_regime(df, ["category"], profile.regime(df, ["category"], 20))
    rich = profile.apply_regime(df, ["category"], profile.regime(df, ["category"], 1))
    assert ("calib",) not in counts(scarce, "split") and counts(rich, "split")[("calib",)] == 5


def test_missing_masks_are_counted(spark):
    files = tree(spark, "c", {"dent": 4})
    defects = records.inventory(files).where("label = 1")
    masks = files.where(F.col("path").contains("ground_truth"))
    assert leaks.missing_counterparts(defects, masks, P.mask_path(F.col("path")), ["category"]).count() == 0
    fewer = masks.where("path not like '%002_mask%'")
    assert leaks.missing_counterparts(defects, fewer, P.mask_path(F.col("path")), ["category"]).first()["n_missing"] == 1


def test_categories_and_unknown_names(spark):
    known = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "dataset string, category string")
    asked = spark.createDataFrame([("a", "x, q"), ("b", "all")], "dataset string, categories string")
    keep, skipped = records.select_categories(asked, known)
    assert {tuple(r) for r in keep.collect()} == {("a", "x"), ("b", "z")} and [tuple(r) for r in skipped.collect()] == [("a", "q")]


def test_check_tally_fails_on_one_failure(spark):
    table = spark.createDataFrame([("a", 1, 0), ("b", 0, 0)], "g string, x int, y int")
    rows = checks.check_rows(table, ["g"], {"x set": F.col("x") > 0, "y set": F.col("y") > 0}, warn=("y set",))
    got = {r["g"]: r for r in checks.tally_checks(rows, ["g"]).collect()}
    assert got["a"]["ok"] and got["a"]["n_warn"] == 1 and not got["b"]["ok"] and got["b"]["failed"] == "x set"


def test_settings(spark):
    config = spark.sql("select map('metrics', 'f1,auroc', 'val_share_mode', 'adaptive', 'injection_val_share', '0.5', 'lr', '3') m union all "
                       "select map('metrics', 'auroc,f1', 'val_share_mode', 'adaptive', 'injection_val_share', '0.6', 'lr', '9') union all "
                       "select map('metrics', 'auroc,f1', 'val_share_mode', 'fixed', 'injection_val_share', '0.6', 'lr', '9')")
    a, b, c = [r[0] for r in config.select(settings.fingerprint(F.col("m"))).collect()]
    assert len({a, b, c}) == 3 and '"injection_val_share":"per-category (adaptive)"' in a and "lr" not in a  # the bounds of the rule differ
    assert '"val_share_bounds":[null,"0.5"]' in a and '"name":"unnamed"' in a and '"metrics":["auroc","f1"]' in a and '"use_validation":null' in a
    over = spark.createDataFrame([("d", "c", "val_split"), ("d", "c", "val_spilt")], "dataset string, category string, key string")
    known = spark.createDataFrame([("val_split",)], "key string")
    assert settings.unknown_keys(over, known).first()["unknown"] == "val_spilt"


def test_donor_rule_and_tagged_rows(spark):
    rows = [("c", "d0", 1, "scratch", True, None), ("c", "d1", 1, "dent", False, None), ("c", "s0", 1, "dent", True, "transplant"), ("c", "h0", 0, "good", None, None), ("e", "d2", 1, "dent", False, None)]
    df = spark.createDataFrame(rows, "category string, path string, label int, type string, inside boolean, tag string")
    out, plan = expansion.top_up(df, ["category"], "duplicate", 6, 5, donor_rule="inside_object")
    found = {r["category"]: r for r in plan.collect()}
    assert (found["c"]["n_donors"], found["c"]["n_paste_donors"], found["c"]["excluded_types"], found["c"]["n_synthetic"], found["c"]["n_distinct_hosts"]) == (2, 1, "dent", 4, 1)
    assert found["e"]["reason"] == "no donor passes the donor rule" and found["e"]["n_synthetic"] == 0
    assert counts(out.where("tag = 'duplicate'"), "path") == {("d0",): 4} and out.where("path = 's0'").first()["tag"] == "transplant"
    with pytest.raises(ValueError):
        expansion.top_up(df, ["category"], "duplicate", donor_rule="outside")


def test_strict_checks_end_the_job(spark):
    a, b = spark.createDataFrame([("x",)], "k string"), spark.createDataFrame([("y",)], "k string")
    assert leaks.key_difference(a, b, ["k"]).count() == 2 and leaks.key_difference(a, a, ["k"], strict=True).count() == 1
    with pytest.raises(PySparkException, match="share no key"):
        leaks.key_difference(a, b, ["k"], strict=True).collect()
    items = spark.createDataFrame([("c", "p1"), ("c", "p2")], "category string, path string")
    masks = spark.createDataFrame([("p1m",)], "path string")
    mask = F.concat("path", F.lit("m"))
    assert leaks.missing_counterparts(items, masks, mask, ["category"]).first()["n_missing"] == 1
    with pytest.raises(PySparkException, match="1 missing, such as p2m"):
        leaks.missing_counterparts(items, masks, mask, ["category"], strict=True).collect()
    over, known = spark.createDataFrame([("d", "c", "lrr")], "dataset string, category string, key string"), spark.createDataFrame([("lr",)], "key string")
    with pytest.raises(PySparkException, match="unknown settings of d/c: lrr"):
        settings.unknown_keys(over, known, strict=True).collect()


def test_evaluation_overlap_catches_each_planted_fault(spark):
    base = [("d0", 1, "train"), ("h0", 0, "train"), ("v0", 0, "val"), ("t0", 0, "test"), ("c0", 0, "calib"), (None, 0, "test"), (None, 0, "train"), ("x", 0, None)]
    schema = "category string, path string, label int, split string, tag string"

    def judged(more=(), donor="d0", host="h0", tag=None):
        rows = [("c", p, y, s, tag if p == "t0" else None) for p, y, s in [*base, *more]]
        synthetic = spark.createDataFrame([("c", host, donor)], "category string, host string, donor string")
        r = leaks.evaluation_overlap(spark.createDataFrame(rows, schema), synthetic, ["category"]).first()
        return r["shared_with_training"], r["in_val_and_test"], r["tagged_evaluation_rows"], r["example"], r["ok"]

    assert judged() == (0, 0, 0, None, True)
    assert judged(donor="t0") == (1, 0, 0, "t0", False)
    assert judged(host="c0") == (1, 0, 0, "c0", False)
    assert judged(more=[("d0", 1, "val")]) == (1, 0, 0, "d0", False)
    assert judged(more=[("v0", 0, "test")]) == (0, 1, 0, "v0", False)
    assert judged(tag="pasted") == (0, 0, 1, None, False)
