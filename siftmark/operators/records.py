"""Labelled train / val / test / calib splits from an inventory of paths.

A record is (path, category, folder, type, label) with ``folder`` the split its path lies in. Every
operator returns the whole inventory with a ``split`` column; rows change split, none are lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftmark.functions import paths as P
from siftmark.functions.draws import half_even, order_key, take_size, validation_part
from siftmark.operators.joins import lookup, require
from siftmark.operators.ranking import hash_cuts, hash_digits, hash_positions, taken, text_digits
from siftmark.session import written


def inventory(files: DataFrame, path: str = "path") -> DataFrame:
    """Records from file paths; ground truth and files outside the layout are left out."""
    # One test on the whole path: the filter moves below the split, where every use of it is computed anew.
    kept = files.where(F.col(path).rlike(P.RECORD_LAYOUT))
    parts = kept.select(F.col(path).alias("path"), F.split(path, "/").alias("_parts"))

    def part(place: int) -> Column:
        return F.try_element_at("_parts", F.lit(place))

    named = parts.select("path", part(-4).alias("category"), part(-3).alias("folder"), part(-2).alias("type"))
    return named.withColumn("label", P.folder_label(F.col("type")))


def select_categories(requested: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dataset, category) pairs to run and the requested names to report as skipped.

    ``all`` selects every known category. A text such as ``a,b`` is read as a list of names.
    """
    asked = requested.select("dataset", F.explode(F.split("categories", r"\s*,\s*")).alias("category")).distinct()
    everything = known.join(asked.where("category = 'all'").select("dataset").distinct(), "dataset", "left_semi")
    named = known.join(asked, ["dataset", "category"], "left_semi")
    skipped = asked.where("category <> 'all'").join(known, ["dataset", "category"], "left_anti")
    return everything.unionByName(named).distinct(), skipped


def accessor(records: DataFrame, split: str, *columns: str) -> DataFrame:
    """Labels, paths or both of one split."""
    return records.where(F.col("split") == split).select(*(columns or ("path", "label")))


def adaptive_shares(
    types: DataFrame, take: Column, low: float, high: float, floor: int, step: float = 0.05
) -> DataFrame:
    """Per category, the smallest validation share that gives at least ``floor`` validation anomalies.

    ``types`` has one row per (category, type) with ``n``. If no share in range is enough, the range
    maximum is used and ``floor_met`` is false.
    """
    steps = int((high - low) / step + 1e-9)
    shares = F.array(*[F.lit(low + i * step) for i in range(steps + 1)], F.lit(float(high)))
    drawn = F.least(take * 2, F.col("n"))
    counts = (
        types.withColumn("drawn", drawn)
        .withColumn("share", F.explode(F.array_distinct(shares)))
        .groupBy("category", "share")
        .agg(F.sum(validation_part(F.col("drawn"), F.col("share"))).alias("n_val"))
    )
    enough = F.col("n_val") >= floor
    best = counts.groupBy("category").agg(
        F.min(F.when(enough, F.struct("share", "n_val"))).alias("first_enough"),
        F.max(F.struct("share", "n_val")).alias("widest"),
    )
    chosen = F.coalesce(F.col("first_enough"), F.col("widest"))
    return best.select(
        "category",
        F.round(chosen["share"], 4).alias("val_share"),
        chosen["n_val"].alias("val_anomalies"),
        (chosen["n_val"] >= floor).alias("floor_met"),
    )


def injection_cuts(
    anomalies: DataFrame,
    fraction: float | None,
    fixed: int = 0,
    use_validation: bool = True,
    val_share: float = 0.5,
    shares: DataFrame | None = None,
    seed: int = 0,
) -> DataFrame:
    """Per (category, type): how many anomalies are available, drawn, and put into train and val, with cuts."""
    keyed = anomalies.withColumn("order_key", order_key("inject", "path", seed))
    n = F.col("n")
    base = take_size(n, fraction, fixed)
    drawn = F.least(base * 2, n) if use_validation else F.least(base, n)
    extra, share = None, F.lit(float(val_share))
    if shares is not None:
        extra = anomalies.select("category", "type").distinct().join(shares.select("category", "val_share"), "category")
        share = F.col("val_share")
    n_val = validation_part(drawn, share) if use_validation else F.lit(0)
    return hash_cuts(keyed, ["category", "type"], "order_key", {"drawn": drawn, "n_val": n_val}, extra)


def coverage(cuts: DataFrame, strict: bool = False) -> DataFrame:
    """Per (category, type) counts; with ``strict`` a type without a training sample is an error."""
    counts = cuts.select(
        "category",
        "type",
        F.col("n").alias("available"),
        F.col("drawn").alias("taken"),
        (F.col("drawn") - F.col("n_val")).alias("train"),
        F.col("n_val").alias("val"),
    )
    if not strict:
        return counts
    return require(counts, F.col("train") >= 1, F.concat(F.lit("no training sample of defect type "), "category", F.lit("/"), "type"))


def coverage_manifest(counts: DataFrame) -> DataFrame:
    """Per category: totals, type lists as text and whether every type reached training."""

    def names(keep: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(keep, F.col("type")))), ",")

    return counts.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_types"),
        F.sum("taken").alias("n_removed_from_test"),
        F.sum("train").alias("n_injected_train"),
        F.sum("val").alias("n_injected_val"),
        names(F.col("train") > 0).alias("train_types"),
        names(F.col("val") > 0).alias("val_types"),
        F.bool_and(F.col("train") > 0).alias("coverage_complete"),
    )


def inject(records: DataFrame, cuts: DataFrame, seed: int = 0) -> DataFrame:
    """Move drawn anomalies from test into val and train. ``records`` carry ``split``."""
    keyed = records.withColumn("order_key", order_key("inject", "path", seed))
    placed = lookup(keyed, cuts.select("category", "type", "drawn_cut", "n_val_cut"), ["category", "type"])
    movable = (F.col("split") == "test") & (F.col("label") == 1)
    split = F.when(movable & taken("order_key", "n_val"), "val").when(movable & taken("order_key", "drawn"), "train")
    return placed.withColumn("split", split.otherwise(F.col("split"))).select(*records.columns)


def swap_plan(records: DataFrame, fraction: float, val_share: float = 1.0 / 3.0) -> DataFrame:
    """Per category the number of normals that change places between train and test, and its parts."""
    good = F.col("label") == 0
    n_test = F.count_if(good & (F.col("split") == "test"))
    n_train = F.count_if(good & (F.col("split") == "train"))
    k = F.greatest(
        F.least(half_even(F.col("test_good") * F.lit(float(fraction))), F.col("test_good"), F.floor(F.col("train_good") / 4)), F.lit(0)
    ).cast("bigint")
    return (
        records.groupBy("category")
        .agg(n_test.alias("test_good"), n_train.alias("train_good"))
        .withColumn("k", k)
        .withColumn("k_val", half_even(F.col("k") * F.lit(float(val_share))))
    )


def swap(records: DataFrame, fraction: float, val_share: float = 1.0 / 3.0, seed: int = 0) -> DataFrame:
    """Swap equal numbers of normals between test and train; no split changes its normal count in test."""
    keyed = records.withColumn("order_key", order_key("swap", "path", seed))
    normals = keyed.where((F.col("label") == 0) & F.col("split").isin("train", "test"))
    plan = swap_plan(records, fraction, val_share)
    sides = plan.select("category", "k", "k_val", F.explode(F.array(F.lit("train"), F.lit("test"))).alias("split"))
    to_val = F.when(F.col("split") == "test", F.col("k_val")).otherwise(F.lit(0))
    cuts = hash_cuts(normals, ["category", "split"], "order_key", {"k_all": F.col("k"), "k_first": to_val}, sides)
    placed = lookup(keyed, cuts.select("category", "split", "k_all_cut", "k_first_cut"), ["category", "split"])
    normal = F.col("label") == 0
    moved = (
        F.when(normal & (F.col("split") == "train") & taken("order_key", "k_all"), "test")
        .when(normal & (F.col("split") == "test") & taken("order_key", "k_first"), "val")
        .when(normal & (F.col("split") == "test") & taken("order_key", "k_all"), "train")
    )
    return placed.withColumn("split", F.coalesce(moved, F.col("split"))).select(*records.columns)


def hold_out(
    records: DataFrame, fraction: float, source: str = "train", target: str = "val", purpose: str = "holdout", seed: int = 0
) -> DataFrame:
    """Move a share (rounded up) of the normals of one split into another, per category."""
    return _move_normals(records, F.ceil(F.col("n") * F.lit(float(fraction))), source, target, purpose, seed)


def calibration_size(fraction: float = 0.0, count: int = 0, min_train: int = 100) -> Column:
    """Calibration rows for a pool of ``n`` training normals: a share, or a count that must leave enough."""
    if fraction > 0 and count > 0:
        raise ValueError("give a calibration fraction or a count, not both")
    n = F.col("n")
    if fraction > 0:
        return F.ceil(n * F.lit(float(fraction)))
    if count > 0:
        return F.when(n - count >= min_train, F.lit(count)).otherwise(F.lit(0))
    return F.lit(0)


def calibrate(
    records: DataFrame, fraction: float = 0.0, count: int = 0, min_train: int = 100, seed: int = 0
) -> DataFrame:
    """Hold calibration normals out of training, with an order of their own."""
    return _move_normals(records, calibration_size(fraction, count, min_train), "train", "calib", "calib", seed + 1)


def split_in_one_pass(
    records: DataFrame,
    injection: DataFrame,
    fraction: float,
    calibration: Column,
    seed: int = 0,
) -> DataFrame:
    """Injection, normal hold-out and calibration as one projection of the inventory.

    The draws take disjoint rows: anomalies of test, then normals of train, then of those the ones that were not held out. So
    only cuts are derived, a row per category and draw, and the inventory is read for their counts and once more for its
    rows; no moved table stands between. Equal to ``inject``, ``hold_out`` and ``calibrate`` in turn.
    """
    category = ["category"]
    train_normal = (F.col("label") == 0) & (F.col("split") == "train")
    keyed = records.withColumn("hold_key", order_key("holdout", "path", seed)).withColumn("calib_key", order_key("calib", "path", seed + 1))
    normals = keyed.where(train_normal)
    held = hash_cuts(normals, category, "hold_key", {"held": F.ceil(F.col("n") * F.lit(float(fraction)))}).select("category", "held_cut")
    pool = lookup(normals, held, category).where(~taken("hold_key", "held"))
    calib = hash_cuts(pool, category, "calib_key", {"calib": calibration}).select("category", "calib_cut")
    drawn = injection.select("category", "type", "drawn_cut", "n_val_cut")
    placed = lookup(lookup(lookup(keyed.withColumn("draw_key", order_key("inject", "path", seed)), drawn, ["category", "type"]), held, category), calib, category)
    anomaly = (F.col("split") == "test") & (F.col("label") == 1)
    split = (
        F.when(anomaly & taken("draw_key", "n_val"), "val")
        .when(anomaly & taken("draw_key", "drawn"), "train")
        .when(train_normal & taken("hold_key", "held"), "val")
        .when(train_normal & taken("calib_key", "calib"), "calib")
    )
    return placed.withColumn("split", split.otherwise(F.col("split"))).select(*records.columns)


def injection_takes(types: DataFrame, fraction: float | None, fixed: int = 0, val_share: float = 0.5, shares: DataFrame | None = None) -> DataFrame:
    """``types`` (category, type, n) with ``drawn`` and ``n_val``, the anomalies to move and those of them that go to validation."""
    share = F.lit(float(val_share)) if shares is None else F.col("val_share")
    planned = types if shares is None else lookup(types, shares.select("category", "val_share"), ["category"], "inner")
    drawn = F.least(take_size(F.col("n"), fraction, fixed) * 2, F.col("n"))
    return planned.select("category", "type", "n", drawn.alias("drawn"), validation_part(drawn, share).alias("n_val"))


def _cut_at(take: str, key: str) -> Column:
    """The key of the row with rank ``take``, of rows with ``rank``, the last rank of a key, and ``times``, its repeats."""
    hit = (F.col(take) <= F.col("rank")) & (F.col(take) > F.col("rank") - F.col("times"))
    repeated = F.raise_error(F.concat(F.lit("order keys repeat at a cut: "), F.col(key))).cast("string")
    return F.max(F.when(hit, F.when(F.col("rank") > F.col(take), repeated).otherwise(F.col(key))))


def _running(rows: DataFrame, keys: list[str], order: str, count: str) -> DataFrame:
    """``upto``, the running total of ``count``, and ``n``, its total, for a table of counts by prefix."""
    group = Window.partitionBy(*keys)
    upto = F.sum(count).over(group.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("*", upto.alias("upto"), F.sum(count).over(group).alias("n"))


def split_by_counts(records: DataFrame, takes: Callable[[DataFrame], DataFrame], fraction: float, calibration: Column, seed: int = 0) -> DataFrame:
    """Injection, hold-out and calibration from counts by prefix: three reads of the inventory for the cuts and one for its rows.

    ``takes`` turns (category, type, n) of the test anomalies into (category, type, n, drawn, n_val), as ``injection_takes`` does.
    The first read counts prefixes of both draws. The second looks at the prefixes that hold a cut and counts, by prefix of the
    calibration order, the normals beyond the hold-out. The third looks at the prefix that holds the calibration cut. Between them are tables of counts,
    written once. The splits are those of ``inject``, ``hold_out`` and ``calibrate`` in turn; repeated keys at a cut end the job.
    """
    digits = hash_digits(records)

    def prefix(key: str) -> Column:
        return F.substring(key, 1, digits)

    anomaly = (F.col("split") == "test") & (F.col("label") == 1)
    normal = (F.col("label") == 0) & (F.col("split") == "train")
    key = F.when(normal, order_key("holdout", "path", seed)).when(anomaly, order_key("inject", "path", seed))
    keyed = records.withColumn("draw_key", key).withColumn("calib_key", F.when(normal, order_key("calib", "path", seed + 1)))
    kind = F.when(normal, F.lit("normal")).when(anomaly, F.concat(F.lit("type "), F.col("type")))
    grain = ["category", "kind"]
    # Rows that no draw takes have no kind and fall into one row of each count table. A filter or an inner join would move below the columns made
    # from the path, which would then be computed once for each use.
    drawable = keyed.select("category", kind.alias("kind"), "draw_key", "calib_key")

    counts = written(drawable.groupBy(*grain, prefix("draw_key").alias("prefix")).agg(F.count(F.lit(1)).alias("c")), "split-counts").where("kind is not null")
    is_type = F.col("kind") != "normal"
    sizes = counts.groupBy(*grain).agg(F.sum("c").alias("n"))
    of_types = takes(sizes.where(is_type).select("category", F.substring("kind", 6, 1 << 30).alias("type"), "n"))
    held = F.least(F.ceil(F.col("n") * F.lit(float(fraction))), F.col("n"))
    plan = of_types.select("category", F.concat(F.lit("type "), F.col("type")).alias("kind"), F.col("drawn").cast("bigint"), F.col("n_val").cast("bigint")).unionByName(
        sizes.where(~is_type).select(*grain, held.cast("bigint").alias("drawn"), F.lit(0).cast("bigint").alias("n_val"))
    )
    placed = lookup(_running(counts, grain, "prefix", "c"), plan, grain, "inner")

    def holds(take: str) -> Column:
        return (F.col(take) <= F.col("upto")) & (F.col(take) > F.col("upto") - F.col("c"))

    def held_by(take: str, value: Column) -> Column:
        return F.max(F.when(holds(take), value))

    bounds = written(
        placed.groupBy(*grain).agg(
            *[F.max(c).alias(c) for c in ("n", "drawn", "n_val")],
            *[held_by(take, F.col("prefix")).alias(f"{take}_prefix") for take in ("drawn", "n_val")],
            *[held_by(take, F.col("upto") - F.col("c")).alias(f"{take}_before") for take in ("drawn", "n_val")],
        ),
        "split-bounds",
    )
    joined = lookup(drawable, bounds, grain).withColumn("prefix", prefix("draw_key"))
    at = F.coalesce(F.col("prefix") == F.col("drawn_prefix"), F.lit(False)) | F.coalesce(F.col("prefix") == F.col("n_val_prefix"), F.lit(False))
    beyond = ~is_type & F.coalesce(F.col("prefix") > F.col("drawn_prefix"), F.lit(True))
    place = F.when(at, F.lit("at")).when(beyond, F.lit("beyond")).alias("place")
    item, calib = F.when(at, F.col("draw_key")).alias("key"), F.when(at, F.col("calib_key")).when(beyond, prefix("calib_key")).alias("calib")
    looked = joined.groupBy(*grain, place, item, calib).agg(F.count(F.lit(1)).alias("times"))
    second = written(looked, "split-second-look").where("kind is not null and place is not null")
    near = lookup(second.where("key is not null").withColumn("prefix", prefix("key")), bounds, grain, "inner")
    before = F.when(F.col("prefix") == F.col("drawn_prefix"), F.col("drawn_before")).otherwise(F.col("n_val_before"))
    rank = F.sum("times").over(Window.partitionBy(*grain, "prefix").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)) + before
    same = F.sum("times").over(Window.partitionBy(*grain, "prefix", "key"))
    ranked = near.select("*", rank.alias("rank"), same.alias("repeats")).drop("times").withColumnRenamed("repeats", "times")
    cuts = ranked.groupBy(*grain).agg(_cut_at("drawn", "key").alias("drawn_cut"), _cut_at("n_val", "key").alias("n_val_cut"))
    found = written(lookup(bounds.select(*grain), cuts, grain), "split-cuts")

    held_cuts = found.where(~is_type).select("category", F.col("drawn_cut").alias("held_cut"))
    pool = lookup(second.where(~is_type), held_cuts, ["category"], "inner").where("key is null or held_cut is null or key > held_cut")
    pooled = _running(pool.groupBy("category", prefix("calib").alias("prefix")).agg(F.sum("times").alias("c")), ["category"], "prefix", "c")
    wanted = pooled.withColumn("wanted", F.least(F.greatest(calibration.cast("bigint"), F.lit(0)), F.col("n"))).where(holds("wanted"))
    held_by_prefix = wanted.select("category", F.col("prefix").alias("calib_prefix"), (F.col("upto") - F.col("c")).alias("before"), "wanted")
    at_calib = written(lookup(held_cuts, held_by_prefix, ["category"]), "split-calibration")
    pooled_row = ~is_type & F.coalesce(F.col("draw_key") > F.col("held_cut"), F.lit(True))
    close = F.when(pooled_row & (prefix("calib_key") == F.col("calib_prefix")), F.col("calib_key")).alias("key")
    third = lookup(drawable, at_calib, ["category"]).groupBy("category", close).agg(F.count(F.lit(1)).alias("times"), *[F.max(c).alias(c) for c in ("before", "wanted")])
    third = written(third, "split-third-look").where("key is not null")
    calib_rank = F.sum("times").over(Window.partitionBy("category").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    calib_cuts = third.select("*", calib_rank.alias("rank")).groupBy("category").agg(_cut_at("wanted", "key").alias("calib_cut"))

    types = found.where(is_type).select("category", F.substring("kind", 6, 1 << 30).alias("type"), "drawn_cut", "n_val_cut")
    normals = written(lookup(held_cuts, calib_cuts, ["category"]), "split-normals")
    rows = lookup(lookup(keyed, types, ["category", "type"]), normals, ["category"])
    split = (
        F.when(anomaly & taken("draw_key", "n_val"), "val")
        .when(anomaly & taken("draw_key", "drawn"), "train")
        .when(normal & taken("draw_key", "held"), "val")
        .when(normal & taken("calib_key", "calib"), "calib")
    )
    return rows.withColumn("split", split.otherwise(F.col("split"))).select(*records.columns)


def _move_normals(records: DataFrame, size: Column, source: str, target: str, purpose: str, seed: int) -> DataFrame:
    keyed = records.withColumn("order_key", order_key(purpose, "path", seed))
    pool = keyed.where((F.col("label") == 0) & (F.col("split") == source))
    cuts = hash_cuts(pool, ["category"], "order_key", {"held": size})
    placed = lookup(keyed, cuts.select("category", "held_cut"), ["category"])
    moves = (F.col("label") == 0) & (F.col("split") == source) & taken("order_key", "held")
    return placed.withColumn("split", F.when(moves, target).otherwise(F.col("split"))).select(*records.columns)


def stratified_quota(records: DataFrame, fraction: float) -> DataFrame:
    """Per (category, label) rows held out when ``ceil(n * fraction)`` rows of a category are.

    Training quotas are the floors of the exact shares; the rows still missing go to the largest remainders.
    """
    sizes = records.groupBy("category", "label").agg(F.count(F.lit(1)).alias("size"))
    group = Window.partitionBy("category")
    shared = (
        sizes.withColumn("total", F.sum("size").over(group))
        .withColumn("n_train", F.col("total") - F.ceil(F.col("total") * F.lit(float(fraction))))
        .withColumn("exact", F.col("size") * F.col("n_train") / F.col("total").cast("double"))
        .withColumn("base", F.floor("exact"))
    )
    missing = F.col("n_train") - F.sum("base").over(group)
    by_remainder = group.orderBy((F.col("exact") - F.col("base")).desc(), F.col("label"))
    extra = F.when(F.row_number().over(by_remainder) <= missing, 1).otherwise(0)
    return shared.select("category", "label", "size", (F.col("size") - F.col("base") - extra).cast("bigint").alias("quota"))


def stratified_split(records: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Move a share of the training rows to val, keeping the label mix of each category."""
    keyed = records.withColumn("order_key", order_key("stratified", "path", seed))
    pool = keyed.where("split = 'train'")
    quota = stratified_quota(pool, fraction).select("category", "label", "quota")
    cuts = hash_cuts(pool, ["category", "label"], "order_key", {"held": F.col("quota")}, quota)
    placed = lookup(keyed, cuts.select("category", "label", "held_cut"), ["category", "label"])
    moves = (F.col("split") == "train") & taken("order_key", "held")
    return placed.withColumn("split", F.when(moves, "val").otherwise(F.col("split"))).select(*records.columns)


def keep_anomalies(records: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Keep ``n`` training anomalies per category and drop the others; asking for too many is an error."""
    keyed = records.withColumn("order_key", order_key("keep", "path", seed + 2))
    pool = keyed.where("split = 'train' and label = 1")
    cuts = hash_cuts(pool, ["category"], "order_key", {"kept": F.lit(n)})
    cuts = require(cuts, F.col("n") >= n, F.concat(F.lit(f"fewer than {n} training anomalies in "), F.col("category")))
    placed = lookup(keyed, cuts.select("category", "kept_cut"), ["category"])
    drop = (F.col("split") == "train") & (F.col("label") == 1) & ~taken("order_key", "kept")
    return placed.where(~drop).select(*records.columns)


def cap_preserving_classes(records: DataFrame, keys: list[str], n: int) -> DataFrame:
    """At most ``n`` rows per group, in proportion to the classes and at least one of each: the first of each class by path.

    Of a group with one class the first ``n`` rows stay. The cuts are found from counts of path prefixes of one length.
    """
    keyed = records.withColumn("order_key", F.col("path"))
    sizes = records.groupBy(*keys).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
    total = F.col("pos") + F.col("neg")
    share = F.greatest(F.lit(1), F.least(F.col("pos"), half_even(F.lit(float(n)) * F.col("pos") / total)))
    plan = sizes.withColumn("q_pos", F.when(F.col("pos") * F.col("neg") > 0, share).otherwise(F.least(F.col("pos"), F.lit(n))))
    rest = F.greatest(F.lit(1), F.least(F.col("neg"), F.lit(n) - F.col("q_pos")))
    plan = plan.withColumn("q_neg", F.when(F.col("pos") * F.col("neg") > 0, rest).otherwise(F.least(F.col("neg"), F.lit(n))))
    quota = F.when(total <= n, F.col("pos") + F.col("neg"))
    sides = plan.select(*keys, F.explode(F.array(
        F.struct(F.lit(0).alias("label"), F.coalesce(quota, F.col("q_neg")).alias("quota")),
        F.struct(F.lit(1).alias("label"), F.coalesce(quota, F.col("q_pos")).alias("quota")),
    )).alias("side")).select(*keys, "side.label", "side.quota")
    cuts = hash_cuts(keyed, [*keys, "label"], "order_key", {"kept": F.col("quota")}, sides, text_digits(keyed, "order_key"))
    placed = lookup(keyed, cuts.select(*keys, "label", "kept_cut"), [*keys, "label"])
    return placed.where(taken("order_key", "kept")).select(*records.columns)


def sample_per_source(records: DataFrame, source: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows of each source in hash order."""
    keyed = records.withColumn("order_key", order_key("sample", "path", seed))
    cuts = hash_cuts(keyed, [source], "order_key", {"kept": F.lit(n)})
    placed = lookup(keyed, cuts.select(source, "kept_cut"), [source])
    return placed.where(taken("order_key", "kept")).select(*records.columns)


def fold_assignment(records: DataFrame, keys: list[str], path: str, label: str, folds: int = 5, repeats: int = 1) -> DataFrame:
    """A fold number per row and repeat, spread evenly within each label."""
    repeated = records.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    keyed = repeated.withColumn("order_key", order_key("fold", path, F.col("repeat")))
    placed = hash_positions(keyed, [*keys, "repeat", label], "order_key")
    return placed.withColumn("fold", (F.col("pos") % folds).cast("int")).drop("order_key", "pos", "pos_size")
