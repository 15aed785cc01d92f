"""Leak checks: no path in two splits, added rows drawn from training only, labels unchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.operators.joins import require

# The pairs of splits that must be disjoint.
PAIRS = [("train", "test"), ("train", "val"), ("val", "test"), ("calib", "train"), ("calib", "val"), ("calib", "test")]


def shared_paths(records: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """Paths that lie in more than one split: one grouping, whatever the number of splits."""
    return (
        records.groupBy(*keys, path)
        .agg(F.array_sort(F.collect_set("split")).alias("splits"))
        .where(F.size("splits") > 1)
    )


def leak_counts(records: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """Per group and pair of splits: how many paths both hold, and the first of them."""
    found = shared_paths(records, keys, path)
    both = [F.array(F.lit(a), F.lit(b)) for a, b in PAIRS]
    pairs = F.filter(F.array(*both), lambda p: F.array_contains(F.col("splits"), p[0]) & F.array_contains(F.col("splits"), p[1]))
    return (
        found.select(*keys, path, F.explode(pairs).alias("pair"))
        .groupBy(*keys, F.array_join("pair", "+").alias("pair"))
        .agg(F.count(F.lit(1)).alias("n_shared"), F.min(path).alias("example"))
    )


def assert_no_leak(records: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """The records, once per path and split, unless a path is in two splits: then the job fails."""
    marked = records.groupBy(*keys, path).agg(F.collect_set("split").alias("splits"))
    clean = require(marked, F.size("splits") <= 1, F.concat(F.lit("path in two splits: "), F.col(path)))
    return clean.select(*keys, path, F.col("splits")[0].alias("split"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many distinct keys two tables share."""
    return a.select(key).intersect(b.select(key)).agg(F.count(F.lit(1)).alias("n_shared"))


def key_difference(a: DataFrame, b: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """Every distinct key of two runs with the side it is on: both, only_a or only_b; with ``strict`` no common key is an error."""
    sides = a.select(*keys, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        b.select(*keys, F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    side = F.when(F.max("a") + F.max("b") == 2, "both").when(F.max("a") == 1, "only_a").otherwise("only_b")
    found = sides.groupBy(*keys).agg(side.alias("side"))
    if not strict:
        return found
    common = found.agg(F.count_if(F.col("side") == "both").alias("n")).scalar()
    return require(found, common > 0, "the two runs share no key")


def donor_audit(records: DataFrame, synthetic: DataFrame, planned: DataFrame, keys: list[str]) -> DataFrame:
    """Check added rows per group: donors are training defects, hosts training normals, counts as planned.

    ``synthetic`` has ``host`` and ``donor`` paths, ``planned`` the number of rows meant to be added.
    """
    train_defects = records.where("split = 'train' and label = 1").select(*keys, F.col("path").alias("donor"))
    train_normals = records.where("split = 'train' and label = 0").select(*keys, F.col("path").alias("host"))
    foreign_donors = synthetic.join(train_defects, [*keys, "donor"], "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("foreign_donors"))
    foreign_hosts = synthetic.join(train_normals, [*keys, "host"], "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("foreign_hosts"))
    added = synthetic.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_synthetic"))
    shared = shared_paths(records, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("shared_files"))
    out = planned
    for part in (added, foreign_donors, foreign_hosts, shared):
        out = out.join(part, keys, "left")
    counts = ["n_synthetic", "foreign_donors", "foreign_hosts", "shared_files"]
    out = out.select(*planned.columns, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts])
    clean = (F.col("foreign_donors") == 0) & (F.col("foreign_hosts") == 0) & (F.col("shared_files") == 0)
    return out.withColumn("ok", clean & (F.col("n_synthetic") == F.col("planned")))


def evaluation_overlap(records: DataFrame, synthetic: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: files of val, test and calib that training, a donor or a host also uses, files in both val and test, tagged rows.

    ``records`` may carry ``tag`` (the name of the step that made a row); a tagged row must not be in an evaluation
    split. ``synthetic`` has ``host`` and ``donor`` paths. All sides meet in one grouping by path, so no set is held in
    memory and a file used as donor a million times is counted map-side. Rows without a path name no file.
    """
    tagged = F.col("tag").isNotNull() if "tag" in records.columns else F.lit(False)
    evaluated = F.coalesce(F.col("split").isin("val", "test", "calib"), F.lit(False))
    files = records.select(
        *keys, "path", F.col("split").eqNullSafe("train").alias("used"), F.col("split").eqNullSafe("val").alias("in_val"),
        F.col("split").eqNullSafe("test").alias("in_test"), evaluated.alias("judged"), (evaluated & tagged).cast("bigint").alias("tagged"),
    )
    no = F.lit(False)
    sides = F.explode(F.array("host", "donor"))
    borrowed = synthetic.select(*keys, sides.alias("path")).select(
        *keys, "path", F.lit(True).alias("used"), no.alias("in_val"), no.alias("in_test"), no.alias("judged"), F.lit(0).cast("bigint").alias("tagged")
    )
    flags = [F.bool_or(c).alias(c) for c in ("used", "in_val", "in_test", "judged")]
    by_file = files.unionByName(borrowed).groupBy(*keys, "path").agg(*flags, F.sum("tagged").alias("tagged"))
    named = F.col("path").isNotNull()
    shared, twice = named & F.col("used") & F.col("judged"), named & F.col("in_val") & F.col("in_test")
    out = by_file.groupBy(*keys).agg(
        F.count_if(shared).alias("shared_with_training"),
        F.count_if(twice).alias("in_val_and_test"),
        F.min(F.when(shared | twice, F.col("path"))).alias("example"),
        F.sum("tagged").alias("tagged_evaluation_rows"),
    )
    clean = (F.col("shared_with_training") == 0) & (F.col("in_val_and_test") == 0) & (F.col("tagged_evaluation_rows") == 0)
    return out.withColumn("ok", clean)


def missing_counterparts(items: DataFrame, present: DataFrame, counterpart: Column, keys: list[str], strict: bool = False) -> DataFrame:
    """Per group the items whose counterpart path (such as a mask) is not among the present paths; with ``strict`` one is an error."""
    wanted = items.withColumn("counterpart", counterpart)
    missing = wanted.join(present.select(F.col("path").alias("counterpart")), "counterpart", "left_anti")
    found = missing.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_missing"), F.min("counterpart").alias("example"))
    return require(found, F.lit(False), F.concat(F.col("n_missing").cast("string"), F.lit(" missing, such as "), "example")) if strict else found


def label_integrity(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: normals added, synthetic rows with the wrong label, real rows whose label changed."""

    def counts(df: DataFrame, suffix: str) -> DataFrame:
        return df.groupBy(*keys).agg(
            F.count_if(F.col("label") == 0).alias(f"normal_{suffix}"), F.count_if(F.col("label") == 1).alias(f"anomaly_{suffix}")
        )

    synthetic = after.groupBy(*keys).agg(
        F.count_if(F.col("tag").isNotNull()).alias("synthetic"),
        F.count_if(F.col("tag").isNotNull() & (F.col("label") != 1)).alias("mislabelled"),
    )
    was = before.select(*keys, "path", F.col("label").alias("label_before")).distinct()
    flipped = (
        after.where("tag is null")
        .join(was, [*keys, "path"])
        .groupBy(*keys)
        .agg(F.count_if(F.col("label") != F.col("label_before")).alias("flipped"))
    )
    out = counts(before, "before").join(counts(after, "after"), keys).join(synthetic, keys).join(flipped, keys, "left")
    out = out.withColumn("flipped", F.coalesce("flipped", F.lit(0)).cast("bigint"))
    passed = (F.col("normal_after") <= F.col("normal_before")) & (F.col("mislabelled") == 0) & (F.col("flipped") == 0)
    return out.withColumn("passed", passed)
