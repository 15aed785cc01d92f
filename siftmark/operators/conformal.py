"""Split-conformal alarm lines and the operating points they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.functions.paths import from_test_folder, is_test_good
from siftmark.functions.scoring import conformal_rank, precision_at_prevalence
from siftmark.operators.joins import lookup, null_safe_lookup
from siftmark.operators.metrics import class_counts
from siftmark.operators.ranking import running_totals, tally


def like_for_like(scores: DataFrame, datasets: list[str]) -> DataFrame:
    """Drop test normals that did not come from the test folder, in the named datasets only."""
    foreign = (F.col("split") == "test") & (F.col("label") == 0) & ~is_test_good(F.col("path"))
    return scores.where(~(F.col("dataset").isin(datasets) & foreign))


def like_for_like_counts(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Test rows before and after the like-for-like rule, and whether both classes remain."""
    kept = (F.col("label") == 1) | from_test_folder(F.col("path"))
    return (
        scores.where("split = 'test'")
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_all"),
            F.count_if(kept).alias("n_kept"),
            F.count_if(kept & (F.col("label") == 0)).alias("n_normals_kept"),
            (F.max(F.when(kept, F.col("label"))) > F.min(F.when(kept, F.col("label")))).alias("both_classes"),
        )
    )


def placed_scores(scores: DataFrame, keys: list[str], score: str, buckets: int | None = None) -> DataFrame:
    """Distinct scores per group and split with running class counts from the lowest score up."""
    rows = scores.select(*keys, "split", F.col(score).alias("score"), "label")
    counted = tally(rows, [*keys, "split"], "score", class_counts())
    return running_totals(counted, [*keys, "split"], "score", ["pos", "neg"], buckets=buckets, source=rows.select("score"))


def lines_of(placed: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """The line of each group: the conformal rank among normals of calib, or of val if calib is empty."""
    return _lines_of(placed, keys, {"line": alpha})


def _lines_of(placed: DataFrame, keys: list[str], alphas: dict[str, float]) -> DataFrame:
    """One line column for each named level.

    NULL if there are too few normals for the rank. Other splits are passed over inside the aggregate,
    not filtered out, so that a caller who also needs them shares the shuffles behind ``placed``.
    """

    def line(split: str, alpha: float) -> Column:
        rank = conformal_rank(F.col("neg_total"), alpha)
        at_rank = (F.col("neg_cum") >= rank) & (F.col("neg_cum") - F.col("neg") < rank)
        return F.max(F.when(at_rank & (F.col("split") == split), F.col("score")))

    def rows_of(split: str, total: str) -> Column:
        return F.max(F.when(F.col("split") == split, F.col(total)))

    def chosen(total: str) -> Column:
        return F.coalesce(F.when(has_calib, rows_of("calib", total)).otherwise(rows_of("val", total)), F.lit(0))

    has_calib = F.coalesce(F.sum(F.when(F.col("split") == "calib", F.col("pos") + F.col("neg"))), F.lit(0)) > 0
    return (
        placed.groupBy(*keys)
        .agg(
            *[F.when(has_calib, line("calib", a)).otherwise(line("val", a)).alias(name) for name, a in alphas.items()],
            chosen("neg_total").alias("n_normals"),
            chosen("pos_total").alias("n_defects"),
            F.when(has_calib, F.lit("calib")).otherwise(F.lit("val")).alias("threshold_split"),
        )
    )


def conformal_lines(
    scores: DataFrame, keys: list[str], alpha: float = 0.05, score: str = "score", buckets: int | None = None
) -> DataFrame:
    """Lines straight from scores; see ``lines_of``."""
    normals = scores.where("split in ('val', 'calib')")
    return lines_of(placed_scores(normals, keys, score, buckets), keys, alpha)


def operating_points(
    scores: DataFrame, keys: list[str], alpha: float = 0.05, score: str = "score", buckets: int | None = None
) -> DataFrame:
    """Per group: line, size of its threshold set, false-alarm rate, recall, precision at 5 % prevalence, AUROC."""
    return operating_points_at(scores, keys, [alpha], score, buckets).drop("alpha")


def operating_points_at(
    scores: DataFrame, keys: list[str], alphas: list[float], score: str = "score", buckets: int | None = None
) -> DataFrame:
    """``operating_points`` at several false-alarm levels: a row per group and ``alpha``, all read off one placement."""
    placed = placed_scores(scores, keys, score, buckets)
    lines = {f"_line_{i}": float(a) for i, a in enumerate(alphas)}
    # Every group has a line row.
    judged = null_safe_lookup(placed, _lines_of(placed, keys, lines), keys, "inner")
    test = F.col("split") == "test"

    def of_test(total: str) -> Column:
        return F.max(F.when(test, F.col(total)))

    def share(count: str, line: str) -> Column:
        over = test & (F.col("score") > F.col(line))
        hit = F.sum(F.when(over, F.col(count)).otherwise(0)).cast("double")
        return F.when(F.max(line).isNotNull(), F.try_divide(hit, of_test(f"{count}_total")))

    def level(line: str, alpha: float) -> Column:
        return F.struct(
            F.lit(alpha).alias("alpha"), F.max(line).alias("line"),
            share("neg", line).alias("false_alarms"), share("pos", line).alias("recall"),
        )

    below = (F.col("neg_cum") - F.col("neg")).cast("double") + F.col("neg") / F.lit(2.0)
    pairs = of_test("pos_total").cast("double") * of_test("neg_total").cast("double")
    points = judged.groupBy(*keys).agg(
        F.array(*[level(name, a) for name, a in lines.items()]).alias("_levels"),
        F.max("n_normals").alias("n_normals"),
        F.max("n_defects").alias("n_defects"),
        F.try_divide(F.sum(F.when(test, F.col("pos") * below)), pairs).alias("auroc"),
    )
    points = points.withColumn("_level", F.explode("_levels")).select(
        *keys, "_level.alpha", "_level.line", "n_normals", "n_defects", "_level.false_alarms", "_level.recall", "auroc"
    )
    return points.withColumn("precision_5", precision_at_prevalence(F.col("recall"), F.col("false_alarms")))


def headline(points: DataFrame) -> DataFrame:
    """Mean over seeds, then over categories, per dataset; undefined values are skipped and counted."""
    by_category = points.groupBy("dataset", "category").agg(
        F.avg("false_alarms").alias("false_alarms"), F.avg("recall").alias("recall"), F.avg("auroc").alias("auroc")
    )
    return by_category.groupBy("dataset").agg(
        F.avg("false_alarms").alias("false_alarms"),
        F.avg("recall").alias("recall"),
        F.avg("auroc").alias("auroc"),
        F.count("false_alarms").alias("categories_with_line"),
        F.count(F.lit(1)).alias("categories"),
    )


def alarms(scores: DataFrame, lines: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Rows strictly above their group's line, with the margin."""
    joined = lookup(scores, lines.select(*keys, "line"), keys)
    return joined.where(F.col(score) > F.col("line")).withColumn("margin", F.col(score) - F.col("line"))
