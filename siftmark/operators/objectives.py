"""Table forms of training objectives: loss, tail margin, view disagreement, session distance, norms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.functions.arrays import squared_distance, unit
from siftmark.functions.scoring import logit_loss
from siftmark.operators.joins import lookup
from siftmark.operators.ranking import running_totals, tally
from siftmark.operators.vectors import means


def mean_loss(scores: DataFrame, keys: list[str], pos_weight: str, score: str = "score") -> DataFrame:
    return scores.groupBy(*keys).agg(F.avg(logit_loss(F.col(score), F.col("label"), F.col(pos_weight))).alias("loss"))


def tail_margin(scores: DataFrame, keys: list[str], beta: float = 0.1, margin: float = 1.0, score: str = "score") -> DataFrame:
    """Mean over defects and the hardest normals of ``max(0, margin - (defect - normal))`` squared.

    A pair counts only if the normal lies above ``defect - margin``, and its square expands into sums of
    1, s and s*s over those normals. So one running total over both kinds of events, from the highest
    score down, replaces the pairs. 0 for a group without defects or normals.
    """
    rows = scores.select(*keys, F.col(score).cast("double").alias("score"), "label")
    sizes = rows.groupBy(*keys).agg(F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg"))
    k = F.greatest(F.lit(1), F.ceil(F.lit(float(beta)) * F.col("n_total"))).cast("bigint")
    normals = tally(rows.where("label = 0"), keys, "score", {"n": F.lit(1)})
    ranked = running_totals(normals, keys, "score", ["n"], descending=True, source=rows.select("score"))
    kept = F.greatest(F.least(F.col("n"), k - (F.col("n_cum") - F.col("n"))), F.lit(0))
    hard = ranked.select(*keys, F.col("score").alias("at"), kept.alias("c"), F.lit(0).cast("bigint").alias("d")).where("c > 0")
    defects = tally(rows.where("label = 1"), keys, "score", {"d": F.lit(1)})
    wanted = defects.select(*keys, (F.col("score") - F.lit(float(margin))).alias("at"), F.lit(0).cast("bigint").alias("c"), "d")
    events = hard.unionByName(wanted).groupBy(*keys, "at").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    events = events.withColumn("s", F.col("c") * F.col("at")).withColumn("q", F.col("c") * F.col("at") * F.col("at"))
    summed = running_totals(events, keys, "at", ["c", "s", "q"], descending=True)
    # At a defect's own point the normals exactly there contribute nothing, so including them is harmless.
    loss = F.col("d") * (F.col("q_cum") - F.lit(2.0) * F.col("at") * F.col("s_cum") + F.col("at") * F.col("at") * F.col("c_cum"))
    found = summed.groupBy(*keys).agg(F.sum(loss).alias("loss"), F.max("c_total").alias("k"))
    out = sizes.join(found, keys, "left")
    value = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("loss") / (F.col("n_pos") * F.col("k")))
    return out.select(*keys, F.coalesce(value, F.lit(0.0)).alias("tail_margin"))


def view_disagreement(scores: DataFrame, keys: list[str], views: str, other: int) -> DataFrame:
    """Mean squared difference between view 0 and another view."""
    gap = F.col(views)[0] - F.col(views)[other]
    return scores.groupBy(*keys).agg(F.avg(gap * gap).alias("disagreement"))


def session_alignment(rows: DataFrame, keys: list[str], features: str, from_test: Column) -> DataFrame:
    """Mean squared distance of test-session normals to the centroid of training-session normals.

    Features are scaled to length one; defects take no part. The centroid is the plain mean.
    """
    normals = rows.where("label = 0").select(*keys, unit(F.col(features)).alias("u"), from_test.alias("_test"))
    centre = means(normals.where(~F.col("_test")), keys, "u", "_centre")
    other = lookup(normals.where("_test"), centre, keys)
    return other.groupBy(*keys).agg(
        F.avg(squared_distance(F.col("u"), F.col("_centre"))).alias("alignment"), F.count("_centre").alias("n_aligned")
    )


def prefix_norms(values: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """L2 norm per leading part of a dotted name, and over all names of a group (layer ``global``)."""
    layered = values.withColumn("layer", F.substring_index(F.col(name), ".", 1))
    sums = layered.groupBy(*keys, "layer").agg(F.sum(F.col(value) * F.col(value)).alias("sq"))
    whole = sums.groupBy(*keys).agg(F.sum("sq").alias("sq")).withColumn("layer", F.lit("global"))
    return sums.unionByName(whole).select(*keys, "layer", F.sqrt("sq").alias("norm"))
