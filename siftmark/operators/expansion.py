"""Training rows added to a split: oversampling, synthetic rows, top-ups of scarce defects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftmark.functions.draws import half_even, hash_slot, order_key
from siftmark.operators.joins import lookup
from siftmark.operators.ranking import hash_cuts, hash_positions, taken

# The scenarios that add rows, and the ways to place a synthetic defect.
REPEATING = ("oversample", "asymmetric")
SYNTHETIC = ("cutpaste",)
PLACEMENTS = ("random", "best_match", "duplicate")
DONOR_RULES = ("all", "inside_object")


def uses_record_expansion(scenario: str | None) -> bool:
    return (scenario or "original").lower() in REPEATING + SYNTHETIC


def oversample(records: DataFrame, multiplier: Column | int) -> DataFrame:
    """Each anomaly row ``multiplier`` times, normals once."""
    times = F.greatest(F.lit(1), multiplier if isinstance(multiplier, Column) else F.lit(int(multiplier)))
    repeats = F.when(F.col("label") == 1, times).otherwise(F.lit(1))
    return records.withColumn("copy", F.explode(F.sequence(F.lit(1), repeats.cast("int"))))


def synthetic_from_normals(records: DataFrame, keys: list[str], ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """Rows labelled 1 and tagged ``cutpaste`` whose image is a normal drawn with replacement.

    ``round(max(anomalies, 1) * ratio)`` rows per group. The slots are generated from the anomaly rows
    themselves (row i makes slots i, i + A, i + 2A, ...), so no task makes all slots of a large group.
    """
    sizes = records.groupBy(*keys).agg(
        F.count_if(F.col("label") == 1).alias("n_anom"), F.count_if(F.col("label") == 0).alias("n_norm")
    )
    sizes = sizes.withColumn("n_synth", half_even(F.greatest(F.col("n_anom"), F.lit(1)) * F.lit(float(ratio))))
    sizes = sizes.where((F.col("n_synth") > 0) & (F.col("n_norm") > 0))
    keyed = records.withColumn("order_key", order_key("synthetic", "path", seed))
    anomalies = hash_positions(keyed.where("label = 1"), keys, "order_key").select(*keys, "pos")
    starts = lookup(anomalies, sizes, keys, "inner").unionByName(
        sizes.where("n_anom = 0").withColumn("pos", F.lit(0).cast("bigint")).select(*keys, "pos", "n_anom", "n_norm", "n_synth")
    )
    slots = starts.where(F.col("pos") < F.col("n_synth")).select(
        *keys,
        "n_norm",
        F.explode(F.sequence(F.col("pos"), F.col("n_synth") - 1, F.greatest(F.col("n_anom"), F.lit(1)))).alias("slot"),
    )
    # The draw depends on the group as well as the slot, so groups draw different hosts.
    draws = slots.withColumn("pos", hash_slot("host", F.concat_ws("/", *keys, F.col("slot")), F.col("n_norm"), seed))
    hosts = hash_positions(keyed.where("label = 0"), keys, "order_key").select(*keys, "pos", "path")
    return draws.join(hosts, [*keys, "pos"]).select(*keys, "slot", "path", F.lit(1).alias("label"), F.lit("cutpaste").alias("tag"))


def expand(records: DataFrame, keys: list[str], scenario: str, multiplier: int = 1, ratio: float = 1.0) -> DataFrame:
    """Record expansion by scenario name; scenarios that only change pixels return the records unchanged."""
    name = (scenario or "original").lower()
    tagged = records.withColumn("tag", F.lit(None).cast("string"))
    if name in REPEATING:
        return oversample(tagged, multiplier).drop("copy")
    if name in SYNTHETIC:
        return tagged.unionByName(synthetic_from_normals(records, keys, ratio).drop("slot"), allowMissingColumns=True)
    return tagged


def scarce_groups(records: DataFrame, keys: list[str], target: int, min_defects: int | None = None) -> DataFrame:
    """Groups that get a top-up: defects below the regime threshold, with the number of rows missing.

    ``n_syn`` and, below the threshold, the defects of a group are bounded by the two parameters.
    """
    sizes = records.groupBy(*keys).agg(
        F.count_if(F.col("label") == 1).cast("int").alias("n_donors"), F.count_if(F.col("label") == 0).alias("n_hosts")
    )
    sizes = sizes.withColumn("n_syn", F.greatest(F.lit(0), F.lit(target) - F.col("n_donors")).cast("int"))
    scarce = F.lit(True) if min_defects is None else F.col("n_donors") < min_defects
    reason = (
        F.when(~scarce, "rich regime")
        .when(F.col("n_donors") == 0, "no donor")
        .when(F.col("n_syn") == 0, "target reached")
    )
    return sizes.withColumn("applied", reason.isNull()).withColumn("reason", reason)


def donors_in_order(records: DataFrame, keys: list[str], groups: DataFrame) -> DataFrame:
    """Defects of the groups to be topped up, numbered from 0, with the hosts each one ``need``s; a group has fewer donors than its target."""
    defects = lookup(records.where("label = 1"), groups.where("applied").select(*keys, "n_donors", "n_syn"), keys, "inner")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("path")) - 1
    need = F.ceil(F.col("n_syn") / F.col("n_donors")).cast("int")
    return defects.select(*keys, "path", "n_donors", "n_syn", number.alias("donor_idx"), need.alias("need"))


def duplicate_top_up(records: DataFrame, keys: list[str], groups: DataFrame) -> DataFrame:
    """Copies of real defects, round robin, up to the target; tag ``duplicate``."""
    donors = donors_in_order(records, keys, groups)
    own_slots = F.sequence(F.col("donor_idx"), F.col("n_syn") - 1, F.col("n_donors"))
    return donors.where(F.col("donor_idx") < F.col("n_syn")).select(
        *keys, F.explode(own_slots).alias("slot"), "path", F.lit(1).alias("label"), F.lit("duplicate").alias("tag"), "donor_idx"
    )


def random_top_up(records: DataFrame, keys: list[str], groups: DataFrame, seed: int = 0) -> DataFrame:
    """Normals as hosts of pasted defects: without replacement, or with it if a group has too few."""
    plan = groups.where("applied").select(*keys, "n_syn", F.col("n_hosts"))
    keyed = records.where("label = 0").withColumn("order_key", order_key("host", "path", seed + 3))
    few = plan.where("n_syn > n_hosts and n_hosts > 0")
    enough = plan.where("n_syn <= n_hosts")
    pool = lookup(keyed, enough.select(*keys), keys, "left_semi")
    cuts = hash_cuts(pool, keys, "order_key", {"kept": F.col("n_syn")}, enough)
    once = lookup(pool, cuts.select(*keys, "kept_cut"), keys).where(taken("order_key", "kept"))
    small = hash_positions(lookup(keyed, few.select(*keys), keys, "left_semi"), keys, "order_key")
    slots = few.select(*keys, "n_hosts", F.explode(F.sequence(F.lit(0), F.col("n_syn") - 1)).alias("slot"))
    slots = slots.withColumn("pos", hash_slot("host", F.concat_ws("/", *keys, F.col("slot")), F.col("n_hosts"), seed + 3))
    again = slots.join(small.select(*keys, "pos", "path"), [*keys, "pos"])
    return once.select(*keys, "path").unionByName(again.select(*keys, "path")).select(
        "*", F.lit(1).alias("label"), F.lit("transplant").alias("tag")
    )


def matched_top_up(groups: DataFrame, keys: list[str], ranked_hosts: DataFrame) -> DataFrame:
    """Slots filled with the best-matching hosts: slot j takes donor j mod D and that donor's next host.

    ``ranked_hosts`` (keys, donor_idx, host, host_rank from 0) needs the first ``ceil(n_syn / D)`` hosts
    of a donor, fewer only if the group has fewer; they are used again once all have been used.
    """
    plan = groups.where("applied").select(*keys, "n_donors", "n_hosts", "n_syn")
    slots = plan.select("*", F.explode(F.sequence(F.lit(0), F.col("n_syn") - 1)).alias("slot")).select(
        *keys,
        "slot",
        (F.col("slot") % F.col("n_donors")).cast("int").alias("donor_idx"),
        (F.floor(F.col("slot") / F.col("n_donors")) % F.col("n_hosts")).cast("int").alias("host_rank"),
    )
    return slots.join(ranked_hosts, [*keys, "donor_idx", "host_rank"]).select(
        *keys, "slot", F.col("host").alias("path"), F.lit(1).alias("label"), F.lit("transplant").alias("tag"), "donor_idx"
    )


def donor_rule_groups(records: DataFrame, keys: list[str], groups: DataFrame, rule: str, inside: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """The defects a rule lets through, and the groups with their number and the sorted types of those it keeps out."""
    if rule not in DONOR_RULES:
        raise ValueError(f"unknown donor rule {rule!r}; known: {DONOR_RULES}")
    passes = F.lit(True) if rule == "all" else F.coalesce(F.col(inside), F.lit(False))
    defects = records.where("label = 1")
    excluded = F.lit("") if rule == "all" else F.array_join(F.array_sort(F.collect_set(F.when(~passes, F.col(kind)))), ",")
    counts = defects.groupBy(*keys).agg(F.count_if(passes).cast("int").alias("n_paste_donors"), excluded.alias("excluded_types"))
    judged = groups.join(counts, keys, "left").withColumn("n_paste_donors", F.coalesce("n_paste_donors", F.lit(0))).withColumn("excluded_types", F.coalesce("excluded_types", F.lit("")))
    reason = F.coalesce("reason", F.when(F.col("n_paste_donors") == 0, "no donor passes the donor rule"))
    return defects.where(passes), judged.withColumn("reason", reason).withColumn("applied", F.col("reason").isNull()).withColumn("donor_rule", F.lit(rule))


def top_up(
    records: DataFrame,
    keys: list[str],
    placement: str,
    target: int = 48,
    min_defects: int | None = 20,
    ranked_hosts: DataFrame | None = None,
    seed: int = 0,
    donor_rule: str = "all",
    inside: str = "inside",
    kind: str = "type",
) -> tuple[DataFrame, DataFrame]:
    """Records with the top-up appended, and one row per group that says what was done and why not.

    Rows that carry a tag already are neither donors nor hosts, do not count as defects, and keep their tag. The rule
    ``inside_object`` takes donors whose column ``inside`` is true, and lists the types (``kind``) of the others.
    """
    if placement not in PLACEMENTS:
        raise ValueError(f"unknown placement {placement!r}; known: {PLACEMENTS}")
    tagged = records if "tag" in records.columns else records.withColumn("tag", F.lit(None).cast("string"))
    real = tagged.where("tag is null").drop("tag")
    pasted, groups = donor_rule_groups(real, keys, scarce_groups(real, keys, target, min_defects), donor_rule, inside, kind)
    usable = pasted.unionByName(real.where("label = 0"))
    sized = groups.withColumn("n_donors", F.col("n_paste_donors"))
    if placement == "duplicate":
        added = duplicate_top_up(usable, keys, sized).drop("slot", "donor_idx")
    elif placement == "random":
        added = random_top_up(usable, keys, sized, seed)
    else:
        if ranked_hosts is None:
            raise ValueError("best_match needs ranked hosts")
        added = matched_top_up(sized, keys, ranked_hosts).drop("slot")
    hosts = added.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_synthetic"), F.countDistinct("path").alias("n_distinct_hosts"))
    plan = groups.withColumn("placement", F.lit(placement)).join(hosts, keys, "left")
    counts = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("n_synthetic", "n_distinct_hosts")}
    return tagged.unionByName(added, allowMissingColumns=True), plan.withColumns(counts)
