"""Measures of small grids stored as row-major arrays, and drift of feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftmark.functions.arrays import distance, let, mean
from siftmark.operators.joins import lookup
from siftmark.operators.vectors import means

# Grey levels, bins of the density descriptor, and guards of the ratios.
GREY_LEVELS = 256
DENSITY_BINS = 16
CONTRAST_FLOOR = 1e-6
RETENTION_MIN, AREA_KEPT_MIN = 0.6, 0.5
DRIFT_MAX = 0.95
OUTLINE_SHARE_MAX = 0.10


def luminance(r: Column, g: Column, b: Column) -> Column:
    return F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b


def gray(r: Column, g: Column, b: Column) -> Column:
    return (r + g + b) / F.lit(3.0)


def variance(values: Column) -> Column:
    """Population variance of an array."""

    def around(centre: Column, of: Column) -> Column:
        return mean(F.transform(of, lambda v: (v.cast("double") - centre) * (v.cast("double") - centre)))

    return let(values, lambda of: let(mean(of), lambda centre: around(centre, of)))


def wrapping_laplacian(grid: Column, width: int, height: int) -> Column:
    """Four-neighbour Laplacian whose edges wrap around."""

    def of(g: Column) -> Column:
        def at(row: Column, col: Column) -> Column:
            return F.get(g, (F.pmod(row, F.lit(height)) * width + F.pmod(col, F.lit(width))).cast("int")).cast("double")

        def cell(value: Column, i: Column) -> Column:
            row, col = F.floor(i / width), i % width
            return F.lit(-4.0) * value.cast("double") + at(row - 1, col) + at(row + 1, col) + at(row, col - 1) + at(row, col + 1)

        return F.transform(g, cell)

    return let(grid, of)


def hf_energy(grid: Column, width: int, height: int) -> Column:
    return variance(wrapping_laplacian(grid, width, height))


def local_contrast(grid: Column, width: int, height: int, k: int = 8) -> Column:
    """Mean deviation of the k-by-k tiles; the deviation of the whole grid if it is smaller than a tile."""
    across, down = width // k, height // k
    if across == 0 or down == 0:
        return F.sqrt(variance(grid))

    def of(g: Column) -> Column:
        def tile(t: Column) -> Column:
            top, left = F.floor(t / across) * k, (t % across) * k
            cells = F.transform(
                F.sequence(F.lit(0), F.lit(k * k - 1)),
                lambda j: F.get(g, ((top + F.floor(j / k)) * width + left + j % k).cast("int")).cast("double"),
            )
            return F.sqrt(variance(cells))

        return mean(F.transform(F.sequence(F.lit(0), F.lit(across * down - 1)), tile))

    return let(grid, of)


def density_histogram(grid: Column, bins: int = DENSITY_BINS, low: float = 0.0, high: float = 255.0) -> Column:
    """Share of values per bin over the bin width; the last bin is closed, values outside are left out."""
    width = (high - low) / bins
    inside = F.filter(grid, lambda v: (v >= low) & (v <= high))
    placed = F.transform(inside, lambda v: F.least(F.floor((v.cast("double") - low) / width), F.lit(bins - 1)))

    def shares(places: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(bins - 1)),
            lambda b: F.coalesce(F.try_divide(F.size(F.filter(places, lambda p: p == b)).cast("double"), F.size(places) * F.lit(width)), F.lit(0.0)),
        )

    return let(placed, shares)


def descriptor(grid: Column, width: int, height: int, k: int = 8) -> Column:
    """Twenty numbers: scaled mean, deviation, log energy, contrast, and the density histogram."""
    head = F.array(
        mean(grid) / 255.0,
        F.sqrt(variance(grid)) / 255.0,
        F.log1p(hf_energy(grid, width, height)) / 10.0,
        local_contrast(grid, width, height, k) / 255.0,
    )
    return F.concat(head, density_histogram(grid))


def dilate(mask: Column, width: int, height: int, reach: int) -> Column:
    """Square dilation of a boolean grid: first along rows, then along columns."""
    steps = F.array(*[F.lit(d * width) for d in range(-reach, reach + 1)])

    def wide(m: Column) -> Column:
        def along_row(value: Column, i: Column) -> Column:
            start = F.greatest(i - reach, i - i % width)
            end = F.least(i + reach, i - i % width + (width - 1))
            return F.exists(F.slice(m, (start + 1).cast("int"), (end - start + 1).cast("int")), lambda v: v)

        return F.transform(m, along_row)

    def tall(rows: Column) -> Column:
        def along_column(value: Column, i: Column) -> Column:
            return F.exists(steps, lambda d: F.coalesce(F.when((i + d >= 0) & (i + d < width * height), F.get(rows, i + d)), F.lit(False)))

        return F.transform(rows, along_column)

    return let(let(mask, wide), tall)


def ring(mask: Column, width: int, height: int, reach: int) -> Column:
    """Cells within ``reach`` of the mask that are not in it."""
    return let(mask, lambda m: F.zip_with(dilate(m, width, height, reach), m, lambda outer, inner: outer & ~inner))


def masked_contrast(grid: Column, mask: Column) -> Column:
    """|mean inside - mean outside|; NULL if either side is empty."""
    pairs = F.zip_with(grid, mask, lambda v, m: F.struct(v.cast("double").alias("v"), m.alias("m")))

    def side(flag: bool) -> Column:
        chosen = F.filter(pairs, lambda p: p["m"] == F.lit(flag))
        return mean(F.transform(chosen, lambda p: p["v"]))

    return F.abs(side(True) - side(False))


def cells_set(mask: Column) -> Column:
    return F.size(F.filter(mask, lambda m: m))


def retention(before: Column, after: Column) -> Column:
    """After over before; 1 where there was nothing to keep."""
    return F.when(before > CONTRAST_FLOOR, after / before).otherwise(F.lit(1.0))


def defect_retention(before: Column, after: Column, mask: Column, width: int, height: int) -> Column:
    """Did the defect survive: by masked contrast, or by energy if the mask is empty or full."""
    by_mask = retention(masked_contrast(before, mask), masked_contrast(after, mask))
    by_energy = retention(hf_energy(before, width, height), hf_energy(after, width, height))
    usable = (cells_set(mask) > 0) & (cells_set(mask) < F.size(mask))
    return F.when(usable, by_mask).otherwise(by_energy)


def paired_retention(before: Column, after: Column, mask_before: Column, mask_after: Column) -> Column:
    """Retention, share of the defect area kept, and the verdict, with a mask that moved along."""
    n0, n1 = cells_set(mask_before), cells_set(mask_after)
    gone = (n0 == 0) | (n1 == 0)
    kept = F.try_divide(n1.cast("double"), n0)
    c0, c1 = F.coalesce(masked_contrast(before, mask_before), F.lit(0.0)), F.coalesce(masked_contrast(after, mask_after), F.lit(0.0))
    held = F.when(gone, F.lit(0.0)).otherwise(retention(c0, c1))
    return F.struct(
        held.alias("retention"),
        F.when(~gone, kept).alias("area_kept"),
        (~gone & (held >= RETENTION_MIN) & (kept >= AREA_KEPT_MIN)).alias("passed"),
    )


def inside_object(mask: Column, outline: Column, foreground: Column) -> Column:
    """True if at most a tenth of the mask lies in the outline band; an all-object grid or empty mask passes."""
    overlap = cells_set(F.zip_with(mask, outline, lambda m, o: m & o)).cast("double")
    share = F.try_divide(overlap, cells_set(mask))
    return F.forall(foreground, lambda f: f) | F.coalesce(share <= OUTLINE_SHARE_MAX, F.lit(True))


def otsu(grids: DataFrame, item: str, grid: str) -> DataFrame:
    """Threshold with the largest between-class variance per grid of grey levels 0..255.

    Works on the at most 256 filled bins of each grid; the lowest bin wins a tie, and empty bins repeat
    the value of the filled bin below them.
    """
    pixels = grids.select(item, F.explode(grid).alias("v"))
    level = F.least(F.floor("v"), F.lit(GREY_LEVELS - 1)).cast("int")
    counted = pixels.where(F.col("v").between(0, GREY_LEVELS)).groupBy(item, level.alias("level")).agg(F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy(item)
    upto = whole.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("c").over(whole).cast("double")
    weight = F.sum("c").over(upto) / total
    moment = F.sum(F.col("c") * F.col("level")).over(upto) / total
    all_moment = F.sum(F.col("c") * F.col("level")).over(whole) / total
    between = F.try_divide(F.pow(all_moment * weight - moment, F.lit(2.0)), weight * (F.lit(1.0) - weight))
    placed = counted.select(item, "level", between.alias("between"))
    best = F.max(F.when(F.col("between").isNotNull(), F.struct("between", (-F.col("level")).alias("low"))))
    return placed.groupBy(item).agg((-best["low"]).cast("double").alias("threshold"))


def centroid_drift(rows: DataFrame, keys: list[str], features: str, role: str = "role") -> DataFrame:
    """How close augmented normals sit to the anomaly centroid, against how close real normals do.

    ``role`` is augmented, normal or anomaly.
    """
    centres = means(rows.where(F.col(role).isin("normal", "anomaly")), [*keys, role], features)

    def centre(name: str) -> Column:
        return F.first(F.when(F.col(role) == name, F.col("centroid")), ignorenulls=True)

    wide = centres.groupBy(*keys).agg(centre("normal").alias("_cn"), centre("anomaly").alias("_ca"))
    judged = lookup(rows.where(F.col(role).isin("augmented", "normal")), wide, keys)
    to_normal, to_anomaly = distance(F.col(features), F.col("_cn")), distance(F.col(features), F.col("_ca"))

    def mean_of(name: str, value: Column) -> Column:
        return F.avg(F.when(F.col(role) == name, value))

    found = judged.groupBy(*keys).agg(
        mean_of("augmented", to_normal).alias("d_n"),
        mean_of("augmented", to_anomaly).alias("d_a"),
        mean_of("normal", to_normal).alias("b_n"),
        mean_of("normal", to_anomaly).alias("b_a"),
    )
    ratio = F.when(F.col("d_a") > 1e-9, F.col("d_n") / F.col("d_a"))
    return found.select(
        *keys,
        ratio.alias("drift_ratio"),
        (F.col("b_n") / F.greatest(F.col("b_a"), F.lit(1e-9))).alias("baseline_ratio"),
        (ratio <= DRIFT_MAX).alias("passed"),
    )
