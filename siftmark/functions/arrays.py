"""Functions on array columns: pooling, norms, distances."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Numeric guards of the pooling functions.
GEM_FLOOR, GEM_P_MIN, GEM_P_MAX = 1e-6, 1.0, 10.0
LSE_P_MIN = 1e-4


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once per row.

    An expression used inside a lambda is computed again for every element; bound this way it is not.
    """
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v.cast("double"))


def mean(values: Column) -> Column:
    return F.try_divide(total(values), F.size(values))


def avg_max(values: Column) -> Column:
    """Average and maximum side by side."""
    return F.array(mean(values), F.array_max(values).cast("double"))


def generalised_mean(values: Column, p: float = 3.0) -> Column:
    """Power mean; values are floored and the exponent is held in its range."""
    p = min(max(float(p), GEM_P_MIN), GEM_P_MAX)
    powered = F.transform(values, lambda v: F.pow(F.greatest(v.cast("double"), F.lit(GEM_FLOOR)), F.lit(p)))
    return F.pow(mean(powered), F.lit(1.0 / p))


def log_sum_exp(values: Column, p: float = 1.0) -> Column:
    """Smooth maximum, shifted by the largest value so that ``exp`` cannot overflow."""
    p = max(float(p), LSE_P_MIN)

    def shifted_by(top: Column) -> Column:
        powers = F.transform(values, lambda v: F.exp(F.lit(p) * (v.cast("double") - top)))
        return top + (F.log(total(powers)) - F.log(F.size(values).cast("double"))) / F.lit(p)

    return let(F.array_max(values).cast("double"), shifted_by)


def attention(values: Column, scores: Column) -> Column:
    """Sum of values weighted by the softmax of a score array of the same length."""

    def averaged(weights: Column) -> Column:
        return total(F.zip_with(values, weights, lambda v, w: v.cast("double") * w)) / total(weights)

    def softmax(top: Column) -> Column:
        return F.transform(scores, lambda s: F.exp(s.cast("double") - top))

    return let(let(F.array_max(scores).cast("double"), softmax), averaged)


POOLS: dict[str, Callable[..., Column]] = {
    "avg": mean,
    "max": lambda values: F.array_max(values).cast("double"),
    "avgmax": avg_max,
    "gem": generalised_mean,
    "lse": log_sum_exp,
    "attention": attention,
}


def pool(kind: str, *args, **kwargs) -> Column:
    """Dispatch by pooling name; an unknown name is an error."""
    if kind not in POOLS:
        raise ValueError(f"unknown pooling {kind!r}; known: {sorted(POOLS)}")
    return POOLS[kind](*args, **kwargs)


def top_fraction_mean(values: Column, fraction: float) -> Column:
    """Mean of the largest ``max(1, ceil(fraction * n))`` values."""
    k = F.greatest(F.lit(1), F.ceil(F.lit(float(fraction)) * F.size(values))).cast("int")
    largest = F.slice(F.sort_array(values, asc=False), F.lit(1), k)
    return total(largest) / k


def norm(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def unit(values: Column, eps: float = 1e-12) -> Column:
    """The array scaled to length one."""
    return let(F.greatest(norm(values), F.lit(eps)), lambda length: F.transform(values, lambda v: v.cast("double") / length))


def squared_distance(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g * g)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def max_abs_difference(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def composite(inside: Column, outside: Column, mask: Column) -> Column:
    """``inside`` where the mask is 1, ``outside`` where it is 0, a blend between."""
    pairs = F.zip_with(inside, outside, lambda a, b: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b")))
    return F.zip_with(pairs, mask, lambda p, m: p["a"] * m + p["b"] * (F.lit(1.0) - m))


def has_random_step(steps: Column) -> Column:
    """True if an augmentation list holds a step that draws random numbers."""
    return F.exists(steps, lambda s: s.rlike("^Random") | s.rlike("Jitter"))


# Arguments, type and body of the pooling functions for SQL text, after ``register_sql_functions``.
SQL_FUNCTIONS = {
    "pool_avg": ("x ARRAY<DOUBLE>", "DOUBLE", "try_divide(aggregate(x, 0D, (a, v) -> a + v), size(x))"),
    "pool_max": ("x ARRAY<DOUBLE>", "DOUBLE", "array_max(x)"),
    "pool_avgmax": ("x ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "array(try_divide(aggregate(x, 0D, (a, v) -> a + v), size(x)), array_max(x))"),
    "pool_gem": (
        "x ARRAY<DOUBLE>, p DOUBLE DEFAULT 3D",
        "DOUBLE",
        f"power(try_divide(aggregate(x, 0D, (a, v) -> a + power(greatest(v, {GEM_FLOOR}D), least(greatest(p, {GEM_P_MIN}D), {GEM_P_MAX}D))), size(x)),"
        f" 1D / least(greatest(p, {GEM_P_MIN}D), {GEM_P_MAX}D))",
    ),
    "pool_lse": (
        "x ARRAY<DOUBLE>, p DOUBLE DEFAULT 1D",
        "DOUBLE",
        f"array_max(x) + (ln(aggregate(x, array_max(x), (a, v) -> a, a -> aggregate(x, 0D, (b, v) -> b + exp(greatest(p, {LSE_P_MIN}D) * (v - a))))) - ln(size(x)))"
        f" / greatest(p, {LSE_P_MIN}D)",
    ),
    "pool_attention": (
        "x ARRAY<DOUBLE>, scores ARRAY<DOUBLE>",
        "DOUBLE",
        "aggregate(transform(array(array_max(scores)), top -> transform(scores, s -> exp(s - top)))[0], 0D, (a, w) -> a + w, "
        "total -> aggregate(zip_with(x, transform(array(array_max(scores)), top -> transform(scores, s -> exp(s - top)))[0], (v, w) -> v * w), 0D, (a, v) -> a + v) / total)",
    ),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Make every pool of ``POOLS`` callable from SQL in this session, as ``pool_<name>``."""
    for name, (arguments, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return sorted(SQL_FUNCTIONS)
