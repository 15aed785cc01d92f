"""Check tables: one row per check with PASS, WARN or FAIL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_rows(table: DataFrame, keys: list[str], checks: dict[str, Column], warn: tuple[str, ...] = ()) -> DataFrame:
    """Boolean expressions over a table of one row per group, as rows (keys, check, status)."""
    each = [
        F.struct(
            F.lit(name).alias("check"),
            F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("WARN" if name in warn else "FAIL").alias("status"),
        )
        for name, ok in checks.items()
    ]
    return table.select(*keys, F.explode(F.array(*each)).alias("c")).select(*keys, "c.check", "c.status")


def tally_checks(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of each status, the verdict, and the failed checks by name."""
    failed = F.array_sort(F.collect_set(F.when(F.col("status") == "FAIL", F.col("check"))))
    return checks.groupBy(*keys).agg(
        F.count_if(F.col("status") == "PASS").alias("n_pass"),
        F.count_if(F.col("status") == "WARN").alias("n_warn"),
        F.count_if(F.col("status") == "FAIL").alias("n_fail"),
        F.bool_and(F.col("status") != "FAIL").alias("ok"),
        F.array_join(failed, ",").alias("failed"),
    )


def layout_checks(records: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Structural checks per expected category: present, injected, both classes in train and val."""
    train, val = F.col("split") == "train", F.col("split") == "val"
    found = records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(train & (F.col("label") == 1)).alias("train_defects"),
        F.count_if(train & (F.col("label") == 0)).alias("train_normals"),
        F.count_if(val & (F.col("label") == 1)).alias("val_defects"),
        F.count_if(val & (F.col("label") == 0)).alias("val_normals"),
    )
    table = expected.join(found, keys, "left")
    return check_rows(
        table,
        keys,
        {
            "category present": F.col("rows") > 0,
            "injection moved a defect": F.col("train_defects") + F.col("val_defects") > 0,
            "train has both classes": (F.col("train_defects") > 0) & (F.col("train_normals") > 0),
            "val has both classes": (F.col("val_defects") > 0) & (F.col("val_normals") > 0),
        },
        warn=("val has both classes",),
    )


def union_all(*tables: DataFrame) -> DataFrame:
    """Check tables of the same shape as one."""
    return reduce(lambda a, b: a.unionByName(b), tables)
