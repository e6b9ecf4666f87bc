"""Differences between two states, keyed: full outer joins, anti joins, ordered run-to-run deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def changed_rows(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """IMP-06, IMP-10, JOIN-05: key, change (added, removed, changed); equal rows are left out. Null values compare equal."""
    a = before.select(*key, F.col(value).alias("was"), F.lit(True).alias("in_a"))
    b = after.select(*key, F.col(value).alias("now"), F.lit(True).alias("in_b"))
    out = a.join(b, key, "full_outer").withColumn("change", F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed"))
    return out.where("change is not null").select(*key, "change")


def run_deltas(runs: DataFrame) -> DataFrame:
    """UI-06, WIN-10: each valid run beside the valid one before it."""
    w = Window.partitionBy("grp").orderBy("run_id")
    valid = runs.where("valid")
    return valid.select("grp", "run_id", *((F.col(c) - F.lag(c).over(w)).alias(f"d_{c}") for c in ("edges", "observed", "holes")))


def regressions(before: DataFrame, after: DataFrame, drop: int = 3) -> DataFrame:
    """IMP-07: groups whose coverage fell by `drop` points or more, or that are gone."""
    j = before.select("key", F.col("percent").alias("was")).join(after.select("key", F.col("percent").alias("now")), "key", "full_outer")
    return j.where(f"now is null or was - now >= {drop}").select("key", "was", "now", F.when(F.col("now").isNull(), "REMOVED").otherwise("COVERAGE_DROP").alias("kind"))
