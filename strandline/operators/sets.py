"""Set differences and equality of logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_diff(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only, with the side; both sides go through one aggregate."""
    flag = lambda df, x, y: df.select(*keys, F.lit(x).alias("in_a"), F.lit(y).alias("in_b"))
    both = flag(a, True, False).unionByName(flag(b, False, True))
    sides = both.groupBy(*keys).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    side = F.when(F.col("in_a"), F.lit("source")).otherwise(F.lit("target"))
    return sides.filter(F.col("in_a") != F.col("in_b")).select(*keys, side.alias("side"))


def all_labels(draft: Column, live: Column) -> Column:
    """Keys of either of two maps, in order."""
    none = F.array().cast("array<string>")
    return F.array_sort(
        F.array_union(F.coalesce(F.map_keys(draft), none), F.coalesce(F.map_keys(live), none))
    )


def logs_equal(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Record counts per partition on both sides, and whether they agree."""
    flag = lambda df, x, y: df.select(*by, F.lit(x).alias("a"), F.lit(y).alias("b"))
    both = flag(a, 1, 0).unionByName(flag(b, 0, 1))
    counts = both.groupBy(*by).agg(F.sum("a").alias("source_n"), F.sum("b").alias("target_n"))
    return counts.withColumn("equal", F.col("source_n") == F.col("target_n"))
