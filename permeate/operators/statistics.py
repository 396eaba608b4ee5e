"""Summaries of values per group, exact and without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, v, n``: how often each value occurs in its group, folded map-side. Null values do not count."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("n"))


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, mean, std, median``: mean and population deviation from folded sums, the exact median from value counts.

    The group of a median meets as its different values with their counts, not as its rows. Groups whose values are all null
    drop out.
    """
    counts = value_counts(df, keys, value)
    x, n = F.col("v").cast("double"), F.col("n")
    mean = F.sum(x * n) / F.sum(n)
    moments = counts.groupBy(*keys).agg(mean.alias("mean"), F.percentile("v", F.lit(0.5), F.col("n")).alias("median"))
    spread = counts.join(moments.select(*keys, F.col("mean").alias("_m")), keys).groupBy(*keys).agg(F.sqrt(F.sum((x - F.col("_m")) * (x - F.col("_m")) * n) / F.sum(n)).alias("std"))
    return moments.join(spread, keys).select(*keys, "mean", "std", "median")


def median_deviation(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, mad``: median of the absolute deviations from the group's median."""
    counts = value_counts(df, keys, value)
    middle = counts.groupBy(*keys).agg(F.percentile("v", F.lit(0.5), F.col("n")).alias("_m"))
    apart = counts.join(middle, keys).withColumn("_d", F.abs(F.col("v").cast("double") - F.col("_m")))
    return apart.groupBy(*keys).agg(F.percentile("_d", F.lit(0.5), F.col("n")).alias("mad"))
