"""Parent and member rows, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAIRS = (("member_struc", "main_struc"), ("member_name", "main_name"), ("member_res", "main_res"), ("member_species", "main_species"), ("member_taxdom", "main_taxdom"))


def with_self_members(df: DataFrame, position: str = "row_id") -> DataFrame:
    """Adds each parent as a member of its own: ``part`` 0 is the added row, 1 a delivered one.

    For the first row of each main_struc: with a member, a copy whose member fields are the parent's goes before
    it; without one, its member fields are filled. Later rows and rows without a main_struc stay as they are. The
    first row is found by an aggregate, so that a hot parent is folded map-side, and joined back.
    """
    first = df.where("main_struc is not null").groupBy("main_struc").agg(F.min(position).alias(position)).select(position).withColumn("is_first", F.lit(True))
    marked = df.join(first, position, "left")
    has = F.coalesce(F.col("member_struc"), F.lit("")) != ""
    leads = F.coalesce("is_first", F.lit(False))
    parts = marked.withColumn("part", F.explode(F.when(leads & has, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    fill = leads & ((F.col("part") == 0) | ~has)
    values = {member: F.when(fill, F.col(main)).otherwise(F.col(member)) for member, main in PAIRS}
    return parts.withColumns(values).drop("is_first")


def rollup_sums(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sum of a value at every level of a hierarchy, with the grouping level."""
    return df.rollup(*keys).agg(F.sum(value).alias(f"sum_{value}"), F.grouping_id().alias("level"))


def first_per_key(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """First row of each key by position."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(position))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")
