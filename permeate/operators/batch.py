"""Batches, positions and lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from permeate.session import cut


def with_position(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """Adds the 0-based position of each row in the order, without a single-task window.

    Rows are range-partitioned and sorted; equal keys are spread by an arrival number behind the key, so a hot key fills
    no single task. Partition and place in it are written down together with the rows (`cut`) before the sizes of the
    partitions are summed up: both readings see the same partitions, whatever the planner does with either. Nulls come
    first, ties in any order. Columns of the helper's names are not touched.
    """
    tie, mark = _free(df, "_tie"), _free(df, "_mark")
    keys = [F.col(f"`{c}`") for c in order]
    ranged = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys, F.col(tie)).sortWithinPartitions(*keys, F.col(tie))
    kept = cut(ranged.drop(tie).withColumn(mark, F.monotonically_increasing_id()))  # partition * 2**33 + place in it
    part = F.shiftright(F.col(mark), 33)
    sizes = kept.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    start = sizes.select(F.col("_p"), F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    # one number per partition: bounded by the number of partitions
    joined = kept.join(F.broadcast(start), part == start["_p"])
    return joined.select(*[kept[f"`{c}`"] for c in df.columns], (start["_start"] + F.col(mark).bitwiseAND(F.lit(2**33 - 1))).alias(name))


def _free(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of the frame has it."""
    while name in df.columns:
        name += "_"
    return name


def batch_number(position: Column, size: int) -> Column:
    return F.floor(position / size).cast("long")


def balanced_shard(position: Column, total: Column, shards: int) -> Column:
    """Contiguous shards of which the first (total mod shards) hold one more."""
    base, extra = F.floor(total / shards), total % shards
    wide = extra * (base + 1)
    return F.when(position < wide, F.floor(position / (base + 1))).otherwise(extra + F.floor((position - wide) / F.greatest(base, F.lit(1)))).cast("long")


def zip_rows(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows of both sides paired by position; the longer side is cut."""
    return with_position(left, left_order).join(with_position(right, right_order), "pos")


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts under the columns of any; a column that a part lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def last_wins(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The row with the largest position of each key (nulls in keys meet each other); folded map-side."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.col(f"`{position}`")).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def missing_keys(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted rows whose key is not stored yet."""
    return wanted.join(stored.select(*keys), keys, "left_anti")


def id_kind(code: Column) -> Column:
    """Kind of a structure id by its separator; an unknown form raises."""
    return (
        F.when(F.contains(code, F.lit("_")), "polymer_entities")
        .when(F.contains(code, F.lit(".")), "polymer_entity_instances")
        .when(F.contains(code, F.lit("-")), "assemblies")
        .when(F.char_length(code) == 4, "entries")
        .otherwise(F.raise_error(F.concat(F.lit("unknown id: "), F.coalesce(code, F.lit("null")))))
    )
