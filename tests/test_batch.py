"""Positions and zips on tables wide enough for the planner to treat their readings differently."""

import pytest
from pyspark.sql import functions as F

from permeate.operators.batch import with_position, zip_rows

ROWS = 1_000_000


def wide(spark):
    return spark.range(ROWS).select(F.xxhash64("id").alias("k"), F.col("id").alias("payload"), F.concat(F.lit("text of row "), F.col("id").cast("string")).alias("text"), F.sha2(F.col("id").cast("string"), 256).alias("more"))


@pytest.mark.parametrize("partitions", ["4", "200"])
def test_each_position_once(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        out = with_position(wide(spark), ["k"])
        seen = out.agg(F.count("*").alias("n"), F.countDistinct("pos").alias("d"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.countDistinct("payload").alias("rows")).first()
        assert tuple(seen) == (ROWS, ROWS, 0, ROWS - 1, ROWS)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    ranks = out.where("pos < 5").orderBy("pos").select("k").collect()
    assert ranks == wide(spark).orderBy("k").select("k").limit(5).collect()


def test_zip_of_a_table_with_itself_pairs_each_row_with_itself(spark):
    left, right = wide(spark), wide(spark).select("k", F.col("payload").alias("other")).withColumnRenamed("k", "k2")
    both = zip_rows(left, right, ["k"], ["k2"])
    assert both.count() == ROWS and both.where("payload <> other").count() == 0


def test_hot_key_nulls_and_clashing_names(spark):
    df = spark.range(90_000).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 7, id)) as k", "id as _tie", "id as _p", "id as _mark", "id as _start", "id as _n")
    out = with_position(df, ["k"])
    assert out.columns == ["k", "_tie", "_p", "_mark", "_start", "_n", "pos"]
    assert tuple(out.agg(F.count("*"), F.countDistinct("pos"), F.max("pos")).first()) == (90_000, 90_000, 89_999)
    assert out.where("k is null").agg(F.max("pos")).first()[0] == 29_999


def test_empty(spark):
    assert with_position(spark.range(0), ["id"]).count() == 0
