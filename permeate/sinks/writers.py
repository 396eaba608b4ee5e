"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permeate.operators.batch import missing_keys
from permeate.session import cut


def append_new(rows: DataFrame, path: str, keys: list[str], partition_by: list[str] | None = None) -> None:
    """Appends rows whose key is not stored yet; a second run writes nothing."""
    spark = rows.sparkSession
    try:
        stored = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        stored = None
    new = rows if stored is None else missing_keys(rows, stored, keys)
    writer = new.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_vectors(vectors: DataFrame, path: str, model_name: str, multi_gpu: bool = False, devices: list[str] | None = None) -> DataFrame:
    """Vectors as parquet and a one-row metadata table beside them, which is returned."""
    vectors.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/vectors")
    meta = vectors.sparkSession.read.parquet(f"{path}/vectors").agg(F.lit(model_name).alias("model_name"), F.max(F.size("embedding")).alias("embedding_dim"), F.count("*").alias("num_chunks"), F.lit(multi_gpu).alias("multi_gpu_used"), F.array(*[F.lit(x) for x in devices or ["CPU"]]).alias("device_info"))
    meta.write.mode("overwrite").parquet(f"{path}/metadata")
    return meta


def store_fetched(fetched: DataFrame, path: str, errors: str) -> tuple[int, int]:
    """Answers of `sources.rest.fetch` that are not stored yet go to ``path``, failures to the side table ``errors``.

    Gives (answers, failures) of this run. The answers are cut once, so that each request is made once.
    """
    once = cut(fetched)
    good, bad = once.where("error is null"), once.where("error is not null").select("key", "error", F.current_timestamp().alias("failed_at"))
    append_new(good.select("key", "body"), path, ["key"])
    bad.write.mode("append").parquet(errors)
    return good.count(), bad.count()


def write_csv(df: DataFrame, path: str, gzip_above: int = 10_000) -> str:
    """CSV with a header, compressed from more than ``gzip_above`` rows on; returns the codec."""
    codec = "gzip" if len(df.limit(gzip_above + 1).select(F.lit(1)).collect()) > gzip_above else "none"
    df.write.mode("overwrite").csv(path, header=True, compression=codec)
    return codec


def write_responses(responses: DataFrame, path: str) -> DataFrame:
    """Responses as JSON keyed by doi; rows with a blank or repeated doi are not written but returned."""
    key = F.trim(F.coalesce("doi", F.lit("")))
    keyed = responses.withColumn("doi", key)
    once = keyed.groupBy("doi").agg(F.count("*").alias("_n"))
    marked = keyed.join(once, "doi")
    good = (F.col("doi") != "") & (F.col("_n") == 1)
    marked.where(good).drop("_n").write.mode("overwrite").json(path)
    return marked.where(~good).drop("_n")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema="doi STRING, prompt STRING, response STRING")
