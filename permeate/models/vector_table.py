"""Vector table of a text collection: read, check, embed, store with metadata."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permeate.models import backends
from permeate.session import cut, log
from permeate.sinks.writers import write_vectors
from permeate.sources.files import CHUNK_COLUMNS, read_chunks


@dataclass(frozen=True)
class BuildOptions:
    """``shards`` 0 keeps the partitions of the source; with more, contiguous shards of equal size go to as many tasks,
    each on the device that Spark's resource scheduling gives it."""

    batch_size: int = 64
    shards: int = 0
    columns: tuple[str, str, str] = CHUNK_COLUMNS


def devices(spark: SparkSession) -> list[str]:
    """Devices the executors offer by configuration: one name per GPU amount and executor, or one CPU."""
    each = int(spark.conf.get("spark.executor.resource.gpu.amount", "0"))
    executors = int(spark.conf.get("spark.executor.instances", "1"))
    return [f"GPU {k}" for k in range(each * executors)] or ["CPU"]


def table_name(source: str, model: str, multi: bool) -> str:
    """Name of a stored table: stem of the source, model with slashes replaced, kind of devices."""
    stem = PurePosixPath(source.rstrip("/")).name.replace(".csv", "").replace(".parquet", "")
    return f"{stem}_embeddings_{model.replace('/', '_')}_{'multi' if multi else 'single'}_gpu"


def build(spark: SparkSession, source: str, model: str, factory: Callable, folder: str, options: BuildOptions = BuildOptions()) -> tuple[str, DataFrame]:
    """Reads chunks, embeds them and stores vectors in the order of the source with one row of metadata.

    Gives (path, metadata): model_name, embedding_dim, num_chunks, multi_gpu_used, device_info. The three columns must
    exist; null texts count as ''. An empty source gives an empty table of dimension null.
    """
    found = devices(spark)
    multi = len(found) > 1
    chunks = read_chunks(spark, source, options.columns)
    log(f"embed {source} with {backends.full_name(model)} on {', '.join(found)}")
    # the arrival number is the order of the source; it is written down before anything is shuffled
    chunks = cut(chunks.withColumn("_arrival", F.monotonically_increasing_id()))
    if options.shards:
        chunks = backends.shards_of(chunks, ["_arrival"], options.shards).drop("shard", "pos")
    vectors = backends.embed(chunks, "chunk_text", factory, options.batch_size).select("_arrival", "doi", "chunk_index", "embedding")
    ordered = vectors.repartitionByRange("_arrival").sortWithinPartitions("_arrival").drop("_arrival")
    path = f"{folder.rstrip('/')}/{table_name(source, model, multi)}"
    return path, write_vectors(ordered, path, model, multi, found)


def batch_speed(chunks: DataFrame, factory: Callable, sizes: tuple[int, ...] = (32, 64, 128), rows: int = 1000) -> DataFrame:
    """``batch_size, seconds, chunks_per_second`` of embedding the same ``rows`` chunks in batches of each size.

    A benchmark: its row limit is the feature. The model is loaded before the clock starts.
    """
    some = cut(chunks.limit(rows))
    n = some.count()
    backends.embed(some.limit(1), "chunk_text", factory).write.format("noop").mode("overwrite").save()
    out = []
    for size in sizes:
        began = time.perf_counter()
        backends.embed(some, "chunk_text", factory, size).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - began
        out.append((size, took, n / took))
    return chunks.sparkSession.createDataFrame(out, "batch_size int, seconds double, chunks_per_second double")
