"""Resumable ingest: a file stream that stores each key once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from permeate.sinks.writers import append_new


def ingest_new(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Parquet files that appear under ``source`` are appended to ``target``, each key once over all runs.

    The checkpoint remembers finished files, the anti join in each batch the stored keys, so a replayed batch adds
    nothing. Runs until all present files are read, then ends.
    """

    def store(batch: DataFrame, _: int) -> None:
        append_new(batch.dropDuplicates(keys), target, keys)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
