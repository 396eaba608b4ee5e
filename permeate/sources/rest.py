"""Batched sources over a request function.

``transport(batch) -> list[str | None]`` answers a list of keys with one raw body each; it is given by the caller,
so everything runs offline with a stub. Keys are dealt into batches, batches into partitions; the number of
partitions bounds the number of requests at a time. A failing batch is kept with its error.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from permeate.operators.batch import id_kind
from permeate.session import cut
from permeate.sources import json_flatten

Transport = Callable[[list[str]], list[str | None]]


def batches_of(keys: list[str], size: int) -> list[list[str]]:
    """Distinct keys in first-seen order, in batches of at most ``size``; no batch for no keys."""
    seen = list(dict.fromkeys(keys))
    return [seen[a : a + size] for a in range(0, len(seen), size)]


def fetch(keys: DataFrame, column: str, transport: Transport, batch_size: int = 200, partitions: int = 5, on_error: str = "keep") -> DataFrame:
    """``(key, body, error)`` of every distinct non-null key. ``on_error``: keep, skip or fail."""
    if on_error not in ("keep", "skip", "fail"):
        raise ValueError("on_error must be keep, skip or fail")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for batch in batches_of(list(frame["key"]), batch_size):
                try:
                    bodies = transport(batch)
                    yield pd.DataFrame({"key": batch, "body": bodies, "error": [None] * len(batch)})
                except Exception as e:
                    if on_error == "fail":
                        raise
                    if on_error == "keep":
                        yield pd.DataFrame({"key": batch, "body": [None] * len(batch), "error": [f"{type(e).__name__}: {e}"] * len(batch)})

    wanted = keys.select(F.col(column).cast("string").alias("key")).where("key is not null").distinct()
    return wanted.repartition(partitions, "key").mapInPandas(work, "key string, body string, error string")


def fetch_tables(keys: DataFrame, column: str, transport: Callable[[list[str]], str], schema: str, batch_size: int = 999, sep: str = "\t", partitions: int = 5) -> DataFrame:
    """Rows of delimited answers: one body with a header for each batch of distinct non-null keys, of ``schema`` and with
    ``batch`` (its first key) and ``error``.

    Columns of the header that the schema lacks are dropped, missing ones are null. A batch size of 1 reads one table per
    key. A failing batch gives one row with its error; bodies without rows give none.
    """
    want = StructType.fromDDL(schema)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for batch in batches_of(list(frame["key"]), batch_size):
                try:
                    got = pd.read_csv(io.StringIO(transport(batch)), sep=sep, dtype=str, keep_default_na=False, na_values=[""])
                    got = got.reindex(columns=want.fieldNames()).assign(batch=batch[0], error=None)
                except Exception as e:
                    got = pd.DataFrame({**{c: [None] for c in want.fieldNames()}, "batch": [batch[0]], "error": [f"{type(e).__name__}: {e}"]})
                yield got.astype(object).where(got.notna(), None)

    wanted = keys.select(F.col(column).cast("string").alias("key")).where("key is not null").distinct()
    text = ", ".join(f"`{f.name}` string" for f in want)
    rows = wanted.repartition(partitions, "key").mapInPandas(work, f"{text}, batch string, error string")
    return rows.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in want], "batch", "error")


def request_body(kind: str, ids: list[str], spec: dict[str, list[str]]) -> str:
    """GraphQL request for some ids of one kind with the fields of a specification, as a JSON body."""
    fields = " ".join(f"{f} {{ {' '.join(subs)} }}" if subs else f for f, subs in spec.items())
    singular = kind[:-3] + "y" if kind.endswith("ies") else kind[:-1]
    return json.dumps({"query": f"query($ids: [String!]!) {{ {kind}({singular}_ids: $ids) {{ {fields} }} }}", "variables": {"ids": ids}})


def fetch_entries(keys: DataFrame, column: str, transport: Callable[[str], str], spec: dict[str, list[str]] | None = None, batch_size: int = 200, partitions: int = 5, schema: str | None = None) -> DataFrame:
    """Flat table of the entries of some ids: ids are classed by their form, requested in batches per class, the answers
    flattened by the specification (its default if none is given), with ``kind`` and ``entry``.

    ``transport`` answers a request body with a JSON body. Failing batches give no rows; null ids none; an id of unknown form
    raises. Answers are cut once, so that inference and flattening do not ask again.
    """
    wanted = spec or json_flatten.DEFAULT_FIELDS
    ids = keys.select(F.col(column).cast("string").alias("key")).where("key is not null").distinct().withColumn("kind", id_kind(F.col("key")))

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for kind, part in frame.groupby("kind"):
                for batch in batches_of(list(part["key"]), batch_size):
                    try:
                        body, error = transport(request_body(kind, batch, wanted)), None
                    except Exception as e:
                        body, error = None, f"{type(e).__name__}: {e}"
                    yield pd.DataFrame({"kind": [kind], "body": [body], "error": [error]})

    answers = cut(ids.repartition(partitions, "kind", "key").mapInPandas(ask, "kind string, body string, error string"))
    out = None
    for kind in [r[0] for r in answers.where("body is not null").select("kind").distinct().collect()]:  # four kinds at most
        own = answers.where(F.col("kind") == kind)
        flat = json_flatten.flatten(json_flatten.entries_of(own, "body", schema, ("kind",), kind), wanted, ("kind", "entry"))
        out = flat if out is None else out.unionByName(flat, allowMissingColumns=True)
    if out is None:
        names = ", ".join(f"`{c}` string" for c in json_flatten.column_names(wanted))
        return keys.sparkSession.createDataFrame([], f"kind string, entry int, {names}")
    return out


class _Batch(InputPartition):
    def __init__(self, keys: list[str]):
        self.keys = keys


class BatchReader(DataSourceReader):
    def __init__(self, transport: Transport, batches: list[list[str]]):
        self.transport, self.batches = transport, batches

    def partitions(self) -> list[InputPartition]:
        return [_Batch(b) for b in self.batches] or [_Batch([])]

    def read(self, partition: _Batch) -> Iterator[tuple]:
        if not partition.keys:
            return
        try:
            for key, body in zip(partition.keys, self.transport(partition.keys)):
                yield (key, body, None)
        except Exception as e:
            for key in partition.keys:
                yield (key, None, f"{type(e).__name__}: {e}")


def register_source(spark: SparkSession, name: str, transport: Transport, batch_size: int = 200) -> None:
    """Registers ``spark.read.format(name).option("ids", ...)`` with one input partition per batch.

    ``ids`` is a JSON list, or text with commas between the ids; ``ids_path`` instead names a text file of one id a line.
    """

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "key string, body string, error string"

        def reader(self, schema) -> DataSourceReader:
            given = self.options.get("ids", "")
            if path := self.options.get("ids_path"):
                ids = [x.strip() for x in Path(path).read_text(encoding="utf-8").splitlines() if x.strip()]
            else:
                ids = json.loads(given) if given.lstrip().startswith("[") else [x for x in given.split(",") if x]
            return BatchReader(transport, batches_of(ids, int(self.options.get("batch_size", batch_size))))

    spark.dataSource.register(Source)


def first_specimen(entries: DataFrame) -> DataFrame:
    """Element 0 of determination and specimen lists with its buffer and details, keywords and title.

    A missing title or formula empties the four columns and sets ``error``.
    """
    from permeate.functions.text_clean import buffer_text

    specimen = F.get(F.get(F.col("structure_determination_list"), F.lit(0))["specimen_preparation_list"]["specimen_preparation"], F.lit(0))
    one = entries.select("row_id", "emdb_id", specimen.alias("s"), "admin").select("row_id", "emdb_id", F.col("s.buffer").alias("b"), F.col("s.details").alias("details"), F.col("admin.keywords").alias("keywords"), F.col("admin.title").alias("title"))
    named = one.withColumn("components", buffer_text(F.col("b")))
    error = F.when(F.col("title").isNull(), "no title").when(F.col("b").isNull(), "no buffer").when(F.col("components").isNull(), "no formula")
    out = named.withColumn("error", error)
    keep = lambda c: F.when(F.col("error").isNull(), F.col(c)).alias(c)
    return out.select("row_id", "emdb_id", keep("components"), keep("details"), keep("keywords"), keep("title"), "error")
