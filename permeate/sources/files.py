"""Text, table, vector and config files."""

from __future__ import annotations

import io
import tomllib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_COLUMNS = ("chunk_text", "chunk_index", "doi")


def read_chunks(spark: SparkSession, path: str, columns: tuple[str, str, str] = CHUNK_COLUMNS) -> DataFrame:
    """Text chunks of a csv or parquet path as ``(doi, chunk_index, chunk_text)``; null texts become ''.

    The three columns must exist. Pickles are refused: they run code when read.
    """
    if ".pkl" in path or ".pickle" in path:
        raise ValueError("pickle files are not read")
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"') if ".csv" in path else spark.read.parquet(path)
    missing = set(columns) - set(raw.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    text, index, doi = columns
    return raw.select(F.col(doi).cast("string").alias("doi"), F.col(index).cast("int").alias("chunk_index"), F.coalesce(F.col(text), F.lit("")).alias("chunk_text"))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; without a schema every column is text."""
    return spark.read.csv(path, header=True, schema=schema)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with role and content."""
    return spark.read.json(path, schema="role STRING, content STRING")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_prompt(path: str) -> str:
    return Path(path).read_text(encoding="utf-8")


def read_config(path: str) -> dict:
    """Model, hosts and system message of a TOML file; the model has a default."""
    raw = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    return {"model": raw.get("model", "llama3.2"), "hosts": raw.get("hosts", {}), "system": raw.get("system", "")}


def read_vector_archives(spark: SparkSession, path: str) -> DataFrame:
    """Vectors of npz archives as ``(doi, chunk_index, embedding)``; arrays that need pickles are refused."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    yield pd.DataFrame({"doi": [str(x) for x in z["dois"]], "chunk_index": z["chunk_indices"].astype("int32"), "embedding": list(z["embeddings"].astype("float32"))})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(work, "doi string, chunk_index int, embedding array<float>")
