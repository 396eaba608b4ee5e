"""Embedding and chat operators over backends that the caller gives.

A backend factory is called once per Python worker and query; nothing of a model is imported here.
"""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permeate.operators.batch import balanced_shard, with_position
from permeate.session import kept_by_worker

Embedder = Callable[[list[str]], np.ndarray]
Chat = Callable[[str, str], str]

# Short names of sentence-embedding models.
MODEL_NAMES = {
    "bge-large-en-v1.5": "BAAI/bge-large-en-v1.5",
    "bge-base-en-v1.5": "BAAI/bge-base-en-v1.5",
    "bge-small-en-v1.5": "BAAI/bge-small-en-v1.5",
    "all-MiniLM-L6-v2": "sentence-transformers/all-MiniLM-L6-v2",
    "all-mpnet-base-v2": "sentence-transformers/all-mpnet-base-v2",
}


def full_name(model: str) -> str:
    """Repository name of a short model name; any other name is its own."""
    return MODEL_NAMES.get(model, model)


def task_device() -> str:
    """Device of the running task: the first GPU address that Spark's resource scheduling gave it, else ``CPU``."""
    context = TaskContext.get()
    gpu = context.resources().get("gpu") if context else None
    return f"cuda:{gpu.addresses[0]}" if gpu and gpu.addresses else "CPU"


def _made(factory: Callable, token: str) -> Callable:
    """The model of this worker for its device, made once per query (``token``); a factory may take a ``device``."""
    device = task_device()
    return kept_by_worker(f"{token} {device}", lambda: _call(factory, device))


def _call(factory: Callable, device: str) -> Callable:
    return factory(device=device) if "device" in inspect.signature(factory).parameters else factory()


def hash_embedder(dimension: int = 16) -> Embedder:
    """Deterministic stand-in for a model: a vector drawn from the hash of the text."""

    def embed(texts: list[str]) -> np.ndarray:
        rows = [np.frombuffer(hashlib.shake_256(t.encode()).digest(4 * dimension), dtype=np.uint32) for t in texts]
        return (np.array(rows, dtype=np.float64).reshape(len(texts), dimension) / 2**31 - 1.0).astype(np.float32)

    return embed


def dimension_of(factory: Callable[[], Embedder]) -> int:
    """Length of the vectors a model gives, from one short text on the caller's side; a model that fails to load raises."""
    return int(np.asarray(_call(factory, "CPU")(["probe"])).shape[1])


def shards_of(chunks: DataFrame, order: list[str], shards: int) -> DataFrame:
    """Contiguous shards of equal size (the first ones hold one row more), one partition each; adds ``pos`` and ``shard``."""
    placed = with_position(chunks, order)
    total = placed.count()
    return placed.withColumn("shard", balanced_shard(F.col("pos"), F.lit(total), shards)).repartitionByRange(shards, "shard")


def embed(chunks: DataFrame, text: str, factory: Callable[[], Embedder], batch_size: int = 64, normalise: bool = True) -> DataFrame:
    """Adds ``embedding`` (ARRAY<FLOAT>) to every row; null texts count as ''. Row order does not matter: the vector
    stays with its row."""
    out, token = chunks.withColumn("embedding", F.lit(None).cast("array<float>")).schema, uuid4().hex

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _made(factory, token)
        for frame in frames:
            texts = [t if isinstance(t, str) else "" for t in frame[text]]
            parts = []
            for a in range(0, len(texts), batch_size):
                v = np.asarray(model(texts[a : a + batch_size]), dtype=np.float32)
                if normalise:
                    n = np.linalg.norm(v, axis=1, keepdims=True)
                    v = np.divide(v, n, out=v.copy(), where=n > 0)
                parts += list(v)
            yield frame.assign(embedding=parts)

    return chunks.mapInPandas(work, out)


def chat(messages: DataFrame, factory: Callable[[], Chat], system: str = "", prompt: str = "prompt", tasks: int = 0) -> DataFrame:
    """Adds ``response`` and ``error``: one model call per row, failures are kept.

    Answers take unequal time: with ``tasks`` the rows are dealt into that many small partitions, more than there are
    hosts, and a free host takes the next one.
    """
    messages = messages.repartition(tasks) if tasks else messages
    token = uuid4().hex
    base = messages.withColumns({"response": F.lit(None).cast("string"), "error": F.lit(None).cast("string")}).schema

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _made(factory, token)
        for frame in frames:
            answers, errors = [], []
            for p in frame[prompt]:
                try:
                    answers.append(model(system, p))
                    errors.append(None)
                except Exception as e:
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield frame.assign(response=answers, error=errors)

    return messages.mapInPandas(work, base)


def echo_chat() -> Chat:
    """Stand-in for a chat model: repeats the last words of the prompt, fails on a null one."""

    def answer(system: str, prompt: str) -> str:
        return (system + " " + " ".join(prompt.split()[-5:])).strip()

    return answer
