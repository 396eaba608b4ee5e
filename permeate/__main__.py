"""Command line: ``python -m permeate vectors | prompts | answers | query``.

Models are given as ``module:function``, a factory as `permeate.models.backends` describes it.
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from permeate.models import backends, vector_table
from permeate.operators import retrieval
from permeate.plans import catalogue
from permeate.session import log, ship
from permeate.sinks import writers
from permeate.sources import files


def _factory(name: str) -> Callable:
    module, function = name.split(":")
    return getattr(importlib.import_module(module), function)


def vectors(spark: SparkSession, a: argparse.Namespace) -> None:
    options = vector_table.BuildOptions(a.batch_size, a.shards)
    path, meta = vector_table.build(spark, a.source, a.model, _factory(a.factory), a.folder, options)
    log(f"{path}: {meta.first().asDict()}")


def prompts(spark: SparkSession, a: argparse.Namespace) -> None:
    """Prompts per doi from stored vectors and chunks."""
    question = files.read_prompt(a.prompt) if a.prompt.endswith((".txt", ".md")) else a.prompt
    query = [float(x) for x in _factory(a.factory)()([question])[0]]
    stored = spark.read.parquet(a.vectors).withColumn("vec_id", F.monotonically_increasing_id())
    texts = files.read_chunks(spark, a.texts).withColumn("text_id", F.monotonically_increasing_id())
    made = retrieval.build_prompts(stored, texts, query, question, a.threshold, a.top_k or None, a.max_chars)
    made.write.mode("overwrite").json(a.out)
    log(f"{a.out}: {retrieval.prompt_stats(spark.read.json(a.out, schema='doi STRING, combined_prompt STRING'), 'combined_prompt').first().asDict()}")


def answers(spark: SparkSession, a: argparse.Namespace) -> None:
    """Answers to stored prompts, in many small tasks so that a free host takes the next one."""
    config = files.read_config(a.config) if a.config else {"system": ""}
    asked = spark.read.json(a.prompts, schema="doi STRING, combined_prompt STRING").withColumnRenamed("combined_prompt", "prompt")
    said = backends.chat(asked, _factory(a.factory), config["system"], tasks=a.tasks)
    left = writers.write_responses(said.where("error is null").select("doi", "prompt", "response"), a.out)
    log(f"{a.out}: {left.count()} answers without a key of their own were left out")


def query(spark: SparkSession, a: argparse.Namespace) -> None:
    catalogue.QUERIES[a.name](spark, a.data).write.mode("overwrite").parquet(a.out)
    log(f"{a.name} written to {a.out}")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="permeate")
    sub = top.add_subparsers(required=True)

    def command(run: Callable, *names: str) -> argparse.ArgumentParser:
        p = sub.add_parser(run.__name__, help=(run.__doc__ or "").split("\n")[0])
        for n in names:
            p.add_argument(n)
        p.set_defaults(run=run)
        return p

    p = command(vectors, "source", "folder")
    p.add_argument("--model", default="all-MiniLM-L6-v2")
    p.add_argument("--factory", required=True)
    p.add_argument("--batch-size", type=int, default=64)
    p.add_argument("--shards", type=int, default=0)
    p = command(prompts, "vectors", "texts", "out")
    p.add_argument("--prompt", required=True)
    p.add_argument("--factory", required=True)
    p.add_argument("--threshold", type=float, default=0.6)
    p.add_argument("--top-k", type=int, default=0)
    p.add_argument("--max-chars", type=int, default=9000)
    p = command(answers, "prompts", "out")
    p.add_argument("--config")
    p.add_argument("--factory", required=True)
    p.add_argument("--tasks", type=int, default=64)
    command(query, "name", "data", "out")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    a.run(spark, a)


if __name__ == "__main__":
    main()
