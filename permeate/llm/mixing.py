"""Sources mixed to target shares of tokens (problem 9).

Method: time-varying curriculum. Each source has a weight schedule over training time; its integral is the
cumulative token demand of the source. A document's place in the stream of its source is inverted through that
demand to a training position, and the documents are range-sorted by position.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from permeate.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def count_tokens(documents: DataFrame, tokenizer_path: str = TOKENIZER) -> DataFrame:
    """``(doc_id, source, n_tokens)`` of whole texts in a public tokenizer; null texts count 0.

    ``tokenizer_path`` is a file of the tokenizers library that every worker can read; strings of special tokens in
    a text are ordinary text. One tokenizer per Python worker, Arrow batches, no shuffle.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.encode_special_tokens = True
        for batch in batches:
            counts = []
            for a in range(0, len(batch), 64):
                texts = [t if isinstance(t, str) else "" for t in batch["text"].iloc[a : a + 64]]
                counts += [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "n_tokens": counts})

    cols = [F.col("doc_id").cast("long").alias("doc_id"), "source", "text"]
    return documents.select(*cols).mapInPandas(work, "doc_id long, source string, n_tokens long")


#: Up to so many sources (checked by a count, about 10 MB) their plan is broadcast to the documents; beyond, the two are joined by source.
BROADCAST_SOURCES = 100_000


def _plan(tokens: DataFrame, targets: DataFrame, total_tokens: int | None, tilt: float) -> DataFrame:
    """Per listed source: share, supply, demand and the slope of its weight schedule; any number of sources.

    The schedule is w(t) = goal * (1 + a * (1 - 2t)): sources with many repeats gain weight late. The slopes a are centred so
    that the weights of all sources sum to 1 at every time; their integral over the whole time is the goal.
    """
    share, repeats = F.coalesce(F.max("target_share"), F.lit(0.0)).cast("double"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).cast("int")
    listed = targets.groupBy("source").agg(share.alias("target_share"), repeats.alias("max_repeats"))
    have = tokens.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("available_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    plan = cut(listed.join(have, "source", "left").select("source", "target_share", "max_repeats", zero("n_documents"), zero("available_tokens")))
    supply = F.col("available_tokens") * F.col("max_repeats")
    live = (supply > 0) & (F.col("target_share") > 0)
    scale = plan.where(live).agg(F.sum("target_share")).first()[0] or 1.0
    plan = plan.withColumn("goal", F.when(live, F.col("target_share") / scale).otherwise(0.0))
    if total_tokens is None:
        # the largest total at which every source that exists can keep its share
        total_tokens = int(plan.where(live).agg(F.min(supply / F.col("goal"))).first()[0] or 0)
    plan = plan.withColumn("demand", F.least(supply, F.round(F.col("goal") * total_tokens).cast("long")))
    drawn = F.col("demand") > 0
    row = plan.where(drawn).agg((F.sum(F.col("goal") * F.col("max_repeats")) / F.sum("goal")).alias("mean")).first()
    mean = row[0] or 0.0
    reach = plan.where(drawn).agg(F.max(F.abs(mean - F.col("max_repeats")))).first()[0] or 1.0
    return plan.withColumn("slope", F.when(drawn, tilt * (mean - F.col("max_repeats")) / reach).otherwise(0.0))


def position(share_done: Column, slope: Column) -> Column:
    """Time t in [0, 1] at which the integral t * (1 + a) - a * t * t of the schedule reaches ``share_done``."""
    a = slope
    root = F.sqrt(F.greatest((a + 1) * (a + 1) - a * 4 * share_done, F.lit(0.0)))
    return F.when(F.abs(a) < 1e-9, share_done).otherwise(share_done * 2 / (a + 1 + root))


def mix(
    documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, tilt: float = 0.5, tokenizer_path: str = TOKENIZER, bucket_rows: int = 50_000, broadcast_sources: int = BROADCAST_SOURCES
) -> tuple[DataFrame, DataFrame]:
    """(positions, report).

    positions: ``doc_id, source, copy, n_tokens, time, position``, one row per use of a document, ``position`` in
    tokens from 0 to the total, range-partitioned and sorted by it. report: one row per listed source with
    ``target_share, max_repeats, n_documents, available_tokens, drawn_tokens, actual_share, n_uses, most_uses``.

    Sources that have no document get nothing and the others keep their proportions; documents of other or null
    sources are not drawn; no document is used more than ``max_repeats`` times. Without ``total_tokens`` the total is
    the largest at which every source can keep its share; with a larger one, sources that run out give all they
    have and the report shows it. Documents without tokens are never drawn. Repeated rows are documents of their
    own. ``tilt`` in [0, 1) is how far weights move over time.

    The prefix sums of a source run in two steps: sums of hashed buckets of about ``bucket_rows`` documents, then
    inside the buckets, so that no source ever meets in one task.
    """
    if not 0 <= tilt < 1:
        raise ValueError("tilt must be in [0, 1)")
    tokens = cut(count_tokens(documents, tokenizer_path).where("n_tokens > 0"))
    plan = _plan(tokens, targets, total_tokens, tilt)
    sums = plan.agg(F.sum("demand"), F.max("n_documents"), F.count("*")).first()
    total_drawn, most, n_sources = sums[0] or 1, sums[1] or 0, sums[2]
    sources = F.broadcast(plan) if n_sources <= broadcast_sources else plan
    n_buckets = max(1, -(-most // bucket_rows))
    hashed = (
        tokens.join(sources.select("source", "available_tokens", "demand", "max_repeats", "slope").where("demand > 0"), "source")
        .withColumn("h", F.xxhash64("doc_id", "source"))
        .withColumn("bucket", F.pmod(F.shiftright("h", 17), F.lit(n_buckets)))
    )
    sums = hashed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
    before = sums.withColumn("before", F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("t")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = hashed.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(before, ["source", "bucket"]).withColumn("offset", F.col("before") + F.col("inside"))
    uses = F.least(F.ceil((F.col("demand") - F.col("offset")) / F.col("available_tokens")).cast("int"), F.col("max_repeats"))
    drawn = (
        placed.withColumn("uses", uses)
        .where("uses > 0")
        .select("doc_id", "source", "n_tokens", "offset", "available_tokens", "demand", "slope", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)).alias("copy"))
    )
    done = (F.col("offset") + F.col("copy").cast("long") * F.col("available_tokens")) / F.col("demand")
    timed = drawn.withColumn("time", position(F.least(done, F.lit(1.0)), F.col("slope"))).withColumn("position", F.floor(F.col("time") * total_drawn).cast("long"))
    positions = timed.select("doc_id", "source", "copy", "n_tokens", "time", "position")
    got = positions.groupBy("source").agg(F.sum("n_tokens").alias("drawn_tokens"), F.count("*").alias("n_uses"), (F.max("copy") + 1).alias("most_uses"))
    whole = got.agg(F.sum("drawn_tokens").alias("all_tokens")).withColumn("one", F.lit(1))  # one row
    report = (
        plan.join(got, "source", "left")
        .withColumn("one", F.lit(1))
        .join(F.broadcast(whole), "one")
        .select(
            "source",
            "target_share",
            "max_repeats",
            "n_documents",
            "available_tokens",
            F.coalesce("drawn_tokens", F.lit(0)).alias("drawn_tokens"),
            F.coalesce(F.col("drawn_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
            F.coalesce("n_uses", F.lit(0)).alias("n_uses"),
            F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        )
    )
    return positions.repartitionByRange("position").sortWithinPartitions("position", "source", "doc_id", "copy"), report
