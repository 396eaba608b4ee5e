"""Vector search and retrieval-augmented prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from permeate.functions import text_clean as tc
from permeate.functions import vectors as v
from permeate.operators.batch import last_wins


def similar_chunks(vectors: DataFrame, query: list[float], threshold: float = 0.5, top_k: int | None = None, per_group: str | None = None) -> DataFrame:
    """Vectors with cosine similarity to ``query`` of at least ``threshold``, most similar first.

    ``top_k`` limits all hits (or, with ``per_group``, those of each group); ties go to the key. Null and wrongly
    sized vectors drop out, zero vectors have similarity 0. The query is a literal, so the scan stays one stage.
    """
    literal = F.array(*[F.lit(float(x)) for x in query])
    hits = vectors.withColumn("similarity", v.cosine(F.col("embedding"), literal)).where(F.col("similarity") >= threshold).drop("embedding")
    order = [F.desc("similarity"), F.asc("vec_id")]
    if not top_k:
        return hits
    if per_group:
        place = F.row_number().over(Window.partitionBy(per_group).orderBy(*order))
        return hits.withColumn("_place", place).where(F.col("_place") <= top_k).drop("_place")
    return hits.orderBy(*order).limit(top_k)


def budget_concat(chunks: DataFrame, group: str, rank: list, text: str, max_chars: int = 12_000, least_rest: int = 100, salts: int = 16) -> DataFrame:
    """Texts of each group joined by blank lines in rank order under a length budget: ``(group, combined)``.

    A chunk counts its length plus 2. The first that does not fit is cut to what is left if that is more than
    ``least_rest``, and everything behind it is dropped, even if it would fit. Groups with no text drop out. Null
    texts count as missing chunks and leave the list first. What one task gathers of a group is bounded by the
    budget, not by the group.
    """
    n = F.char_length(text)
    # a hot group is dealt into salts by its whole rows first, so a repeated text does not stay together: a row that is over the budget within its salt is over it in the group
    salted = chunks.where(F.col(text).isNotNull()).withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in chunks.columns]), F.lit(salts)))
    part = Window.partitionBy(group, "_salt").orderBy(*rank).rowsBetween(Window.unboundedPreceding, -1)
    few = salted.withColumn("_sum", F.coalesce(F.sum(n + 2).over(part), F.lit(0))).where(F.col("_sum") <= max_chars).drop("_sum", "_salt")
    w = Window.partitionBy(group).orderBy(*rank)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = few.withColumns({"_before": F.coalesce(F.sum(n + 2).over(past), F.lit(0)), "_n": F.row_number().over(w)})
    rows = rows.withColumn("_over", F.col("_before") + n > max_chars)
    # lengths only grow, so the budget bounds the rows of a group that are kept before they are collected
    kept = rows.withColumn("_stopped", F.coalesce(F.max("_over").over(past), F.lit(False))).where(~F.col("_stopped"))
    rest = F.lit(max_chars) - F.col("_before")
    cut = F.when(~F.col("_over"), F.col(text)).when(rest > least_rest, tc.strip_ends(F.substring(F.col(text), F.lit(1), rest.cast("int"))))
    pieces = kept.withColumn("_piece", cut).where("_piece is not null and (not _over or _piece <> '')")
    gathered = pieces.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("_n", "_piece"))).alias("_list"))
    joined = tc.strip_ends(F.array_join(F.transform("_list", lambda x: x["_piece"]), "\n\n"))
    return gathered.select(group, joined.alias("combined")).where("combined <> ''")


def build_prompts(vectors: DataFrame, texts: DataFrame, query: list[float], prompt: str, threshold: float = 0.5, top_k: int | None = None, max_chars: int = 12_000) -> DataFrame:
    """One prompt per doi from its similar chunks: ``(doi, combined_prompt)``.

    Search, join with the last text of each (doi, chunk_index), ordered concatenation under a budget, template.
    Chunks without a text leave the list; groups without text give no prompt.
    """
    hits = similar_chunks(vectors, query, threshold, top_k).select("vec_id", "doi", "chunk_index", "similarity")
    latest = last_wins(texts.select("doi", "chunk_index", "chunk_text", "text_id"), ["doi", "chunk_index"], "text_id")
    joined = hits.join(latest.where("chunk_text is not null"), ["doi", "chunk_index"])
    combined = budget_concat(joined, "doi", [F.desc("similarity"), F.asc("vec_id")], "chunk_text", max_chars)
    return combined.select("doi", tc.prompt_text(F.lit(prompt), F.col("combined")).alias("combined_prompt"))


def prompt_stats(prompts: DataFrame, column: str) -> DataFrame:
    n = F.char_length(column)
    return prompts.agg(F.count(column).alias("n_prompts"), F.avg(n).alias("mean_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"))
