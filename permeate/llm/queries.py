"""Queries of the text and embedding problems 2, 4, 5, 7, 8, 9 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permeate.llm import canonical, leakage, mixing, neighbours, pairs, splitting, templates
from permeate.plans import core_problems
from permeate.session import spread, table


def p2_mapped(spark: SparkSession, d: str) -> DataFrame:
    """Every component value with its list entry, how it was found and the score."""
    return canonical.map_to_list(spread(core_problems.p1_components(spark, d)), table(spark, d, "ref_components"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_mapped(spark, d).select("row_id", "path", "ref_id")


def p2_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values the list does not hold, with how often they were typed."""
    typed = core_problems.p1_components(spark, d)
    missing = p2_mapped(spark, d).where("ref_id = -1").select("row_id", "path")
    return typed.join(missing, ["row_id", "path"]).groupBy("name", "formula").agg(F.count("*").alias("n_values"))


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar vectors of every vector, however far they are; more trees and leaves than for near ones."""
    return neighbours.nearest(table(spark, d, "vector_database"), least=-1.0, trees=8, extra=40, leaf_rows=384)


def _near(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(table(spark, d, "vector_database"), least=0.9)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(_near(spark, d))


def p4_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall against brute force for the vectors whose id is divisible by 20: of the ten nearest of at least 0.9 (p4_found)
    and of the ten nearest whatever their similarity (p4_neighbours)."""
    vectors = table(spark, d, "vector_database")
    near = neighbours.recall(vectors, _near(spark, d), least=0.9).withColumn("links", F.lit("at least 0.9"))
    return near.unionByName(neighbours.recall(vectors, p4_neighbours(spark, d), least=-1.0).withColumn("links", F.lit("all")))


def p5_flags(spark: SparkSession, d: str) -> DataFrame:
    """Every triggered defect type with its rank."""
    return pairs.flag_pairs(spread(table(spark, d, "llm_responses").select("resp_id", "prompt", "response")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_flags(spark, d).where("rank = 0").select("resp_id", "defect")


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of the oversized texts."""
    return splitting.split_oversized(spread(table(spark, d, "text_database").select("text_id", "doi", "chunk_index", "chunk_text")), 2000, 200)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.cut_kinds(p7_pieces(spark, d))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Leaked passages, questions and answers with their length, changed words and place in the document."""
    return leakage.find_leaks(spread(table(spark, d, "documents").select("doc_id", "text")), leakage.item_texts(table(spark, d, "eval_items")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).where("part = 'passage'").select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked test items with the number of documents that hold their passage, question or answer."""
    return p8_leaks(spark, d).groupBy("item_id", "part").agg(F.count("*").alias("n_documents"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual token share per source."""
    return mixing.mix(spread(table(spark, d, "documents").select("doc_id", "source", "text")), table(spark, d, "mix_targets"))[1]


def p9_positions(spark: SparkSession, d: str) -> DataFrame:
    """Training position of every use of a document."""
    return mixing.mix(spread(table(spark, d, "documents").select("doc_id", "source", "text")), table(spark, d, "mix_targets"))[0]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return templates.find_residue(spread(table(spark, d, "documents").select("doc_id", "text")))


def p10_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents that are left, per source."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    left = docs.join(p10_found(spark, d).select("doc_id"), "doc_id", "left_anti")
    return left.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n_chars").alias("n_chars"))


def p10_templates(spark: SparkSession, d: str) -> DataFrame:
    """Flagged templates with their kind and count."""
    return templates.mine_templates(spread(table(spark, d, "documents").select("text"))).where("kind is not null")


QUERIES = {
    "p4_found": p4_found,
    "p4_neighbours": p4_neighbours,
    "p4_recall": p4_recall,
    "p9_shares": p9_shares,
    "p9_positions": p9_positions,
    "p10_found": p10_found,
    "p10_clean": p10_clean,
    "p10_templates": p10_templates,
    "p2_found": p2_found,
    "p2_mapped": p2_mapped,
    "p2_unmatched": p2_unmatched,
    "p5_found": p5_found,
    "p5_flags": p5_flags,
    "p7_found": p7_found,
    "p7_pieces": p7_pieces,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p8_items": p8_items,
}

ORACLE = {
    "p7_found": """
select text_id, case when regexp_matches(chunk_text, '[^ \\t\\n]{1000}[^ \\t\\n]{1000}[^ \\t\\n]') then 'forced' else 'natural' end as cut
from text_database where length(chunk_text) > 2000""",
}
