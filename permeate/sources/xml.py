"""XML sources of membrane-protein databases.

Each reader splits files by row tag, so a file never has to fit in memory; schemas are given, never inferred.
``*_rows`` take parsed structs and work on files and on XML held in a column (``from_xml``) alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from permeate.functions.text_clean import squeeze_space
from permeate.operators.helix import helix_rows

_PROTEIN = "pdbCode STRING, name STRING, resolution STRING, species STRING, taxonomicDomain STRING"
GROUP = f"name STRING, subgroups STRUCT<subgroup: ARRAY<STRUCT<name: STRING, proteins: STRUCT<protein: ARRAY<STRUCT<{_PROTEIN.replace(' STRING', ': STRING')}, memberProteins: STRUCT<memberProtein: ARRAY<STRUCT<{_PROTEIN.replace(' STRING', ': STRING')}>>>>>>>>>"
CHAINS = "_ID STRING, CHAIN ARRAY<STRUCT<_CHAINID: STRING, _NUM_TM: INT, _TYPE: STRING, SEQ: STRING, REGION: ARRAY<STRUCT<_seq_beg: INT, _pdb_beg: INT, _seq_end: INT, _pdb_end: INT, _type: STRING>>>>"
TOPOLOGY = "_ID STRING, _type STRING, Membrane STRING, PDB ARRAY<STRUCT<_ID: STRING>>"


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Rows of one tag, with prefixed or default namespaces."""
    return spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true").schema(schema).load(path)


def xml_column(text: Column, schema: str) -> Column:
    return F.from_xml(text, schema, {"ignoreNamespace": "true"})


def group_rows(groups: DataFrame, member_attrs: str = "parent", keep: tuple[str, ...] = ()) -> DataFrame:
    """Twelve-column rows of nested groups: one per member protein, one with null members where there is none.

    ``member_attrs`` tells whether a member's resolution, species and domain are the parent's (the default) or its own.
    """
    if member_attrs not in ("parent", "own"):
        raise ValueError("member_attrs must be parent or own")
    s = groups.select(*keep, F.col("name").alias("group_name"), F.explode("subgroups.subgroup").alias("s"))
    p = s.select(*keep, "group_name", F.col("s.name").alias("subgroup"), F.explode("s.proteins.protein").alias("p"))
    m = p.select(*keep, "group_name", "subgroup", "p", F.explode_outer("p.memberProteins.memberProtein").alias("m"))
    side = "p" if member_attrs == "parent" else "m"
    has = F.col("m").isNotNull()
    pick = lambda field: F.when(has, F.col(f"{side}.{field}"))
    return m.select(
        *keep,
        "group_name",
        "subgroup",
        F.col("p.pdbCode").alias("main_struc"),
        F.col("p.name").alias("main_name"),
        F.col("p.resolution").alias("main_res"),
        F.col("p.species").alias("main_species"),
        F.col("p.taxonomicDomain").alias("main_taxdom"),
        F.col("m.pdbCode").alias("member_struc"),
        F.col("m.name").alias("member_name"),
        pick("species").alias("member_species"),
        pick("taxonomicDomain").alias("member_taxdom"),
        pick("resolution").alias("member_res"),
    )


def chain_rows(entries: DataFrame) -> DataFrame:
    """One row per chain with its sequence (white space removed) and regions."""
    one = entries.select(F.upper("_ID").alias("pdbCode"), F.explode("CHAIN").alias("c"))
    return one.select("pdbCode", F.col("c._CHAINID").alias("chain_id"), F.col("c._NUM_TM").alias("num_tm"), F.col("c._TYPE").alias("chain_type"), squeeze_space(F.col("c.SEQ")).alias("sequence"), F.col("c.REGION").alias("regions"))


def topology_rows(entries: DataFrame) -> DataFrame:
    """One row per structure of an entry; entries without one vanish."""
    return entries.select(F.col("_ID").alias("topdb_id"), F.col("_type").alias("topdb_type"), F.explode("PDB").alias("p"), F.col("Membrane").alias("membrane")).select("topdb_id", "topdb_type", F.upper("p._ID").alias("pdbCode"), "membrane")


def read_groups(spark: SparkSession, path: str, member_attrs: str = "parent") -> DataFrame:
    return group_rows(read_xml(spark, path, "group", GROUP), member_attrs)


def read_chains(spark: SparkSession, path: str) -> DataFrame:
    """Chain mode: one row per chain."""
    return chain_rows(read_xml(spark, path, "pdbtm", CHAINS))


def read_helices(spark: SparkSession, path: str, flank_length: int = 5) -> DataFrame:
    """Helix mode: one row per helix region."""
    return helix_rows(read_chains(spark, path), flank_length)


def read_topology(spark: SparkSession, path: str) -> DataFrame:
    """Topology entries; structures and membrane may lie at any depth, so they are found by path expressions.

    The file is split behind each ``TOPDB>``, so it never has to fit in memory; what ends in a closing tag is an entry.
    """
    pieces = spark.read.option("lineSep", "TOPDB>").text(path)
    # the last opening tag of a piece begins the entry; one without attributes was the split itself
    start = F.regexp_extract("value", r"(?s)^.*(<(?:\w+:)?TOPDB\s.*)$", 1)
    whole = F.concat(F.when(start != "", start).otherwise(F.concat(F.lit("<TOPDB>"), "value")), F.lit("TOPDB>"))
    # null for other pieces and not a filter, which Spark may run behind the parsing
    entry = F.when(F.col("value").rlike(r"</(?:\w+:)?$"), whole)
    return topology_rows(pieces.select(topology_from_text(entry).alias("t")).select("t.*"))


def topology_from_text(text: Column) -> Column:
    """Struct of an entry given as XML text, with descendants at any depth."""
    plain = F.regexp_replace(F.regexp_replace(text, r'\sxmlns(?::\w+)?="[^"]*"', ""), r"(</?)\w+:", "$1")
    ids = F.xpath(plain, F.lit("//PDB/@ID"))
    membrane = F.xpath_string(plain, F.lit("//Membrane"))
    return F.struct(
        F.xpath_string(plain, F.lit("/TOPDB/@ID")).alias("_ID"),
        F.xpath_string(plain, F.lit("/TOPDB/@type")).alias("_type"),
        F.when(membrane != "", membrane).alias("Membrane"),
        F.transform(ids, lambda i: F.struct(i.alias("_ID"))).alias("PDB"),
    )
