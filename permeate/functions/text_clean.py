"""Annotation text clean-up as Catalyst expressions. An empty text and a null give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_end(text: Column) -> Column:
    """Without trailing white space, Unicode-wide."""
    return F.regexp_replace(text, r"(?U)\s+$", "")


def strip_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze_space(text: Column) -> Column:
    """All white space removed."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def subcellular_location(text: Column) -> Column:
    """Location text: heading of 22 characters, notes, evidence, membrane-pass phrases and isoform tags removed."""
    out = F.split_part(F.substring(text, 23, 1_000_000_000), F.lit(" Note="), F.lit(1))
    out = F.regexp_replace(out, r"(?d)\s\{.+\}", "")
    for phrase in (r"; Multi-pass membrane protein\.\s*", r"; Single-pass membrane protein[.;]\s*", r"; Single-pass type II membrane protein[.;]\s*", r"; Single-pass type I membrane protein[.;]\s*"):
        out = F.regexp_replace(out, phrase, ". ")
    out = strip_end(F.regexp_replace(out, r"(?d)\[.+\]:\s", ""))
    return F.when(text != "", out)


def function_text(text: Column) -> Column:
    """Function text without evidence tags and literature references."""
    out = F.regexp_replace(F.regexp_replace(text, r"(?d)\s\{ECO:.+?\}\.", ""), r"(?d)\(PubMed:.+?\)", "")
    return F.when(text != "", strip_end(out))


def domain_text(text: Column) -> Column:
    """Domain text without evidence, heading, quotes and note keys; its last character is dropped."""
    out = F.regexp_replace(text, r"(?d)/e.+?\d\";?\s?", "")
    out = F.replace(F.regexp_replace(out, r"(?d)DO.+?;\s", ""), F.lit('"'), F.lit(""))
    out = strip_end(F.regexp_replace(out, r"(?d)/n.+?=", ""))
    return F.when(text != "", F.substring(out, F.lit(1), F.greatest(F.char_length(out) - 1, F.lit(0))))


def similarity_text(text: Column) -> Column:
    """Similarity text from behind its heading, first letter upper case, without evidence tags."""
    out = F.regexp_replace(text, r"(?d)SIM.+the\s", "")
    out = F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, 2, 1_000_000_000))
    return F.when(text != "", strip_end(F.regexp_replace(out, r"(?d)\s\{ECO:.+?\}\.", "")))


def buffer_text(buffer: Column) -> Column:
    """Buffer struct as text: ``name: amount units`` of each component and the pH, joined by `` + ``.

    A name with 'detergent' gives way to the formula, as does a missing name; a missing pH prints ``pH None``. A
    component whose formula is needed but missing makes the whole text null. Null elements are left out.
    """
    ph = F.concat(F.lit("pH "), F.coalesce(buffer["ph"], F.lit("None")))
    name = lambda c: F.when(c["name"].isNull() | F.contains(F.lower(c["name"]), F.lit("detergent")), c["formula"]).otherwise(c["name"])
    amount = lambda c: F.when(c["concentration"].isNull(), F.lit("")).otherwise(F.concat(F.coalesce(c["concentration"]["valueOf_"], F.lit("")), F.lit(" "), F.coalesce(c["concentration"]["units"], F.lit(""))))
    parts = F.transform(F.filter(buffer["component"], lambda c: c.isNotNull()), lambda c: F.concat(name(c), F.lit(": "), amount(c)))
    joined = F.when(F.exists(parts, lambda p: p.isNull()), F.lit(None)).otherwise(F.array_join(F.concat(parts, F.array(ph)), " + "))
    return F.when(buffer.isNotNull(), F.when(buffer["component"].isNull(), ph).otherwise(joined))


def flanks(sequence: Column, begin: Column, end: Column, length: int = 5) -> tuple[Column, Column]:
    """Up to ``length`` residues before and behind a 1-based inclusive region; '' at the ends and for length 0."""
    low = F.greatest(begin - 1 - length, F.lit(0))
    before = F.substring(sequence, low + 1, F.greatest(begin - 1 - low, F.lit(0)))
    behind = F.substring(sequence, end + 1, F.lit(length))
    return before, F.when(end < F.char_length(sequence), behind).otherwise(F.when(sequence.isNotNull(), F.lit("")))


def slice_1based(sequence: Column, begin: Column, end: Column) -> Column:
    """1-based inclusive region of a sequence."""
    return F.substring(sequence, begin, F.greatest(end - begin + 1, F.lit(0)))


def slice_0based(sequence: Column, start: Column, end: Column) -> Column:
    """0-based inclusive region of a sequence."""
    return F.substring(sequence, start + 1, F.greatest(end - start + 1, F.lit(0)))


def prompt_text(prompt: Column, context: Column) -> Column:
    return F.concat(prompt, F.lit("\n\n**Context:**\n"), context, F.lit("\n\n**Answer:"))


def file_stem(name: Column) -> Column:
    """A name that is safe as a file name."""
    return F.regexp_replace(strip_ends(name), r"[/\\ ]", "_")


def first_values(maps: Column) -> Column:
    """First value of every map of an array."""
    return F.transform(maps, lambda m: F.get(F.map_values(m), F.lit(0)))


# Paths of the two services below their roots.
def simulation_url(root: str, code: Column, suffix: str = "_default_dppc") -> Column:
    """Address of the residue contacts of a structure's simulation below ``root``; null for a null code."""
    return F.concat(F.lit(root + "data/memprotmd/simulations/"), F.lower(code), F.lit(suffix + "/files/contacts/by_resid_postprocess.csv"))


def accessions_url(root: str, codes: Column, fields: tuple[str, ...]) -> Column:
    """Address of a batch of accessions (an array of codes) with the wanted fields below ``root``."""
    return F.concat(F.lit(root + "/uniprotkb/accessions?accessions="), F.array_join(codes, ","), F.lit("&fields=" + ",".join(fields) + "&format=tsv"))
