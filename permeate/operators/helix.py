"""Helix rows and segment classes of membrane proteins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permeate.functions import sequence as seq
from permeate.functions import text_clean as tc

# Region types that say nothing about the side before a helix.
AMBIGUOUS = ("F", "H", "U", "L", "I", "0")


def lagged_regions(regions: Column, type_field: str = "_type") -> Column:
    """Array of (region, prev_type): the type of the region before, '0' for the first; null elements are left out."""
    live = F.filter(regions, lambda r: r.isNotNull())
    return F.transform(live, lambda r, i: F.struct(r.alias("region"), F.when(i == 0, F.lit("0")).otherwise(F.get(live, i - 1)[type_field]).alias("prev_type")))


def helix_rows(chains: DataFrame, flank_length: int = 5, types: tuple[str, ...] = ("H",)) -> DataFrame:
    """One row per region of the given types with its slice and flanks.

    ``chains`` has pdbCode, chain_id, num_tm, chain_type, sequence and regions (array of structs with the fields
    _seq_beg, _seq_end, _pdb_beg, _pdb_end, _type). The lag runs inside the array, before the filter, so nothing is
    shuffled. Chains without regions give no row.
    """
    wanted = F.filter(lagged_regions(F.col("regions")), lambda x: x["region"]["_type"].isin(*types))
    one = chains.select("pdbCode", "chain_id", "num_tm", "chain_type", "sequence", F.explode(wanted).alias("x"))
    begin, end = F.col("x.region._seq_beg"), F.col("x.region._seq_end")
    before, behind = tc.flanks(F.col("sequence"), begin, end, flank_length)
    return one.select(
        "pdbCode",
        "chain_id",
        "num_tm",
        "chain_type",
        F.col("x.region._type").alias("region_type"),
        F.col("x.prev_type").alias("prev_type"),
        begin.alias("region_beg"),
        end.alias("region_end"),
        F.col("x.region._pdb_beg").alias("pdb_beg"),
        F.col("x.region._pdb_end").alias("pdb_end"),
        before.alias("n_flank"),
        tc.slice_1based(F.col("sequence"), begin, end).alias("region_seq"),
        behind.alias("c_flank"),
    )


def helix_view(rows: DataFrame, align: bool = False, remove_ambiguous: bool = True, lenient: bool = True) -> DataFrame:
    """Helix rows with their flanked sequence; aligned ones run from side 1 to side 2.

    ``remove_ambiguous`` keeps known sides only and makes prev_type a number (null where it is none and ``lenient``,
    else an error). Only then can ``align`` reverse the rows that come from side 2.
    """
    out = rows.withColumn("flanked_region_seq", F.concat("n_flank", "region_seq", "c_flank"))
    if remove_ambiguous:
        out = out.where(~F.coalesce(F.col("prev_type").isin(*AMBIGUOUS), F.lit(False)))
        out = out.withColumn("prev_type", F.col("prev_type").try_cast("int") if lenient else F.col("prev_type").cast("int"))
    keep = ["row_id"] if "row_id" in rows.columns else []
    out = out.select(*keep, "pdbCode", "chain_id", "num_tm", "prev_type", "region_seq", "flanked_region_seq")
    if align:
        turn = F.col("prev_type") == 2 if remove_ambiguous else F.lit(False)
        for name in ("region_seq", "flanked_region_seq"):
            out = out.withColumn(f"{name}_aligned", F.coalesce(F.when(turn, F.reverse(name)), F.col(name)))
    return out


def classified_segments(df: DataFrame, sequence: str, segments: str) -> DataFrame:
    """Adds ``segment_classes``: the class of each segment of a text such as ``10,30 45,60`` (0-based, inclusive).

    Always an array, empty for an empty list, null for a null; bad numbers raise. Arrow batches, no shuffle.
    """

    @F.pandas_udf("array<string>")
    def classes(text: pd.Series, sequences: pd.Series) -> pd.Series:
        return pd.Series([seq.classify_segments(a, b) for a, b in zip(text, sequences)])

    return df.withColumn("segment_classes", classes(F.col(segments), F.col(sequence)))


def window_rows(df: DataFrame, row_id: str, sequence: str) -> DataFrame:
    """``(row_id, start, entropy, octanol, interface, difference)`` for every window start (1-based).

    Entropy is that of 12 residues, the scales are sums of 19; where the longer window does not fit they are null.
    Sequences of less than 12 residues and nulls give no row.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for i, text in zip(batch["row_id"], batch["sequence"]):
                e = seq.window_entropy(text)
                h = np.full((len(e), 3), np.nan)
                sums = seq.window_hydrophobicity(text)
                h[: len(sums)] = sums
                parts.append((np.full(len(e), i), np.arange(1, len(e) + 1), e, h))
            if parts:
                ids, start, entropy, scales = (np.concatenate(x) for x in zip(*parts))
                frame = pd.DataFrame({"row_id": ids, "start": start, "entropy": entropy})
                for k, name in enumerate(("octanol", "interface", "difference")):
                    frame[name] = pd.arrays.FloatingArray(scales[:, k], np.isnan(scales[:, k]))
                yield frame

    rows = df.select(F.col(row_id).cast("long").alias("row_id"), F.col(sequence).alias("sequence")).where(F.char_length("sequence") >= seq.ENTROPY_WINDOW)
    return rows.mapInPandas(work, "row_id long, start long, entropy double, octanol double, interface double, difference double")
