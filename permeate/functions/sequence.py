"""Sequence statistics of protein segments.

Statistics of one text are Catalyst expressions. Statistics of all windows of a text are numpy kernels over prefix
sums (`window_entropy`, `window_hydrophobicity`): as nested higher-order functions they are interpreted and took a
hundred times as long.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (interface scale, octanol scale, octanol minus interface) of each residue.
HYDROPHOBICITY = {
    "A": (0.17, 0.51, 0.33),
    "R": (0.81, 1.81, 1.00),
    "N": (0.42, 0.85, 0.43),
    "D": (1.23, 3.64, 2.41),
    "C": (-0.24, -0.02, 0.22),
    "E": (2.02, 3.63, 1.61),
    "Q": (0.58, 0.77, 0.19),
    "G": (0.01, 1.15, 1.14),
    "H": (0.96, 2.33, 1.37),
    "I": (-0.31, -1.12, -0.81),
    "L": (-0.56, -1.25, -0.69),
    "K": (0.99, 2.80, 1.81),
    "M": (-0.23, -0.67, -0.44),
    "F": (-1.13, -1.71, -0.58),
    "P": (0.45, 0.14, -0.31),
    "S": (0.13, 0.46, 0.33),
    "T": (0.14, 0.25, 0.11),
    "W": (-1.85, -2.09, -0.24),
    "Y": (-0.94, -0.71, 0.23),
    "V": (0.07, -0.46, -0.53),
}
UNKNOWN_RESIDUE = 0.33  # fixed value: difference scale of any other letter
# Residues of each entropy group; isoleucine, leucine and valine are one group.
ENTROPY_GROUPS = ("ILV", "C", "A", "M", "W", "F", "P", "G", "R", "N", "D", "E", "Q", "H", "K", "S", "T", "Y")
# Centre and spread of entropy and hydrophobicity, slope of the sign line, class limits.
ENTROPY_CENTRE, ENTROPY_SPREAD, HYDRO_CENTRE, HYDRO_SPREAD = 2.4, 0.30, -0.64, 2.85
SIGN_SLOPE, COMPLEX_FROM, SIMPLE_TO = 0.436, -3.29, -5.41
ENTROPY_WINDOW, HYDRO_WINDOW = 12, 19


def residue_hydrophobicity(letter: Column) -> Column:
    """Difference scale of one residue, in any case; 0.33 for any other letter."""
    table = F.create_map(*[F.lit(x) for k, v in HYDROPHOBICITY.items() for x in (k, v[2])])
    return F.coalesce(F.element_at(table, F.upper(letter)), F.lit(UNKNOWN_RESIDUE))


def _with_counts(df: DataFrame, sequence: str, keys: dict[str, str]) -> DataFrame:
    """Adds ``_n_<key>``: how often each key letter stands in the text, once other letters are gone and the letters
    of ``keys`` are replaced. Plain string functions in staged projections, so each count is made once."""
    source, target = "".join(keys), "".join(keys.values())
    kept = F.translate(F.regexp_replace(F.upper(sequence), f"[^{source}]", ""), source, target)
    out = df.withColumn("_t", kept)
    return out.withColumns({f"_n_{k}": F.char_length("_t") - F.char_length(F.replace(F.col("_t"), F.lit(k), F.lit(""))) for k in dict.fromkeys(keys.values())})


def add_group_entropy(df: DataFrame, sequence: str, out: str) -> DataFrame:
    """Adds the Shannon entropy (bits) over 18 residue groups; -1 where no known residue stands, null for null."""
    keys = {letter: g[0] for g in ENTROPY_GROUPS for letter in g}
    counted = _with_counts(df, sequence, keys).withColumn("_total", F.nullif(F.char_length("_t"), F.lit(0)))
    names = [f"_n_{g[0]}" for g in ENTROPY_GROUPS]
    share = counted.withColumns({f"_s{n}": F.col(n) / F.col("_total") for n in names})
    # log2 of 0 is null
    terms = [F.coalesce(F.col(f"_s{n}") * F.log2(F.col(f"_s{n}")), F.lit(0.0)) for n in names]
    entropy = F.when(F.col("_total").isNotNull(), -sum(terms[1:], terms[0])).otherwise(F.when(F.col("_t").isNotNull(), F.lit(-1.0)))
    return share.withColumn(out, entropy).select(*df.columns, out)


def add_hydrophobicity(df: DataFrame, sequence: str) -> DataFrame:
    """Adds ``octanol``, ``interface`` and ``difference``: summed scales; zeros where no known residue stands."""
    counted = _with_counts(df, sequence, {k: k for k in HYDROPHOBICITY})

    def total(i: int) -> Column:
        terms = [F.col(f"_n_{k}") * float(v[i]) for k, v in HYDROPHOBICITY.items()]
        return sum(terms[1:], terms[0])

    return counted.withColumns({"octanol": total(1), "interface": total(0), "difference": total(2)}).select(*df.columns, "octanol", "interface", "difference")


def mean_std(values: Column) -> Column:
    """Struct (mean, std) of an array, population deviation from the moments; (-1, -1) for an empty array."""
    n = F.size(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x)
    mean = total / n
    std = F.sqrt(F.greatest(squares / n - mean * mean, F.lit(0.0)))
    return F.when(n > 0, F.struct(mean.alias("mean"), std.alias("std"))).otherwise(F.struct(F.lit(-1.0).alias("mean"), F.lit(-1.0).alias("std")))


def signed_zscore(entropy: Column, hydro: Column, correlation: float | None = None) -> Column:
    """Squared distance from the reference centre, negative on the simple side of the sign line."""
    de, dh = entropy - ENTROPY_CENTRE, hydro - HYDRO_CENTRE
    z = de * de / (ENTROPY_SPREAD**2) + dh * dh / (HYDRO_SPREAD**2)
    if correlation is not None:
        z = z - 2 * correlation * de * dh / (ENTROPY_SPREAD * HYDRO_SPREAD)
    return F.when(SIGN_SLOPE * ENTROPY_SPREAD * dh < -1 * HYDRO_SPREAD * de, -z).otherwise(z)


def segment_class(z: Column) -> Column:
    return F.when(z >= COMPLEX_FROM, "complex").when(z <= SIMPLE_TO, "simple").otherwise("twilight")


# ---------------------------------------------------------------- kernels over all windows of one sequence

_GROUP_OF = np.full(128, -1, dtype=np.int64)
_SCALES = np.zeros((128, 3))
_RESIDUE = np.full(128, UNKNOWN_RESIDUE)
for _n, _letters in enumerate(ENTROPY_GROUPS):
    for _c in _letters:
        _GROUP_OF[[ord(_c), ord(_c.lower())]] = _n
for _c, (_i, _o, _d) in HYDROPHOBICITY.items():
    _SCALES[[ord(_c), ord(_c.lower())]] = (_o, _i, _d)
    _RESIDUE[[ord(_c), ord(_c.lower())]] = _d


def _codes(sequence: str) -> np.ndarray:
    raw = np.frombuffer(sequence.encode("utf-32-le"), dtype=np.uint32)
    return np.where(raw < 128, raw, 0).astype(np.int64)


def window_entropy(sequence: str, width: int = ENTROPY_WINDOW) -> np.ndarray:
    """Group entropy of every window; -1 where a window holds no known residue."""
    groups = _GROUP_OF[_codes(sequence)]
    if len(groups) < width:
        return np.zeros(0)
    hot = np.zeros((len(groups) + 1, len(ENTROPY_GROUPS)))
    known = groups >= 0
    hot[1:][known, groups[known]] = 1.0
    sums = np.cumsum(hot, axis=0)
    counts = sums[width:] - sums[:-width]
    total = counts.sum(axis=1, keepdims=True)
    share = np.divide(counts, total, out=np.zeros_like(counts), where=total > 0)
    log = np.log2(share, out=np.zeros_like(share), where=share > 0)
    return np.where(total[:, 0] > 0, -(share * log).sum(axis=1), -1.0)


def window_hydrophobicity(sequence: str, width: int = HYDRO_WINDOW) -> np.ndarray:
    """Summed (octanol, interface, difference) scales of every window."""
    values = _SCALES[_codes(sequence)]
    if len(values) < width:
        return np.zeros((0, 3))
    sums = np.vstack([np.zeros((1, 3)), np.cumsum(values, axis=0)])
    return sums[width:] - sums[:-width]


def extend_segment(sequence: str, start: int, end: int, target: int = HYDRO_WINDOW) -> str:
    """A 0-based inclusive segment grown to at least ``target`` residues.

    Each step looks one residue out on both sides and keeps the more hydrophobic one (the lower value), both on a
    tie, and the only one there is at an end of the sequence. Where both lie outside, both are kept, and a segment
    that then reaches before the begin is the tail of the sequence of that length.
    """
    own = sequence[start : end + 1]
    if len(own) >= target:
        return own
    value = _RESIDUE[_codes(sequence)]
    n, left, right = len(sequence), start, end
    for _ in range(target - len(own)):
        if right - left + 1 >= target:
            break
        a = value[left - 1] if left >= 1 else None
        b = value[right + 1] if right + 1 < n else None
        if a is None and b is None:
            left, right = left - 1, right + 1
            continue
        if b is None or (a is not None and a <= b):
            left -= 1
            if b is not None and a == b:
                right += 1
        else:
            right += 1
    return sequence[left:] if left < 0 else sequence[left : right + 1]


def segment_zscore(helix: str) -> float:
    """Signed z-score of a helix; a missing window mean counts as -1."""
    entropy, hydro = window_entropy(helix), window_hydrophobicity(helix)[:, 2]
    e = float(entropy.mean()) if len(entropy) else -1.0
    h = float(hydro.mean()) if len(hydro) else -1.0
    de, dh = e - ENTROPY_CENTRE, h - HYDRO_CENTRE
    z = de * de / ENTROPY_SPREAD**2 + dh * dh / HYDRO_SPREAD**2
    return -z if SIGN_SLOPE * ENTROPY_SPREAD * dh < -HYDRO_SPREAD * de else z


def classify(z: float) -> str:
    return "complex" if z >= COMPLEX_FROM else "simple" if z <= SIMPLE_TO else "twilight"


def classify_segments(segments: str | None, sequence: str | None) -> list[str] | None:
    """Class of each segment of ``10,30 45,60``; [] for an empty list, None for a null."""
    if segments is None or sequence is None:
        return None
    out = []
    for part in segments.split():
        start, end = map(int, part.split(","))
        out.append(classify(segment_zscore(extend_segment(sequence, start, end))))
    return out
