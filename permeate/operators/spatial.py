"""Radius joins and solvent-accessible surface of atoms.

The radius join is rewritten to an equi-join on grid cells: an inequality join would be a nested loop.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Van der Waals radii of elements in angstrom; any other element has 2.0.
RADII = {
    "H": 1.200,
    "HE": 1.400,
    "C": 1.700,
    "N": 1.550,
    "O": 1.520,
    "F": 1.470,
    "NA": 2.270,
    "MG": 1.730,
    "P": 1.800,
    "S": 1.800,
    "CL": 1.750,
    "K": 2.750,
    "CA": 2.310,
    "NI": 1.630,
    "CU": 1.400,
    "ZN": 1.390,
    "SE": 1.900,
    "BR": 1.850,
    "CD": 1.580,
    "I": 1.980,
    "HG": 1.550,
}
OTHER_RADIUS = 2.0
LEVELS = ("A", "R", "C", "M", "S")
_KEYS = {"S": ["structure_id"], "M": ["structure_id", "model_id"], "C": ["structure_id", "model_id", "chain_id"], "R": ["structure_id", "model_id", "chain_id", "residue_id"]}
_WORD = 60  # points per mask word; a BIGINT holds 63


def atom_radius(element: Column, overrides: dict[str, float] | None = None) -> Column:
    table = {**RADII, **{k.upper(): v for k, v in (overrides or {}).items()}}
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.upper(element)), F.lit(OTHER_RADIUS))


def sphere_points(n: int) -> list[tuple[float, float, float]]:
    """``n`` points of the golden spiral on the unit sphere."""
    out = []
    for k in range(n):
        z = (1 - 1 / n) - k * (2 / n)
        r, a = math.sqrt(max(0.0, 1 - z * z)), k * math.pi * (3 - math.sqrt(5))
        out.append((math.cos(a) * r, math.sin(a) * r, z))
    return out


def radius_join(atoms: DataFrame, reach: Column, largest: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Ordered pairs of different atoms ``(atom_id, other_id, d2, ...)`` with distance at most ``reach`` of the first.

    ``atoms`` has atom_id, x, y, z, r and the key columns within which atoms meet; ``largest`` bounds ``reach``
    and is the edge of a grid cell. Each atom is sent to the 27 cells around it, the others stay in their own.
    """
    cell = lambda c: F.floor(F.col(c) / largest).cast("long")
    cells = atoms.withColumns({"cx": cell("x"), "cy": cell("y"), "cz": cell("z")})
    shifts = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("a", "b", "c"), s)]) for s in product((-1, 0, 1), repeat=3)])
    near = cells.select(*keys, F.col("atom_id"), F.col("x"), F.col("y"), F.col("z"), F.col("r"), reach.alias("reach"), "cx", "cy", "cz", F.explode(shifts).alias("s"))
    near = near.select(*keys, "atom_id", "x", "y", "z", "r", "reach", (F.col("cx") + F.col("s.a")).alias("cx"), (F.col("cy") + F.col("s.b")).alias("cy"), (F.col("cz") + F.col("s.c")).alias("cz"))
    there = cells.select(*keys, F.col("atom_id").alias("other_id"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"), F.col("r").alias("other_r"), "cx", "cy", "cz")
    d2 = (F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2 + (F.col("z") - F.col("oz")) ** 2
    return near.join(there, [*keys, "cx", "cy", "cz"]).where(F.col("atom_id") != F.col("other_id")).withColumn("d2", d2).where(F.col("d2") <= F.col("reach") * F.col("reach")).drop("cx", "cy", "cz")


def surface(atoms: DataFrame, probe: float = 1.40, n_points: int = 100, keys: tuple[str, ...] = ("structure_id",), radii: dict[str, float] | None = None, level: str = "A") -> DataFrame:
    """Accessible surface per atom (``n_free``, ``sasa``) or summed per residue, chain, model or structure.

    ``atoms`` has atom_id, element, x, y, z and the hierarchy columns. A point of an atom's sphere is lost where it
    lies within the sphere of any other atom; buried atoms keep a row with 0. Lost points are one bit mask per pair,
    merged per atom by ``bit_or``, which combines map-side: points are never exploded. Masks have 60 points a word.
    Atoms with a null coordinate take no part.
    """
    if probe <= 0:
        raise ValueError("probe must be positive")
    if n_points < 1:
        raise ValueError("n_points must be 1 or more")
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    own = atoms.where("x is not null and y is not null and z is not null").withColumn("r", atom_radius(F.col("element"), radii) + probe)
    largest = own.agg(F.max("r")).first()[0]
    if largest is None:
        raise ValueError("there are no atoms")
    pairs = radius_join(own.select(*keys, "atom_id", "x", "y", "z", "r"), F.col("r") + F.lit(largest), 2 * largest, keys)
    points = sphere_points(n_points)
    words = [points[a : a + _WORD] for a in range(0, n_points, _WORD)]

    unit = np.array(points)
    bits = [np.array([1 << k for k in range(len(w))], dtype=np.int64) for w in words]
    kind = "struct<" + ", ".join(f"m{i}: bigint" for i in range(len(words))) + ">"

    @F.pandas_udf(kind)
    def mask(dx: pd.Series, dy: pd.Series, dz: pd.Series, r: pd.Series, other: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(dx), len(words)), dtype=np.int64)
        apart = np.column_stack([dx, dy, dz])
        for a in range(0, len(dx), 2048):
            at = apart[a : a + 2048, None, :] + r.to_numpy()[a : a + 2048, None, None] * unit[None]
            # a point on the rim is lost; the factor keeps rounding from deciding it
            lost = (at * at).sum(axis=2) <= (other.to_numpy()[a : a + 2048] ** 2 * (1 + 1e-12))[:, None]
            for i, weights in enumerate(bits):
                out[a : a + 2048, i] = lost[:, i * _WORD : i * _WORD + len(weights)] @ weights
        return pd.DataFrame(out, columns=[f"m{i}" for i in range(len(words))])

    masks = pairs.select(*keys, "atom_id", mask(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"), F.col("z") - F.col("oz"), F.col("r"), F.col("other_r")).alias("m"))
    lost = masks.groupBy(*keys, "atom_id").agg(*[F.bit_or(f"m.m{i}").alias(f"m{i}") for i in range(len(words))])
    n_lost = sum((F.bit_count(F.coalesce(f"m{i}", F.lit(0))) for i in range(1, len(words))), F.bit_count(F.coalesce("m0", F.lit(0))))
    out = own.join(lost, [*keys, "atom_id"], "left").withColumn("n_free", (F.lit(n_points) - n_lost).cast("long"))
    out = out.withColumn("sasa", F.col("n_free") * F.col("r") * F.col("r") * F.lit(4 * math.pi / n_points)).drop(*[f"m{i}" for i in range(len(words))])
    if level == "A":
        return out
    return out.groupBy(*_KEYS[level]).agg(F.sum("sasa").alias("sasa"))
