"""Radius join and accessible surface against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from permeate.operators import spatial

SCHEMA = "structure_id string, model_id int, chain_id string, residue_id string, atom_id long, element string, x double, y double, z double"


def brute(atoms, n, probe=1.4):
    radius = {i: spatial.RADII.get(e.upper(), 2.0) + probe for i, e, *_ in atoms}
    out = {}
    for i, _, *p in atoms:
        free = 0
        for s in spatial.sphere_points(n):
            q = [a + radius[i] * b for a, b in zip(p, s)]
            free += not any(j != i and sum((a - b) ** 2 for a, b in zip(q, o)) <= radius[j] ** 2 for j, _, *o in atoms)
        out[i] = free
    return out


def frame(spark, atoms, structure="s"):
    return spark.createDataFrame([(structure, 1, "A", f"r{i % 3}", i, e, x, y, z) for i, e, x, y, z in atoms], SCHEMA)


def test_surface_equals_brute_force(spark):
    rng = random.Random(2)
    atoms = [(i, rng.choice(["C", "N", "o", "Zn", "QQ"]), *(rng.uniform(-6, 6) for _ in range(3))) for i in range(60)]
    got = {r.atom_id: (r.n_free, r.sasa) for r in spatial.surface(frame(spark, atoms), n_points=130).collect()}
    want = brute(atoms, 130)
    assert {i: n for i, (n, _) in got.items()} == want
    assert 0 in want.values() or len(want) == 60
    total = spatial.surface(frame(spark, atoms), n_points=130, level="R").agg(F.sum("sasa")).first()[0]
    assert math.isclose(total, sum(s for _, s in got.values()))


def test_isolated_coincident_and_foreign_atoms(spark):
    alone = spatial.surface(frame(spark, [(1, "C", 0.0, 0.0, 0.0), (2, "C", 50.0, 0.0, 0.0)])).collect()
    assert all(math.isclose(r.sasa, 4 * math.pi * 3.1**2) for r in alone)
    same = spatial.surface(frame(spark, [(1, "C", 0.0, 0.0, 0.0), (2, "C", 0.0, 0.0, 0.0)])).collect()
    assert [r.n_free for r in same] == [0, 0]
    apart = frame(spark, [(1, "C", 0.0, 0.0, 0.0)]).union(frame(spark, [(2, "C", 0.0, 0.0, 0.0)], "t"))
    assert [r.n_free for r in spatial.surface(apart).collect()] == [100, 100]


def test_radius_join_equals_brute_force(spark):
    rng = random.Random(4)
    atoms = [(i, "C", *(rng.uniform(-9, 9) for _ in range(3))) for i in range(150)]
    df = frame(spark, atoms).withColumn("r", F.lit(1.0))
    got = {(r.atom_id, r.other_id) for r in spatial.radius_join(df, F.lit(2.5), 2.5).collect()}
    assert got == {(i, j) for i, _, *p in atoms for j, _, *q in atoms if i != j and math.dist(p, q) <= 2.5}
    plan = spatial.radius_join(df, F.lit(2.5), 2.5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_checks(spark):
    df = frame(spark, [(1, "C", 0.0, 0.0, 0.0)])
    for bad in ({"probe": 0}, {"n_points": 0}, {"level": "X"}):
        with pytest.raises(ValueError):
            spatial.surface(df, **bad)
    with pytest.raises(ValueError):
        spatial.surface(df.limit(0))
    assert spatial.surface(df, n_points=1).first().n_free == 1
    assert spatial.surface(df, radii={"c": 3.0}).first().r == 4.4
