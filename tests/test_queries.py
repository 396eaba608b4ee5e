"""Every query of the core with SQL, on the smallest tables, against DuckDB."""

import datetime
import glob
import math
import os
import re

import duckdb
import numpy as np
import pytest

from permeate.models import backends
from permeate.plans import catalogue

DATA = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6g}"
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    con.execute("set timezone='UTC'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_against_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    rel = duck.sql(catalogue.ORACLE[name])
    cols, names = sorted(rel.columns), rel.columns
    assert sorted(df.columns) == cols
    want = sorted(str([norm(r[names.index(c)]) for c in cols]) for r in rel.fetchall())
    assert sorted(str([norm(r[c]) for c in cols]) for r in df.collect()) == want


def rows(duck, sql):
    return duck.sql(sql).fetchall()


WITHOUT_SQL = {"embed_stub", "rest_stub", "p3_found", "p3_missing_units", "p3_unit_quality"}


def test_every_query_has_sql_or_a_test_here():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE) == WITHOUT_SQL


def test_embed_stub(spark, duck):
    model = backends.hash_embedder()
    texts = dict(rows(duck, "select text_id, coalesce(chunk_text, '') from text_database"))
    got = catalogue.QUERIES["embed_stub"](spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got[::7]:
        want = model([texts[r.text_id]])[0]
        assert np.allclose(r.embedding, want / np.linalg.norm(want), atol=1e-5)


def test_rest_stub(spark, duck):
    codes = {c for (c,) in rows(duck, "select distinct rcsb_id from structures where rcsb_id is not null")}
    got = catalogue.QUERIES["rest_stub"](spark, DATA).collect()
    assert len(got) == len(codes) and {r.key for r in got} == codes
    assert all((r.body == f'{{"id": "{r.key}"}}') if r.error is None else r.error == "OSError: no answer" for r in got)


COMPONENTS = """with d as (select row_id, unnest(structure_determination_list) as d, generate_subscripts(structure_determination_list, 1) - 1 as i from emdb_entries),
s as (select row_id, i || '.' || (generate_subscripts(d.specimen_preparation_list.specimen_preparation, 1) - 1) as path, unnest(d.specimen_preparation_list.specimen_preparation) as s from d),
c as (select row_id, path || '.' || (generate_subscripts(s.buffer.component, 1) - 1) as path, unnest(s.buffer.component) as c from s)
select row_id, path, c.concentration.valueOf_ as v, c.concentration.units as u from c where c.concentration is not null"""
FACTOR = {"M": 10**9, "mM": 10**6, "uM": 10**3, "µM": 10**3, "μM": 10**3, "nM": 1}


def test_p3_found_against_a_plain_reading(spark, duck):
    """Amounts in the plain notation ``12.5 mM`` (or with the unit in its own field) read by Python, and no amount twice."""
    got = catalogue.QUERIES["p3_found"](spark, DATA).collect()
    found = {(r.row_id, r.path): (r.kind, r.value) for r in got if r.kind != "ph"}
    assert len(found) == sum(r.kind != "ph" for r in got)
    n = 0
    for row_id, path, v, u in rows(duck, COMPONENTS):
        m = re.fullmatch(r"(\d+(?:\.\d+)?)\s*([mnuµμ]?M)?", (v or "").strip())
        unit = (m and m[2]) or (u or "").strip()
        if m and unit in FACTOR and (not m[2] or not (u or "").strip() or (u or "").strip() == m[2]):
            n += 1
            assert found[row_id, path] == ("molar", round(float(m[1]) * FACTOR[unit])), (v, u)
    assert n > 20
    assert all(r.kind in ("molar", "mass", "volume", "ph") and r.value is not None for r in got)


def test_p3_missing_units_are_the_unitless_amounts(spark, duck):
    got = {(r.row_id, r.path): r for r in catalogue.QUERIES["p3_missing_units"](spark, DATA).collect()}
    found = {(r.row_id, r.path) for r in catalogue.QUERIES["p3_found"](spark, DATA).where("kind <> 'ph'").collect()}
    bare = {(i, p) for i, p, v, u in rows(duck, COMPONENTS) if re.fullmatch(r"\d+(?:\.\d+)?", (v or "").strip()) and not (u or "").strip()}
    assert bare and bare <= set(got) and not found & set(got)
    assert all((r.value is None) == (r.route == "review") for r in got.values())


def test_p3_unit_quality(spark):
    out = {r.route: r for r in catalogue.QUERIES["p3_unit_quality"](spark, DATA.replace("0.001", "0.01")).collect()}
    assert out["converted"].accuracy >= 0.8 and abs(out["converted"].accuracy - out["converted"].mean_confidence) < 0.15
