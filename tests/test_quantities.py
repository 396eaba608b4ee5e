"""Problem 3: quantities in common units."""

import pytest
from pyspark.sql import functions as F

from permeate.functions import quantities as q
from permeate.operators import quantities as op

AMOUNTS = [
    ("150", "mM", "molar", 150_000_000),
    ("150 mM", None, "molar", 150_000_000),
    ("150 mmol l-1", "", "molar", 150_000_000),
    ("1,5", "mol/m3", "molar", 1_500_000),
    (".5", "M final", "molar", 500_000_000),
    ("2 x 10^3", "µM", "molar", 2_000_000),
    ("2*10^-1", "pmol/uL", "molar", 200),
    ("1e2", "nM", "molar", 100),
    ("c = ~5", "MILLIMOLAR", "molar", 5_000_000),
    ("diluted to 5 mmol/dm^3", None, "molar", 5_000_000),
    ("0.000010", "molar", "molar", 10_000),
    ("2.5E-2", "M", "molar", 25_000_000),
    ("5", "mmol per litre (final)", "molar", 5_000_000),
    ("1", "% (w/v)", "mass", 10_000),
    ("0.2 w/v", "%", "mass", 2_000),
    ("1", "g/100 mL", "mass", 10_000),
    ("2", "micrograms per millilitre", "mass", 2),
    ("3", "kg/m3", "mass", 3_000),
    ("2", "mg ml-1", "mass", 2_000),
    ("1500ng/uL", None, "mass", 1_500),
    ("10", "vol%", "volume", 100_000),
    ("5", "%(vol/vol)", "volume", 50_000),
    ("5 mL/L", "mL/L", "volume", 5_000),
]
NONE = [("10-20", "mM"), ("0.5–1", "mg/mL"), ("1 to 5", "% w/v"), ("saturated", "mM"), ("n/a", "n/a"), ("", ""), (None, "mM"), ("2", "x CMC"), ("3", "drops"), ("5", "units/mL"), ("5", None), ("5", "%")]


def test_amounts(spark):
    rows = [(i, v, u) for i, (v, u, *_) in enumerate(AMOUNTS + NONE)]
    out = {r.i: (r.kind, r.value, r.status) for r in q.read_amounts(spark.createDataFrame(rows, "i int, v string, u string"), "v", "u").collect()}
    for i, (_, _, kind, value) in enumerate(AMOUNTS):
        assert out[i] == (kind, value, "stated"), AMOUNTS[i]
    for i in range(len(AMOUNTS), len(rows)):
        assert out[i][2] != "stated", rows[i]


@pytest.mark.parametrize(("name", "text"), [("NaCl, 5 mM", "5 mM"), ("NaCl (5 mmol l-1)", "5 mmol l-1"), ("urea - 2 M", "2 M"), ("Tris 0.1 % (w/v)", "0.1 % (w/v)"), ("CaCl2 · 2 H₂O", ""), ("2-morpholinoethanesulfonic acid", ""), ("C8H18N2O4S", ""), ("lipid mix 7", "")])
def test_amount_in_name(spark, name, text):
    got = spark.createDataFrame([(name,)], "n string").select(q.amount_in_name(F.col("n"))).first()[0]
    assert got == text or (not text and q.unit_table().get(got.split(" ", 1)[-1].lower()) is None)


PH = [
    ("7.5", 750),
    (" 7 ", 700),
    ("pH 7.45", 745),
    ("ph=8", 800),
    ("6,8", 680),
    ("~7.2", 720),
    ("about 7", 700),
    ("7.4 +/- 0.2", 740),
    ("7.5 (25 °C)", 750),
    ("8 at 4 C", 800),
    ("7.2 @ RT", 720),
    ("[H+] = 1.000e-07 mol/L", 700),
    ("[H+] = 3.162e-08 M", 750),
    ("39.81 nM H+", 740),
    ("1.5e+04 nM H+", 482),
    ("7 to 8", None),
    ("7.0-7.5", None),
    ("neutral", None),
    ("", None),
    ("n/a", None),
    (None, None),
]


def test_ph_field(spark):
    rows = [(i, t) for i, (t, _) in enumerate(PH)]
    out = {r.i: r.v for r in q.read_ph(spark.createDataFrame(rows, "i int, t string"), "t", "v").collect()}
    assert out == {i: v for i, (_, v) in enumerate(PH)}


def test_ph_in_text(spark):
    rows = [(0, "Kept cold. Final pH was 7.4."), (1, "pH=8,09, degassed."), (2, "The pH of the eluate read 6.5 on the meter."), (3, "The pH electrode was recalibrated. Run at 4 degrees."), (4, "No pH was noted."), (5, None), (6, "Sample at a pH of about 7.")]
    out = {r.i: r.v for r in q.read_ph_in_text(spark.createDataFrame(rows, "i int, t string"), "t", "v").collect()}
    assert out == {0: 740, 1: 809, 2: 650, 3: None, 4: None, 5: None, 6: 700}


SCHEMA = "row_id long, kind string, structure_determination_list array<struct<specimen_preparation_list: struct<specimen_preparation: array<struct<buffer: struct<ph: string, component: array<struct<name: string, formula: string, concentration: struct<valueOf_: string, units: string>>>>, details: string>>>>>"


def entry(i, ph, parts, details=None):
    return (i, "clash", [(([((ph, parts), details)],),)])


def test_whole_entries(spark):
    rows = [entry(1, "7", [("NaCl, 5 mM", None, None), None, ("KCl", None, ("2", "M"))]), entry(1, None, None, "pH 7.1"), (2, None, None), (3, "x", [])]
    got = sorted(tuple(r) for r in op.quantities(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, "0.0", "ph", 700), (1, "0.0", "ph", 710), (1, "0.0.0", "molar", 5_000_000), (1, "0.0.2", "molar", 2_000_000_000)]
    assert op.quantities(spark.createDataFrame([], SCHEMA)).count() == 0


def test_missing_units_are_predicted_or_reviewed(spark):
    rows = []
    for i in range(300):
        parts = [("NaCl", "NaCl", (str(50 + i % 100), "mM")), ("detergent x", None, (f"0.{1 + i % 9}", "% w/v"))]
        parts.append(("KCl", "KCl", (str(60 + i % 90), None)))
        rows.append(entry(i, "7", parts))
    out = op.predict_units(spark.createDataFrame(rows, SCHEMA))
    got = out.groupBy("route").count().collect()
    assert sum(r["count"] for r in got) == 300
    sure = out.where("route = 'converted'").collect()
    assert len(sure) > 200 and sum(r.predicted_kind == "molar" for r in sure) >= 0.95 * len(sure)
    assert all(r.value == round(r.number * 1e6) for r in sure if r.predicted_kind == "molar")
    assert op.predict_units(spark.createDataFrame([entry(1, None, [("a", None, ("5", None))])], SCHEMA)).first().route == "review"


def quality_rows():
    rows = []
    for i in range(400):
        parts = [("NaCl", "NaCl", (str(50 + i % 100), "mM")), (f"detergent {i % 3}", None, (f"0.{1 + i % 9}", "% w/v")), ("EDTA", None, (str(100 + i % 50), "uM"))]
        rows.append(entry(i, "7", parts))
    return rows


def test_held_out_accuracy_and_routes(spark):
    out = {r.route: r for r in op.unit_quality(spark.createDataFrame(quality_rows(), SCHEMA)).collect()}
    assert out["converted"].accuracy >= 0.95 and out["converted"].n_amounts >= 150
    assert sum(r.n_amounts for r in out.values()) % 3 == 0  # whole rows are held out
    assert op.unit_quality(spark.createDataFrame([], SCHEMA)).count() == 0


def test_features_look_at_others_only(spark):
    rows = [entry(1, None, [("NaCl", None, ("5", "mM")), ("KCl", None, ("2", "g/L")), ("x", None, ("7", None))]), entry(2, None, [("NaCl", None, ("9", "mM"))]), entry(2, None, [("NaCl", None, ("8", "mM"))])]
    for n in (1, 4):
        got = {(r.row_id, r.path, r.number): r for r in op.unit_features(spark.createDataFrame(rows, SCHEMA).repartition(n)).collect()}
        assert len(got) == 5
        a, b, x = got[1, "0.0.0", 5.0], got[1, "0.0.1", 2.0], got[1, "0.0.2", 7.0]
        assert (a.n_near, a.near_kind, a.near_bare) == (1, 2.0, 1) and (b.near_kind, x.n_near) == (1.0, 2)
        assert b.category_known == 0 and b.category_kind == -1 and a.category_kind == 1.0 and x.category_known == 0
        assert got[2, "0.0.0", 9.0].n_near == 0  # rows of one id stay apart


ADDED = [
    ("5 +/- 1 mM", None, "molar", 5_000_000),
    ("5 ± 0.5", "mM", "molar", 5_000_000),
    ("5 mM ± 1 mM", None, "molar", 5_000_000),
    ("2 ± 10 % mg/mL", None, "mass", 2_000),
    ("2 mg/mL ± 10 %", None, "mass", 2_000),
    ("1 ± 0.1 % w/v", None, "mass", 10_000),
    ("1 +/- 0.1", "% (v/v)", "volume", 10_000),
    ("5", "mM (25 °C)", "molar", 5_000_000),
    ("5 mM at 4 C", None, "molar", 5_000_000),
    ("5 mM @ RT", "", "molar", 5_000_000),
]


def test_tolerance_and_temperature_of_amounts(spark):
    rows = [(i, v, u) for i, (v, u, *_) in enumerate(ADDED)] + [(len(ADDED), "5 ± 1", None)]
    out = {r.i: (r.kind, r.value, r.status) for r in q.read_amounts(spark.createDataFrame(rows, "i int, v string, u string"), "v", "u").collect()}
    for i, (_, _, kind, value) in enumerate(ADDED):
        assert out[i] == (kind, value, "stated"), ADDED[i]
    assert out[len(ADDED)][2] == "unitless"


RANGES = ["NaCl 5-10 mM", "NaCl (5-10 mM)", "NaCl, 5 to 10 mM", "NaCl 5 – 10 mM", "NaCl (5–10 mM)", "NaCl 5 mM to 10 mM", "NaCl, 5 mM - 10 mM", "NaCl ~5 -10 mM", "NaCl - 1,5 - 2 g/L", "NaCl (0.5 % (w/v) - 1 % (w/v))"]
IN_NAMES = [
    ("NaCl 5 +/- 1 mM", 5_000_000),
    ("NaCl (5 mM ± 1 mM)", 5_000_000),
    ("NaCl, 5 mM ± 1", 5_000_000),
    ("NaCl 5 mM at 4 °C", 5_000_000),
    ("NaCl - 5 mM (RT)", 5_000_000),
    ("velnira-117 - 200 mM", 200_000_000),
    ("PEG 400 - 500 mM", 500_000_000),
    ("lipid mix 7 - 5 mM", 5_000_000),
    ("lipid mix 7, 9 mM", 9_000_000),
    ("2-(4-hydroxyethylpiperazin-1-yl)ethanesulfonic acid - 1 mM", 1_000_000),
]


def test_p3_found_reads_names_without_ranges_and_with_tolerances(spark):
    rows = [entry(1, None, [(n, None, None) for n in RANGES]), entry(2, None, [(n, None, None) for n, _ in IN_NAMES])]
    got = {(r.row_id, r.path): (r.kind, r.value) for r in op.quantities(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [RANGES[i] for i in range(len(RANGES)) if (1, f"0.0.{i}") in got] == []
    assert [(n, got.get((2, f"0.0.{i}"))) for i, (n, _) in enumerate(IN_NAMES)] == [(n, ("molar", v)) for n, v in IN_NAMES]
