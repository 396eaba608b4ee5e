"""Problem 2: values mapped to a canonical list."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from permeate.llm.canonical import CanonicalList, Near, edits, map_to_list

LIST = [
    (1, "sodium chloride", "NaCl", None),
    (2, "potassium chloride", "KCl", None),
    (3, "lithium nitrate", "LiNO3", None),
    (4, "dimethyl sulfoxide", "C2H6OS", "DMSO"),
    (5, "n-octyl-beta-D-glucoside", "C14H28O6", "OG"),
    (6, "n-octyl-beta-D-maltoside", "C20H38O11", "OM"),
    (7, "sucrose", "C12H22O11", None),
    (8, "trehalose", "C12H22O11", None),
    (9, "boric acid", "BH3O3", None),
    (10, "glycine", "C2H5NO2", "Gly"),
    (11, "calcium nitrate", "Ca(NO3)2", None),
    (12, "2-morpholinoethanesulfonic acid", "C6H13NO4S", "MES"),
]
CASES = [
    ("sodium chloride", None, 1),
    ("Chloride (sodium), 5 mM", None, 1),
    ("SODIUM  CHLOORIDE (200000 nmol/mL)", "n/a", 1),
    ("sodiumchloride", None, 1),
    (None, "NaCl · 2 H₂O", 1),
    ("NaCl.4H2O", "Sodium chlcoride", 1),
    ("the detergent used", "octyl β-D-maltoside", 6),
    ("octylglucoside*", None, 5),
    ("OG / n-octyl-beta-D-glucoside", "-", 5),
    ("DMSO", None, 4),
    ("sulfoxide, dimethyl", None, 4),
    ("acid, boric (analytical grade)", None, 9),
    ("Gly buffer", None, 10),
    ("ca(no3)2", None, 11),
    ("MES - 1 mmol l-1", None, 12),
    ("sucrse", "C12H22O11", 7),
    (None, "C12H22O11", -1),
    ("potassium nitrate", "KNO3", -1),
    ("lithium chloride", None, -1),
    ("molsese acid", None, -1),
    ("detergent", None, -1),
    ("unknown detergent - 2 mmol l-1", None, -1),
    ("?", None, -1),
]


@pytest.mark.parametrize(("name", "formula", "want"), CASES)
def test_match(name, formula, want):
    assert CanonicalList(LIST).match(name, formula)[0] == want


def test_table(spark):
    rows = [(1, "0.0.0", "NaCl", None, "x"), (1, "0.0.0", "NaCl", None, "x"), (2, "0.0.1", None, " ", "x"), (3, "0.0.2", "", "KCl", None), (4, "0.0.3", "w" * 30000, None, None)]
    values = spark.createDataFrame(rows, "row_id long, path string, name string, formula string, ref_id string")
    ref = spark.createDataFrame(LIST, "ref_id long, canonical_name string, formula string, abbreviation string")
    want = [(1, 1), (1, 1), (3, 2), (4, -1)]
    assert sorted((r.row_id, r.ref_id) for r in map_to_list(values, ref).collect()) == want
    blocks = sorted((r.row_id, r.ref_id) for r in map_to_list(values, ref, max_list_rows=5).collect())
    assert blocks == want
    assert map_to_list(values.limit(0), ref).count() == 0
    assert {r.ref_id for r in map_to_list(values, ref.limit(0)).collect()} == {-1}


@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
@settings(max_examples=300, deadline=None)
def test_edits_against_recursion(a, b):
    def far(x, y):
        if not x or not y:
            return len(x) + len(y)
        out = min(far(x[1:], y) + 1, far(x, y[1:]) + 1, far(x[1:], y[1:]) + (x[0] != y[0]))
        if len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0]:
            out = min(out, far(x[2:], y[2:]) + 1)
        return out

    assert edits(a, b, 9) == far(a, b)


WORDS = sorted({w for _, name, _, _ in LIST for w in name.replace("-", " ").split()} | {"sdium", "chlorde", "2", "5", "mM", "buffer", "lithium", "ethanol", "NaCl", "DMSO", "Gly"})


@given(st.lists(st.sampled_from(WORDS), min_size=1, max_size=4), st.sampled_from(["", " ", ", ", "-"]), st.sampled_from([None, "NaCl", "C12H22O11", "n/a"]), st.integers(1, 5))
@settings(max_examples=300, deadline=None)
def test_blocks_match_as_the_whole_list(words, glue, formula, n):
    name = glue.join(words)
    parts = [CanonicalList(LIST[k::n]) for k in range(n)]
    rows = sorted({r for p in parts for r in map(p.rows.get, p.relevant(name, formula))})
    assert CanonicalList(rows).match(name, formula) == CanonicalList(LIST).match(name, formula)


def test_near_words_are_those_of_the_edit_distance():
    import random

    rng = random.Random(4)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    near = Near(words)
    for w in words[:60]:
        got = {x for _, x in near.within(w, 2, lambda n: 2)}
        assert got == {x for x in words if edits(w, x, 2) <= 2}


def test_long_lists(spark):
    """A list of 100,000 names: one look at a misspelled value is cheap, and blocks tell the same."""
    import time

    letters = "abcdefghijklmnopqrst"
    made = [(i, "".join(letters[(i // 20**k + 7 * k) % 20] for k in range(6)) + " acid", None, None) for i in range(100_000)]
    known = CanonicalList(made)
    began = time.perf_counter()
    for ref, name, _, _ in made[:: len(made) // 50]:
        assert known.match(name.upper(), None)[0] == ref
        known.match(name[1] + name[0] + name[2:], None)
    assert (time.perf_counter() - began) / 100 < 0.1
