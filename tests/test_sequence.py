"""Sequence statistics, helices and segment classes against plain definitions."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from permeate.functions import sequence as seq
from permeate.functions import text_clean as tc
from permeate.operators import helix

LETTERS = "ACDEFGHIKLMNPQRSTVWYXBz-"


def plain_entropy(text):
    groups = [next(g for g in seq.ENTROPY_GROUPS if c in g) for c in text.upper() if any(c in g for g in seq.ENTROPY_GROUPS)]
    if not groups:
        return -1.0
    return -sum(p * math.log2(p) for p in (groups.count(g) / len(groups) for g in set(groups)))


def plain_extend(text, start, end):
    """One step at a time, from the definition."""
    own = text[start : end + 1]
    if len(own) >= 19:
        return own
    value = lambda c: seq.HYDROPHOBICITY.get(c.upper(), (0, 0, 0.33))[2]
    lo, hi, steps = start, end, 19 - len(own)
    while steps and hi - lo + 1 < 19:
        steps -= 1
        can_left, can_right = lo - 1 >= 0, hi + 1 < len(text)
        if can_left and can_right:
            a, b = value(text[lo - 1]), value(text[hi + 1])
            lo, hi = lo - (a <= b), hi + (b <= a)
        elif can_right:
            hi += 1
        elif can_left:
            lo -= 1
        else:
            lo, hi = lo - 1, hi + 1
    return text[lo:] if lo < 0 else text[lo : hi + 1]


@given(st.text(LETTERS, max_size=40))
@settings(max_examples=200, deadline=None)
def test_window_entropy(text):
    got = seq.window_entropy(text)
    want = [plain_entropy(text[i : i + 12]) for i in range(len(text) - 11)]
    assert len(got) == len(want) and all(abs(a - b) < 1e-9 for a, b in zip(got, want))
    assert all(x == -1 or -1e-9 <= x <= math.log2(18) for x in got)


@given(st.text(LETTERS, min_size=1, max_size=45), st.data())
@settings(max_examples=300, deadline=None)
def test_extension(text, data):
    start = data.draw(st.integers(0, len(text) - 1))
    end = data.draw(st.integers(start, len(text) - 1))
    assert seq.extend_segment(text, start, end) == plain_extend(text, start, end)


def test_tie_extends_both_sides():
    assert len(seq.extend_segment("A" * 60, 20, 37)) == 20


def test_short_protein_is_simple():
    # no window fits: entropy and hydrophobicity count as -1
    z = seq.segment_zscore("AAAA")
    assert round(z, 2) == -128.46 and seq.classify(z) == "simple"


def test_classes(spark):
    rows = [(1, "0,3", "AAAA"), (2, " 10,30  45,60 ", "MKTLLVLAVLLAGSAQAVVLIFGWTYPNDEQHKR" * 3), (3, "", "AAA"), (4, None, "AAA"), (5, "1,2", None)]
    out = {r.i: r.segment_classes for r in helix.classified_segments(spark.createDataFrame(rows, "i int, seg string, s string"), "s", "seg").collect()}
    assert out[1] == ["simple"] and len(out[2]) == 2 and out[3] == [] and out[4] is None and out[5] is None


def test_columns_equal_kernels(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["", "xxzz"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "i int, t string")
    out = {r.i: r for r in seq.add_hydrophobicity(seq.add_group_entropy(df, "t", "e"), "t").collect()}
    for i, t in enumerate(texts):
        assert abs(out[i].e - plain_entropy(t)) < 1e-9
        want = [sum(seq.HYDROPHOBICITY[c][k] for c in t.upper() if c in seq.HYDROPHOBICITY) for k in (1, 0, 2)]
        assert all(abs(a - b) < 1e-9 for a, b in zip((out[i].octanol, out[i].interface, out[i].difference), want))
    assert out[99].e is None and out[99].octanol is None


def test_flanks(spark):
    rows = [("ABCDEFGHIJKLMNOP", 1, 3), ("ABCDEFGHIJKLMNOP", 7, 9), ("ABCDEFGHIJKLMNOP", 14, 16), ("ABC", 2, 2)]
    df = spark.createDataFrame(rows, "s string, b int, e int")
    for k in (5, 0):
        before, behind = tc.flanks(df.s, df.b, df.e, k)
        got = [tuple(r) for r in df.select(before, tc.slice_1based(df.s, df.b, df.e), behind).collect()]
        want = [(s[max(0, b - 1 - k) : b - 1] if k else "", s[b - 1 : e], s[e : e + k]) for s, b, e in rows]
        assert got == want


def test_helix_rows_and_view(spark):
    schema = "pdbCode string, chain_id string, num_tm int, chain_type string, sequence string, regions array<struct<_seq_beg: int, _pdb_beg: int, _seq_end: int, _pdb_end: int, _type: string>>"
    regions = [(1, 1, 4, 4, "H"), (5, 5, 6, 6, "1"), None, (7, 7, 9, 9, "H"), (10, 10, 10, 10, "2"), (11, 11, 14, 14, "H"), (15, 15, 15, 15, "B"), (16, 16, 18, 18, "H")]
    df = spark.createDataFrame([("1ABC", "A", 4, "alpha", "ABCDEFGHIJKLMNOPQRST", regions), ("1ABD", "A", 0, "alpha", "AB", []), ("1ABE", "A", 0, "alpha", "AB", None)], schema)
    rows = helix.helix_rows(df, 2)
    assert [(r.prev_type, r.n_flank, r.region_seq, r.c_flank) for r in rows.orderBy("region_beg").collect()] == [("0", "", "ABCD", "EF"), ("1", "EF", "GHI", "JK"), ("2", "IJ", "KLMN", "OP"), ("B", "NO", "PQR", "ST")]
    view = {r.region_seq: r for r in helix.helix_view(rows, align=True).collect()}
    assert set(view) == {"GHI", "KLMN", "PQR"} and view["PQR"].prev_type is None
    assert view["KLMN"].region_seq_aligned == "NMLK" and view["GHI"].flanked_region_seq_aligned == "EFGHIJK"
    kept = {r.region_seq: r for r in helix.helix_view(rows, align=True, remove_ambiguous=False).collect()}
    assert len(kept) == 4 and kept["KLMN"].region_seq_aligned == "KLMN"
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        helix.helix_view(rows, lenient=False).collect()


def test_window_rows(spark):
    df = spark.createDataFrame([(1, "A" * 20), (2, "A" * 12), (3, "A" * 11), (4, None)], "i long, s string")
    got = {(r.row_id, r.start): r for r in helix.window_rows(df, "i", "s").collect()}
    assert len(got) == 10 and got[1, 9].octanol is None and abs(got[1, 2].octanol - 19 * 0.51) < 1e-9 and got[2, 1].entropy == 0
