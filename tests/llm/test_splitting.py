"""Problem 7: oversized texts."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from permeate.llm.splitting import cut_kinds, split_oversized, split_text

PART = st.sampled_from(["a", "bb", " ", "\n", "\n\n", ". ", "; ", "\t", ".Ab", "# Head\n", "- item\n", "x" * 13, "y" * 40, "      ", "äöü", "😀"])


@given(st.lists(PART, max_size=40).map("".join), st.integers(3, 25), st.data())
@settings(max_examples=400, deadline=None)
def test_pieces_round_trip(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    pieces = split_text(text, limit, overlap)
    assert "".join(text[own:end] for _, own, end, _ in pieces) == text
    assert all(end - start <= limit and own - start <= overlap for start, own, end, _ in pieces)
    forced = len(text) > limit and bool(re.search(r"[^ \t\n]{%d}" % (limit + 1), text))
    assert any(how == "forced" for *_, how in pieces) == forced


def test_natural_boundaries_and_overlap():
    text = "\n\n".join(("Sentence number %d of a block. " % i) * 12 for i in range(12))
    pieces = split_text(text, 2000, 200)
    assert all(how == "block" for *_, how in pieces)
    assert all(0 < own - start <= 200 for start, own, _, _ in pieces[1:])
    assert all(text[start - 1] in " \n" for start, *_ in pieces[1:])


def test_table(spark):
    rows = [(1, "d", 3, "word " * 500, "x"), (1, "d", 3, "word " * 500, "x"), (2, None, None, "z" * 2001, "y"), (3, "d", 1, "short", None), (4, "d", 1, None, None), (5, "d", 1, "q" * 2000, None), (6, "d", 2, " " * 2500, None)]
    df = spark.createDataFrame(rows, "text_id long, doi string, chunk_index int, chunk_text string, cut string")
    out = split_oversized(df)
    assert sorted(tuple(r) for r in cut_kinds(out).collect()) == [(1, "natural"), (1, "natural"), (2, "forced"), (6, "natural")]
    assert {(r.text_id, r.doi, r.chunk_index) for r in out.collect()} == {(1, "d", 3), (2, None, None), (6, "d", 2)}
    assert split_oversized(df.limit(0)).count() == 0
