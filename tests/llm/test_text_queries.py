"""Every query of the subpackage on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from permeate.llm import queries

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "p2_found": ["row_id", "path", "ref_id"],
    "p4_found": ["vec_id_a", "vec_id_b"],
    "p5_found": ["resp_id", "defect"],
    "p7_found": ["text_id", "cut"],
    "p8_found": ["doc_id", "item_id"],
    "p10_found": ["doc_id", "kind"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    df = queries.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(set(rows)) == len(rows) > 0


def test_cuts_against_sql(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.sql(f"create view text_database as select * from '{DATA}/text_database.parquet'")
    want = sorted(con.sql(queries.ORACLE["p7_found"]).fetchall())
    assert sorted(tuple(r) for r in queries.p7_found(spark, DATA).collect()) == want


@pytest.fixture(scope="module")
def tables(spark):
    """Results of every query on the smallest tables, and SQL on the tables themselves."""
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"create view {name[:-8]} as select * from '{DATA}/{name}'")
    done = {}

    def rows(query):
        if query not in done:
            done[query] = queries.QUERIES[query](spark, DATA).collect()
        return done[query]

    return rows, lambda sql: con.sql(sql).fetchall()


def test_p2_covers_every_value_once(tables):
    rows, sql = tables
    typed = sql("""with d as (select row_id, unnest(structure_determination_list) as d from emdb_entries), s as (select row_id, unnest(d.specimen_preparation_list.specimen_preparation) as s from d),
      c as (select row_id, unnest(s.buffer.component) as c from s) select count(*) from c where c is not null and (regexp_matches(coalesce(c.name, ''), '[^\\s\\x{00A0}]') or regexp_matches(coalesce(c.formula, ''), '[^\\s\\x{00A0}]'))""")[0][0]
    found = rows("p2_found")
    assert len(found) == len({(r.row_id, r.path) for r in found}) == typed
    assert {r.ref_id for r in found} <= {-1} | {i for (i,) in sql("select ref_id from ref_components")}
    assert sum(r.n_values for r in rows("p2_unmatched")) == sum(r.ref_id == -1 for r in found)


def test_p4_against_brute_force(tables):
    rows, sql = tables
    valid = [(i, np.array(v, dtype=np.float64)) for i, v in sql("select vec_id, embedding from vector_database where embedding is not null and len(embedding) = 64") if np.any(v)]
    ids = np.array([i for i, _ in valid])
    x = np.array([v / np.linalg.norm(v) for _, v in valid])
    near = x @ x.T
    np.fill_diagonal(near, -1)
    at = {i: k for k, i in enumerate(ids)}
    pairs = {(r.vec_id_a, r.vec_id_b) for r in rows("p4_found")}
    assert all(a < b and near[at[a], at[b]] >= 0.9 - 1e-6 for a, b in pairs)
    want = {tuple(sorted((int(ids[k]), int(ids[j])))) for k in range(len(ids)) for j in np.argsort(-near[k], kind="stable")[:10] if near[k, j] >= 0.9}
    assert len(want & pairs) >= 0.98 * len(want)
    assert all(r.recall >= 0.9 for r in rows("p4_recall"))


def test_p5_first_flags_are_the_found_ones(tables):
    rows, sql = tables
    flags = rows("p5_flags")
    assert sorted((r.resp_id, r.defect) for r in flags if r.rank == 0) == sorted(map(tuple, rows("p5_found")))
    assert {i for (i,) in sql("select resp_id from llm_responses where response is null or trim(response) = ''")} <= {r.resp_id for r in flags if r.defect == "empty"}


def test_p7_pieces_cover_the_texts(tables):
    rows, sql = tables
    texts = dict(sql("select text_id, chunk_text from text_database where length(chunk_text) > 2000"))
    pieces = {}
    for r in rows("p7_pieces"):
        pieces.setdefault(r.text_id, []).append(r)
    assert set(pieces) == set(texts)
    columns = rows("p7_pieces")[0].asDict()
    text = next(c for c in columns if isinstance(columns[c], str) and columns[c] in texts[rows("p7_pieces")[0].text_id])
    for i, parts in pieces.items():
        assert all(len(p[text]) <= 2000 and p[text] in texts[i] for p in parts)


def test_p8_counts(tables):
    rows, sql = tables
    leaks = rows("p8_leaks")
    texts = dict(sql("select doc_id, text from documents"))
    assert all(0 <= r.start < r.stop <= len(texts[r.doc_id]) and r.changed * 8 <= r.words for r in leaks)
    assert {(r.doc_id, r.item_id) for r in leaks if r.part == "passage"} == {tuple(r) for r in rows("p8_found")}
    assert sum(r.n_documents for r in rows("p8_items")) == len(leaks)


def test_p9_shares_add_up(tables):
    rows, sql = tables
    uses = {}
    for r in rows("p9_positions"):
        u = uses.setdefault(r.source, [0, 0, 0])
        u[0], u[1], u[2] = u[0] + 1, u[1] + r.n_tokens, max(u[2], r.copy + 1)
    caps = dict(sql("select source, max_repeats from mix_targets"))
    for r in rows("p9_shares"):
        assert [r.n_uses, r.drawn_tokens, r.most_uses] == uses.get(r.source, [0, 0, 0]) and r.most_uses <= caps[r.source]
    assert abs(sum(r.actual_share for r in rows("p9_shares")) - 1) < 1e-9


def test_p10_parts_the_documents(tables):
    rows, sql = tables
    assert sum(r.n_documents for r in rows("p10_clean")) + len(rows("p10_found")) == sql("select count(*) from documents")[0][0]
    assert all(r.kind in ("filler", "error_page", "script_notice", "placeholder") for r in [*rows("p10_found"), *rows("p10_templates")])
