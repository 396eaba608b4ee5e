"""Problem 1: flattening of nested records."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from permeate.operators import nested
from permeate.plans.core_problems import BUFFER, COMPONENT, DETERMINATION

EMDB = "row_id long, structure_determination_list array<struct<specimen_preparation_list: struct<specimen_preparation: array<struct<buffer: struct<ph: string, component: array<struct<name: string, formula: string, concentration: struct<valueOf_: string, units: string>>>>, details: string>>>>>, path string, child string"
ROWS = [
    (1, None, "x", "y"),
    (2, [], None, None),
    (3, [None, ((None,),), (([],),), None], None, None),
    (4, [((  [None, ((None, None), None), (("7", [None, (None, None, None), ("a", "b", ("1", "mM"))]), "d")],),)], None, None),
    (4, [(([(None, None)],),)], None, None),
]


def test_child_records_positions_and_nulls(spark):
    df = spark.createDataFrame(ROWS, EMDB)
    got = sorted((r.row_id, r.child, r.parent_path, r.path) for r in nested.child_records(df, "row_id", DETERMINATION).collect())
    assert got == sorted(
        [
            (4, "specimen_preparation", "0", "0.1"),
            (4, "buffer", "0.1", "0.1"),
            (4, "specimen_preparation", "0", "0.2"),
            (4, "buffer", "0.2", "0.2"),
            (4, "component", "0.2", "0.2.1"),
            (4, "component", "0.2", "0.2.2"),
            (4, "specimen_preparation", "0", "0.0"),
        ]
    )


def test_typed_subtype_tables(spark, tmp_path):
    records = nested.child_records(spark.createDataFrame(ROWS, EMDB), "row_id", DETERMINATION, typed=True)
    got = [(r.row_id, r.parent_path, r.path, r.shape, r.name, r.units) for r in nested.subtype_table(records, COMPONENT).orderBy("path").collect()]
    assert got == [(4, "0.2", "0.2.1", "(000)", None, None), (4, "0.2", "0.2.2", "(ttv)", "a", "mM")]
    assert [(r.path, r.ph) for r in nested.subtype_table(records, BUFFER).orderBy("path").collect()] == [("0.1", None), ("0.2", "7")]
    assert nested.subtype_table(records, COMPONENT, "(000)", "name,formula,concentration").columns == ["row_id", "parent_path", "path", "shape"]
    assert nested.subtype_table(records, COMPONENT, "(0tv)", "name,formula,concentration").columns[4:] == ["formula", "amount", "units"]
    for path in nested.write_subtypes(records, DETERMINATION, str(tmp_path)):
        back = spark.read.parquet(path)
        kind = path.rsplit("/", 1)[1]
        assert back.count() == records.where(f"child = '{kind}'").count() and "parent_path" in back.columns


def test_the_state_decides_what_is_a_record(spark):
    """An automaton that calls every node absent gives no records."""
    before, nested.ABSENT = nested.ABSENT, "(000)"
    try:
        rows = nested.child_records(spark.createDataFrame(ROWS, EMDB), "row_id", DETERMINATION).where("child = 'component'").collect()
    finally:
        nested.ABSENT = before
    assert "0.2.1" not in {r.path for r in rows}


def test_empty_table(spark):
    df = spark.createDataFrame([], EMDB)
    assert nested.child_records(df, "row_id", DETERMINATION).count() == 0


def test_states_of_variants(spark):
    df = spark.createDataFrame(ROWS, EMDB)
    shapes = {(r.child, r.path): r.shape for r in nested.child_records(df, "row_id", DETERMINATION).where("row_id = 4").collect()}
    assert shapes["component", "0.2.1"] == "(000)" and shapes["component", "0.2.2"] == "(ttv)"


def body(value):
    return json.dumps({"data": {"entries": [{"rcsb_id": "1ABC", "struct_keywords": value}, None, {"rcsb_id": None}]}})


def test_keyword_shapes(spark):
    cases = [
        ({"text": "a, b"}, "object", ["a, b"]),
        ({"text": ["a", " ", None, "b"]}, "object", ["a", "b"]),
        ([{"text": "a"}, {"text": ["b", "c"]}, {"text": None}], "objects", ["a", "b", "c"]),
        (["a", "b"], "texts", ["a", "b"]),
        ("a", "text", ["a"]),
        ("  ", "none", []),
        ({}, "none", []),
        ([], "none", []),
        (None, "none", []),
        (5, "other", []),
    ]
    df = spark.createDataFrame([(i, body(v)) for i, (v, _, _) in enumerate(cases)] + [(90, None), (91, "{"), (92, "[]"), (93, body("x")[:-3]), (94, '{"errors": [], "data": null}'), (95, body("a") + "x")], "response_id long, body string")
    nodes = {(r.row_id, r.entry): (r.shape, r.strings) for r in nested.json_nodes(df, "response_id", "body", "struct_keywords").collect()}
    for i, (_, shape, strings) in enumerate(cases):
        assert nodes[i, 0] == (shape, strings)
        assert nodes[i, 2] == ("absent", []) and (i, 1) not in nodes
    assert max(k for k, _ in nodes) < 90
    paths = [(r.path, r.value) for r in nested.string_children(nested.json_nodes(df, "response_id", "body", "struct_keywords"), "k").where("row_id = 2").orderBy("path").collect()]
    assert paths == [("0.0", "a"), ("0.1", "b"), ("0.2", "c")]


VALUES = st.recursive(st.none() | st.text(max_size=3) | st.integers() | st.booleans(), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["text", "other"]), x, max_size=2), max_leaves=12)


def strings_of(value):
    """Brute force: strings reached through lists and text keys."""
    if isinstance(value, str):
        return [value] if value.strip() else []
    if isinstance(value, list):
        return [s for x in value for s in strings_of(x)]
    return strings_of(value.get("text")) if isinstance(value, dict) else []


@given(VALUES)
@settings(max_examples=300, deadline=None)
def test_automaton_accepts_what_brute_force_finds(value):
    state, found = nested.TreeAutomaton().run(value)
    assert found == strings_of(value)
    assert (state in ("text", "texts", "object", "objects")) == bool(found)
