"""Text clean-up, flattening, XML, retrieval, batches, sources, sinks, models and streams."""

import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from permeate.functions import text_clean as tc
from permeate.functions import vectors as v
from permeate.models import backends
from permeate.operators import batch, hierarchy, retrieval
from permeate.plans import catalogue
from permeate.sinks import writers
from permeate.sources import files, json_flatten, rest, xml
from permeate.streaming import ingest


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("f", "raw", "want"),
    [
        (tc.function_text, "FUNCTION: Binds. {ECO:01}. Then (PubMed:12) more. {ECO:02}. \n", "FUNCTION: Binds. Then  more."),
        (tc.function_text, "", None),
        (tc.function_text, None, None),
        (tc.subcellular_location, "SUBCELLULAR LOCATION: Membrane; Multi-pass membrane protein. Cell; Single-pass type I membrane protein; x {ECO:1} y {ECO:2}. Note=Rest.", "Membrane. Cell. x."),
        (tc.subcellular_location, "SUBCELLULAR LOCATION: [Isoform 2]: Golgi.", "Golgi."),
        (tc.domain_text, 'DOMAIN 1..9; /note="Helix"; /evidence="ECO:0000255"; ', "Helix"),
        (tc.similarity_text, "SIMILARITY: Belongs to the kinase family. {ECO:1}.", "Kinase family."),
        (tc.similarity_text, "SIMILARITY: Belongs to the ", ""),
    ],
)
def test_clean(spark, f, raw, want):
    assert one(spark, raw, f) == want


def test_buffer_text(spark):
    schema = "b struct<ph: string, component: array<struct<name: string, formula: string, concentration: struct<valueOf_: string, units: string>>>>"
    rows = [
        ((("7.5", [("Tris", "C4", ("20", "mM")), ("LMNG Detergent", "C47", None), (None, "NaCl", None), None])),),
        (((None, None)),),
        ((("7", [(None, None, None)])),),
        (None,),
    ]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(tc.buffer_text(F.col("b"))).collect()]
    assert got == ["Tris: 20 mM + C47:  + NaCl:  + pH 7.5", "pH None", None, None]


def test_flatten_plan_and_rows(spark):
    schema = "id long, a struct<s: string>, l array<string>, x array<struct<m: string, d: string>>, y array<struct<q: string>>"
    rows = [(1, ("u",), ["f", "g"], [("m1", "d1"), None, ("m2", None)], [("q1",), ("q2",)]), (2, None, [], [], None), (3, (None,), None, None, [])]
    spec = {"x": ["m", "none"], "a": ["s"], "l": [], "y": ["q"], "gone": ["z"]}
    df = spark.createDataFrame(rows, schema)
    out = json_flatten.flatten(df, spec, ("id",))
    assert out.columns == ["id", *json_flatten.column_names(spec)]
    assert sorted([tuple(r) for r in out.collect()], key=str) == sorted([(1, "m1", None, "u", "f", ["q1", "q2"], None), (1, "m2", None, "u", "f", ["q1", "q2"], None), (2, None, None, None, None, None, None), (3, None, None, None, None, [], None)], key=str)
    assert [k for _, k, _ in json_flatten.describe(df.schema, spec)] == ["expand", "struct", "first", "nest", "missing"]


@given(st.lists(st.lists(st.one_of(st.none(), st.integers(0, 5)), max_size=4) | st.none(), min_size=1, max_size=5))
@settings(max_examples=8, deadline=None)
def test_outer_rows(spark, lists):
    rows = [(i, None if x is None else [None if y is None else (y,) for y in x]) for i, x in enumerate(lists)]
    df = spark.createDataFrame(rows, "i int, x array<struct<v: int>>")
    assert json_flatten.flatten(df, {"x": ["v"]}, ("i",)).count() == sum(max(1, len([y for y in x or [] if y is not None])) for x in lists)


GROUPS = """<mpstruc><groups><group><name>G</name><subgroups><subgroup><name>S</name><proteins>
<protein><pdbCode>1ABC</pdbCode><name>P</name><resolution>2.0</resolution><species>sp</species><taxonomicDomain>td</taxonomicDomain><memberProteins/></protein>
<protein><pdbCode>2ABC</pdbCode><name>Q</name><resolution>3.0</resolution><species>sq</species><taxonomicDomain>tq</taxonomicDomain><memberProteins>
<memberProtein><pdbCode>3ABC</pdbCode><name>M</name><resolution>9</resolution><species>own</species></memberProtein>
<memberProtein><pdbCode>4ABC</pdbCode><name>N</name></memberProtein></memberProteins></protein></proteins></subgroup></subgroups></group></groups></mpstruc>"""
CHAINS = """<PDBTM xmlns="https://pdbtm.unitmp.org"><pdbtm ID="1abc"><CHAIN CHAINID="A" NUM_TM="2" TYPE="alpha"><SEQ>ABCDE FGHIJ
 KLMNO</SEQ><REGION seq_beg="1" pdb_beg="1" seq_end="3" pdb_end="3" type="1"/><REGION seq_beg="4" pdb_beg="4" seq_end="8" pdb_end="8" type="H"/></CHAIN>
<CHAIN CHAINID="B" NUM_TM="0" TYPE="non_tm"><SEQ>AB</SEQ></CHAIN></pdbtm></PDBTM>"""


def test_xml_files(spark, tmp_path):
    (tmp_path / "g.xml").write_text(GROUPS)
    rows = [tuple(r) for r in xml.read_groups(spark, str(tmp_path / "g.xml")).orderBy("main_struc", "member_struc").collect()]
    assert rows[0] == ("G", "S", "1ABC", "P", "2.0", "sp", "td", None, None, None, None, None)
    assert rows[1] == ("G", "S", "2ABC", "Q", "3.0", "sq", "tq", "3ABC", "M", "sq", "tq", "3.0") and len(rows) == 3
    own = xml.read_groups(spark, str(tmp_path / "g.xml"), "own").where("member_struc = '3ABC'").first()
    assert (own.member_species, own.member_res) == ("own", "9")
    (tmp_path / "c.xml").write_text(CHAINS)
    chains = xml.read_chains(spark, str(tmp_path / "c.xml")).orderBy("chain_id").collect()
    assert [(c.pdbCode, c.chain_id, c.num_tm, c.sequence) for c in chains] == [("1ABC", "A", 2, "ABCDEFGHIJKLMNO"), ("1ABC", "B", 0, "AB")]
    (h,) = xml.read_helices(spark, str(tmp_path / "c.xml"), 2).collect()
    assert (h.prev_type, h.n_flank, h.region_seq, h.c_flank) == ("1", "BC", "DEFGH", "IJ")
    (tmp_path / "t.xml").write_text('<t:TOPDBS xmlns:t="https://topdb.unitmp.org"><t:TOPDB ID="T1" type="a"><t:Membrane>Inner</t:Membrane><t:PDB ID="1abc"/><t:PDB ID="2abc"/></t:TOPDB><t:TOPDB ID="T2" type="b"></t:TOPDB></t:TOPDBS>')
    assert sorted(tuple(r) for r in xml.read_topology(spark, str(tmp_path / "t.xml")).collect()) == [("T1", "a", "1ABC", "Inner"), ("T1", "a", "2ABC", "Inner")]


def test_topology_at_any_depth(spark):
    text = '<n:TOPDB xmlns:n="https://x" ID="T1" type="a"><n:A><n:Membrane>Inner</n:Membrane></n:A><n:B><n:C><n:PDB ID="1abc"/></n:C></n:B></n:TOPDB>'
    df = spark.createDataFrame([(text,)], "x string").select(xml.topology_from_text(F.col("x")).alias("t")).select("t.*")
    assert [tuple(r) for r in xml.topology_rows(df).collect()] == [("T1", "a", "1ABC", "Inner")]


def plain_budget(texts, most):
    used, out = 0, []
    for t in texts:
        if used + len(t) > most:
            if most - used > 100 and t[: most - used].strip():
                out.append(t[: most - used].strip())
            break
        out.append(t)
        used += len(t) + 2
    return "\n\n".join(out).strip()


@pytest.mark.parametrize("lengths", [(150, 148), (150, 149), (250, 80), (150, 400, 5), (50, 0, 60), (500,)])
@pytest.mark.parametrize("salts", [1, 16])
def test_budget(spark, lengths, salts):
    texts = [chr(97 + i) * n for i, n in enumerate(lengths)]
    df = spark.createDataFrame([("g", i, t) for i, t in enumerate(texts)] + [("g", 99, None)], "doi string, rank int, text string")
    got = retrieval.budget_concat(df, "doi", ["rank"], "text", 300, salts=salts).first()
    assert got.combined == plain_budget(texts, 300)


def test_budget_on_many(spark):
    rng = random.Random(1)
    rows = [(f"d{i % 3}", i, "x" * rng.randint(0, 90) + str(i)) for i in range(400)]
    got = {r.doi: r.combined for r in retrieval.budget_concat(spark.createDataFrame(rows, "doi string, rank int, text string"), "doi", ["rank"], "text", 1500).collect()}
    assert got == {d: plain_budget([t for e, _, t in rows if e == d], 1500) for d in ("d0", "d1", "d2")}


def test_similarity_search(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [1.0, 1.0]), (3, "b", [0.0, 0.0]), (4, "b", None), (5, "b", [1.0]), (6, "b", [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, doi string, embedding array<float>")
    got = [(r.vec_id, round(r.similarity, 4)) for r in retrieval.similar_chunks(df, [1.0, 0.0], 0.0, 3).collect()]
    assert got == [(1, 1.0), (6, 1.0), (2, 0.7071)]
    assert {r.vec_id for r in retrieval.similar_chunks(df, [1.0, 0.0], 0.5, 1, "doi").collect()} == {1, 6}
    assert retrieval.similar_chunks(df, [1.0, 0.0], 1.5).count() == 0
    plan = retrieval.similar_chunks(df, [1.0, 0.0], 0.0, 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert df.where("vec_id = 2").select(v.normalised(F.col("embedding"))).first()[0] == pytest.approx([0.70710678] * 2)


def test_positions_batches_shards(spark):
    rng = random.Random(3)
    values = [rng.randint(0, 50) for _ in range(101)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x int").repartition(5)
    out = batch.with_position(df, ["x", "i"]).select("i", "pos", batch.batch_number(F.col("pos"), 25).alias("b"), batch.balanced_shard(F.col("pos"), F.lit(101), 4).alias("s")).collect()
    order = sorted(range(101), key=lambda i: (values[i], i))
    assert {r.i: r.pos for r in out} == {i: p for p, i in enumerate(order)}
    assert [sum(r.s == k for r in out) for k in range(4)] == [26, 25, 25, 25] and max(r.b for r in out) == 4
    assert batch.zip_rows(df, df.limit(7), ["x", "i"], ["x", "i"]).count() == 7


def test_lookups(spark):
    df = spark.createDataFrame([("a", 1, "old", 1), ("a", 1, None, 2), (None, 1, "n", 3), ("b", 2, "x", 4)], "doi string, k int, t string, p int")
    assert sorted([tuple(r) for r in batch.last_wins(df, ["doi", "k"], "p").collect()], key=str) == sorted([("a", 1, None, 2), (None, 1, "n", 3), ("b", 2, "x", 4)], key=str)
    kinds = [r[0] for r in spark.createDataFrame([("1ABC",), ("1ABC_1",), ("1ABC.A",), ("1ABC-1",), ("A_B.C",)], "c string").select(batch.id_kind(F.col("c"))).collect()]
    assert kinds == ["entries", "polymer_entities", "polymer_entity_instances", "assemblies", "polymer_entities"]
    with pytest.raises(Exception, match="unknown id"):
        spark.createDataFrame([("TOOLONG",)], "c string").select(batch.id_kind(F.col("c"))).collect()


def test_self_members(spark):
    cols = "row_id long, main_struc string, main_name string, main_res string, main_species string, main_taxdom string, member_struc string, member_name string, member_res string, member_species string, member_taxdom string"
    row = lambda i, m, k: (i, m, "n", "r", "s", "t", k, k, None, None, None)
    out = hierarchy.with_self_members(spark.createDataFrame([row(1, "A", "x"), row(2, "A", "y"), row(3, "B", None), row(4, "B", None), row(5, None, "z")], cols))
    got = [(r.row_id, r.part, r.member_struc, r.member_name) for r in out.orderBy("row_id", "part").collect()]
    assert got == [(1, 0, "A", "n"), (1, 1, "x", "x"), (2, 1, "y", "y"), (3, 1, "B", "n"), (4, 1, None, None), (5, 1, "z", "z")]


@pytest.mark.parametrize(("n", "want"), [(0, 0), (1, 1), (998, 1), (999, 1), (1000, 2), (1998, 2)])
def test_request_batches(n, want):
    keys = [f"k{i}" for i in range(n)]
    assert len(rest.batches_of(keys + keys[:3], 999)) == want


def test_fetch_keeps_errors_and_source(spark):
    def transport(keys):
        if "bad" in keys:
            raise OSError("down")
        return [f"body of {k}" for k in keys]

    keys = spark.createDataFrame([("a",), ("a",), ("bad",), (None,), ("b",)], "k string")
    got = {r.key: (r.body, r.error) for r in rest.fetch(keys, "k", transport, 1).collect()}
    assert got == {"a": ("body of a", None), "b": ("body of b", None), "bad": (None, "OSError: down")}
    assert {r.key for r in rest.fetch(keys, "k", transport, 1, on_error="skip").collect()} == {"a", "b"}
    with pytest.raises(Exception, match="down"):
        rest.fetch(keys, "k", transport, 1, on_error="fail").collect()
    rest.register_source(spark, "stub", transport, 2)
    rows = spark.read.format("stub").option("ids", "a,b,c,bad,c").load()
    assert {r.key: r.error is None for r in rows.collect()} == {"a": True, "b": True, "c": False, "bad": False}


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text('doi,chunk_index,chunk_text\n10.1,0,"two\nlines"\n10.1,1,\n')
    got = sorted(tuple(r) for r in files.read_chunks(spark, str(tmp_path / "t.csv")).collect())
    assert got == [("10.1", 0, "two\nlines"), ("10.1", 1, "")]
    with pytest.raises(ValueError, match="missing"):
        files.read_chunks(spark, str(tmp_path / "t.csv"), ("nope", "chunk_index", "doi"))
    with pytest.raises(ValueError, match="pickle"):
        files.read_chunks(spark, "x.pkl")
    np.savez(tmp_path / "v.npz", embeddings=np.ones((2, 3)), dois=np.array(["a", "b"]), chunk_indices=np.array([0, 4]))
    assert sorted((r.doi, r.chunk_index, r.embedding) for r in files.read_vector_archives(spark, str(tmp_path / "v.npz")).collect()) == [("a", 0, [1.0] * 3), ("b", 4, [1.0] * 3)]
    (tmp_path / "c.toml").write_text('system = "s"\n[hosts]\na = 0\n')
    assert files.read_config(str(tmp_path / "c.toml")) == {"model": "llama3.2", "hosts": {"a": 0}, "system": "s"}
    (tmp_path / "m.jsonl").write_text(json.dumps({"role": "user", "content": "q"}) + "\n")
    assert files.read_messages(spark, str(tmp_path / "m.jsonl")).first().content == "q"
    (tmp_path / "l.txt").write_text("a\nb\n")
    assert files.read_lines(spark, str(tmp_path / "l.txt")).count() == 2 and files.read_prompt(str(tmp_path / "l.txt")) == "a\nb\n"
    (tmp_path / "u.tsv").write_text("Entry\tX\nP1\t2\n")
    assert files.read_tsv(spark, str(tmp_path / "u.tsv")).first().Entry == "P1"
    assert files.read_csv(spark, str(tmp_path / "t.csv")).columns == ["doi", "chunk_index", "chunk_text"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, x int")
    writers.append_new(df, str(tmp_path / "p"), ["k"])
    writers.append_new(df.union(spark.createDataFrame([("c", 3)], "k string, x int")), str(tmp_path / "p"), ["k"])
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "p")).collect()) == ["a", "b", "c"]
    assert writers.write_csv(df, str(tmp_path / "c"), 1) == "gzip" and writers.write_csv(df, str(tmp_path / "d"), 2) == "none"
    vec = spark.createDataFrame([("a", 0, [1.0, 2.0])], "doi string, chunk_index int, embedding array<float>")
    assert tuple(writers.write_vectors(vec, str(tmp_path / "v"), "m").first()) == ("m", 2, 1, False, ["CPU"])
    answers = spark.createDataFrame([("d1", "p", "r"), (" ", "p", "r"), ("d2", "p", "r"), ("d2", "p", "s")], "doi string, prompt string, response string")
    assert writers.write_responses(answers, str(tmp_path / "r")).count() == 3
    assert [r.doi for r in writers.read_responses(spark, str(tmp_path / "r")).collect()] == ["d1"]


def test_models(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "i int, prompt string")
    out = backends.embed(df, "prompt", backends.hash_embedder).collect()
    assert all(abs(np.linalg.norm(r.embedding) - 1) < 1e-5 for r in out) and len(out) == 2
    said = {r.i: (r.response, r.error is None) for r in backends.chat(df, backends.echo_chat, "S").collect()}
    assert said == {1: ("S a b", True), 2: (None, False)}


def test_stream_stores_each_key_once(spark, tmp_path):
    src, dst, cp = (str(tmp_path / x) for x in ("src", "dst", "cp"))
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string").write.parquet(src)
    ingest.ingest_new(spark, src, "k int, v string", dst, cp, ["k"]).awaitTermination(120)
    spark.createDataFrame([(2, "again"), (3, "c")], "k int, v string").write.mode("append").parquet(src)
    ingest.ingest_new(spark, src, "k int, v string", dst, cp, ["k"]).awaitTermination(120)
    assert sorted(tuple(r) for r in spark.read.parquet(dst).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_flagship_gives_every_doi_with_a_hit_a_prompt(spark, tmp_path):
    n = 2100
    spark.createDataFrame([(i, f"10.1/{i}", 0, [1.0] * 64) for i in range(n)], "vec_id long, doi string, chunk_index int, embedding array<float>").write.parquet(f"{tmp_path}/vector_database.parquet")
    spark.createDataFrame([(i, f"10.1/{i}", 0, f"text {i}") for i in range(n)], "text_id long, doi string, chunk_index int, chunk_text string").write.parquet(f"{tmp_path}/text_database.parquet")
    assert catalogue.QUERIES[catalogue.FLAGSHIP](spark, str(tmp_path)).select("doi").distinct().count() == n


def test_whole_tables_reach_the_record_operators(spark, tmp_path):
    codes = [(1, "1abc", "X"), (2, "pdb_00001abc", "X"), (3, " 1abc\t", None), (4, "  ", "X"), (5, None, "X"), (6, "2abc ", " ")]
    spark.createDataFrame(codes, "structure_id long, rcsb_id string, method string").write.parquet(f"{tmp_path}/structures.parquet")
    fields = "group_name subgroup main_struc main_name main_res main_species main_taxdom member_struc member_name".split()
    rows = [(i, "g", "s", main, "n", "2", "sp", "t", member, name) for i, (main, member, name) in enumerate([("1abc", "2abc", "m"), (" 1abc ", " 2abc\n", "m"), (" ", " ", "m"), (None, None, None), ("1abc", None, "m")])]
    spark.createDataFrame(rows, "row_id long, " + ", ".join(f"{f} string" for f in fields)).write.parquet(f"{tmp_path}/mpstruc.parquet")
    q = {k: catalogue.QUERIES[k](spark, str(tmp_path)).collect() for k in ("id_classify", "xml_groups", "xml_topology")}
    kinds = {r.structure_id: (r.id, r.kind) for r in q["id_classify"]}
    assert kinds == {1: ("1ABC_1", "polymer_entities"), 2: ("PDB_00001ABC.A", "polymer_entities"), 3: ("1ABC-1", "assemblies"), 4: (None, None), 5: (None, None), 6: ("2ABC.A", "polymer_entity_instances")}
    got = {r.row_id: r for r in q["xml_groups"]}
    assert sorted(got) == [0, 1, 2, 3, 4] and got[1].main_struc.strip() == "1abc" and got[1].member_struc.strip() == "2abc"
    assert got[4].member_struc is None and got[4].member_name == "m" and got[3].member_name is None
    assert sorted(int(r.topdb_id) for r in q["xml_topology"]) == [1, 2, 3, 4, 6]


def test_topology_files_at_any_depth(spark, tmp_path):
    nested = '<TOPDB ID="T{0}" type="a"><Topology><Membrane>Inner</Membrane></Topology>\n<CrossRef><PDB ID="{0}abc"/></CrossRef></TOPDB>\n'
    empty = '<TOPDB ID="T8" type="a"/><TOPDB><CrossRef/></TOPDB>'
    (tmp_path / "t.xml").write_text('<?xml version="1.0"?>\n<TOPDBS xmlns="https://topdb.unitmp.org">' + nested.format(1) + empty + nested.format(2) + "</TOPDBS>")
    rows = sorted(tuple(r) for r in xml.read_topology(spark, str(tmp_path / "t.xml")).collect())
    assert rows == [("T1", "a", "1ABC", "Inner"), ("T2", "a", "2ABC", "Inner")]
