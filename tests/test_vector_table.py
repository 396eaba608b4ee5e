"""Vector tables, requests and the command line, with stand-ins for models and servers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from permeate.__main__ import main
from permeate.functions import text_clean as tc
from permeate.models import backends, vector_table
from permeate.sinks import writers
from permeate.sources import json_flatten, rest


@pytest.fixture
def chunks(spark, tmp_path):
    rows = [(f"10.1/{i % 3}", i, f"text {i}" if i % 5 else None) for i in range(23)]
    path = str(tmp_path / "chunks.parquet")
    spark.createDataFrame(rows, "doi string, chunk_index int, chunk_text string").coalesce(1).write.parquet(path)
    return path


@pytest.mark.parametrize("shards", [0, 4])
def test_build(spark, tmp_path, chunks, shards):
    path, meta = vector_table.build(spark, chunks, "BAAI/bge-small-en-v1.5", backends.hash_embedder, str(tmp_path), vector_table.BuildOptions(batch_size=5, shards=shards))
    assert path.endswith("/chunks_embeddings_BAAI_bge-small-en-v1.5_single_gpu")
    assert meta.first().asDict() == {"model_name": "BAAI/bge-small-en-v1.5", "embedding_dim": 16, "num_chunks": 23, "multi_gpu_used": False, "device_info": ["CPU"]}
    back = spark.read.parquet(path + "/vectors").collect()
    made = backends.hash_embedder()
    by_index = {r.chunk_index: np.array(r.embedding) for r in back}
    for i in range(23):
        want = made([f"text {i}" if i % 5 else ""])[0]
        assert np.allclose(by_index[i], want / np.linalg.norm(want), atol=1e-6)


def test_order_of_the_source_is_kept(spark, tmp_path, chunks):
    path, _ = vector_table.build(spark, chunks, "m", backends.hash_embedder, str(tmp_path), vector_table.BuildOptions(shards=3))
    files = sorted(p.name for p in (tmp_path / path.rsplit("/", 1)[1] / "vectors").glob("part-*"))
    seen = [r.chunk_index for f in files for r in spark.read.parquet(f"{path}/vectors/{f}").collect()]
    assert seen == list(range(23))


def test_shards_are_contiguous_and_balanced(spark):
    out = backends.shards_of(spark.range(11), ["id"], 4).withColumn("part", F.spark_partition_id()).collect()
    sizes = {}
    for r in out:
        sizes.setdefault(r.shard, []).append(r.id)
    assert [len(sizes[k]) for k in range(4)] == [3, 3, 3, 2] and sorted(sizes[1]) == [3, 4, 5]
    assert len({(r.shard, r.part) for r in out}) == 4


def test_models(spark):
    assert backends.full_name("bge-large-en-v1.5") == "BAAI/bge-large-en-v1.5" and backends.full_name("own/model") == "own/model"
    assert backends.dimension_of(backends.hash_embedder) == 16

    def named(device):
        return lambda texts: np.full((len(texts), 2), float(device == "CPU"))

    assert backends.embed(spark.createDataFrame([("a",)], "t string"), "t", named, normalise=False).first().embedding == [1.0, 1.0]

    def broken():
        raise OSError("no such model")

    with pytest.raises(OSError):
        backends.dimension_of(broken)


def test_batch_speed(spark):
    rows = spark.range(50).selectExpr("concat('t', id) as chunk_text")
    out = vector_table.batch_speed(rows, backends.hash_embedder, (8, 32)).collect()
    assert [r.batch_size for r in out] == [8, 32] and all(r.seconds > 0 and r.chunks_per_second > 0 for r in out)


def test_tables_by_batch_and_by_key(spark):
    asked = spark.createDataFrame([(k,) for k in ("P1", "P2", "P2", "P9", None)], "k string")

    def transport(keys):
        if "P9" in keys:
            raise OSError("no answer")
        return "Entry\tLength\tExtra\n" + "".join(f"{k}\t{len(k)}\tx\n" for k in keys)

    one = rest.fetch_tables(asked, "k", transport, "Entry string, Length int, Missing string", batch_size=1)
    got = sorted((r.Entry or "", r.Length, r.Missing, r.error) for r in one.collect())
    assert got == [("", None, None, "OSError: no answer"), ("P1", 2, None, None), ("P2", 2, None, None)]
    all_fail = rest.fetch_tables(asked, "k", transport, "Entry string, Length int", batch_size=999, partitions=1).collect()
    assert [r.error for r in all_fail] == ["OSError: no answer"]


def test_answers_and_failures_are_stored_apart(spark, tmp_path):
    asked = spark.createDataFrame([(k,) for k in "abc"], "k string")
    calls = {"fail": True}

    def transport(keys, calls=calls):
        if "c" in keys and calls["fail"]:
            raise OSError("down")
        return [k.upper() for k in keys]

    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    assert writers.store_fetched(rest.fetch(asked, "k", transport, 1), good, bad) == (2, 1)
    calls["fail"] = False
    writers.store_fetched(rest.fetch(asked, "k", lambda keys: [k.upper() for k in keys], 1), good, bad)
    assert sorted(tuple(r) for r in spark.read.parquet(good).collect()) == [("a", "A"), ("b", "B"), ("c", "C")]
    assert spark.read.parquet(bad).select("key", "error").collect() == [("c", "OSError: down")]


def test_entries_by_class(spark):
    def transport(body):
        request = json.loads(body)
        kind = request["query"].split("{", 1)[1].split("(")[0].strip()
        return json.dumps({"data": {kind: [{"rcsb_id": i, "exptl": [{"method": "EM", "details": "d"}], "struct": {"title": f"T {i}"}, "rcsb_entry_info": {"experimental_method": []}} for i in request["variables"]["ids"]]}})

    ids = spark.createDataFrame([(k,) for k in ("1ABC", "2DEF", "1ABC_1", None)], "k string")
    rows = rest.fetch_entries(ids, "k", transport).collect()
    assert sorted((r.kind, r["rcsb_id"], r["exptl.method"], r["exptl.details"], r["struct.title"]) for r in rows) == [
        ("entries", "1ABC", "EM", "d", "T 1ABC"),
        ("entries", "2DEF", "EM", "d", "T 2DEF"),
        ("polymer_entities", "1ABC_1", "EM", "d", "T 1ABC_1"),
    ]
    assert rest.fetch_entries(ids.limit(0), "k", transport).count() == 0
    assert rest.request_body("polymer_entities", ["1ABC_1"], {"a": [], "b": ["c"]}).count("polymer_entity_ids") == 1


def test_schema_over_all_rows(spark):
    bodies = [
        '{"data": {"entries": [{"a": 1, "same": {"x": "u"}, "mixed": "t", "none": null, "empty": []}]}}',
        '{"data": {"entries": [{"a": 2, "late": [{"y": 1.5}], "mixed": ["t"], "empty": []}, null]}}',
        "{damaged",
        '{"errors": []}',
    ]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    entries = json_flatten.entries_of(df, "body", None, ("i",))
    flat = json_flatten.flatten(entries, {"a": [], "same": ["x"], "late": ["y"], "mixed": [], "none": [], "empty": []}, ("i",))
    assert [tuple(r) for r in flat.orderBy("i").collect()] == [(0, 1, "u", None, "t", None, []), (1, 2, None, 1.5, '["t"]', None, [])]
    assert [r.kind for r in json_flatten.plan(entries.schema, {"empty": [], "late": ["y"], "mixed": []})] == ["list", "expand", "primitive"]


def test_default_fields():
    assert json_flatten.DEFAULT_FIELDS["exptl"] == ["method", "method_details", "details"]


def test_addresses(spark):
    df = spark.createDataFrame([("1ABC", ["P1", "P2"]), (None, [])], "c string, l array<string>")
    got = df.select(tc.simulation_url("http://x/", F.col("c")), tc.accessions_url("http://y", F.col("l"), ("a", "b"))).collect()
    assert got[0][0] == "http://x/data/memprotmd/simulations/1abc_default_dppc/files/contacts/by_resid_postprocess.csv" and got[1][0] is None
    assert got[0][1] == "http://y/uniprotkb/accessions?accessions=P1,P2&fields=a,b&format=tsv"


def test_command_line(spark, tmp_path, chunks):
    factory = ["--factory", "permeate.models.backends:hash_embedder"]
    main(["vectors", chunks, str(tmp_path / "v"), *factory, "--model", "m"], spark)
    stored = f"{tmp_path}/v/chunks_embeddings_m_single_gpu/vectors"
    main(["prompts", stored, chunks, str(tmp_path / "p"), "--prompt", "What?", *factory, "--threshold", "-1"], spark)
    main(["answers", str(tmp_path / "p"), str(tmp_path / "a"), "--factory", "permeate.models.backends:echo_chat", "--tasks", "4"], spark)
    answers = writers.read_responses(spark, str(tmp_path / "a")).collect()
    assert {r.doi for r in answers} == {"10.1/0", "10.1/1", "10.1/2"} and all(r.response for r in answers)
    with pytest.raises(SystemExit):
        main(["nothing"], spark)
