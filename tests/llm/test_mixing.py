"""Problem 9: sources mixed to target shares."""

import pytest

from permeate.llm.mixing import count_tokens, mix

TOKENIZERS = pytest.importorskip("public_tokenizers")
PATH = TOKENIZERS.path("byte_bpe_50k.json")


def docs(spark):
    rows, i = [], 0
    for source, n, size in (("big", 400, 40), ("small", 20, 30), ("odd", 30, 20), (None, 5, 20)):
        for k in range(n):
            i += 1
            rows.append((i, "protein membrane helix " * size + str(k), source, "x"))
    rows += [(9001, None, "big", "x"), (9002, "", "big", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, copy string")


def targets(spark):
    return spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 5), ("missing", 0.1, 3)], "source string, target_share double, max_repeats int")


def test_shares_and_caps(spark):
    positions, report = mix(docs(spark), targets(spark), tokenizer_path=PATH)
    r = {x.source: x for x in report.collect()}
    assert abs(r["big"].actual_share - 2 / 3) < 0.03 and abs(r["small"].actual_share - 1 / 3) < 0.03
    assert r["missing"].drawn_tokens == 0 and r["small"].most_uses <= 5 and r["big"].most_uses == 1
    rows = positions.collect()
    assert {x.source for x in rows} == {"big", "small"}
    assert len({(x.doc_id, x.copy) for x in rows}) == len(rows)
    assert all(0 <= x.time <= 1 for x in rows)
    first = [x.n_tokens for x in rows if x.source == "small" and x.time < 0.25]
    last = [x.n_tokens for x in rows if x.source == "small" and x.time >= 0.75]
    assert sum(first) < sum(last)  # sources with many repeats gain weight


def test_sorted_by_position(spark):
    positions, _ = mix(docs(spark), targets(spark), tokenizer_path=PATH)
    flat = [x.position for x in positions.collect()]
    assert flat == sorted(flat)


def test_buckets_do_not_change_the_demand(spark):
    a = {x.source: x.drawn_tokens for x in mix(docs(spark), targets(spark), tokenizer_path=PATH)[1].collect()}
    b = {x.source: x.drawn_tokens for x in mix(docs(spark), targets(spark), tokenizer_path=PATH, bucket_rows=7)[1].collect()}
    assert all(abs(a[s] - b[s]) <= 130 for s in a)


def test_total_beyond_supply_is_reported(spark):
    r = {x.source: x for x in mix(docs(spark), targets(spark), total_tokens=10**9, tokenizer_path=PATH)[1].collect()}
    assert r["big"].drawn_tokens == r["big"].available_tokens and r["small"].drawn_tokens == 5 * r["small"].available_tokens


def test_empty_and_nulls(spark):
    assert {x.drawn_tokens for x in mix(docs(spark).limit(0), targets(spark), tokenizer_path=PATH)[1].collect()} == {0}
    counts = {r.doc_id: r.n_tokens for r in count_tokens(docs(spark), PATH).collect()}
    assert counts[9001] == 0 and counts[9002] == 0


def test_joined_sources_give_what_broadcast_ones_give(spark):
    def rows(**more):
        positions, report = mix(docs(spark), targets(spark), tokenizer_path=PATH, **more)
        return sorted(map(tuple, positions.collect())), sorted(map(tuple, report.collect()))

    assert rows() == rows(broadcast_sources=1)


def test_any_number_of_sources(spark):
    n = 12_000
    many = spark.range(n).selectExpr("id as doc_id", "'protein membrane helix' as text", "concat('s', id) as source")
    wanted = spark.range(n).selectExpr("concat('s', id) as source", f"1.0D / {n} as target_share", "1 as max_repeats")
    report = mix(many, wanted, tokenizer_path=PATH)[1]
    assert report.count() == n and report.where("n_uses <> 1").count() == 0
