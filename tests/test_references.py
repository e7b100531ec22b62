from datetime import datetime as dt

from pyspark.sql import functions as F

from codeweft.operators import references as rf
from conftest import rows

T = [dt(2024, 1, d) for d in range(1, 12)]
EDGE = "edge_id bigint, rel_type string, source_id string, target_id string, observed_at timestamp_ntz, side string"
NODE = "id string, observed_at timestamp_ntz, deleted_at timestamp_ntz, edge_id string"


def _case(spark, edges, nodes):
    refs = rf.edge_references(spark.createDataFrame(edges, EDGE))
    return rows(rf.dangling_references(refs, spark.createDataFrame(nodes, NODE)), "edge_id", "side")


def brute(edges, nodes):
    out = []
    for e in edges:
        for side, i in (("source", e[2]), ("target", e[3])):
            if i is None:
                continue
            alive = any(n[0] == i and n[1] and e[4] and n[1] <= e[4] and (n[2] is None or n[2] > e[4]) for n in nodes)
            if not alive:
                out.append((e[0], side))
    return sorted(out, key=repr)


NODES = [
    ("a", T[2], None, "x"), ("b", T[1], T[4], "x"), ("b", T[6], T[8], None), ("c", T[0], T[0], "x"), ("d", None, None, "x"), ("a", T[2], None, "x"), (None, T[0], None, "x"), ("A", T[0], None, None),
]
EDGES = [
    (1, "CALLS", "a", "b", T[3], "z"), (2, "calls", "a", "b", T[1], "z"), (3, "CALLS", "b", "b", T[4], "z"), (4, "CALLS", "c", "d", T[5], "z"), (5, None, None, "gone", T[5], "z"),
    (6, "CALLS", "A", "a ", T[5], "z"), (7, "CALLS", "a", None, None, "z"), (8, "CALLS", "b", "b", T[7], None), (8, "CALLS", "b", "b", T[7], None), (9, "X", "", "a", T[2], "z"),
]


def test_lifetimes_nulls_ties_and_extra_columns(spark):
    assert _case(spark, EDGES, NODES) == brute(EDGES, NODES)


def test_empty_tables(spark):
    assert _case(spark, [], NODES) == []
    assert _case(spark, EDGES, []) == brute(EDGES, [])


def test_hot_key_is_salted_and_whole(spark):
    edges = [(i, "CALLS", "hot" if i % 3 else f"k{i % 7}", "hot", T[i % 11], "s") for i in range(3000)]
    nodes = [("hot", T[3], T[6], None), ("hot", T[8], None, None)] + [(f"k{i}", T[i], None, None) for i in range(5)]
    assert "hot" in rf.hot_keys(rf.edge_references(spark.createDataFrame(edges, EDGE)), "ref_id")
    assert _case(spark, edges, nodes) == brute(edges, nodes)


def test_a_filter_too_large_to_broadcast_is_met_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(rf, "MAX_BROADCAST_WORDS", 8)
    assert _case(spark, EDGES, NODES) == brute(EDGES, NODES)
    edges = [(i, "CALLS", "hot" if i % 3 else f"k{i % 7}", "hot", T[i % 11], "s") for i in range(500)]
    nodes = [("hot", T[3], T[6], None)] + [(f"k{i}", T[i], None, None) for i in range(5)]
    assert _case(spark, edges, nodes) == brute(edges, nodes)


def test_bloom_is_bounded_and_never_denies_a_key(spark):
    assert rf.bloom_words(0) == 64 and rf.bloom_words(10**9) == 1 << 28
    keys = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    words = rf.bloom_words(5000)
    b = rf.bloom_filter(keys, "k", words)
    assert b.count() <= words
    j = keys.union(spark.range(10**6, 10**6 + 5000).select(F.col("id").cast("string"))).withColumn("word", rf._word(F.col("k"), words)).join(b, "word", "left")
    hit = j.where(F.coalesce(F.col("bits").bitwiseAND(rf._mask(F.col("k"))) == rf._mask(F.col("k")), F.lit(False)))
    assert hit.where("cast(k as bigint) < 5000").count() == 5000
    assert hit.where("cast(k as bigint) >= 10000").count() < 500
