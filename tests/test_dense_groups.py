from collections import Counter
from datetime import datetime as dt

from pyspark.sql import functions as F

from codeweft.operators import dense_groups as dg
from conftest import rows


def test_counts_sums_and_maxima_of_a_skewed_key(spark):
    data = [("hot" if i % 3 else f"k{i % 50}", i % 5, i if i % 4 else None, "x") for i in range(5000)] + [(None, 1, 1, "x"), ("none", None, None, "x")]
    df = spark.createDataFrame(data, "k string, w bigint, t bigint, _k string").repartition(7)
    got = {r[0]: tuple(r[1:]) for r in dg.dense_group_stats(df, "k", {"n": None, "s": "w"}, "t").collect()}
    want = {}
    for k in {x[0] for x in data if x[0] is not None}:
        own = [x for x in data if x[0] == k]
        ts = [x[2] for x in own if x[2] is not None]
        want[k] = (len(own), sum(x[1] or 0 for x in own), max(ts) if ts else None)
    assert got == want


def test_full_blocks_are_sent_on(spark, monkeypatch):
    monkeypatch.setattr(dg, "BLOCK_SLOTS", 8)
    data = [(f"k{i % 40}",) for i in range(4000)]
    got = dict(rows(dg.dense_group_stats(spark.createDataFrame(data, "k string").coalesce(2), "k", {"n": None})))
    assert got == Counter(f"k{i % 40}" for i in range(4000))


def test_heavy_keys_count_null_rows_in_the_total(spark):
    data = [("a",)] * 10 + [("b",)] * 9 + [(None,)] * 81
    df = spark.createDataFrame(data, "k string")
    assert rows(dg.heavy_keys(df, "k", 0.10)) == [("a", 10)]
    assert dg.heavy_keys(df.limit(0), "k", 0.1).count() == 0


def test_key_stats(spark):
    t = [dt(2024, 1, d) for d in (1, 2, 3)]
    data = [("a", "x", t[0]), ("a", "x", t[2]), ("a", "y", t[1]), ("a", None, None), ("b", None, None), (None, "x", t[0])]
    df = spark.createDataFrame(data, "key string, src string, at timestamp_ntz")
    got = {r.key: (r.n_rows, r.n_others, r.newest_us) for r in dg.key_stats(df, "key", "src", "at").collect()}
    assert got == {"a": (4, 2, int((t[2] - dt(1970, 1, 1)).total_seconds() * 1e6)), "b": (1, 0, None)}
    assert dg.key_stats(df.limit(0), "key", "src", "at").count() == 0


def test_dictionary_blocks_and_single_entries_agree(spark, monkeypatch):
    """Frequent keys over several blocks, rare keys beside them, counters that are thinned: as a plain aggregation."""
    import random

    rnd = random.Random(2)
    data = [(f"k{min(int(rnd.expovariate(0.02)), 400)}" if rnd.random() < 0.7 else f"rare{i}", rnd.randrange(-5, 9) if rnd.random() < 0.9 else None, rnd.randrange(100) if rnd.random() < 0.5 else None) for i in range(6000)]
    df = spark.createDataFrame(data, "k string, w bigint, t bigint").repartition(5)
    want = rows(df.groupBy("k").agg(F.count(F.lit(1)), F.coalesce(F.sum("w"), F.lit(0)), F.max("t")))
    for keys, numbers, slots in ((4096, 512, 1 << 16), (40, 7, 64), (0, 512, 1 << 16)):
        monkeypatch.setattr(dg, "DICTIONARY_KEYS", keys)
        monkeypatch.setattr(dg, "BLOCK_NUMBERS", numbers)
        monkeypatch.setattr(dg, "BLOCK_SLOTS", slots)
        assert rows(dg.dense_group_stats(df, "k", {"n": None, "s": "w"}, "t")) == want
    assert dg.frequent_keys(df.limit(0), "k") == []
