import random
from collections import Counter

import pytest

from codeweft.llm import packing as pk
from conftest import rows


def pack(spark, lengths, capacity):
    df = spark.createDataFrame([(i, n, 9) for i, n in enumerate(lengths)], "doc_id bigint, n_tokens bigint, piece bigint")
    return pk.pack(df, "doc_id", capacity)


def check(spark, lengths, capacity):
    got = pack(spark, lengths, capacity).collect()
    room, whole = Counter(), Counter()
    for r in got:
        room[r.container_id] += r.piece_tokens
        whole[r.doc_id] += r.piece_tokens
    assert all(0 < v <= capacity for v in room.values())
    assert whole == {i: n for i, n in enumerate(lengths) if n}  # nothing lost, nothing twice
    pieces = Counter(r.doc_id for r in got)
    assert all(pieces[i] == -(-n // capacity) for i, n in enumerate(lengths) if n)  # cut only where it must be
    assert sorted(room) == list(range(len(room)))
    return len(room)


def test_exact_complements_fill_containers(spark):
    assert check(spark, [60, 40, 70, 30, 100, 50, 30, 20, 50, 50], 100) == 5


def test_oversized_empty_and_equal_items(spark):
    assert check(spark, [0, 250, 100, 1, 1, 99, 50], 100) in (6, 5)
    check(spark, [7] * 1000, 10)
    check(spark, [], 10)
    check(spark, [0, 0], 10)


@pytest.mark.parametrize("seed", range(3))
def test_random_items_come_near_the_bound(spark, seed):
    rnd = random.Random(seed)
    lengths = [min(900, int(rnd.expovariate(1 / 120)) + 1) for _ in range(3000)]
    n = check(spark, lengths, 512)
    assert n <= 1.01 * -(-sum(lengths) // 512) + 1


def test_one_length_may_hold_a_third(spark):
    rnd = random.Random(1)
    check(spark, [333] * 1000 + [rnd.randrange(1, 400) for _ in range(2000)], 1000)


def test_plan_is_bounded_by_the_capacity():
    rnd = random.Random(2)
    hist = {x: rnd.randrange(1, 10**6) for x in range(1, 400)}
    plan = pk.packing_plan(hist, 512)
    used = Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 512 and times > 0
        for x in pattern:
            used[x] += times
    assert used == hist and len(plan) < 20 * 512


def test_plan_against_the_best_packing():
    def best(items, cap):  # brute force over assignments
        out = [len(items)]

        def go(i, bins):
            if len(bins) >= out[0]:
                return
            if i == len(items):
                out[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[i] <= cap:
                    bins[k] += items[i]
                    go(i + 1, bins)
                    bins[k] -= items[i]
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return out[0]

    rnd = random.Random(5)
    for _ in range(30):
        items = [rnd.randrange(1, 10) for _ in range(8)]
        assert sum(t for _, t in pk.packing_plan(Counter(items), 10)) <= best(items, 10) + 1


def test_reruns_agree_and_report(spark):
    a, b = (rows(pack(spark, [5, 5, 3, 3, 2, 9, 1], 10)) for _ in range(2))
    assert a == b
    r = pk.packing_report(pack(spark, [6, 4, 5, 5], 10), 10).first()
    assert (r.n_containers, r.n_pieces, r.n_tokens, r.fullest, r.least_containers, r.fill) == (2, 4, 20, 10, 2, 1.0)


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "a" * 5000), (5, "<|endoftext|> é 漢")], "doc_id bigint, text string")
    got = dict(rows(pk.token_counts(df, "doc_id", "text")))
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 100 and got[5] > 3
