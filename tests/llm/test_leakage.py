import random


from codeweft.llm import leakage as lk
from conftest import rows

DOC, ITEM = "doc_id bigint, text string, item_id string", "item_id bigint, text string, doc_id string"


def brute(docs, items):
    out = set()
    for i, t in items:
        w = lk.words(t)
        runs = {tuple(w[k : k + 20]) for k in range(len(w) - 19)}
        for d, u in docs:
            v = lk.words(u)
            if any(tuple(v[k : k + 20]) in runs for k in range(len(v) - 19)):
                out.add((d, i))
    return sorted(out, key=repr)


def run(spark, docs, items):
    d = spark.createDataFrame([(a, b, "z") for a, b in docs], DOC)
    i = spark.createDataFrame([(a, b, "z") for a, b in items], ITEM)
    return rows(lk.leaked_items(d, i), "doc_id", "item_id")


def test_words():
    assert lk.words("Ｔｈｅ  Ca­fé_1, x​y ﬁne ① STRASSE ß") == ["the", "café", "1", "xy", "fine", "1", "strasse", "ss"]
    assert lk.words(None) == lk.words("") == []


def test_against_brute_force(spark):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, text(45)) for i in range(12)] + [(100, text(19)), (101, None), (102, "")]
    items.append((103, items[0][1]))
    docs = [(1, None), (2, ""), (3, "short")]
    for k in range(60):
        w = items[k % 12][1].split()
        n = rnd.choice([17, 18, 19, 20, 21, 30, 45])
        s = rnd.randrange(0, 46 - n)
        part = w[s : s + n]
        if k % 5 == 0:
            part[len(part) // 2] = "other"
        part = [x.upper() if k % 3 else f"**{x}**" for x in part]
        docs.append((10 + k, text(rnd.randrange(0, 40)) + " \n" + " - ".join(part) + "\t" + text(rnd.randrange(0, 40))))
    docs += [(200, docs[20][1]), (201, docs[20][1]), (300, text(4000) + " " + items[3][1] + " " + text(4000))]
    want = brute(docs, items)
    assert len(want) > 20 and run(spark, docs, items) == want


def test_common_phrases_do_not_leak(spark):
    phrase = " ".join(f"p{i}" for i in range(19))
    docs = [(i, f"a{i} {phrase} b{i} " * 3) for i in range(200)]
    assert run(spark, docs, [(1, f"x {phrase} y " + " ".join(f"q{i}" for i in range(20)))]) == []


def test_empty_tables_and_report(spark):
    item = [(1, " ".join(f"q{i}" for i in range(44)))]
    assert run(spark, [], item) == [] and run(spark, [(1, "a")], []) == []
    d = spark.createDataFrame([(1, item[0][1], "z"), (2, item[0][1], "z")], DOC)
    assert rows(lk.leak_report(lk.leaked_items(d, spark.createDataFrame([(*item[0], "z")], ITEM)))) == [(1, 2, 44)]


def test_verify_finds_the_longest_run():
    a = list("abcdefghij")
    assert [lk._longest(a, b, d) for b, d in ((["c", "d", "e", "x", "g", "h"], [2, 0]), (["zz"], [0]))] == [3, 0]
