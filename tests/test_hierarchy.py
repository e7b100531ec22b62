import random

from codeweft.operators import hierarchy as hi
from conftest import rows

EDGE = "rel_type string, source_id string, target_id string, child string"


def links(spark, pairs):
    return hi.parent_links(spark.createDataFrame([("contains" if i % 2 else "CONTAINS", p, c, "x") for i, (p, c) in enumerate(pairs)], EDGE))


def brute_cycles(pairs):
    down = {}
    for p, c in set(pairs):
        if p is not None and c is not None:
            down.setdefault(p, set()).add(c)
    nodes = set(down) | {c for s in down.values() for c in s}

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for x in down.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    r = {a: reach(a) for a in nodes}
    out = set()
    for a in nodes:
        if a in r[a]:
            cid = min(b for b in r[a] if a in r[b])
            out |= {(x, cid) for x in r[a] | {a}}
    return sorted(out)


def check(spark, pairs):
    assert rows(hi.cycle_members(links(spark, pairs))) == brute_cycles(pairs)


def test_cycles_of_many_shapes(spark):
    pairs = [("r", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("s", "s"), ("s", "t"), ("x", "y"), ("y", "x"), ("r", "x"), ("r", "z"), ("z", "q"), ("a", "b"), (None, "n"), ("n", None)]
    check(spark, pairs)


def test_long_cycle_and_long_chain(spark):
    n = 37
    ring = [(f"c{i:02}", f"c{(i + 1) % n:02}") for i in range(n)]
    tail = [("c05", "t00")] + [(f"t{i:02}", f"t{i + 1:02}") for i in range(40)]
    chain = [(f"k{i:02}", f"k{i + 1:02}") for i in range(50)] + [("k50", "c09")]
    check(spark, ring + tail + chain)


def test_cycle_below_a_cycle(spark):
    check(spark, [("a", "b"), ("b", "a"), ("b", "m"), ("m", "c"), ("c", "d"), ("d", "c"), ("d", "e")])


def test_no_cycles_and_empty(spark):
    check(spark, [("a", "b"), ("b", "c")])
    check(spark, [])
    assert hi.hierarchy(links(spark, [])).count() == 0


def test_random_forests_with_loops(spark):
    rnd = random.Random(4)
    pairs = [(f"n{rnd.randrange(i)}", f"n{i}") for i in range(1, 60)] + [("n40", "n3"), ("n9", "n9")]
    check(spark, pairs)


def test_paths_depths_roots_and_descendants(spark):
    pairs = [("r", "a"), ("r", "b"), ("a", "c"), ("c", "d"), ("q", "c"), ("u", "v"), ("v", "u"), ("v", "w"), ("r", "a")]
    tree = hi.hierarchy(links(spark, pairs))
    got = {(r.node_id, r.root_id, r.depth, " ".join(r.path)) for r in tree.collect()}
    assert got == {
        ("r", "r", 0, "r"), ("q", "q", 0, "q"), ("a", "r", 1, "r a"), ("b", "r", 1, "r b"), ("c", "r", 2, "r a c"), ("c", "q", 1, "q c"),
        ("d", "r", 3, "r a c d"), ("d", "q", 2, "q c d"),
    }
    assert rows(hi.descendants(tree)) == sorted([
        ("r", "a", 1), ("r", "b", 1), ("r", "c", 2), ("r", "d", 3), ("a", "c", 1), ("a", "d", 2), ("c", "d", 1), ("q", "c", 1), ("q", "d", 2)], key=repr)


def brute_ways(pairs):
    """All ways down that repeat no node but may end where they began, as tuples of two nodes and more."""
    down = {}
    for p, c in set(pairs):
        if p is not None and c is not None:
            down.setdefault(p, set()).add(c)
    out, todo = [], [(p, c) for p in down for c in down[p]]
    while todo:
        w = todo.pop()
        out.append(w)
        if w[0] != w[-1]:
            todo += [(*w, c) for c in down.get(w[-1], ()) if c not in w[1:]]
    return out


def check_all(spark, pairs):
    ways, cycles = brute_ways(pairs), {}
    for node, cid in brute_cycles(pairs):
        if any(w[0] == node == w[-1] for w in ways) and any(w[0] == node and w[-1] == cid for w in ways):
            cycles[node] = cid
    kids = {c for p, c in pairs if p is not None and c is not None}
    roots = {p: True for p, c in pairs if p is not None and c is not None and p not in kids}
    entered = {cycles[c] for p, c in pairs if p is not None and c in cycles and cycles.get(p) != cycles[c]}
    roots |= {cid: False for cid in cycles.values() if cid not in entered}
    want = [(r, r, 0, r, t) for r, t in roots.items()] + [(w[-1], w[0], len(w) - 1, " ".join(w), roots[w[0]]) for w in ways if w[0] in roots and w[0] != w[-1]]
    got = [(r.node_id, r.root_id, r.depth, " ".join(r.path), r.rooted) for r in hi.all_paths(links(spark, pairs)).collect()]
    assert sorted(got) == sorted(want)
    assert {x[0] for x in got} == {x for pc in pairs if None not in pc for x in pc}
    assert rows(hi.all_descendants(links(spark, pairs))) == sorted({(w[0], w[-1], len(w) - 1) for w in ways}, key=repr)


def test_every_id_has_paths_and_descendants(spark):
    check_all(spark, [("r", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("b", "d"), ("q", "b"), ("q", "d"), ("d", "e"), ("a", "b"), (None, "n"), ("n", None)])
    check_all(spark, [("a", "b"), ("b", "a"), ("b", "m"), ("m", "c"), ("c", "d"), ("d", "c"), ("d", "e"), ("s", "s"), ("s", "t"), ("r", "z"), ("z", "z"), ("o", "o")])
    check_all(spark, [("r", "x0")] + [(f"x{i}", f"x{(i + 1) % 9}") for i in range(9)] + [("x4", "y"), ("y", "z"), ("k", "y")])


def test_every_id_of_random_forests_with_loops(spark):
    rnd = random.Random(5)
    check_all(spark, [(f"n{rnd.randrange(i)}", f"n{i}") for i in range(1, 40)] + [("n20", "n3"), ("n39", "n39"), ("u", "n7")])


def test_every_id_of_no_links(spark):
    assert hi.all_paths(links(spark, [])).count() == hi.all_descendants(links(spark, [])).count() == 0


def test_hot_inner_nodes_are_set_apart(spark, monkeypatch):
    monkeypatch.setattr(hi, "MAX_HOT_ROWS", 50)
    links = [("top", "root"), ("hot", "top")] + [(f"n{i}", "hot") for i in range(300)] + [(f"m{i}", f"n{i}") for i in range(100)] + [("x", "y"), ("y", "x")] + [(f"z{i}", "x") for i in range(200)]
    df = spark.createDataFrame(links, "child string, parent string")
    got = {r.node_id: (r.root_id, r.depth) for r in hi.hierarchy(df).collect()}
    assert len(got) == 403 and got["m7"] == ("root", 4) and got["n299"] == ("root", 3)
    assert {r.node_id for r in hi.cycle_members(df).collect()} == {"x", "y", *(f"z{i}" for i in range(200))}
