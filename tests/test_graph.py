from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from codeweft.functions import ids
from codeweft.operators import explore as ex, traversal as tr
from conftest import rows

EDGE = "source_id string, target_id string, rel_type string, repo_id string"


def walk(spark, edges, seed, depth=10, incoming=False, types=None, repo="r"):
    es = spark.createDataFrame([(a, b, t, r) for a, b, t, r in edges], EDGE)
    seeds = spark.createDataFrame([(seed, repo)], "seed string, repo_id string")
    return {(r.id, r.depth, tuple(r.path_types)) for r in tr.traverse(es, seeds, depth, types, incoming).collect()}


def calls(*pairs, t="CALLS", repo="r"):
    return [(p[0], p[1], t, repo) for p in pairs]


def test_chain_both_ways(spark):
    e = calls("AB", "BC")
    assert walk(spark, e, "A", 1) == {("B", 1, ("CALLS",))}
    assert walk(spark, e, "A", 2) == {("B", 1, ("CALLS",)), ("C", 2, ("CALLS", "CALLS"))}
    assert walk(spark, e, "C", 2, incoming=True) == {("B", 1, ("CALLS",)), ("A", 2, ("CALLS", "CALLS"))}


@pytest.mark.parametrize(("depth", "n"), [(1, 1), (3, 3), (10, 4)])
def test_depth_bounds(spark, depth, n):
    assert len(walk(spark, calls("12", "23", "34", "45"), "1", depth)) == n


def test_cycle_self_loop_diamond(spark):
    assert {x[:2] for x in walk(spark, calls("XY", "YZ", "ZX"), "X")} == {("Y", 1), ("Z", 2)}
    assert walk(spark, calls("SS"), "S") == set()
    assert {x[:2] for x in walk(spark, calls("AB", "BD", "AC", "CD", "AD"), "A")} == {("B", 1), ("C", 1), ("D", 1)}


def test_repositories_types_and_ties(spark):
    assert walk(spark, calls("ab", repo="r2") + calls("bc"), "a") == set()
    every = [("s", f"t{t}", t, "r") for t in tr.ALLOWED_TYPES]
    assert len(walk(spark, every, "s")) == 3
    assert {x[0] for x in walk(spark, every, "s", types=[" contains "])} == {"tCONTAINS"}
    tie = [("a", "b", "INHERITS", "r"), ("a", "c", "CALLS", "r"), ("b", "d", "CALLS", "r"), ("c", "d", "INHERITS", "r"), ("a", "b", "INHERITS", "r")]
    assert ("d", 2, ("CALLS", "INHERITS")) in walk(spark, tie, "a")


def test_many_seeds_and_empty(spark):
    es = spark.createDataFrame(calls("AB", "BC", "CA"), EDGE)
    seeds = spark.createDataFrame([("A", "r"), ("C", "r"), ("Q", "r")], "seed string, repo_id string")
    assert {(r.seed, r.id, r.depth) for r in tr.traverse(es, seeds, 5).collect()} == {("A", "B", 1), ("A", "C", 2), ("C", "A", 1), ("C", "B", 2)}
    assert tr.traverse(es.limit(0), seeds, 5).count() == 0
    assert rows(tr.impact_summary(tr.traverse(es, seeds, 5, incoming=True))) == [("A", 2, 1, 1), ("C", 2, 1, 1)]


def test_validation():
    for bad in (0, -1, True, "3"):
        with pytest.raises(ValueError):
            tr.check_depth(bad)
    with pytest.raises(ValueError):
        tr.relationship_types(["", " "])
    with pytest.raises(ValueError):
        tr.relationship_types(["LIKES"])
    assert tr.relationship_types(["calls", "CALLS "]) == ["CALLS"]
    for limit, offset in ((0, 0), (201, 0), (5, -1)):
        with pytest.raises(ValueError):
            ex.check_page(limit, offset)
    for q in ("", "  ", "x" * 101):
        with pytest.raises(ValueError):
            ex.check_query(q)


def test_affected_files(spark):
    reached = spark.createDataFrame([("s", x, 1) for x in "abcd"], "seed string, id string, depth bigint")
    nodes = spark.createDataFrame([("a", "./x/y.py", None), ("b", "x//y.py", None), ("c", "", "z.py"), ("d", None, "")], "id string, file_path string, path string")
    assert rows(tr.affected_files(reached, nodes), "path") == [("x/y.py",), ("z.py",)]


def test_neighbours_and_edge_ids(spark):
    loc = "struct<start_line:bigint,start_column:bigint>"
    es = spark.createDataFrame(
        [(1, "a", "a", "CALLS", None), (2, "a", "b", "CALLS", (3, 9)), (3, "a", "b", "CALLS", (3, 1)), (4, "c", "a", "IMPORTS", None)], f"edge_id bigint, source_id string, target_id string, rel_type string, location {loc}")
    assert rows(ex.neighbor_counts(es, "a")) == [(4, 2)]
    assert rows(ex.incident(es, "a", "outgoing"), "edge_id") == [(1,), (2,), (3,)]
    assert rows(ex.incident(es, "a", "incoming", ["IMPORTS"]), "neighbor") == [("c",)]
    assert rows(ex.edge_ids(es), "edge_id", "graph_edge_id") == [(1, "a->CALLS->a"), (2, "a->CALLS->b:L3#1"), (3, "a->CALLS->b:L3"), (4, "c->IMPORTS->a")]


def test_search_is_literal(spark):
    cols = "id string, label string, name string, qualified_name string, path string, file_path string"
    ns = spark.createDataFrame([("1", "Function", "a_b", "m.a_b", None, None), ("2", "Function", "axb", "m.axb", None, None), ("3", "File", None, None, "x/a_b", None), ("4", "Class", "100%", None, None, None)], cols)
    assert rows(ex.search(ns, "A_B"), "id", "rank") == [("1", 1), ("3", 3)]
    assert rows(ex.search(ns, "%"), "id") == [("4",)]
    assert rows(ex.search(ns, "a", label="file"), "id", "rank") == [("3", 3)]
    assert [(r.id, r.score) for r in ex.scored_search(ns, "a_b").collect()] == [("1", 110), ("3", 75)]
    assert ex.scored_search(ns, "  ").count() == 0
    two = ns.withColumns({"repo_id": F.when(F.col("id") == "1", "r").otherwise("q"), "imported_name": F.when(F.col("id") == "4", "a_bc")})
    assert rows(ex.search(two, "a_b", "r"), "id") == [("1",)] and rows(ex.search(two, "a_b", "q"), "id", "rank") == [("3", 3), ("4", 3)]


def test_scores_by_field(spark):
    """Display name before name, id and path, in this order: the first that matches counts, not the best."""
    cols = "id string, label string, name string, path string, file_path string, display_name string"
    ns = spark.createDataFrame([
        ("i1", "Class", "thing", None, "lib/item.py", None), ("x::item", "Class", "thing", None, None, None), ("i3", "Class", "item", None, None, "The Item"), ("i4", "Class", "items", None, None, None),
        ("item", "Module", None, None, None, None), ("i6", "File", None, "a/item.py", None, None), ("i7", "Class", "xitemx", None, None, None), ("i8", "Class", "thing", None, None, None), ("i9", "Class", "my item", None, None, None),
    ], cols)
    got = {r.id: r.score for r in ex.scored_search(ns, "Item").collect()}
    assert got == {"i1": 60, "x::item": 65, "i3": 75, "i4": 90, "item": 110, "i6": 75, "i7": 60, "i9": 75}


def test_full_graph_and_pages_of_edges(spark):
    loc = "struct<start_line:bigint,start_column:bigint,start_byte:bigint>"
    ns = spark.createDataFrame([("r", "r", "Repository", "R"), ("b", "r", "Class", "B"), ("a", "r", "Class", "A"), ("z", "q", "Class", "Z")], "id string, repo_id string, label string, name string")
    es = spark.createDataFrame([(1, "a", "b", "CALLS", (5, 1, 9)), (2, "a", "b", "CALLS", (5, 0, 8)), (3, "a", "z", "CALLS", None), (4, "r", "b", "CONTAINS", None), (5, "r", "b", "CONTAINS", (2, 0, 0)), (6, "b", "b", "CALLS", None)], f"edge_id bigint, source_id string, target_id string, rel_type string, location {loc}")
    n, e = ex.full_graph(ns, es, "r")
    assert [x.id for x in n.collect()] == ["r", "a", "b"]
    assert [(x.edge_id, x.graph_edge_id) for x in e.collect()] == [(2, "a->CALLS->b:L5"), (1, "a->CALLS->b:L5#1"), (6, "b->CALLS->b"), (4, "r->CONTAINS->b"), (5, "r->CONTAINS->b:L2")]
    n, e = ex.full_graph(ns, es, "r", 2)
    assert [x.id for x in n.collect()] == ["r", "a"] and e.count() == 0 and ex.full_graph(ns, es, "none")[0].count() == 0
    assert [x.graph_edge_id for x in ex.contained_edges(es, "r", ns.where("id = 'b'")).collect()] == ["r->CONTAINS->b"]
    p = ex.neighbor_page(es, "b")
    assert [(x.edge_id, x.neighbor, x.graph_edge_id) for x in p.orderBy(*ex.NEIGHBOR_ORDER).collect()] == [(2, "a", "a->CALLS->b:L5"), (1, "a", "a->CALLS->b:L5#1"), (6, "b", "b->CALLS->b"), (4, "r", "r->CONTAINS->b"), (5, "r", "r->CONTAINS->b:L2")]
    assert [x.id for x in ex.page_neighbors(p, ns, "b").collect()] == ["a", "r"]
    m = {x.id: x for x in ex.node_models(ns).collect()}
    assert m["a"].display_name == "A" and m["a"].properties == {"repo_id": "r", "name": "A"}


def test_documents_and_stored_shapes_round_trip(spark):
    e = f"edge_id bigint, rel_type string, source_id string, target_id string, location struct<{','.join(c + ':bigint' for c in ex.PLACE)}>, metadata map<string,string>"
    es = spark.createDataFrame([(1, "CALLS", "a", 'b"é', (1, 2, 3, 4, 5, 6), {"k": "v", "n": None}), (2, "CALLS", "a", "c", None, None), (3, "CALLS", "a", "d", (1, None, 2, None, None, None), {})], e)
    back = {r.edge_id: r for r in ex.edges_of_documents(ex.edge_documents(es)).collect()}
    assert tuple(back[1].location) == (1, 2, 3, 4, 5, 6) and back[1].target_id == 'b"é' and back[2].location is None and back[2].metadata == {}
    doc = ex.edge_documents(es).where("edge_id = 2").first().doc
    assert doc == '{"location":null,"metadata":{},"rel_type":"CALLS","source_id":"a","target_id":"c"}'
    again = {r.edge_id: r for r in ex.placed_edges(ex.flat_edges(es)).collect()}
    assert tuple(again[1].location) == (1, 2, 3, 4, 5, 6) and again[1].metadata == {"k": "v"} and again[2].location is None and tuple(again[3].location) == (1, 0, 2, 0, 0, 0)
    ns = spark.createDataFrame([("a", "Class", "A", None), ("b", "Repository", "B", None)], "id string, label string, name string, start_byte bigint").withColumn("end_byte", F.lit(None).cast("bigint"))
    assert rows(ex.entities(ns), "id", "start_byte") == [("a", 0), ("b", None)]
    assert rows(ex.nodes_of_documents(ex.document_json(ns), "id string, name string, start_byte bigint")) == [("a", "A", None), ("b", "B", None)]
    with pytest.raises(Exception, match="unknown label"):
        ex.entities(ns.withColumn("label", F.lit("Thing"))).collect()


def test_impact_of_many_requests(spark):
    ns = spark.createDataFrame([("repo::r", "repo::r", "Repository", "r", None), ("repo::q", "repo::q", "Repository", "q", None), *[(f"repo::r::function::{x}", "repo::r", "Function", x, f"{x}.py") for x in "abc"], ("repo::q::function::z", "repo::q", "Function", "z", "z.py")], "id string, repo_id string, label string, name string, file_path string").withColumn("path", F.lit(None).cast("string"))
    es = spark.createDataFrame([(f"repo::r::function::{a}", f"repo::r::function::{b}", "CALLS", "repo::r") for a, b in ("ab", "bc", "ca")], EDGE)
    ask = [("repo::r", "repo::r::function::c"), ("repo::r", "repo::r::function::none"), ("repo::q", "repo::r::function::c"), ("repo::none", "repo::none::function::x"), ("repo::q", "repo::q::function::z")]
    out, hit, files = tr.impact(ns, es, spark.createDataFrame(ask, "repository_id string, entity_id string"))
    got = {(r.repository_id, r.entity_id): (r.repo_exists, r.entity_exists, r.found, r.name, r.blast_radius, r.directly_impacted, r.transitively_impacted, r.affected_file_count) for r in out.collect()}
    assert got == {ask[0]: (True, True, True, "c", 2, 1, 1, 2), ask[1]: (True, False, False, None, 0, 0, 0, 0), ask[2]: (True, False, False, None, 0, 0, 0, 0), ask[3]: (False, False, False, None, 0, 0, 0, 0), ask[4]: (True, True, True, "z", 0, 0, 0, 0)}
    assert [(r.name, r.depth, r.direct, r.path_types) for r in hit.orderBy("depth", "id").collect()] == [("b", 1, True, ["CALLS"]), ("a", 2, False, ["CALLS", "CALLS"])]
    assert rows(files, "path") == [("a.py",), ("b.py",)]
    assert [(r.id[-1], r.depth) for r in tr.transitive_dependents(es, "repo::r::function::c").collect()] == [("b", 1), ("a", 2)] and [r.id[-1] for r in tr.direct_dependencies(es, "repo::r::function::c").collect()] == ["a"]


def test_tags(spark):
    df = spark.createDataFrame([(x,) for x in ("repo::r::class::m.A", "a/b c/d(1).py", "plain", None)], "x string")
    got = [tuple(r) for r in df.select(ids.short_name(F.col("x")), ids.encode_path(F.col("x"))).collect()]
    assert got == [("m.A", "repo%3A%3Ar%3A%3Aclass%3A%3Am.A"), ("d(1).py", "a/b%20c/d(1).py"), ("plain", "plain"), ("", None)]
    lab = spark.createDataFrame([(x,) for x in ("Method", "file", "odd", None)], "x string")
    assert [tuple(r) for r in lab.select(ids.is_leaf(F.col("x")), ids.style(F.lower("x"), ids.BADGES)).collect()] == [(True, "#2dd4bf"), (False, "#60a5fa"), (False, "#cbd5e1"), (False, "#cbd5e1")]


def test_pages_and_meta(spark):
    df = spark.range(25).select(F.col("id").cast("string").alias("id"))
    assert len(ex.page(df, ["id"], 10, 20).collect()) == 5
    assert rows(ex.page_meta(df, 10, 20)) == [(25, 5, False, True)]
    assert rows(ex.page_meta(df.limit(0), 10, 0)) == [(0, 0, False, False)]


def test_upsert_keeps_what_null_does_not_replace_and_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "id string, v bigint, w string")
    new = spark.createDataFrame([("b", None, "y"), ("c", 3, None)], "id string, v bigint, w string")
    once = ex.upsert(old, new, "id")
    assert rows(once) == [("a", 1, "x"), ("b", 2, "y"), ("c", 3, None)]
    assert rows(ex.upsert(once, new, "id")) == rows(once)


def test_merge_drops_repeats_and_dangling(spark):
    ns, more = (spark.createDataFrame([(x,) for x in s], "id string") for s in ("ab", "bc"))
    e = "source_id string, target_id string, rel_type string"
    old, new = spark.createDataFrame([("a", "b", "CALLS")], e), spark.createDataFrame([("a", "b", "CALLS"), ("b", "c", "CALLS"), ("b", "z", "CALLS")], e)
    n, m = ex.merge_graphs(ns, more, old, new)
    assert rows(n) == [("a",), ("b",), ("c",)] and rows(m, "source_id", "target_id") == [("a", "b"), ("b", "c")]


def test_layout_columns(spark):
    ns = spark.createDataFrame([(f"f{i:02}", "File") for i in range(14)] + [("r", "Repository"), ("q", "Other")], "id string, label string")
    at = {r.id: (r.tier, r.x, r.y) for r in ex.layout(ns).collect()}
    assert at["r"] == (0, 60, 60) and at["f00"] == (1, 420, 60) and at["f11"] == (1, 420, 995) and at["f12"] == (1, 700, 60) and at["q"] == (5, 1060, 60)
    named = spark.createDataFrame([("1", "Method", "b"), ("2", "Function", "z"), ("3", "Method", "a"), ("4", "Function", None)], "id string, label string, name string")
    assert [r.id for r in ex.layout(named).orderBy("y").collect()] == ["4", "2", "3", "1"]


def test_ids_and_paths(spark):
    df = spark.createDataFrame([(r".\services\item.py",), ("//a/./b//c.py",), ("../x/__init__.py",), ("__init__.py",), ("",), (None,)], "p string")
    short, dotted = ids.module_info(F.col("p"))
    got = [tuple(r) for r in df.select(ids.normalize_path(F.col("p")), short, dotted).collect()]
    assert got[0] == ("services/item.py", "item", "services.item") and got[1][0] == "a/b/c.py" and got[2] == ("../x/__init__.py", "x", "...x") and got[3][1:] == ("root", "root")
    i = spark.createDataFrame([("repo::a::function::m.f",), ("repo::a",), ("repo::x::class::a::file::b",), ("zzz",), (None,)], "i string")
    assert [tuple(r) for r in i.select(ids.label_of(F.col("i")), ids.repo_of(F.col("i"))).collect()] == [("Function", "repo::a"), ("Repository", "repo::a"), ("File", "repo::x::class::a"), (None, None), (None, None)]
    s = spark.createDataFrame([(x,) for x in ("item", "items", "my_item", "xitem", "none", None)], "t string")
    assert [r[0] for r in s.select(ids.match_score(F.col("t"), "Item")).collect()] == [100, 80, 65, 50, 0, 0]


def test_last_and_first_wins(spark):
    from codeweft.plans import graph as g

    t = [dt(2024, 1, d) for d in (1, 2)]
    n = spark.createDataFrame([("a", t[0], "old"), ("a", t[1], "new"), ("a", t[1], None), ("b", None, "x")], "id string, observed_at timestamp_ntz, name string")
    assert rows(g.last_wins(n, "id", "observed_at")) == [("a", "new"), ("b", "x")]
