import pytest
from pyspark.sql import functions as F

from codeweft.api import CodeGraph
from codeweft.operators.analysis import analyze
from codeweft.sources.store import GraphStore, write_graph
from conftest import rows
from test_extraction import FILES

R = "repo::r"


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    """The small repository through the whole way: extraction, resolution, store."""
    df = spark.createDataFrame([(r, p, c) for r in (R, "repo::s") for p, c in FILES.items()], "repo_id string, file_path string, content string")
    nodes, edges, told = analyze(df)
    store = GraphStore(spark, str(tmp_path_factory.mktemp("g")))
    counts = write_graph(store, nodes, edges)
    assert counts == {"nodes": 66, "edges": 74, "skipped": 0}
    return CodeGraph.of_store(store)


def test_lookups_and_existence(graph):
    assert [r.name for r in graph.repository(R).collect()] == ["r"] and graph.repository("repo::none").count() == 0
    assert graph.entity(f"{R}::class::square.Square", R).count() == 1 and graph.entity(f"{R}::class::square.Square", "repo::s").count() == 0 and graph.entity(R, "repo::s").count() == 1
    assert rows(graph.of_label(R, "class"), "name") == [("App",), ("Shape",), ("Square",)]
    assert rows(graph.relationships(R, "INHERITS"), "source_id", "target_id") == [(f"{R}::class::square.Square", f"{R}::class::shapes.Shape")]
    assert rows(graph.exists(R, f"{R}::file::main.py")) == [(True, True)] and rows(graph.exists(R, "repo::s::file::main.py")) == [(True, False)] and rows(graph.exists("repo::none")) == [(False, None)]


def test_answers(graph):
    o = graph.overview(R, 2, 1)
    assert rows(o.meta) == [(6, 2, True, True)] and [r.name for r in o.nodes.orderBy("name").collect()] == ["main.py", "pkg/__init__.py"]
    assert o.edges.first().graph_edge_id == f"{R}->CONTAINS->{R}::file::main.py" and o.edges.count() == 2
    c = graph.children(R, f"{R}::class::main.App")
    assert rows(c.meta) == [(2, 2, False, False)] and rows(c.nodes, "name") == [("__init__",), ("run",)] and rows(c.exists) == [(True, True)]
    n = graph.neighbors(R, f"{R}::function::square.make", "incoming", "calls")
    assert rows(n.nodes, "name") == [("inner",), ("run",)] and rows(n.meta) == [(2, 2)]
    s = graph.search(R, "SQUARE", "class")
    assert rows(s.nodes, "name", "rank") == [("Square", 1)] and rows(s.meta) == [(1, 1, False, False)]
    w = graph.graph(R)
    assert w.nodes.count() == 33 and w.edges.count() == 37 and [r.label for r in w.nodes.take(1)] == ["Repository"]
    assert graph.graph("repo::none").nodes.count() == 0 and rows(graph.overview("repo::none").exists) == [(False, None)]
    for bad in (lambda: graph.search(R, " "), lambda: graph.search(R, "x", "thing"), lambda: graph.neighbors(R, "x", "up"), lambda: graph.overview("../x"), lambda: graph.overview(R, 0)):
        with pytest.raises(ValueError):
            bad()


def test_impact_of_a_base_method(graph):
    envelope, hit, files = graph.impact(R, f"{R}::method::shapes.Shape.area")
    e = envelope.first()
    assert e.found and (e.blast_radius, e.directly_impacted, e.transitively_impacted, e.affected_file_count) == (3, 2, 1, 2)
    assert [(r.name, r.depth) for r in hit.collect()] == [("run", 1), ("twice", 1), ("main", 2)] and [r.path for r in files.collect()] == ["main.py", "square.py"]
    missing = graph.impact(R, f"{R}::function::none")[0].first()
    assert missing.repo_exists and not missing.found and missing.blast_radius == 0
    assert graph.impact(R, f"{R}::function::helpers.double", 1)[0].select(F.col("blast_radius")).first()[0] == 1
