"""A small repository of our own, its entities and edges written out by hand."""

import pytest
from pyspark.sql import functions as F

from codeweft.operators import analysis as an
from codeweft.operators.facts import extract_facts, file_facts, syntax_nodes, table_of
from codeweft.operators.resolution import resolve_edges
from conftest import rows

FILES = {
    "shapes.py": '''class Shape:
    """Base of all."""
    def __init__(self, n):
        self.n = n
    def area(self):
        return self.n
''',
    "square.py": '''from shapes import Shape as Base

class Square(Base):
    def __init__(self, n):
        super().__init__(n)
    def twice(self):
        return self.area() + self.missing()

def make(n):
    return Square(n)
''',
    "helpers.py": '''def double(x):
    return x * 2
''',
    "main.py": '''import helpers
from square import Square, make
from nowhere import ghost

class App:
    def __init__(self):
        self.sq = Square(1)
    def run(self):
        self.sq.twice()
        v = make(2)
        v.area()
        w = Square(3)
        w = unknown(w)
        w.area()
        helpers.double(4)
        ghost()

def main():
    def inner():
        return make(1)
    inner()
    App().run()
    a = App()
    a.run()

main()
''',
    "pkg/__init__.py": "",
    "pkg/_private.py": "from . import nothing\n\n\ndef broken(:\n    pass\n\n\n@deco\nasync def fine():\n    r'''raw'''\n",
}
CALLS = {
    ("method::square.Square.__init__", "method::shapes.Shape.__init__"), ("method::square.Square.twice", "method::shapes.Shape.area"),
    ("function::square.make", "method::square.Square.__init__"), ("method::main.App.__init__", "method::square.Square.__init__"),
    ("method::main.App.run", "method::square.Square.twice"), ("method::main.App.run", "function::square.make"),
    ("method::main.App.run", "method::square.Square.__init__"), ("method::main.App.run", "method::shapes.Shape.area"),
    ("method::main.App.run", "function::helpers.double"), ("function::main.main.inner", "function::square.make"),
    ("function::main.main", "function::main.main.inner"), ("function::main.main", "method::main.App.__init__"), ("function::main.main", "method::main.App.run"),
}


def frame(spark, repos=("repo::r",)):
    return spark.createDataFrame([(r, p, c) for r in repos for p, c in FILES.items()], "repo_id string, file_path string, content string")


def test_edges_match_the_hand_written_ones(spark):
    e = resolve_edges(extract_facts(frame(spark))).collect()
    got = {t: {(x.source_id.removeprefix("repo::r::"), x.target_id.removeprefix("repo::r::")) for x in e if x.rel_type == t} for t in ("CALLS", "IMPORTS", "INHERITS", "CONTAINS")}
    assert got["CALLS"] == CALLS
    assert got["IMPORTS"] == {("file::square.py", "module::shapes"), ("file::main.py", "module::helpers"), ("file::main.py", "module::square")}
    assert got["INHERITS"] == {("class::square.Square", "class::shapes.Shape")}
    assert ("repo::r", "file::pkg/_private.py") in got["CONTAINS"] and ("function::main.main", "function::main.main.inner") in got["CONTAINS"]
    assert len(got["CONTAINS"]) == 6 + 14


def test_two_repositories_never_mix_and_reruns_agree(spark):
    both = rows(resolve_edges(extract_facts(frame(spark, ("repo::r", "repo::s")))))
    one = rows(resolve_edges(extract_facts(frame(spark))))
    assert [x for x in both if x[0] == "repo::r"] == one and len(both) == 2 * len(one)
    assert all(x[2].startswith(x[0]) and x[3].startswith(x[0]) for x in both)


def test_definitions_imports_and_recovery(spark):
    f = extract_facts(frame(spark))
    d = {(r.file_path, r.qname): r for r in table_of(f, "defs").collect()}
    assert len(d) == 14
    fine = d["pkg/_private.py", "pkg._private.fine"]
    assert (fine.start_line, fine.end_line, fine.docstring) == (8, 10, "r'''raw'''")
    src = FILES["pkg/_private.py"].encode()
    assert src[fine.start_byte : fine.end_byte].startswith(b"@deco\nasync def fine")
    assert d["shapes.py", "shapes.Shape"].docstring == "Base of all."
    assert {r.file_path for r in f.where("has_syntax_errors").collect()} == {"pkg/_private.py"}
    im = rows(table_of(f, "imports"), "module_name", "imported_name", "alias")
    assert im == sorted([("shapes", "Shape", "Base"), ("helpers", "helpers", None), ("square", "Square", None), ("square", "make", None), ("nowhere", "ghost", None), (".", "nothing", None)], key=repr)


def test_inheritance_over_three_levels_cycles_and_aliases(spark):
    code = "class A:\n    def top(self): pass\nclass B(A): pass\nclass C(B):\n    def go(self):\n        self.top()\nclass X(Y): pass\nclass Y(X):\n    def go(self):\n        self.none()\n"
    df = spark.createDataFrame([("repo::q", "m.py", code)], "repo_id string, file_path string, content string")
    e = {(x.source_id, x.target_id) for x in resolve_edges(extract_facts(df)).where("rel_type = 'CALLS'").collect()}
    assert e == {("repo::q::method::m.C.go", "repo::q::method::m.A.top")}


def test_inner_blocks_are_read_and_errors_told(spark):
    code = "class A:\n    def one(self):\n        return 1\n\n    def bad(self:\n        return 2\n\n    def two(self):\n        x = (\n        return x\n\n    def three(self):\n        if a b:\n            pass\n        return self.one()\n\n\ndef last(:\n    pass\n\n\ndef fine(): return A()\n"
    f = file_facts("repo::r", "m.py", code)
    assert [d["qname"] for d in f["defs"]] == ["m.A", "m.A.one", "m.A.two", "m.A.three", "m.fine"] and f["has_syntax_errors"]
    assert [(d["start_line"], d["end_line"]) for d in f["defs"] if d["qname"] == "m.A.three"] == [(12, 15)]
    assert sorted(e["start_line"] for e in f["errors"]) == [5, 9, 13, 18] and {e["node_type"] for e in f["errors"]} >= {"ERROR", ")"}
    assert {(c["caller"], c["name"]) for c in f["calls"]} == {("m.A.three", "one"), ("m.fine", "A")}
    df = spark.createDataFrame([("repo::r", "m.py", code), ("repo::r", "n.py", "x = 1\n")], "repo_id string, file_path string, content string")
    assert table_of(extract_facts(df), "errors").count() == 4


def test_trees_are_walked_parents_first(spark):
    df = spark.createDataFrame([("repo::r", "m.py", "def f():\n    return g(1)\nx = 2\n")], "repo_id string, file_path string, content string")
    every = [(r.node_type, r.depth) for r in syntax_nodes(df).orderBy("ord").collect()]
    assert every == [("Module", 0), ("FunctionDef", 1), ("arguments", 2), ("Return", 2), ("Call", 3), ("Name", 4), ("Load", 5), ("Constant", 4), ("Assign", 1), ("Name", 2), ("Store", 3), ("Constant", 2)]
    assert [(r.node_type, r.start_line) for r in syntax_nodes(df, ["Call", "Assign"]).orderBy("ord").collect()] == [("Call", 2), ("Assign", 3)]


def test_analysis_has_all_kinds_of_entities(spark):
    nodes, edges, told = an.analyze(frame(spark))
    labels = {r.label: r.n for r in nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert labels == {"Repository": 1, "File": 6, "Module": 6, "Class": 3, "Function": 5, "Method": 6, "Import": 6}
    assert {(r.rel_type, r.n) for r in edges.groupBy("rel_type").agg(F.count(F.lit(1)).alias("n")).collect()} == {("CALLS", 13), ("CONTAINS", 20), ("IMPORTS", 3), ("INHERITS", 1)}
    assert rows(told) == [("repo::r", 6, 6, 3, 5, 6, 6, 37)]


def test_made_edges_and_chosen_sources(spark):
    e = "rel_type string, source_id string, target_id string, metadata map<string,string>"
    ok = spark.createDataFrame([(" calls ", " a ", "b", None), ("IMPORTS", "a", "c", {"k": "v"})], e)
    assert rows(an.relationships(ok), "rel_type", "source_id", "target_id") == [("CALLS", "a", "b"), ("IMPORTS", "a", "c")] and [r.metadata for r in an.calls(ok).collect()] == [{}, {"k": "v"}]
    for bad in (("LIKES", "a", "b", None), ("CALLS", " ", "b", None), ("CALLS", "a", None, None)):
        with pytest.raises(Exception, match="unknown relationship type|blank"):
            an.relationships(spark.createDataFrame([bad], e)).collect()
    with pytest.raises(ValueError):
        an.relationships(ok, "LIKES")
    f = "repo_id string, file_path string, content string"
    one, two = spark.createDataFrame([("r", "a.py", "1")], f), spark.createDataFrame([("r", "a.py", "2"), ("r", "b.py", "3")], f)
    assert rows(an.chosen_sources(one, None, two)) == [("r", "a.py", "1"), ("r", "b.py", "3")]


def test_odd_files():
    for text in ("", "# only a comment", "﻿x = 1\r\n", "\x00", "(" * 500, "def f(:\n"):
        f = file_facts("repo::r", "a.py", text)
        assert f["end_line"] >= 1 and f["end_byte"] == len(text.removeprefix("﻿").replace("\r\n", "\n").encode())


def test_empty_table(spark):
    assert resolve_edges(extract_facts(frame(spark).limit(0))).count() == 0
