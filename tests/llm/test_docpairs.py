from datetime import datetime as dt

import pytest

from codeweft.llm import docpairs as dp
from conftest import rows

SAYS = ["Bytes, not roots.", "Times are UTC.", "Raises KeyError without a value.", "None means all orders.", "Sin branch no hace nada.", "Leere tags zählen nicht.", "Newest index wins.", ":param line: byte to start from",
        "Args:\n    line: stale row taken from the index.", "Split the line.\n\nSafe to call twice.", "Returns zero for empty lines.", "返回最近的一行。", ":raises KeyError: if the row is missing", "Note: not thread safe"]
SILENT = [None, "", "  \n\t", ".", "TODO", "TODO: document", "T.B.D.", "n/a", "N/A", "Docstring.", "Split the line.", "Splits the line", "split_line", "This function will split the line.", "_summary_\n\nArgs:\n    line (_type_): _description_\n    n (_type_): _description_",
          ":param line:\n:return:", "Split line.\n\n:param line: the line\n:type line: object\n:returns: the result\n:rtype: object", "(line) -> int", "See base class.", "Same as super.", "Inherited.", "Overrides parent.", "À compléter.", "Por documentar.",
          "Copyright the authors. All rights reserved.\nUse of this code is subject to the licence terms of the project.", "Auto-generated stub.", "Generated accessor.", "-----\nsplit line\n-----", "noqa", "type: ignore", "pylint: disable=all", "Constructor.",
          "This is the function which is used in order to split the line.\n\nIt takes the parameter line and it will split the line.", "Split line.\n\nReturns:\n    None", "Splitting lines", "***", "None"]


@pytest.mark.parametrize("text", SAYS)
def test_texts_that_say_something(text):
    assert dp.informative(text, "pkg.mod.split_line", "(line, n=None)")


@pytest.mark.parametrize("text", SILENT)
def test_texts_that_say_nothing(text):
    assert not dp.informative(text, "pkg.mod.split_line", "(line, n=None)")


PY = '''"""Module."""
# not a doc

class A:
    def one(self, a=")"):  # def no(): pass
        """Says
        one."""
        return "def two(): pass"

    # Takes the second
    # of both.
    @deco
    def two(self, x: dict = {"a": [1]}): return x

def outer(
    a,
    b=(1, 2),
):
    text = """
def fake():
    pass
"""
    def inner():
        'In.'
        return text
    return inner

async def last(): pass
'''


def test_python_functions():
    f = {q: (s, p, d) for q, s, p, d in dp.python_functions("pkg/mod/__init__.py", PY)}
    assert list(f) == ["pkg.mod.A.one", "pkg.mod.A.two", "pkg.mod.outer", "pkg.mod.outer.inner", "pkg.mod.last"]
    assert f["pkg.mod.A.one"][0].endswith('return "def two(): pass"') and f["pkg.mod.A.one"][2].split() == ["Says", "one."]
    assert f["pkg.mod.A.two"][2] == "Takes the second\nof both." and f["pkg.mod.A.two"][0].endswith("return x")
    assert f["pkg.mod.outer"][0].endswith("return inner") and "fake" in f["pkg.mod.outer"][0]
    assert f["pkg.mod.outer.inner"][2] == "In." and f["pkg.mod.last"][2] is None
    crlf = {q: s for q, s, _, _ in dp.python_functions("pkg/mod/__init__.py", "﻿" + PY.replace("\n", "\r\n"))}
    assert list(crlf) == list(f)


JS = '''/** Adds two. */
export function add(a, b = "}") { // {
  return `${a}}` + b;
}

// Keeps the first.
const first = (x) => { return x[0] / 2; };

class K {
  /**
   * Counts.
   */
  count(n) { if (n) { return 1; } return /[{]/.test(n); }
  plain() {}
}
function bare() {}
'''


def test_javascript_functions():
    f = {q: (s, d) for q, s, _, d in dp.javascript_functions("a/b.js", JS)}
    assert list(f) == ["a.b.add", "a.b.first", "a.b.K.count", "a.b.K.plain", "a.b.bare"]
    assert f["a.b.add"][0].startswith("export function add") and f["a.b.add"][0].endswith("+ b;\n}") and f["a.b.add"][1] == "Adds two."
    assert f["a.b.first"][1] == "Keeps the first." and f["a.b.K.count"][1] == "Counts." and f["a.b.K.plain"][1] is None and f["a.b.bare"][1] is None


def test_broken_and_odd_sources_do_not_crash():
    for t in ("", "def", "def f(", "def f(:\n  '''open", "class", "/*", "function f( {", "`${", "\x00", "def f():\n" * 300):
        dp.python_functions("a.py", t)
        dp.javascript_functions("a.js", t)


NODE = "id string, repo_id string, qualified_name string, file_path string, docstring string, observed_at timestamp_ntz, source string"
FILE = "repo_id string, file_path string, content string, parsed_at timestamp_ntz, docstring string"


def test_pairs_of_latest_rows(spark):
    t = [dt(2024, 1, d) for d in (1, 2)]
    nodes = spark.createDataFrame([
        ("f1", "r", "m.go", "m.py", "Stops at once.", t[0], "x"), ("f1", "r", "m.go", "m.py", "TODO", t[1], "x"), ("f2", "r", "m.run", "m.py", "TODO", t[0], "x"), ("f2", "r", "m.run", "m.py", "Safe to call twice.", t[1], "x"),
        ("f2", "r", "m.run", "m.py", "Safe to call twice.", t[1], "x"), ("f3", "r", "m.gone", "m.py", "Times are UTC.", None, "x"), ("f4", "r", "z.a", "no.py", "Bytes, not lines.", t[0], "x"), (None, "r", "m.x", "m.py", "Times are UTC.", t[0], "x"), ("f5", None, None, None, "  ", t[0], "x"),
        ("f6", None, None, None, "Times are UTC.", t[0], "x"),
    ], NODE)
    files = spark.createDataFrame([("r", "m.py", "def run(a):\n    return a\n", t[0], "x"), ("r", "m.py", "def run(b):\n    return b\n", t[1], "x"), ("r", "m.py", "def run(b):\n    return b\n", t[1], "x"), ("r", "n.py", None, t[0], "x")], FILE)
    assert rows(dp.documented_pairs(nodes, files), "entity_id", "source") == sorted([("f2", "def run(b):\n    return b"), ("f3", None), ("f4", None), ("f6", None)], key=repr)
    assert dp.documented_pairs(nodes.limit(0), files).count() == 0
    assert rows(dp.documented_pairs(nodes, files.limit(0)), "entity_id") == [("f2",), ("f3",), ("f4",), ("f6",)]
