import pytest
from pyspark.sql import functions as F

from codeweft.functions import validate as v
from codeweft.sources import scan
from codeweft.sources.store import GraphStore, write_graph
from codeweft.streaming import manifests as mf
from conftest import rows


def test_scan_keeps_hidden_names_and_leaves_out_ignored_folders(spark, tmp_path):
    for p, c in {"a.py": "x = 1\n", "pkg/__init__.py": "", "pkg/_private.py": "é = 1\n", ".venv/b.py": "", "pkg/__pycache__/c.py": "", "n.txt": "", "bad.py": None}.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"\xff = 1\n" if c is None else c.encode())
    df = scan.read_files(spark, str(tmp_path), "repo::t")
    assert rows(scan.usable(df), "file_path") == [("a.py",), ("bad.py",), ("pkg/__init__.py",), ("pkg/_private.py",)]
    some = scan.read_files(spark, str(tmp_path), "repo::t", ["a.py", str(tmp_path / "pkg/__init__.py"), "gone.py"])
    assert rows(some, "file_path", "content", "error") == [("a.py", "x = 1\n", None), ("gone.py", None, "FileNotFoundError"), ("pkg/__init__.py", "", None)]
    assert scan.read_files(spark, str(tmp_path), "repo::t", []).count() == 0


def test_store_upserts_and_leaves_other_repositories_alone(spark, tmp_path):
    s = GraphStore(spark, str(tmp_path / "g"))
    assert s.read("nodes") is None
    n = "id string, repo_id string, name string, docstring string"
    e = "rel_type string, source_id string, target_id string, repo_id string"
    nodes = spark.createDataFrame([("a", "r", "A", "says"), ("b", "r", "B", None), ("z", "q", "Z", None)], n)
    edges = spark.createDataFrame([("CALLS", "a", "b", "r"), ("CALLS", "a", "b", "r"), ("CALLS", "a", "gone", "r")], e)
    assert write_graph(s, nodes, edges) == {"nodes": 3, "edges": 1, "skipped": 2}
    before = rows(s.read("nodes"), "id", "name", "docstring")
    write_graph(s, nodes, edges)
    assert rows(s.read("nodes"), "id", "name", "docstring") == before
    s.write("nodes", spark.createDataFrame([("a", "r", "A2", None), ("c", "r", "C", None)], n))
    assert rows(s.read("nodes"), "id", "name", "docstring") == [("a", "A2", "says"), ("b", "B", None), ("c", "C", None), ("z", "Z", None)]
    assert rows(s.read("nodes", "q"), "id") == [("z",)] and s.read("nodes", "none").count() == 0
    assert s.write("nodes", nodes.limit(0)) == 0


def _manifest(spark, data):
    return spark.createDataFrame(data, "repo_id string, file_path string, content string, t bigint").select("repo_id", "file_path", "content", F.timestamp_seconds("t").alias("observed_at"))


def test_manifest_stream_is_idempotent(spark, tmp_path):
    m = str(tmp_path / "m")
    _manifest(spark, [("repo::t", "a.py", "import b\n\n\ndef f():\n    return g()\n\n\ndef g(): pass\n", 2), ("repo::t", "a.py", "old(", 1), ("repo::t", "b.py", "", 1), (None, "b.py", "", 1)]).write.parquet(m)
    for run in range(2):
        mf.ingest(spark, m, str(tmp_path / "g"), str(tmp_path / f"c{run}")).awaitTermination()
        s = GraphStore(spark, str(tmp_path / "g"))
        assert rows(s.read("nodes"), "id") == [(f"repo::t{x}",) for x in ("", "::file::a.py", "::file::b.py", "::function::a.f", "::function::a.g", "::import::a.py::L1::b", "::module::a", "::module::b")]
        got = rows(s.read("edges"), "rel_type", "source_id", "target_id")
        assert ("CALLS", "repo::t::function::a.f", "repo::t::function::a.g") in got and ("IMPORTS", "repo::t::file::a.py", "repo::t::module::b") in got


def test_batches_see_each_other_and_late_ones_change_nothing(spark, tmp_path):
    s = GraphStore(spark, str(tmp_path / "g"))
    mf.ingest_batch(s, _manifest(spark, [("repo::t", "lib.py", "def h(): pass\ndef old(): pass\n", 5), ("repo::u", "x.py", "def only(): pass\n", 5)]))
    mf.ingest_batch(s, _manifest(spark, [("repo::t", "a.py", "from lib import h\ndef f():\n    h()\n", 6)]))
    call = ("CALLS", "repo::t::function::a.f", "repo::t::function::lib.h")
    assert call in rows(s.read("edges", "repo::t"), "rel_type", "source_id", "target_id")
    mf.ingest_batch(s, _manifest(spark, [("repo::t", "lib.py", "def wrong(): pass\n", 4)]))  # late
    assert ("repo::t::function::lib.old",) in rows(s.read("nodes"), "id") and ("repo::t::function::lib.wrong",) not in rows(s.read("nodes"), "id")
    mf.ingest_batch(s, _manifest(spark, [("repo::t", "lib.py", "def h(): pass\n", 7)]))
    assert ("repo::t::function::lib.old",) not in rows(s.read("nodes"), "id") and call in rows(s.read("edges"), "rel_type", "source_id", "target_id")
    mf.ingest_batch(s, _manifest(spark, [("repo::t", "lib.py", None, 8), ("repo::t", "a.py", None, 8)]))
    assert s.read("nodes", "repo::t").count() == s.read("edges", "repo::t").count() == 0 and ("repo::u::function::x.only",) in rows(s.read("nodes"), "id")


def test_arguments(tmp_path):
    assert v.repository_path(str(tmp_path)) == tmp_path.resolve()
    for bad in (None, "", " ", "/", "/etc", "/bin", "/usr/../etc", "/lib", str(tmp_path / "none")):
        with pytest.raises(ValueError):
            v.repository_path(bad)
    for bad in (None, " ", "a\0b", "a/../b", "x" * 1001):
        with pytest.raises(ValueError):
            v.identifier(bad)
    assert v.identifier(" a::b ") == "a::b"
    assert v.repository_identity(" repo::x ") == ("repo::x", "x") and v.repository_identity("x") == ("repo::x", "x") and v.repository_identity(None) == ("repo::default", "default")
    assert v.type_list(" calls,CALLS, imports ") == ["CALLS", "IMPORTS"] and v.type_list(" ,") == list(v.RELATIONSHIP_TYPES)
    assert v.direction(" Incoming ") == "incoming" and v.direction(None) == "both"
    with pytest.raises(ValueError):
        v.direction("sideways")
    assert v.label("fUNCTION") == "Function" and v.label(None) is None
    for f, bad in ((v.type_list, "likes"), (v.label, "thing")):
        with pytest.raises(ValueError):
            f(bad)
