import importlib
import subprocess
import sys

import __spark_entry__ as entry


def test_names_and_sql_fit():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and {f"p{n}_found" for n in (2, 3, 4)} <= set(q)


def test_the_rest_works_without_the_text_operators():
    code = "import sys; sys.modules['codeweft.llm'] = None; import __spark_entry__ as e; assert 'p2_found' in e.queries() and 'p1_found' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=entry.__file__.rpartition("/")[0], capture_output=True).returncode == 0
    importlib.reload(entry)


def test_tasks_find_the_package_from_any_folder(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {entry.__file__.rpartition('/')[0]!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()
from codeweft.sources.ship import ship
from codeweft.operators.dense_groups import dense_group_stats
ship(s)
print('rows', dense_group_stats(s.createDataFrame([('a',), ('a',)], 'k string'), 'k', {{'n': None}}).collect())
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert "Row(k='a', n=2)" in out.stdout, out.stderr[-500:]
