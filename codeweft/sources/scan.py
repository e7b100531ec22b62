"""Reading a repository's Python files.

Spark's file sources leave out names that begin with _ or ., so ``__init__.py``
would be lost; folders are walked and files read inside tasks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

# Folders whose files are no source of the repository.
IGNORED = {".git", ".venv", "venv", "__pycache__", "node_modules", ".pytest_cache", ".ruff_cache"}


def _walk(root: str, start: str) -> Iterator[str]:
    """Paths of the .py files below root/start, relative to root, ignored folders left out."""
    for folder, dirs, names in os.walk(os.path.join(root, start)):
        dirs[:] = sorted(d for d in dirs if d not in IGNORED)
        for n in sorted(names):
            if n.endswith(".py"):
                yield os.path.relpath(os.path.join(folder, n), root).replace(os.sep, "/")


def list_python_files(spark: SparkSession, root: str) -> DataFrame:
    """(file_path) of the .py files below root, relative to it: the driver lists the topmost folder, tasks walk those below it."""
    top = [(e.name, e.is_dir()) for e in os.scandir(root) if e.name not in IGNORED]
    if not top:
        return spark.createDataFrame([], "file_path string")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, folder in zip(b["name"], b["folder"]):
                paths = list(_walk(root, name)) if folder else [name] if name.endswith(".py") else []
                yield pd.DataFrame({"file_path": paths}, dtype="str")

    return spark.createDataFrame(top, "name string, folder boolean").repartition(min(len(top), 200)).mapInPandas(walk, "file_path string")


def read_files(spark: SparkSession, root: str, repo_id: str, paths: list[str] | None = None) -> DataFrame:
    """(repo_id, file_path, content, error): one row a file; paths may be absolute or relative to root.

    A file that cannot be read has an error and no content; bytes that are no
    UTF-8 are replaced.  The folder must be visible to all executors.
    """
    if paths is None:
        listed = list_python_files(spark, root)
    else:
        chosen = dict.fromkeys(os.path.relpath(p, root).replace(os.sep, "/") if os.path.isabs(p) else p for p in paths)
        listed = spark.createDataFrame([(p,) for p in chosen], "file_path string")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p in b["file_path"]:
                try:
                    with open(os.path.join(root, p), "rb") as f:
                        rows.append((repo_id, p, f.read().decode("utf-8", "replace"), None))
                except OSError as e:
                    rows.append((repo_id, p, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["repo_id", "file_path", "content", "error"])

    # spread over tasks whatever folder they are in
    return listed.repartition(F.col("file_path")).mapInPandas(read, "repo_id string, file_path string, content string, error string")


def usable(files: DataFrame) -> DataFrame:
    return files.where(F.col("error").isNull()).drop("error")
