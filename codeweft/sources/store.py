"""Graph tables on disk: Parquet by repository, written with Spark's dynamic partition overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeweft.operators.explore import upsert
from codeweft.sources.tables import cut_lineage

KEYS = {"nodes": ("id",), "edges": ("rel_type", "source_id", "target_id"), "facts": ("file_path",)}


class GraphStore:
    """Tables under ``root``, a partition for each repository; a write replaces the partitions of the repositories it touches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def read(self, table: str, repo_id: str | None = None, repos: DataFrame | None = None) -> DataFrame | None:
        """The rows of a table, of one repository, or of those of ``repos`` (repo_id); None if it was never written."""
        if not self._fs.globStatus(self._path(f"{self.root}/{table}/repo_id=*")):
            return None
        rows = self.spark.read.parquet(f"{self.root}/{table}").withColumn("repo_id", F.col("repo_id").cast("string"))
        if repo_id is not None:
            rows = rows.where(F.col("repo_id") == repo_id)
        return rows if repos is None else rows.join(repos.select("repo_id").distinct(), "repo_id", "left_semi")

    def replace(self, table: str, rows: DataFrame, repos: DataFrame) -> None:
        """The rows become all that the table has of the given repositories (repo_id)."""
        rows = cut_lineage(rows)  # it may have been read from what is overwritten
        gone = repos.select("repo_id").distinct().join(rows.select("repo_id").distinct(), "repo_id", "left_anti")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(f"{self.root}/{table}")
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for r in gone.toLocalIterator():  # repositories without any row left
            self._fs.delete(self._path(f"{self.root}/{table}/repo_id={escape(r[0])}"), True)

    def write(self, table: str, new: DataFrame) -> int:
        """Upserts rows (unique by key, with repo_id); nulls replace nothing; returns how many came in."""
        count = new.count()
        if not count:
            return 0
        repos = new.select("repo_id").distinct()
        k = F.concat_ws("\x01", *KEYS[table])
        rows, old = new.withColumn("_k", k), self.read(table, repos=repos)
        if old is not None:
            mine = old.withColumn("_k", k)
            for c in new.columns:
                if c not in mine.columns:
                    mine = mine.withColumn(c, F.lit(None).cast(new.schema[c].dataType))
            rows = upsert(mine, rows, "_k")
        self.replace(table, rows.drop("_k"), repos)
        return count


def write_graph(store: GraphStore, nodes: DataFrame, edges: DataFrame) -> dict[str, int]:
    """Nodes first, then the edges whose two ends are stored; counts of what came in, was kept and left out."""
    n = store.write("nodes", nodes)
    ids = store.read("nodes").select("id")
    kept = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    total, k = edges.count(), store.write("edges", kept.dropDuplicates(list(KEYS["edges"])))
    return {"nodes": n, "edges": k, "skipped": total - k}
