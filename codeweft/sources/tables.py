"""Parquet tables of a data directory, and the places where intermediate tables go."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

NODE_TABLES = ("repository", "file", "module", "class", "function", "method")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def all_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_table, id, observed_at, deleted_at) of all six node tables."""
    parts = [
        table(spark, sf_dir, f"{t}_node").select(F.lit(t).alias("node_table"), "id", "observed_at", "deleted_at")
        for t in NODE_TABLES
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cut_lineage(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint in the shared folder named by ``spark.checkpoint.dir``.

    Only where that setting is absent on one machine (tests) a folder of our own is
    set; on a cluster that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)
