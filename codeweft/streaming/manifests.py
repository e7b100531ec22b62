"""Continuous ingest: a stream of manifests (changed files with their content) into the graph store. An extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from codeweft.operators.analysis import graph_of
from codeweft.operators.facts import extract_facts
from codeweft.sources.store import GraphStore
from codeweft.sources.tables import cut_lineage

MANIFEST = "repo_id string, file_path string, content string, observed_at timestamp"


def ingest_batch(store: GraphStore, manifests: DataFrame) -> None:
    """Takes a batch of manifests into the store.

    The facts of a file are those of its newest manifest, in this batch or before;
    one that comes late changes nothing.  The graph of every repository in the
    batch is resolved anew from all its stored facts, so names in files that did
    not change are found, and definitions that are gone leave the graph.  A null
    content is a file that was deleted.  A batch that runs again changes nothing.
    """
    newest = (
        manifests.where("repo_id IS NOT NULL AND file_path IS NOT NULL").groupBy("repo_id", "file_path")
        .agg(F.max(F.struct("observed_at", "content")).alias("m")).select("repo_id", "file_path", "m.observed_at", F.col("m.content").alias("content"))
    )
    newest = cut_lineage(newest)
    if not newest.limit(1).count():
        return
    repos = cut_lineage(newest.select("repo_id").distinct())
    facts = extract_facts(newest).join(newest.select("repo_id", "file_path", "observed_at", F.col("content").isNull().alias("deleted")), ["repo_id", "file_path"])
    old = store.read("facts", repos=repos)
    if old is not None:
        facts = facts.unionByName(old.select(facts.columns))
    rest = [c for c in facts.columns if c not in ("repo_id", "file_path")]
    # of equal times the one that is stored already or comes again: they are the same row, or the greater content
    last = facts.groupBy("repo_id", "file_path").agg(F.max_by(F.struct(*rest), F.struct("observed_at", F.to_json(F.struct("deleted", "end_byte", "defs")))).alias("r")).select("repo_id", "file_path", *[F.col(f"r.{c}").alias(c) for c in rest])
    last = cut_lineage(last)
    store.replace("facts", last, repos)
    nodes, edges = graph_of(last.where("NOT deleted").drop("deleted", "observed_at"))
    store.replace("nodes", nodes, repos)
    store.replace("edges", edges, repos)


def ingest(spark: SparkSession, manifests: str, store_root: str, checkpoint: str) -> StreamingQuery:
    """Reads manifest files as they arrive, and takes in what there is."""
    stream = spark.readStream.schema(MANIFEST).parquet(manifests)
    return stream.writeStream.foreachBatch(lambda df, _: ingest_batch(GraphStore(df.sparkSession, store_root), df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
