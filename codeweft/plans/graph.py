"""The property graph of a data directory: one wide node table and one edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeweft.functions.ids import label_of, repo_of
from codeweft.sources.tables import NODE_TABLES, table

NODE_COLUMNS = ("name", "qualified_name", "path", "file_path", "language", "source", "created_at", "docstring", "start_line", "end_line", "start_byte", "end_byte")
_LONGS = {"start_line", "end_line", "start_byte", "end_byte"}
# The legal (edge type, source label, target label) triples.
LEGAL_TRIPLES = (
    ("CONTAINS", "Repository", "File"), ("CONTAINS", "File", "Class"), ("CONTAINS", "File", "Function"), ("CONTAINS", "Class", "Method"),
    ("CONTAINS", "Class", "Class"), ("CONTAINS", "Function", "Function"), ("IMPORTS", "File", "Module"), ("CALLS", "Function", "Function"),
    ("CALLS", "Function", "Method"), ("CALLS", "Method", "Function"), ("CALLS", "Method", "Method"), ("INHERITS", "Class", "Class"),
)


def node_rows(spark: SparkSession, d: str) -> DataFrame:
    """All rows of the six node tables in one shape; File rows carry path, the others file_path; a repository is its own repo_id."""
    out = None
    for t in NODE_TABLES:
        df = table(spark, d, f"{t}_node")
        have = set(df.columns)
        cols = []
        for c in NODE_COLUMNS:
            src = "file_path" if t == "file" and c == "path" else c
            known = src in have and not (t == "file" and c == "file_path")
            cols.append((F.col(src) if known else F.lit(None)).cast("bigint" if c in _LONGS else "string").alias(c))
        repo = F.col("id") if t == "repository" else F.col("repo_id")
        part = df.select("id", repo.alias("repo_id"), F.lit(t.capitalize()).alias("label"), *cols, "observed_at", "deleted_at")
        out = part if out is None else out.unionByName(part)
    return out


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the one with the greatest order value; ties: the greatest row, nulls least, so a rerun agrees."""
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return last_wins(node_rows(spark, d).where(F.col("id").isNotNull()), "id", "observed_at").drop("deleted_at")


def edge_rows(spark: SparkSession, d: str) -> DataFrame:
    """Edges with both endpoints; the type in upper case, the repository by the source's id."""
    e = table(spark, d, "relationship_edge").where(F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
    return e.select("edge_id", F.upper("rel_type").alias("rel_type"), "source_id", "target_id", "location", "metadata", "observed_at", repo_of(F.col("source_id")).alias("repo_id"))


def first_wins(edges: DataFrame) -> DataFrame:
    """One row per (type, source, target): the earliest, equal times by edge_id, with its place and metadata."""
    return (
        edges.groupBy("rel_type", "source_id", "target_id", "repo_id")
        .agg(F.min_by(F.struct("edge_id", "location", F.map_entries("metadata").alias("metadata")), F.struct("observed_at", "edge_id")).alias("_r"))
        .select("rel_type", "source_id", "target_id", "repo_id", "_r.edge_id", "_r.location", F.map_from_entries("_r.metadata").alias("metadata"))
    )


def with_endpoints(edges: DataFrame, ns: DataFrame) -> DataFrame:
    """Edges whose two ends are both among the nodes, in the edge's repository."""
    s = ns.select(F.col("id").alias("source_id"), F.col("repo_id"))
    t = ns.select(F.col("id").alias("target_id"), F.col("repo_id"))
    return edges.join(s, ["source_id", "repo_id"], "left_semi").join(t, ["target_id", "repo_id"], "left_semi")


def labelled(edges: DataFrame) -> DataFrame:
    """Edges with the labels their ids show and whether the triple is legal within one repository."""
    e = edges.withColumns({"source_label": label_of(F.col("source_id")), "target_label": label_of(F.col("target_id")), "target_repo": repo_of(F.col("target_id"))})
    triple = F.concat_ws("|", "rel_type", "source_label", "target_label")
    return e.withColumn("legal", triple.isin(["|".join(x) for x in LEGAL_TRIPLES]) & (F.col("repo_id") == F.col("target_repo")))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """The stored edges: first of each key, legal, both ends stored."""
    keep = labelled(first_wins(edge_rows(spark, d))).where("legal").drop("source_label", "target_label", "target_repo", "legal")
    return with_endpoints(keep, nodes(spark, d).select("id", "repo_id"))
