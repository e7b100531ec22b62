"""Reads of a code graph by repository and entity: what a service would answer, as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeweft.functions import validate
from codeweft.operators import explore as ex, traversal as tr
from codeweft.sources.store import GraphStore


@dataclass
class Answer:
    """exists: one row (repo_exists, entity_exists); the other parts are empty if what was asked for does not exist."""

    exists: DataFrame
    nodes: DataFrame
    edges: DataFrame
    meta: DataFrame


class CodeGraph:
    """nodes: id, repo_id, label and what else is known; edges: edge_id, rel_type, source_id, target_id, repo_id, location."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    @classmethod
    def of_tables(cls, spark: SparkSession, sf_dir: str) -> CodeGraph:
        from codeweft.plans import graph

        return cls(graph.nodes(spark, sf_dir), graph.graph_edges(spark, sf_dir))

    @classmethod
    def of_store(cls, store: GraphStore) -> CodeGraph:
        edges = store.read("edges")
        if "location" not in edges.columns:
            edges = edges.withColumn("location", F.lit(None).cast(f"struct<{','.join(f'{c}:bigint' for c in ex.PLACE)}>"))
        if "edge_id" not in edges.columns:
            edges = edges.withColumn("edge_id", F.xxhash64("rel_type", "source_id", "target_id"))
        return cls(store.read("nodes"), edges)

    # ---- lookups ----------------------------------------------------------------

    def repository(self, repo_id: str) -> DataFrame:
        return self.nodes.where((F.col("id") == validate.identifier(repo_id, 255)) & (F.col("label") == "Repository"))

    def entity(self, entity_id: str, repo_id: str | None = None) -> DataFrame:
        """The node with the id, of the repository if one is given; a repository is found whatever repository is given."""
        hit = self.nodes.where(F.col("id") == validate.identifier(entity_id))
        return hit if repo_id is None else hit.where((F.col("repo_id") == validate.identifier(repo_id, 255)) | (F.col("label") == "Repository"))

    def of_label(self, repo_id: str, label: str) -> DataFrame:
        return self.nodes.where((F.col("repo_id") == validate.identifier(repo_id, 255)) & (F.col("label") == validate.label(label)))

    def relationships(self, repo_id: str, rel_type: str | None = None, source_id: str | None = None, target_id: str | None = None) -> DataFrame:
        """Edges of a repository both ends of which are in it."""
        ids = self.nodes.where((F.col("repo_id") == validate.identifier(repo_id, 255)) | (F.col("id") == repo_id)).select("id")
        e = self.edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
        for column, value in (("rel_type", rel_type), ("source_id", source_id), ("target_id", target_id)):
            if value is not None:
                e = e.where(F.col(column) == value)
        return e

    def exists(self, repo_id: str, entity_id: str | None = None) -> DataFrame:
        """One row (repo_exists, entity_exists); the latter means in this repository, and null if no entity is asked for."""
        repo = F.count_if((F.col("id") == repo_id) & (F.col("label") == "Repository")) > 0
        entity = F.lit(None).cast("boolean") if entity_id is None else F.count_if((F.col("id") == entity_id) & ((F.col("repo_id") == repo_id) | (F.col("id") == repo_id))) > 0
        return self.nodes.agg(repo.alias("repo_exists"), entity.alias("entity_exists"))

    # ---- answers ----------------------------------------------------------------

    def graph(self, repo_id: str, limit: int | None = None) -> Answer:
        """The whole graph of a repository, or its first nodes with the edges between them."""
        nodes, edges = ex.full_graph(self.nodes, self.edges, validate.identifier(repo_id, 255), limit)
        return Answer(self.exists(repo_id), ex.node_models(nodes), edges, nodes.agg(F.count(F.lit(1)).alias("total")))

    def overview(self, repo_id: str, limit: int = ex.DEFAULT_PAGE, offset: int = 0) -> Answer:
        """A page of the files of a repository, by path; the repository itself does not count."""
        files = ex.children(self.edges, self.nodes.where("label = 'File'"), validate.identifier(repo_id, 255))
        page = ex.page(files, ["path", "id"], limit, offset)
        return Answer(self.exists(repo_id), ex.node_models(page), ex.contained_edges(self.edges, repo_id, page), ex.page_meta(files, limit, offset))

    def children(self, repo_id: str, parent_id: str, limit: int = ex.DEFAULT_PAGE, offset: int = 0) -> Answer:
        """A page of what an entity contains directly, by line."""
        kids = ex.children(self.edges, self.nodes.where(F.col("repo_id") == validate.identifier(repo_id, 255)), validate.identifier(parent_id))
        page = ex.page(kids, [F.coalesce("start_line", F.lit(0)), "id"], limit, offset)
        return Answer(self.exists(repo_id, parent_id), ex.node_models(page), ex.contained_edges(self.edges, parent_id, page), ex.page_meta(kids, limit, offset))

    def neighbors(self, repo_id: str, center_id: str, direction: str | None = "both", types: str | None = None, limit: int = ex.DEFAULT_PAGE, offset: int = 0) -> Answer:
        """A page of the edges at an entity, and the nodes at their other ends."""
        mine = self.relationships(repo_id)
        way, kinds = validate.direction(direction), validate.type_list(types)
        page = ex.neighbor_page(mine, validate.identifier(center_id), way, kinds, limit, offset)
        counts = ex.neighbor_counts(mine.where(F.col("rel_type").isin(kinds)), center_id, way)
        return Answer(self.exists(repo_id, center_id), ex.node_models(ex.page_neighbors(page, self.nodes, center_id)), page, counts)

    def search(self, repo_id: str, q: str, label: str | None = None, limit: int = ex.DEFAULT_PAGE, offset: int = 0) -> Answer:
        """A page of the nodes of a repository that hold a text, the best first."""
        hits = ex.search(self.nodes, ex.check_query(q), validate.identifier(repo_id, 255), validate.label(label))
        return Answer(self.exists(repo_id), ex.page(hits, ex.search_order(self.nodes), limit, offset), self.edges.limit(0), ex.page_meta(hits, limit, offset))

    def impact(self, repo_id: str, entity_id: str, max_depth: int = tr.DEFAULT_DEPTH, types: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(envelope, impacted entities by depth and id, affected files by path): see ``traversal.impact``."""
        asked = self.nodes.sparkSession.createDataFrame([(validate.identifier(repo_id, 255), validate.identifier(entity_id))], "repository_id string, entity_id string")
        envelope, impacted, files = tr.impact(self.nodes, self.edges, asked, max_depth, types)
        return envelope, impacted.orderBy("depth", "id"), files.orderBy("path")
