"""Reads of the graph: pages, children, neighbours, search, serialised documents, merging and layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeweft.functions.ids import STROKES, blank_to_null, match_score, scalar_metadata, style
from codeweft.sources.tables import cut_lineage

MAX_PAGE, DEFAULT_PAGE, MAX_QUERY = 200, 50, 100


def check_page(limit: int, offset: int) -> None:
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must lie between 1 and {MAX_PAGE}")
    if offset < 0:
        raise ValueError("offset must not be negative")


def check_query(q: str) -> str:
    if not q or not q.strip() or len(q) > MAX_QUERY:
        raise ValueError(f"a query has 1 to {MAX_QUERY} characters")
    return q.strip()


def page(df: DataFrame, order: list, limit: int = DEFAULT_PAGE, offset: int = 0) -> DataFrame:
    check_page(limit, offset)
    return df.orderBy(*order).offset(offset).limit(limit)


def page_meta(df: DataFrame, limit: int = DEFAULT_PAGE, offset: int = 0) -> DataFrame:
    """One row: total, returned, has_more, truncated."""
    check_page(limit, offset)
    n = F.count(F.lit(1))
    returned = F.least(F.lit(limit).cast("long"), F.greatest(n - offset, F.lit(0).cast("long")))
    return df.agg(n.alias("total"), returned.alias("returned"), (F.lit(offset) + returned < n).alias("has_more"), (n > returned).alias("truncated"))


def children(edges: DataFrame, nodes: DataFrame, parent: str) -> DataFrame:
    """Nodes directly contained in ``parent``, repositories excepted."""
    kids = edges.where((F.col("rel_type") == "CONTAINS") & (F.col("source_id") == parent)).select(F.col("target_id").alias("id")).distinct()
    return nodes.where("label <> 'Repository'").join(kids, "id", "left_semi")




def incident(edges: DataFrame, center: str, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """Edges at ``center`` with their other end; a self-loop counts once, parallel edges each."""
    if direction not in ("incoming", "outgoing", "both"):
        raise ValueError("direction is incoming, outgoing or both")
    out, inc = F.col("source_id") == center, F.col("target_id") == center
    e = edges.where({"outgoing": out, "incoming": inc, "both": out | inc}[direction])
    if types:
        e = e.where(F.col("rel_type").isin(types))
    return e.withColumn("neighbor", F.when(out, F.col("target_id")).otherwise(F.col("source_id")))


def neighbor_counts(edges: DataFrame, center: str, direction: str = "both") -> DataFrame:
    return incident(edges, center, direction).agg(
        F.count(F.lit(1)).alias("total_relationships"), F.count_distinct(F.when(F.col("neighbor") != center, F.col("neighbor"))).alias("total_neighbors"))


def edge_base_id() -> Column:
    line = F.col("location.start_line")
    return F.concat("source_id", F.lit("->"), "rel_type", F.lit("->"), "target_id", F.when(line.isNotNull(), F.concat(F.lit(":L"), line.cast("string"))).otherwise(F.lit("")))


def edge_ids(edges: DataFrame) -> DataFrame:
    """Edges with an id of their own: repeats of a base id get #1, #2 … in order of line, column, edge_id."""
    w = Window.partitionBy("base_id").orderBy(F.coalesce("location.start_line", F.lit(-1)), F.coalesce("location.start_column", F.lit(-1)), "edge_id")
    n = F.row_number().over(w) - 1
    return edges.withColumn("base_id", edge_base_id()).withColumn("graph_edge_id", F.when(n == 0, F.col("base_id")).otherwise(F.concat("base_id", F.lit("#"), n.cast("string")))).drop("base_id")


def _column(nodes: DataFrame, name: str) -> Column:
    return F.col(name) if name in nodes.columns else F.lit(None).cast("string")


def search(nodes: DataFrame, q: str, repo_id: str | None = None, label: str | None = None) -> DataFrame:
    """Nodes (of one repository) that hold ``q`` literally in a name, path or id, letter case aside, with their rank (1 equal, 2 prefix, 3 anywhere)."""
    q = check_query(q).lower()
    hit = F.lit(False)
    for c in ("name", "qualified_name", "path", "file_path", "imported_name", "id", "display_name"):
        hit = hit | F.coalesce(F.lower(_column(nodes, c)).contains(q), F.lit(False))
    name, path, imported = _column(nodes, "name"), _column(nodes, "path"), _column(nodes, "imported_name")
    exact = F.lower(F.coalesce(name, path, imported, F.lit(""))) == q
    prefix = F.lower(F.coalesce(name, _column(nodes, "qualified_name"), path, imported, F.lit(""))).startswith(q)
    out = nodes.where(hit)
    if repo_id is not None:
        out = out.where((F.col("repo_id") == repo_id) | (F.col("id") == repo_id))
    if label:
        out = out.where(F.lower("label") == label.lower())
    return out.withColumn("rank", F.when(exact, 1).when(prefix, 2).otherwise(3))


def search_order(nodes: DataFrame | None = None) -> list[Column]:
    imported = F.lit("") if nodes is None else F.coalesce(_column(nodes, "imported_name"), F.lit(""))
    return [F.col("rank"), F.coalesce("path", "file_path", F.lit("")), F.coalesce(F.col("name"), imported), F.col("id")]


def model_name(nodes: DataFrame) -> Column:
    """The name a node goes by: a file's is its path, an import's what it imports; without one it is the id."""
    name = F.when(F.col("label") == "File", _column(nodes, "path")).when(F.col("label") == "Import", _column(nodes, "imported_name")).otherwise(_column(nodes, "name"))
    clean = F.trim(name)
    return F.coalesce(F.when(clean != "", clean), F.col("id"))


def node_models(nodes: DataFrame) -> DataFrame:
    """(id, label, name, type, display_name, properties MAP): what is told of a node; properties are its other columns that have a value."""
    props = [c for c in nodes.columns if c not in ("id", "label", "rank")]
    pairs = [x for c in props for x in (F.lit(c), F.col(c).cast("string"))]
    name = model_name(nodes)
    return nodes.select("id", "label", name.alias("name"), F.col("label").alias("type"), name.alias("display_name"), F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("properties"))


def scored_search(nodes: DataFrame, q: str, k: int = 20) -> DataFrame:
    """The k best by the first field that matches (display name +10, name +5, id 0, path -5); ties by length, then text. A blank query finds nothing."""
    if not q or not q.strip():
        return nodes.select("id", "label", F.lit("").alias("display"), F.lit(0).cast("long").alias("score")).limit(0)
    q = q.strip()
    name = model_name(nodes)
    shown = F.trim(_column(nodes, "display_name"))
    display = F.coalesce(F.when(shown != "", shown), name)
    path = F.trim(F.coalesce(_column(nodes, "file_path"), _column(nodes, "path")))
    score = None
    for c, bias in ((display, 10), (name, 5), (F.col("id"), 0), (path, -5)):
        s = match_score(c, q)
        part = F.when(s > 0, s + bias)
        score = part if score is None else F.coalesce(score, part)
    out = nodes.select("id", "label", display.alias("display"), score.cast("long").alias("score")).where("score IS NOT NULL")
    return out.orderBy(F.desc("score"), F.length("display"), "display", "id").limit(k)


def full_graph(nodes: DataFrame, edges: DataFrame, repo_id: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a repository: the repository first, then by id, the first ``limit`` of them; edges between them with ids of their own.

    Edges are ordered by source, type, target and id.  An unknown repository has neither.
    """
    mine = nodes.where((F.col("repo_id") == repo_id) | (F.col("id") == repo_id))
    order = [F.col("label") != "Repository", F.col("id")]
    mine = mine.orderBy(*order).limit(limit) if limit is not None and limit > 0 else mine.orderBy(*order)
    ids = mine.select("id")
    inner = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return mine, edge_ids(inner).orderBy("source_id", "rel_type", "target_id", "graph_edge_id")


def contained_edges(edges: DataFrame, parent: str, page_nodes: DataFrame) -> DataFrame:
    """(graph_edge_id, source_id, rel_type, target_id) of the CONTAINS edges from ``parent`` to the nodes of a page; repeated edges are one, lines are no part of the id."""
    e = edges.where((F.col("rel_type") == "CONTAINS") & (F.col("source_id") == parent)).join(page_nodes.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return e.select(F.concat("source_id", F.lit("->"), "rel_type", F.lit("->"), "target_id").alias("graph_edge_id"), "source_id", "rel_type", "target_id").distinct().orderBy("source_id", "rel_type", "target_id", "graph_edge_id")


NEIGHBOR_ORDER = ("source_id", "rel_type", "target_id", "start_line", "start_byte", "edge_id")


def neighbor_page(edges: DataFrame, center: str, direction: str = "both", types: list[str] | None = None, limit: int = DEFAULT_PAGE, offset: int = 0) -> DataFrame:
    """A page of the edges at ``center`` with the other end of each, in the order of NEIGHBOR_ORDER, and graph_edge_id: repeats on the page get #1, #2 ... as they come."""
    e = incident(edges, center, direction, types)
    e = e.withColumns({"start_line": F.coalesce("location.start_line", F.lit(0)), "start_byte": F.coalesce("location.start_byte", F.lit(0))})
    p = page(e, list(NEIGHBOR_ORDER), limit, offset).withColumn("base_id", edge_base_id())
    n = F.row_number().over(Window.partitionBy("base_id").orderBy(*NEIGHBOR_ORDER)) - 1
    return p.withColumn("graph_edge_id", F.when(n == 0, F.col("base_id")).otherwise(F.concat("base_id", F.lit("#"), n.cast("string")))).drop("base_id")


def page_neighbors(page_edges: DataFrame, nodes: DataFrame, center: str) -> DataFrame:
    """The nodes at the other ends of a page of edges, without the center, by id."""
    ids = page_edges.where(F.col("neighbor") != center).select(F.col("neighbor").alias("id")).distinct()
    return nodes.join(ids, "id", "left_semi").orderBy("id")


def flat_edges(edges: DataFrame) -> DataFrame:
    """Edges as they are stored: the place in six columns, metadata without nulls."""
    place = [F.col(f"location.{c}").alias(c) for c in PLACE]
    return edges.select("edge_id", "rel_type", "source_id", "target_id", *place, scalar_metadata(F.col("metadata")).alias("metadata"))


# The parts of a place.
PLACE = ("start_line", "start_column", "end_line", "end_column", "start_byte", "end_byte")


def placed_edges(flat: DataFrame) -> DataFrame:
    """The converse of ``flat_edges``: a place if both lines are known, absent columns and bytes 0; no place otherwise."""
    parts = [F.col(c) if c.endswith("line") else F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in PLACE]
    known = F.col("start_line").isNotNull() & F.col("end_line").isNotNull()
    return flat.select("edge_id", "rel_type", "source_id", "target_id", F.when(known, F.struct(*parts)).alias("location"), "metadata")


def entities(rows: DataFrame) -> DataFrame:
    """Stored node rows as entities: bytes are 0 where they are unknown and the label has a span; an unknown label is an error."""
    spanned = F.col("label").isin("File", "Import", "Class", "Function", "Method")
    known = F.col("label").isin("Repository", "File", "Module", "Class", "Function", "Method", "Import")
    label = F.when(known, F.col("label")).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce("label", F.lit("null")))).cast("string"))
    return rows.withColumns({"label": label, **{c: F.when(spanned, F.coalesce(c, F.lit(0).cast("bigint"))).otherwise(F.col(c)) for c in ("start_byte", "end_byte")}})


def target_entity(nodes: DataFrame) -> DataFrame:
    """(id, label, name, file_path): the first that is not blank of name, path, imported name and id; file path or path."""
    name = F.coalesce(*[blank_to_null(_column(nodes, c)) for c in ("name", "path", "imported_name")], F.col("id"))
    return nodes.select("id", "label", name.alias("name"), F.coalesce(blank_to_null(_column(nodes, "file_path")), blank_to_null(_column(nodes, "path"))).alias("file_path"))


def edge_documents(edges: DataFrame) -> DataFrame:
    """(edge_id, doc): every edge as a JSON object with its keys in alphabetical order; absent places are null, absent metadata is empty."""
    place = F.when(F.col("location").isNotNull(), F.struct(*[F.col(f"location.{c}").alias(c) for c in sorted(PLACE)]))
    meta = F.coalesce(F.map_from_entries(F.array_sort(F.map_entries("metadata"))), F.create_map().cast("map<string,string>"))
    return edges.select("edge_id", F.to_json(F.struct(place.alias("location"), meta.alias("metadata"), "rel_type", "source_id", "target_id"), {"ignoreNullFields": "false"}).alias("doc"))


def edges_of_documents(docs: DataFrame) -> DataFrame:
    """The converse of ``edge_documents``."""
    shape = f"location struct<{','.join(f'{c}:bigint' for c in PLACE)}>, metadata map<string,string>, rel_type string, source_id string, target_id string"
    return docs.select("edge_id", F.from_json("doc", shape).alias("x")).select("edge_id", "x.*")


def document_json(nodes: DataFrame, nulls: bool = False) -> DataFrame:
    """(id, doc): each node as a JSON object of its columns in alphabetical order; absent values are left out, or null."""
    cols = sorted(c for c in nodes.columns)
    return nodes.select("id", F.to_json(F.struct(*cols), {"ignoreNullFields": str(not nulls).lower()}).alias("doc"))


def nodes_of_documents(docs: DataFrame, schema: str) -> DataFrame:
    """The converse of ``document_json``; keys a document does not have are null."""
    return docs.select(F.from_json("doc", schema).alias("x")).select("x.*")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keyed upsert: new values replace old ones, nulls replace nothing, nothing is removed. Keys are unique on each side."""
    n = new.select([F.col(c).alias(f"_n_{c}") for c in new.columns])
    j = old.join(n, old[key] == n[f"_n_{key}"], "full_outer")
    return j.select([F.coalesce(f"_n_{c}", c).alias(c) if c in new.columns else F.col(c) for c in old.columns])


def merge_graphs(nodes: DataFrame, more: DataFrame, edges: DataFrame, more_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Known graph and news in one: known ids and edge keys stay, dangling edges go."""
    ns = nodes.unionByName(more.join(nodes.select("id"), "id", "left_anti"))
    key = ["source_id", "target_id", "rel_type"]
    es = edges.unionByName(more_edges.join(edges.select(*key), key, "left_anti").dropDuplicates(key))
    ids = ns.select("id")
    es = es.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return ns, es


# Tiers of the layout, rows of a column, width, row height, gap and margin.
TIERS = {"Repository": 0, "File": 1, "Module": 1, "Class": 2, "Function": 3, "Method": 3, "Import": 4}
ROWS, WIDTH, HEIGHT, GAP, MARGIN = 12, 280, 85, 80, 60


def layout(nodes: DataFrame) -> DataFrame:
    """(id, tier, x, y): columns of twelve within tiers, the tiers side by side, in each by label, name and id.

    The place of a node in its tier is counted in blocks of that order, so no tier
    is sorted by one task.
    """
    tier = None
    for label, t in TIERS.items():
        tier = F.when(F.col("label") == label, t) if tier is None else tier.when(F.col("label") == label, t)
    order = ["label", "name", "id"]
    n = nodes.select("id", F.coalesce("label", F.lit("")).alias("label"), model_name(nodes).alias("name"), tier.otherwise(5).cast("long").alias("tier"))
    blocks = cut_lineage(n.repartitionByRange("tier", *order).withColumn("_p", F.spark_partition_id()))
    size = blocks.groupBy("tier", "_p").agg(F.count(F.lit(1)).alias("_n"))
    # a row per tier and partition: small
    start = size.withColumn("_s", F.coalesce(F.sum("_n").over(Window.partitionBy("tier").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = size.groupBy("tier").agg(F.sum("_n").alias("_t"))
    left = total.select("tier", F.coalesce(F.sum(F.ceil(F.col("_t") / ROWS) * WIDTH + GAP).over(Window.orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_x"))
    r = blocks.withColumn("_r", F.row_number().over(Window.partitionBy("tier", "_p").orderBy(*order)) - 1)
    idx = F.col("_s") + F.col("_r")
    return (
        r.join(start.select("tier", "_p", "_s"), ["tier", "_p"]).join(left, "tier")
        .select("id", "tier", (F.col("_x") + MARGIN + F.floor(idx / ROWS) * WIDTH).cast("long").alias("x"), (idx % ROWS * HEIGHT + MARGIN).cast("long").alias("y"))
    )


def drawn_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of a drawing with the colour of their line: dangling ones go, parallel ones stay."""
    ids = nodes.select("id")
    e = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return e.withColumn("stroke", style(F.upper("rel_type"), STROKES))
