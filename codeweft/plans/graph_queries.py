"""Registered queries of the graph operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeweft.functions import ids
from codeweft.operators import explore as ex, traversal as tr
from codeweft.plans import graph as g
from codeweft.sources.tables import NODE_TABLES, cut_lineage, table

# ---- the places the queries look at, by rule --------------------------------------


def _first(df: DataFrame, *order) -> str | None:
    """The first value, or null, which equals no id, if there is none."""
    top = df.orderBy(*order).limit(1).collect()
    return top[0][0] if top else None


def busiest_repository(spark: SparkSession, d: str) -> str | None:
    """The repository with the most files, the least id of several; the file rows alone tell it."""
    rows = table(spark, d, "file_node").where("id IS NOT NULL").select("id", "repo_id", "observed_at")
    return _first(g.last_wins(rows, "id", "observed_at").groupBy("repo_id").count(), F.desc("count"), "repo_id")


def most_called(es: DataFrame) -> str | None:
    """The entity most edges (self-loops aside) call, the least id of several."""
    return _first(es.where("rel_type = 'CALLS' AND source_id <> target_id").groupBy("target_id").count(), F.desc("count"), "target_id")


def top_caller(es: DataFrame) -> str | None:
    return _first(es.where("rel_type = 'CALLS' AND source_id <> target_id").groupBy("source_id").count(), F.desc("count"), "source_id")


def fullest_parent(es: DataFrame) -> str | None:
    return _first(es.where("rel_type = 'CONTAINS' AND source_id LIKE '%::file::%'").groupBy("source_id").count(), F.desc("count"), "source_id")


def _kept_edges(spark: SparkSession, d: str) -> DataFrame:
    """The stored edges, kept: the place a query looks at and its rows come from one reading."""
    return cut_lineage(g.graph_edges(spark, d).select("edge_id", "rel_type", "source_id", "target_id", "repo_id", "location"))


# ---- SQL of the same places -------------------------------------------------------


def _sql_nodes() -> str:
    parts = []
    for t in NODE_TABLES:
        if t == "repository":
            cols = {"name": "name", "source": "source", "created_at": "created_at"}
        elif t == "file":
            cols = {c: c for c in ("language", "start_line", "end_line", "start_byte", "end_byte")} | {"path": "file_path"}
        elif t == "module":
            cols = {c: c for c in ("name", "qualified_name", "file_path")}
        else:
            cols = {c: c for c in ("name", "qualified_name", "file_path", "language", "docstring", "start_line", "end_line", "start_byte", "end_byte")}
        sel = ", ".join(f"{cols.get(c) or 'CAST(NULL AS ' + ('BIGINT' if c.endswith(('line', 'byte')) else 'VARCHAR') + ')'} AS {c}" for c in g.NODE_COLUMNS)
        parts.append(f"SELECT id, {'id' if t == 'repository' else 'repo_id'} AS repo_id, '{t.capitalize()}' AS label, {sel}, observed_at, deleted_at FROM {t}_node WHERE id IS NOT NULL")
    order = ", ".join(f"{c} DESC NULLS LAST" for c in ("observed_at", "repo_id", "label", *g.NODE_COLUMNS, "deleted_at"))
    return f"nr AS ({' UNION ALL '.join(parts)}), n AS (SELECT * FROM nr QUALIFY row_number() OVER (PARTITION BY id ORDER BY {order}) = 1)"


def _case(col: str, values: list[tuple[str, str]], rest: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({col}, '::{k}::') THEN {v}" for k, v in values) + f" WHEN starts_with({col}, 'repo::') THEN {rest} END"


def _label(col: str) -> str:
    return _case(col, [(k, f"'{v}'") for k, v in ids.KINDS], "'Repository'")


def _repo(col: str) -> str:
    return _case(col, [(k, f"split_part({col}, '::{k}::', 1)") for k, _ in ids.KINDS], col)


_LEGAL = "(" + " OR ".join(f"(rel_type = '{a}' AND sl = '{b}' AND tl = '{c}')" for a, b, c in g.LEGAL_TRIPLES) + ")"
_RAW = f"er AS (SELECT edge_id, upper(rel_type) AS rel_type, source_id, target_id, location, metadata, observed_at, {_repo('source_id')} AS repo_id FROM relationship_edge WHERE source_id IS NOT NULL AND target_id IS NOT NULL)"
_FIRST = "ef AS (SELECT * FROM er QUALIFY row_number() OVER (PARTITION BY rel_type, source_id, target_id ORDER BY observed_at, edge_id) = 1)"
_LABELLED = f"el AS (SELECT *, {_label('source_id')} AS sl, {_label('target_id')} AS tl, {_repo('target_id')} AS target_repo FROM ef)"
_STORED = f"e AS (SELECT * FROM el WHERE {_LEGAL} AND repo_id = target_repo AND EXISTS (SELECT 1 FROM n WHERE n.id = el.source_id AND n.repo_id = el.repo_id) AND EXISTS (SELECT 1 FROM n WHERE n.id = el.target_id AND n.repo_id = el.repo_id))"
_N = f"WITH RECURSIVE {_sql_nodes()}"
_G = f"{_N}, {_RAW}, {_FIRST}, {_LABELLED}, {_STORED}"
_BUSY = "(SELECT repo_id FROM n WHERE label = 'File' GROUP BY repo_id ORDER BY count(*) DESC, repo_id LIMIT 1)"
_CALLED = "(SELECT target_id FROM e WHERE rel_type = 'CALLS' AND source_id <> target_id GROUP BY target_id ORDER BY count(*) DESC, target_id LIMIT 1)"
_CALLER = "(SELECT source_id FROM e WHERE rel_type = 'CALLS' AND source_id <> target_id GROUP BY source_id ORDER BY count(*) DESC, source_id LIMIT 1)"
_PARENT = "(SELECT source_id FROM e WHERE rel_type = 'CONTAINS' AND source_id LIKE '%::file::%' GROUP BY source_id ORDER BY count(*) DESC, source_id LIMIT 1)"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ---- scans and lookups --------------------------------------------------------------


@query("g_nodes", f"{_N} SELECT id, repo_id, label, name, qualified_name, path, file_path, language, source, created_at, docstring, start_line, end_line, start_byte, end_byte FROM n")
def g_nodes(spark: SparkSession, d: str) -> DataFrame:
    return g.nodes(spark, d)


@query("g_repository_files", f"{_N} SELECT id, path, language, start_line, end_line FROM n WHERE label = 'File' AND repo_id = {_BUSY}")
def g_repository_files(spark: SparkSession, d: str) -> DataFrame:
    ns = g.nodes(spark, d)
    return ns.where((F.col("label") == "File") & (F.col("repo_id") == busiest_repository(spark, d))).select("id", "path", "language", "start_line", "end_line")


@query("g_entity", f"{_G} SELECT id, label, repo_id, coalesce(nullif(name, ''), nullif(path, ''), id) AS name, coalesce(nullif(file_path, ''), nullif(path, '')) AS file_path FROM n WHERE id = {_CALLED}")
def g_entity(spark: SparkSession, d: str) -> DataFrame:
    ns = g.nodes(spark, d)
    name = F.coalesce(ids.blank_to_null(F.col("name")), ids.blank_to_null(F.col("path")), F.col("id"))
    path = F.coalesce(ids.blank_to_null(F.col("file_path")), ids.blank_to_null(F.col("path")))
    return ns.where(F.col("id") == most_called(_kept_edges(spark, d))).select("id", "label", "repo_id", name.alias("name"), path.alias("file_path"))


@query("g_edges", f"{_G} SELECT edge_id, rel_type, source_id, target_id, repo_id FROM e")
def g_edges(spark: SparkSession, d: str) -> DataFrame:
    return g.graph_edges(spark, d).select("edge_id", "rel_type", "source_id", "target_id", "repo_id")


@query("g_duplicate_ids", "SELECT id, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT id FROM {t}_node" for t in NODE_TABLES) + ") WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1")
def g_duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    """The uniqueness check of the schema: ids delivered more than once."""
    return g.node_rows(spark, d).where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


# ---- counts -------------------------------------------------------------------------


@query("g_label_counts", f"{_N} SELECT repo_id, label, count(*) AS n FROM n GROUP BY ALL")
def g_label_counts(spark: SparkSession, d: str) -> DataFrame:
    return g.nodes(spark, d).groupBy("repo_id", "label").agg(F.count(F.lit(1)).alias("n"))


@query("g_skip_counts", f"{_G} SELECT el.rel_type, count(*) AS n, count(k.edge_id) AS n_kept, count(*) - count(k.edge_id) AS n_skipped FROM el LEFT JOIN e k ON k.edge_id = el.edge_id GROUP BY el.rel_type")
def g_skip_counts(spark: SparkSession, d: str) -> DataFrame:
    """Edges stored and left out per type: illegal triples, other repositories, missing ends."""
    all_, kept = g.first_wins(g.edge_rows(spark, d)), g.graph_edges(spark, d).select("edge_id", F.lit(1).alias("kept"))
    n = F.count(F.lit(1))
    return all_.join(kept, "edge_id", "left").groupBy("rel_type").agg(n.alias("n"), F.count("kept").alias("n_kept"), (n - F.count("kept")).alias("n_skipped"))


@query("g_triples", f"WITH {_RAW}, {_FIRST}, {_LABELLED} SELECT rel_type, sl AS source_label, tl AS target_label, coalesce({_LEGAL} AND repo_id = target_repo, false) AS legal, count(*) AS n FROM el GROUP BY ALL")
def g_triples(spark: SparkSession, d: str) -> DataFrame:
    e = g.labelled(g.first_wins(g.edge_rows(spark, d)))
    return e.groupBy("rel_type", "source_label", "target_label", F.coalesce("legal", F.lit(False)).alias("legal")).agg(F.count(F.lit(1)).alias("n"))


@query("g_cross_repository", f"WITH {_RAW}, {_FIRST}, {_LABELLED} SELECT repo_id, target_repo, rel_type, count(*) AS n FROM el WHERE repo_id <> target_repo GROUP BY ALL")
def g_cross_repository(spark: SparkSession, d: str) -> DataFrame:
    e = g.labelled(g.first_wins(g.edge_rows(spark, d)))
    return e.where("repo_id <> target_repo").groupBy("repo_id", "target_repo", "rel_type").agg(F.count(F.lit(1)).alias("n"))


# ---- duplicates and upserts ---------------------------------------------------------


@query("g_first_edges", f"WITH {_RAW}, {_FIRST} SELECT edge_id, rel_type, source_id, target_id, location.start_line AS start_line, location.start_column AS start_column, location.end_line AS end_line, location.end_column AS end_column, location.start_byte AS start_byte, location.end_byte AS end_byte FROM ef")
def g_first_edges(spark: SparkSession, d: str) -> DataFrame:
    """First of each (type, source, target), its place spread into columns."""
    place = [F.col(f"location.{c}").alias(c) for c in ("start_line", "start_column", "end_line", "end_column", "start_byte", "end_byte")]
    return g.first_wins(g.edge_rows(spark, d)).select("edge_id", "rel_type", "source_id", "target_id", *place)


@query("g_metadata_merged", f"""WITH {_RAW}, m AS (SELECT rel_type, source_id, target_id, observed_at, edge_id, unnest(map_entries(metadata)) AS kv FROM er)
SELECT rel_type, source_id, target_id, kv.key AS meta_key, arg_max(kv.value, (observed_at, edge_id)) AS meta_value FROM m GROUP BY ALL""")
def g_metadata_merged(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of repeated edges in one: the latest value of each key."""
    m = g.edge_rows(spark, d).select("rel_type", "source_id", "target_id", "observed_at", "edge_id", F.explode("metadata").alias("meta_key", "v"))
    return m.groupBy("rel_type", "source_id", "target_id", "meta_key").agg(F.max_by("v", F.struct("observed_at", "edge_id")).alias("meta_value"))


_UP = ("name", "qualified_name", "language", "docstring")


@query("g_upsert", f"""WITH {_sql_nodes()}, cut AS (SELECT TIMESTAMP '2024-07-01' AS t),
o AS (SELECT * FROM nr, cut WHERE observed_at < t QUALIFY row_number() OVER (PARTITION BY id ORDER BY {", ".join(f"{c} DESC NULLS LAST" for c in ("observed_at", "repo_id", "label", *_UP))}) = 1),
w AS (SELECT * FROM nr, cut WHERE observed_at >= t QUALIFY row_number() OVER (PARTITION BY id ORDER BY {", ".join(f"{c} DESC NULLS LAST" for c in ("observed_at", "repo_id", "label", *_UP))}) = 1)
SELECT coalesce(w.id, o.id) AS id, coalesce(w.repo_id, o.repo_id) AS repo_id, coalesce(w.label, o.label) AS label, {", ".join(f"coalesce(w.{c}, o.{c}) AS {c}" for c in _UP)}
FROM o FULL JOIN w ON w.id = o.id""")
def g_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Rows observed from July 2024 on upserted into the earlier ones: new values win, nulls replace nothing."""
    rows = g.node_rows(spark, d).where("id IS NOT NULL").select("id", "observed_at", "repo_id", "label", *_UP)
    cut = F.lit("2024-07-01").cast("timestamp_ntz")
    old = g.last_wins(rows.where(F.col("observed_at") < cut), "id", "observed_at")
    new = g.last_wins(rows.where(F.col("observed_at") >= cut), "id", "observed_at")
    return ex.upsert(old, new, "id")


# ---- traversal and impact -----------------------------------------------------------


def _walk_sql(seed: str, depth: int, incoming: bool, select: str) -> str:
    a, b = ("target_id", "source_id") if incoming else ("source_id", "target_id")
    return f"""{_G}, s AS (SELECT {seed} AS seed), st AS (SELECT DISTINCT {a} AS a, {b} AS b FROM e WHERE rel_type IN ('CALLS', 'IMPORTS', 'INHERITS')),
bfs(id, depth) AS (SELECT seed, 0::BIGINT FROM s UNION SELECT st.b, bfs.depth + 1 FROM bfs JOIN st ON st.a = bfs.id WHERE bfs.depth < {depth}),
r AS (SELECT id, min(depth) AS depth FROM bfs GROUP BY id HAVING id <> (SELECT seed FROM s)) {select}"""


def _reach(spark: SparkSession, d: str, depth: int, incoming: bool) -> DataFrame:
    es = _kept_edges(spark, d)
    seed = most_called(es) if incoming else top_caller(es)
    seeds = es.where(F.col("target_id" if incoming else "source_id") == seed).select(F.lit(seed).alias("seed"), "repo_id").distinct()
    return tr.traverse(es, seeds, depth, incoming=incoming)


for _depth in (1, 3, 10):
    for _incoming in (False, True):
        _name = f"g_{'dependents' if _incoming else 'dependencies'}_d{_depth}"
        query(_name, _walk_sql(_CALLED if _incoming else _CALLER, _depth, _incoming, "SELECT id, depth FROM r"))(
            lambda spark, d, n=_depth, i=_incoming: _reach(spark, d, n, i).select("id", "depth")
        )


@query("g_impact_summary", _walk_sql(_CALLED, 10, True, "SELECT (SELECT seed FROM s) AS seed, count(*) AS blast_radius, count(*) FILTER (depth = 1) AS directly_impacted, count(*) FILTER (depth > 1) AS transitively_impacted FROM r"))
def g_impact_summary(spark: SparkSession, d: str) -> DataFrame:
    return tr.impact_summary(_reach(spark, d, 10, True))


@query("g_impact_by_depth", _walk_sql(_CALLED, 10, True, "SELECT depth, count(*) AS n FROM r GROUP BY depth"))
def g_impact_by_depth(spark: SparkSession, d: str) -> DataFrame:
    return _reach(spark, d, 10, True).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


@query("g_impact_files", _walk_sql(_CALLED, 10, True, "SELECT DISTINCT coalesce(nullif(n.file_path, ''), nullif(n.path, '')) AS path FROM r JOIN n ON n.id = r.id WHERE coalesce(nullif(n.file_path, ''), nullif(n.path, '')) IS NOT NULL"))
def g_impact_files(spark: SparkSession, d: str) -> DataFrame:
    return tr.affected_files(_reach(spark, d, 10, True), g.nodes(spark, d)).select("path")


@query("g_blast_radius", f"""{_G}, c AS (SELECT repo_id, target_id, count(*) AS k FROM e WHERE rel_type = 'CALLS' AND source_id <> target_id GROUP BY ALL),
s AS (SELECT repo_id, target_id AS seed FROM c QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY k DESC, target_id) = 1),
st AS (SELECT DISTINCT target_id AS a, source_id AS b FROM e WHERE rel_type IN ('CALLS', 'IMPORTS', 'INHERITS')),
bfs(seed, id, depth) AS (SELECT seed, seed, 0::BIGINT FROM s UNION SELECT bfs.seed, st.b, bfs.depth + 1 FROM bfs JOIN st ON st.a = bfs.id WHERE bfs.depth < 3),
r AS (SELECT seed, id, min(depth) AS depth FROM bfs WHERE id <> seed GROUP BY seed, id)
SELECT seed, count(*) AS blast_radius, count(*) FILTER (depth = 1) AS directly_impacted, count(*) FILTER (depth > 1) AS transitively_impacted FROM r GROUP BY seed""")
def g_blast_radius(spark: SparkSession, d: str) -> DataFrame:
    """Impact of the most called entity of every repository, three steps deep, in one traversal."""
    es = g.graph_edges(spark, d).select("rel_type", "source_id", "target_id", "repo_id")
    c = es.where("rel_type = 'CALLS' AND source_id <> target_id").groupBy("repo_id", "target_id").agg(F.count(F.lit(1)).alias("k"))
    seeds = c.groupBy("repo_id").agg(F.min_by("target_id", F.struct(-F.col("k"), "target_id")).alias("seed"))
    return tr.impact_summary(tr.traverse(es, seeds, 3, incoming=True))


_ASKED = f"""{_G}, q AS (SELECT {_CALLED} AS id, (SELECT repo_id FROM n WHERE id = {_CALLED}) AS repo), asked AS (SELECT repo AS repository_id, id AS entity_id FROM q UNION ALL SELECT repo, repo || '::function::none.such' FROM q UNION ALL SELECT 'repo::none-such', id FROM q),
t AS (SELECT a.*, r.id IS NOT NULL AS repo_exists, x.id IS NOT NULL AS entity_exists, r.id IS NOT NULL AND x.id IS NOT NULL AS found, coalesce(nullif(x.name, ''), nullif(x.path, ''), x.id) AS name, x.label, coalesce(nullif(x.file_path, ''), nullif(x.path, '')) AS file_path
 FROM asked a LEFT JOIN n r ON r.id = a.repository_id AND r.label = 'Repository' LEFT JOIN n x ON x.id = a.entity_id AND x.repo_id = a.repository_id),
st AS (SELECT DISTINCT target_id AS a, source_id AS b FROM e WHERE rel_type IN ('CALLS', 'IMPORTS', 'INHERITS')),
bfs(seed, id, depth) AS (SELECT entity_id, entity_id, 0::BIGINT FROM t WHERE found UNION SELECT bfs.seed, st.b, bfs.depth + 1 FROM bfs JOIN st ON st.a = bfs.id WHERE bfs.depth < 10),
r AS (SELECT seed, id, min(depth) AS depth FROM bfs WHERE id <> seed GROUP BY seed, id),
i AS (SELECT r.*, n.label, coalesce(nullif(n.name, ''), nullif(n.path, ''), n.id) AS name, coalesce(nullif(n.file_path, ''), nullif(n.path, '')) AS file_path FROM r JOIN n ON n.id = r.id)"""


def _impact(spark: SparkSession, d: str):
    """The most called entity, one that does not exist, and the first one asked for in a repository that does not exist."""
    es, ns = _kept_edges(spark, d), g.nodes(spark, d)
    seed = most_called(es)
    repo = _first(es.where(F.col("target_id") == seed).select("repo_id"), "repo_id")
    asked = spark.createDataFrame([(repo, seed), (repo and f"{repo}::function::none.such", None), ("repo::none-such", seed)], "repository_id string, entity_id string")
    asked = asked.select(F.when(F.col("entity_id").isNull(), F.lit(repo)).otherwise(F.col("repository_id")).alias("repository_id"), F.coalesce("entity_id", "repository_id").alias("entity_id"))
    return tr.impact(ns, es, asked)


@query("g_impact", f"""{_ASKED} SELECT repository_id, entity_id, repo_exists, entity_exists, found, CASE WHEN found THEN name END AS name, CASE WHEN found THEN label END AS label, CASE WHEN found THEN file_path END AS file_path,
(SELECT count(*) FROM i WHERE found AND i.seed = t.entity_id) AS blast_radius, (SELECT count(*) FROM i WHERE found AND i.seed = t.entity_id AND depth = 1) AS directly_impacted,
(SELECT count(*) FROM i WHERE found AND i.seed = t.entity_id AND depth > 1) AS transitively_impacted, (SELECT count(DISTINCT i.file_path) FROM i WHERE found AND i.seed = t.entity_id) AS affected_file_count FROM t""")
def g_impact(spark: SparkSession, d: str) -> DataFrame:
    """The answer to each request, with what of it exists."""
    return _impact(spark, d)[0]


@query("g_impact_entities", f"{_ASKED} SELECT t.repository_id, t.entity_id, i.id, i.label, i.name, i.file_path, i.depth, i.depth = 1 AS direct FROM t JOIN i ON t.found AND i.seed = t.entity_id ORDER BY depth, id")
def g_impact_entities(spark: SparkSession, d: str) -> DataFrame:
    return _impact(spark, d)[1].drop("path_types").orderBy("depth", "id")


@query("g_impact_paths")
def g_impact_paths(spark: SparkSession, d: str) -> DataFrame:
    """The types along a shortest way to each impacted entity."""
    return _impact(spark, d)[1].select("entity_id", "id", "depth", F.array_join("path_types", ">").alias("path_types"))


# ---- pages --------------------------------------------------------------------------


@query("g_overview_page", f"{_G} SELECT id, path, language FROM n WHERE label = 'File' AND id IN (SELECT target_id FROM e WHERE rel_type = 'CONTAINS' AND source_id = {_BUSY}) ORDER BY path, id LIMIT 50 OFFSET 20")
def g_overview_page(spark: SparkSession, d: str) -> DataFrame:
    ns, es = g.nodes(spark, d), _kept_edges(spark, d)
    files = ex.children(es, ns.where("label = 'File'"), busiest_repository(spark, d))
    return ex.page(files, ["path", "id"], 50, 20).select("id", "path", "language")


@query("g_overview_meta", f"{_G} SELECT count(*) AS total, least(50, greatest(count(*) - 20, 0)) AS returned, 20 + least(50, greatest(count(*) - 20, 0)) < count(*) AS has_more, count(*) > least(50, greatest(count(*) - 20, 0)) AS truncated FROM n WHERE label = 'File' AND id IN (SELECT target_id FROM e WHERE rel_type = 'CONTAINS' AND source_id = {_BUSY})")
def g_overview_meta(spark: SparkSession, d: str) -> DataFrame:
    ns, es = g.nodes(spark, d), _kept_edges(spark, d)
    return ex.page_meta(ex.children(es, ns.where("label = 'File'"), busiest_repository(spark, d)), 50, 20)


@query("g_children_page", f"{_G} SELECT id, label, name, start_line FROM n WHERE label <> 'Repository' AND id IN (SELECT target_id FROM e WHERE rel_type = 'CONTAINS' AND source_id = {_PARENT}) ORDER BY coalesce(start_line, 0), id LIMIT 10")
def g_children_page(spark: SparkSession, d: str) -> DataFrame:
    es = _kept_edges(spark, d)
    kids = ex.children(es, g.nodes(spark, d), fullest_parent(es))
    return ex.page(kids, [F.coalesce("start_line", F.lit(0)), "id"], 10).select("id", "label", "name", "start_line")


_NEAR = f"""{_G}, c AS (SELECT {_CALLED} AS id), pg AS (SELECT edge_id, rel_type, source_id, target_id, location.start_line AS line, coalesce(location.start_line, 0) AS l0, coalesce(location.start_byte, 0) AS b0,
 CASE WHEN source_id = (SELECT id FROM c) THEN target_id ELSE source_id END AS neighbor FROM e WHERE source_id = (SELECT id FROM c) OR target_id = (SELECT id FROM c)
 ORDER BY source_id, rel_type, target_id, l0, b0, edge_id LIMIT 50),
pb AS (SELECT *, source_id || '->' || rel_type || '->' || target_id || coalesce(':L' || line::VARCHAR, '') AS base FROM pg),
pi AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY source_id, rel_type, target_id, l0, b0, edge_id) - 1 AS k FROM pb)"""


@query("g_neighbors_page", f"{_NEAR} SELECT edge_id, rel_type, source_id, target_id, neighbor, CASE WHEN k = 0 THEN base ELSE base || '#' || k::VARCHAR END AS graph_edge_id FROM pi")
def g_neighbors_page(spark: SparkSession, d: str) -> DataFrame:
    es = _kept_edges(spark, d)
    return ex.neighbor_page(es, most_called(es)).select("edge_id", "rel_type", "source_id", "target_id", "neighbor", "graph_edge_id")


@query("g_neighbors_nodes", f"{_NEAR} SELECT n.id, n.label, n.name FROM n WHERE n.id IN (SELECT neighbor FROM pi) AND n.id <> (SELECT id FROM c) ORDER BY n.id")
def g_neighbors_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The nodes at the other ends of the page."""
    es = _kept_edges(spark, d)
    center = most_called(es)
    return ex.page_neighbors(ex.neighbor_page(es, center), g.nodes(spark, d), center).select("id", "label", "name")


@query("g_neighbor_counts", f"{_G}, c AS (SELECT {_CALLED} AS id) SELECT count(*) AS total_relationships, count(DISTINCT CASE WHEN source_id <> target_id THEN CASE WHEN source_id = (SELECT id FROM c) THEN target_id ELSE source_id END END) AS total_neighbors FROM e WHERE source_id = (SELECT id FROM c) OR target_id = (SELECT id FROM c)")
def g_neighbor_counts(spark: SparkSession, d: str) -> DataFrame:
    es = _kept_edges(spark, d)
    return ex.neighbor_counts(es, most_called(es))


def _search_sql(q: str, label: str | None, repo: str | None, tail: str, select: str) -> str:
    hit = " OR ".join(f"contains(lower(coalesce({c}, '')), '{q}')" for c in ("name", "qualified_name", "path", "file_path", "id"))
    where = f"({hit})" + (f" AND label = '{label}'" if label else "") + (f" AND (repo_id = {repo} OR id = {repo})" if repo else "")
    return f"""{_N}, h AS (SELECT *, CASE WHEN lower(coalesce(name, path, '')) = '{q}' THEN 1 WHEN starts_with(lower(coalesce(name, qualified_name, path, '')), '{q}') THEN 2 ELSE 3 END AS rank
FROM n WHERE {where}) {select} FROM h {tail}"""


_SEARCH_ORDER = "ORDER BY rank, coalesce(path, file_path, ''), coalesce(name, ''), id LIMIT 50"


@query("g_search", _search_sql("cursor", None, _BUSY, _SEARCH_ORDER, "SELECT id, label, name, rank"))
def g_search(spark: SparkSession, d: str) -> DataFrame:
    """The first page of what a repository has for a word."""
    ns = g.nodes(spark, d)
    return ex.page(ex.search(ns, "cursor", busiest_repository(spark, d)), ex.search_order(ns)).select("id", "label", "name", "rank")


@query("g_search_typed", _search_sql("sync_page", "Function", _BUSY, _SEARCH_ORDER, "SELECT id, label, name, rank"))
def g_search_typed(spark: SparkSession, d: str) -> DataFrame:
    ns = g.nodes(spark, d)
    return ex.page(ex.search(ns, "SYNC_PAGE", busiest_repository(spark, d), "function"), ex.search_order(ns)).select("id", "label", "name", "rank")


@query("g_search_meta", _search_sql("cursor", None, _BUSY, "", "SELECT count(*) AS total, least(50, count(*)) AS returned, least(50, count(*)) < count(*) AS has_more, count(*) > least(50, count(*)) AS truncated"))
def g_search_meta(spark: SparkSession, d: str) -> DataFrame:
    return ex.page_meta(ex.search(g.nodes(spark, d), "cursor", busiest_repository(spark, d)))


@query("g_search_counts", _search_sql("_p", None, None, "GROUP BY ALL", "SELECT repo_id, label, rank, count(*) AS n"))
def g_search_counts(spark: SparkSession, d: str) -> DataFrame:
    """All hits, in every repository, of a query with a sign that would be a wild card elsewhere."""
    return ex.search(g.nodes(spark, d), "_p").groupBy("repo_id", "label", "rank").agg(F.count(F.lit(1)).alias("n"))


def _score_sql(col: str, q: str, bias: int) -> str:
    return f"CASE WHEN lower({col}) = '{q}' THEN {100 + bias} WHEN starts_with(lower({col}), '{q}') THEN {80 + bias} WHEN regexp_matches(lower({col}), '[._/:[:space:]]{q}') THEN {65 + bias} WHEN contains(lower({col}), '{q}') THEN {50 + bias} END"


# Fixed by the rule: display name +10, name +5, id 0, path -5; a node without a name goes by its id, a file by its path.
_MODEL = "coalesce(nullif(trim(CASE label WHEN 'File' THEN path ELSE name END), ''), id)"


@query("g_scored_search", f"{_N}, m AS (SELECT id, label, {_MODEL} AS display, trim(coalesce(file_path, path)) AS p FROM n), h AS (SELECT id, label, display, coalesce({', '.join(_score_sql(c, 'batch', b) for c, b in (('display', 10), ('display', 5), ('id', 0), ('p', -5)))}) AS score FROM m) SELECT * FROM h WHERE score IS NOT NULL ORDER BY score DESC, length(display), display, id LIMIT 20")
def g_scored_search(spark: SparkSession, d: str) -> DataFrame:
    return ex.scored_search(g.nodes(spark, d), "batch")


# ---- whole graphs -------------------------------------------------------------------


@query("g_edge_ids", f"""WITH {_RAW}, b AS (SELECT *, source_id || '->' || rel_type || '->' || target_id || coalesce(':L' || location.start_line::VARCHAR, '') AS base_id FROM er),
r AS (SELECT *, row_number() OVER (PARTITION BY base_id ORDER BY coalesce(location.start_line, -1), coalesce(location.start_column, -1), edge_id) - 1 AS k FROM b)
SELECT edge_id, CASE WHEN k = 0 THEN base_id ELSE base_id || '#' || k::VARCHAR END AS graph_edge_id FROM r""")
def g_edge_ids(spark: SparkSession, d: str) -> DataFrame:
    return ex.edge_ids(g.edge_rows(spark, d)).select("edge_id", "graph_edge_id")


_DOCUMENT = ", ".join(f"'{c}', {c}" for c in sorted(("id", "repo_id", "label", *g.NODE_COLUMNS)))


@query("g_documents", f"{_N} SELECT id, json_object({_DOCUMENT})::VARCHAR AS doc FROM n")
def g_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every node as a JSON document, keys in alphabetical order, null where nothing is known."""
    return ex.document_json(g.nodes(spark, d).drop("observed_at"), True)


@query("g_documents_back", f"{_N} SELECT id, repo_id, label, name, qualified_name, path, docstring, start_line, end_byte FROM n")
def g_documents_back(spark: SparkSession, d: str) -> DataFrame:
    """The documents without their nulls, read back."""
    ns = g.nodes(spark, d).drop("observed_at")
    return ex.nodes_of_documents(ex.document_json(ns), ns.schema.simpleString()[7:-1].replace(":", " ")).select("id", "repo_id", "label", "name", "qualified_name", "path", "docstring", "start_line", "end_byte")


_PLACED = ", ".join(f"location.{c} AS {c}" for c in ex.PLACE)


@query("g_edge_documents_back", f"WITH {_RAW} SELECT edge_id, rel_type, source_id, target_id, {_PLACED}, len(coalesce(map_keys(metadata), [])) AS n_metadata FROM er")
def g_edge_documents_back(spark: SparkSession, d: str) -> DataFrame:
    """Edges as JSON documents, read back."""
    back = ex.edges_of_documents(ex.edge_documents(g.edge_rows(spark, d)))
    return back.select("edge_id", "rel_type", "source_id", "target_id", *[F.col(f"location.{c}").alias(c) for c in ex.PLACE], F.size("metadata").cast("long").alias("n_metadata"))


@query("g_flat_edges_back", f"""WITH {_RAW} SELECT edge_id, rel_type, source_id, target_id, location.start_line IS NOT NULL AND location.end_line IS NOT NULL AS placed,
CASE WHEN location.start_line IS NOT NULL AND location.end_line IS NOT NULL THEN coalesce(location.start_column, 0) + coalesce(location.end_column, 0) + coalesce(location.start_byte, 0) + coalesce(location.end_byte, 0) END AS offsets FROM er""")
def g_flat_edges_back(spark: SparkSession, d: str) -> DataFrame:
    """Edges flattened into columns as they are stored, and put together again."""
    back = ex.placed_edges(ex.flat_edges(g.edge_rows(spark, d)))
    total = F.col("location.start_column") + F.col("location.end_column") + F.col("location.start_byte") + F.col("location.end_byte")
    return back.select("edge_id", "rel_type", "source_id", "target_id", F.col("location").isNotNull().alias("placed"), total.alias("offsets"))


@query("g_entities", f"{_N} SELECT id, label, CASE WHEN label IN ('File', 'Import', 'Class', 'Function', 'Method') THEN coalesce(start_byte, 0) ELSE start_byte END AS start_byte, CASE WHEN label IN ('File', 'Import', 'Class', 'Function', 'Method') THEN coalesce(end_byte, 0) ELSE end_byte END AS end_byte FROM n")
def g_entities(spark: SparkSession, d: str) -> DataFrame:
    return ex.entities(g.nodes(spark, d)).select("id", "label", "start_byte", "end_byte")


_WHOLE = f"{_G}, fn AS (SELECT id, label, {_MODEL} AS name FROM n WHERE repo_id = {_BUSY} OR id = {_BUSY} ORDER BY label <> 'Repository', id LIMIT 500)"


@query("g_full_graph_nodes", f"{_WHOLE} SELECT id, label, name, label AS type, name AS display_name FROM fn")
def g_full_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The first 500 nodes of the busiest repository as they are told: the repository, then by id."""
    ns, _ = ex.full_graph(g.nodes(spark, d), g.edge_rows(spark, d), busiest_repository(spark, d), 500)
    return ex.node_models(ns).select("id", "label", "name", "type", "display_name")


@query("g_full_graph_edges", f"""{_WHOLE}, b AS (SELECT *, source_id || '->' || rel_type || '->' || target_id || coalesce(':L' || location.start_line::VARCHAR, '') AS base FROM er WHERE source_id IN (SELECT id FROM fn) AND target_id IN (SELECT id FROM fn)),
k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY coalesce(location.start_line, -1), coalesce(location.start_column, -1), edge_id) - 1 AS k FROM b)
SELECT edge_id, source_id, rel_type, target_id, CASE WHEN k = 0 THEN base ELSE base || '#' || k::VARCHAR END AS graph_edge_id FROM k""")
def g_full_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """All edge rows between those nodes, repeats too, each with an id of its own."""
    _, es = ex.full_graph(g.nodes(spark, d), g.edge_rows(spark, d), busiest_repository(spark, d), 500)
    return es.select("edge_id", "source_id", "rel_type", "target_id", "graph_edge_id")


@query("g_overview_edges", f"""{_G}, p AS (SELECT id FROM n WHERE label = 'File' AND id IN (SELECT target_id FROM e WHERE rel_type = 'CONTAINS' AND source_id = {_BUSY}) ORDER BY path, id LIMIT 50 OFFSET 20)
SELECT DISTINCT source_id || '->CONTAINS->' || target_id AS graph_edge_id, source_id, rel_type, target_id FROM e WHERE rel_type = 'CONTAINS' AND source_id = {_BUSY} AND target_id IN (SELECT id FROM p)""")
def g_overview_edges(spark: SparkSession, d: str) -> DataFrame:
    ns, es, repo = g.nodes(spark, d), _kept_edges(spark, d), busiest_repository(spark, d)
    files = ex.page(ex.children(es, ns.where("label = 'File'"), repo), ["path", "id"], 50, 20)
    return ex.contained_edges(es, repo, files)


@query("g_drawn_edges", f"{_G} SELECT edge_id, CASE rel_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ids.STROKES.items() if k) + f" ELSE '{ids.STROKES['']}' END AS stroke FROM er WHERE source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n)")
def g_drawn_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of a drawing of everything: dangling ones left out, parallel ones kept."""
    return ex.drawn_edges(g.edge_rows(spark, d), g.nodes(spark, d)).select("edge_id", "stroke")


@query("g_node_tags", f"""{_N} SELECT id, CASE WHEN contains(id, '::') THEN split_part(id, '::', -1) ELSE split_part(id, '/', -1) END AS short_name, label IN ('Method', 'Import') AS is_leaf,
CASE lower(label) """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ids.BADGES.items() if k) + f""" ELSE '{ids.BADGES['']}' END AS badge FROM n""")
def g_node_tags(spark: SparkSession, d: str) -> DataFrame:
    label = F.col("label")
    return g.nodes(spark, d).select("id", ids.short_name(F.col("id")).alias("short_name"), ids.is_leaf(label).alias("is_leaf"), ids.style(F.lower(label), ids.BADGES).alias("badge"))


@query("g_analysis_summary", f"""WITH {_RAW}, c AS (""" + " UNION ALL ".join(f"SELECT {'id' if t == 'repository' else 'repo_id'} AS repo_id, '{t}' AS t, count(*) AS n FROM {t}_node WHERE id IS NOT NULL GROUP BY 1" for t in NODE_TABLES) + f""" UNION ALL SELECT repo_id, 'edge', count(*) FROM er GROUP BY 1)
SELECT repo_id, """ + ", ".join(f"coalesce(sum(n) FILTER (t = '{t}'), 0)::BIGINT AS n_{t}" for t in (*NODE_TABLES, "edge")) + " FROM c WHERE repo_id IS NOT NULL GROUP BY repo_id")
def g_analysis_summary(spark: SparkSession, d: str) -> DataFrame:
    """Rows as they were delivered, repeats included, per repository: of each label, and of edges."""
    ns = g.node_rows(spark, d).where("id IS NOT NULL").select("repo_id", F.lower("label").alias("t"))
    both = ns.unionByName(g.edge_rows(spark, d).select("repo_id", F.lit("edge").alias("t"))).where("repo_id IS NOT NULL")
    return both.groupBy("repo_id").agg(*[F.count_if(F.col("t") == t).alias(f"n_{t}") for t in (*NODE_TABLES, "edge")])


@query("g_merge", f"""{_G}, cut AS (SELECT TIMESTAMP '2024-07-01' AS t),
oe AS (SELECT DISTINCT rel_type, source_id, target_id FROM er, cut WHERE observed_at < t), we AS (SELECT DISTINCT rel_type, source_id, target_id FROM er, cut WHERE observed_at >= t),
m AS (SELECT rel_type, source_id, target_id, 'old' AS part FROM oe UNION ALL SELECT we.rel_type, we.source_id, we.target_id, 'new' FROM we WHERE NOT EXISTS (SELECT 1 FROM oe WHERE oe.rel_type = we.rel_type AND oe.source_id = we.source_id AND oe.target_id = we.target_id))
SELECT part, rel_type, count(*) AS n FROM m WHERE source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n) GROUP BY ALL""")
def g_merge(spark: SparkSession, d: str) -> DataFrame:
    """Edges up to June 2024 merged with the later ones: repeats and dangling edges left out."""
    ns = g.nodes(spark, d).select("id")
    rows = g.edge_rows(spark, d)
    cut = F.lit("2024-07-01").cast("timestamp_ntz")
    key = ["rel_type", "source_id", "target_id"]
    old = rows.where(F.col("observed_at") < cut).select(*key).distinct().withColumn("part", F.lit("old"))
    new = rows.where(F.col("observed_at") >= cut).select(*key).distinct().withColumn("part", F.lit("new"))
    return ex.merge_graphs(ns, ns.limit(0), old, new)[1].groupBy("part", "rel_type").agg(F.count(F.lit(1)).alias("n"))


@query("g_collapse", f"""{_G}, k(id) AS (SELECT target_id FROM e WHERE rel_type = 'CONTAINS' AND source_id = {_PARENT} UNION SELECT e.target_id FROM k JOIN e ON e.source_id = k.id AND e.rel_type = 'CONTAINS')
SELECT rel_type, count(*) AS n FROM e WHERE source_id NOT IN (SELECT id FROM k) AND target_id NOT IN (SELECT id FROM k) GROUP BY ALL""")
def g_collapse(spark: SparkSession, d: str) -> DataFrame:
    """Edges left per type when the fullest file is collapsed: its descendants go with their edges."""
    es = _kept_edges(spark, d)
    parent = fullest_parent(es)
    seeds = es.where(F.col("source_id") == parent).select(F.lit(parent).alias("seed"), "repo_id").distinct()
    gone = tr.traverse(es, seeds, None, ["CONTAINS"]).select("id")
    left = es.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return left.groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))


@query("g_layout", f"""{_N}, t AS (SELECT id, label, {_MODEL} AS name, CASE label WHEN 'Repository' THEN 0 WHEN 'File' THEN 1 WHEN 'Module' THEN 1 WHEN 'Class' THEN 2 WHEN 'Function' THEN 3 WHEN 'Method' THEN 3 WHEN 'Import' THEN 4 ELSE 5 END AS tier FROM n),
r AS (SELECT id, tier, row_number() OVER (PARTITION BY tier ORDER BY label, name, id) - 1 AS i FROM t),
w AS (SELECT tier, coalesce(sum(ceil(count(*) / {ex.ROWS}.0) * {ex.WIDTH} + {ex.GAP}) OVER (ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x0 FROM t GROUP BY tier)
SELECT r.id, r.tier::BIGINT AS tier, (x0 + 60 + (i // {ex.ROWS}) * {ex.WIDTH})::BIGINT AS x, (60 + i % {ex.ROWS} * {ex.HEIGHT})::BIGINT AS y FROM r JOIN w ON w.tier = r.tier""")
def g_layout(spark: SparkSession, d: str) -> DataFrame:
    return ex.layout(g.nodes(spark, d))


# ---- scalar functions ---------------------------------------------------------------


@query("g_id_parts", f"SELECT DISTINCT target_id AS id, {_label('target_id')} AS label, {_repo('target_id')} AS repo_id FROM relationship_edge WHERE target_id IS NOT NULL")
def g_id_parts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "relationship_edge").where("target_id IS NOT NULL").select(F.col("target_id").alias("id")).distinct()
    return t.select("id", ids.label_of(F.col("id")).alias("label"), ids.repo_of(F.col("id")).alias("repo_id"))


@query("g_module_names", r"""WITH p AS (SELECT DISTINCT file_path, regexp_replace(regexp_replace(trim(file_path), '^(\./+|/+)', ''), '\.py$', '') AS stem FROM file_node WHERE file_path LIKE '%.py'),
q AS (SELECT file_path, CASE WHEN stem = '__init__' THEN '' ELSE regexp_replace(stem, '/__init__$', '') END AS s FROM p)
SELECT file_path, CASE WHEN s = '' THEN 'root' ELSE split_part(s, '/', -1) END AS short_name, CASE WHEN s = '' THEN 'root' ELSE replace(s, '/', '.') END AS dotted_name FROM q""")
def g_module_names(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "file_node").where("file_path LIKE '%.py'").select("file_path").distinct()
    short, dotted = ids.module_info(F.col("file_path"))
    return f.select("file_path", short.alias("short_name"), dotted.alias("dotted_name"))
