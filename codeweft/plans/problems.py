"""Registered queries of the general problems 2, 3 and 4, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeweft.operators import dense_groups as dg, hierarchy as hi, references as rf
from codeweft.sources.tables import NODE_TABLES, all_nodes, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    refs = rf.edge_references(table(spark, d, "relationship_edge"))
    return rf.dangling_references(refs, all_nodes(spark, d)).select("edge_id", "side")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return rf.dangling_report(rf.edge_references(table(spark, d, "relationship_edge")), all_nodes(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hi.cycle_members(hi.parent_links(table(spark, d, "relationship_edge")))


def p3_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    tree = hi.hierarchy(hi.parent_links(table(spark, d, "relationship_edge")))
    return tree.select("node_id", "root_id", "depth", F.array_join("path", " > ").alias("path"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hi.descendants(hi.hierarchy(hi.parent_links(table(spark, d, "relationship_edge"))))


def p3_all_paths(spark: SparkSession, d: str) -> DataFrame:
    tree = hi.all_paths(hi.parent_links(table(spark, d, "relationship_edge")))
    return tree.select("node_id", "root_id", "depth", F.array_join("path", " > ").alias("path"), "rooted")


def p3_all_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hi.all_descendants(hi.parent_links(table(spark, d, "relationship_edge")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    t = dg.heavy_keys(table(spark, d, "relationship_edge"), "target_id", 0.01)
    r = dg.heavy_keys(table(spark, d, "function_node"), "repo_id", 0.05)
    return t.select(F.lit("target_id").alias("key_field"), F.col("target_id").alias("key_value")).union(
        r.select(F.lit("repo_id").alias("key_field"), F.col("repo_id").alias("key_value"))
    )


def p4_target_stats(spark: SparkSession, d: str) -> DataFrame:
    return dg.key_stats(table(spark, d, "relationship_edge"), "target_id", "source_id", "observed_at").withColumnRenamed("n_others", "n_callers")


def p4_repo_stats(spark: SparkSession, d: str) -> DataFrame:
    return dg.key_stats(table(spark, d, "function_node"), "repo_id", "file_path", "observed_at").withColumnRenamed("n_others", "n_files")


_NODES = " UNION ALL ".join(f"SELECT id, observed_at, deleted_at FROM {t}_node" for t in NODE_TABLES)
_DANGLING = f"""WITH n AS ({_NODES}),
r AS (SELECT edge_id, upper(rel_type) AS rel_type, observed_at AS t, 'source' AS side, source_id AS id FROM relationship_edge
 UNION ALL SELECT edge_id, upper(rel_type), observed_at, 'target', target_id FROM relationship_edge),
x AS (SELECT * FROM r WHERE id IS NOT NULL AND NOT EXISTS (
 SELECT 1 FROM n WHERE n.id = r.id AND n.observed_at <= r.t AND (n.deleted_at IS NULL OR n.deleted_at > r.t)))"""
_LINKS = "c AS (SELECT DISTINCT source_id AS p, target_id AS n FROM relationship_edge WHERE upper(rel_type) = 'CONTAINS' AND source_id IS NOT NULL AND target_id IS NOT NULL)"
QUERIES = {
    "p2_found": p2_found, "p2_report": p2_report, "p3_found": p3_found, "p3_hierarchy": p3_hierarchy,
    "p3_descendants": p3_descendants, "p3_all_paths": p3_all_paths, "p3_all_descendants": p3_all_descendants, "p4_found": p4_found, "p4_target_stats": p4_target_stats, "p4_repo_stats": p4_repo_stats,
}

# Up-closures would be quadratic under long cycles, so the SQL walks down from roots (finite nodes) and from the rest.
_WALK = f"""WITH RECURSIVE {_LINKS},
reach(a, b) AS (SELECT p, n FROM c UNION SELECT reach.a, c.n FROM reach JOIN c ON c.p = reach.b),
cyc AS (SELECT a AS node FROM reach WHERE a = b),
cid AS (SELECT x.a AS node, min(x.b) AS cycle_id FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a JOIN cyc ON cyc.node = x.a GROUP BY x.a),
bad AS (SELECT DISTINCT node_id, cycle_id FROM (
 SELECT node AS node_id, cycle_id FROM cid UNION ALL SELECT reach.b, cid.cycle_id FROM reach JOIN cid ON cid.node = reach.a))"""

ORACLES = {
    "p2_found": f"{_DANGLING} SELECT edge_id, side FROM x",
    "p2_report": f"""{_DANGLING} SELECT rel_type, CASE WHEN contains(id, '::file::') THEN 'file' WHEN contains(id, '::module::') THEN 'module'
 WHEN contains(id, '::class::') THEN 'class' WHEN contains(id, '::function::') THEN 'function' WHEN contains(id, '::method::') THEN 'method'
 WHEN contains(id, '::import::') THEN 'import' WHEN starts_with(id, 'repo::') THEN 'repository' ELSE 'unknown' END AS endpoint_table,
 side, strftime(t, '%Y-%m') AS month, count(*) AS n_dangling, count(DISTINCT id) AS n_missing_ids FROM x GROUP BY 1, 2, 3, 4""",
    "p3_found": f"{_WALK} SELECT node_id, cycle_id FROM bad",
    "p3_hierarchy": f"""{_WALK}, w AS (
 SELECT p AS node_id, p AS root_id, 0::BIGINT AS depth, p AS path FROM (SELECT DISTINCT p FROM c WHERE p NOT IN (SELECT n FROM c))
 UNION ALL SELECT c.n, w.root_id, w.depth + 1, w.path || ' > ' || c.n FROM w JOIN c ON c.p = w.node_id
 WHERE c.n NOT IN (SELECT node_id FROM bad)) SELECT node_id, root_id, depth, path FROM w""",
    "p3_descendants": f"""{_WALK}, w AS (
 SELECT p AS a, n AS b, 1::BIGINT AS d FROM c WHERE p NOT IN (SELECT node_id FROM bad) AND n NOT IN (SELECT node_id FROM bad)
 UNION SELECT w.a, c.n, w.d + 1 FROM w JOIN c ON c.p = w.b WHERE c.n NOT IN (SELECT node_id FROM bad))
 SELECT a AS ancestor_id, b AS node_id, d AS distance FROM w""",
    "p3_all_paths": f"""{_WALK}, top AS (SELECT DISTINCT p AS r, TRUE AS rooted FROM c WHERE p NOT IN (SELECT n FROM c)
 UNION ALL SELECT DISTINCT cycle_id, FALSE FROM cid WHERE cycle_id NOT IN (SELECT x.cycle_id FROM c JOIN cid x ON x.node = c.n LEFT JOIN cid y ON y.node = c.p
 WHERE y.cycle_id IS DISTINCT FROM x.cycle_id)),
w AS (SELECT r AS b, [r] AS way, rooted FROM top UNION ALL SELECT c.n, list_append(w.way, c.n), w.rooted FROM w JOIN c ON c.p = w.b WHERE NOT list_contains(w.way, c.n))
SELECT b AS node_id, way[1] AS root_id, len(way) - 1 AS depth, array_to_string(way, ' > ') AS path, rooted FROM w""",
    "p3_all_descendants": f"""WITH RECURSIVE {_LINKS}, w AS (
 SELECT p AS a, n AS b, [n] AS way FROM c
 UNION ALL SELECT w.a, c.n, list_append(w.way, c.n) FROM w JOIN c ON c.p = w.b WHERE w.a <> w.b AND NOT list_contains(w.way, c.n))
 SELECT DISTINCT a AS ancestor_id, b AS node_id, len(way) AS distance FROM w""",
    "p4_found": """SELECT 'target_id' AS key_field, target_id AS key_value FROM relationship_edge WHERE target_id IS NOT NULL GROUP BY target_id
 HAVING count(*) >= 0.01 * (SELECT count(*) FROM relationship_edge)
 UNION ALL SELECT 'repo_id', repo_id FROM function_node WHERE repo_id IS NOT NULL GROUP BY repo_id HAVING count(*) >= 0.05 * (SELECT count(*) FROM function_node)""",
    "p4_target_stats": """SELECT target_id, count(*) AS n_rows, count(DISTINCT source_id) AS n_callers, epoch_us(max(observed_at)) AS newest_us
 FROM relationship_edge WHERE target_id IS NOT NULL GROUP BY target_id""",
    "p4_repo_stats": """SELECT repo_id, count(*) AS n_rows, count(DISTINCT file_path) AS n_files, epoch_us(max(observed_at)) AS newest_us
 FROM function_node WHERE repo_id IS NOT NULL GROUP BY repo_id""",
}
