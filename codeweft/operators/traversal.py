"""Bounded breadth-first traversal by joins of the frontier with the edges, for one start or many."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codeweft.functions.ids import repo_of
from codeweft.sources.tables import cut_lineage

DEFAULT_TYPES = ("CALLS", "IMPORTS", "INHERITS")
ALLOWED_TYPES = (*DEFAULT_TYPES, "CONTAINS")
DEFAULT_DEPTH = 10


def relationship_types(types: list[str] | tuple[str, ...] | None = None) -> list[str]:
    """The types to follow: upper case, without repeats, sorted; none given means the default three."""
    if types is None:
        return sorted(DEFAULT_TYPES)
    clean = sorted({t.strip().upper() for t in types if t and t.strip()})
    if not clean:
        raise ValueError("at least one relationship type is needed")
    if wrong := [t for t in clean if t not in ALLOWED_TYPES]:
        raise ValueError(f"unknown relationship types: {wrong}")
    return clean


def check_depth(depth: int) -> int:
    if isinstance(depth, bool) or not isinstance(depth, int) or depth < 1:
        raise ValueError("depth must be an integer of at least 1")
    return depth


def traverse(edges: DataFrame, seeds: DataFrame, max_depth: int | None = DEFAULT_DEPTH, types=None, incoming: bool = False) -> DataFrame:
    """(seed, id, depth, path_types): what each seed reaches in up to max_depth steps, at its least depth.

    edges: source_id, target_id, rel_type, repo_id; seeds: seed, repo_id.  Steps
    stay inside the seed's repository.  Of several shortest ways the one with
    the least list of types is told.  The seed itself is never a result, so
    cycles and self-loops end.  max_depth None follows all ways to their ends.  No
    seeds or no edges: no rows.
    """
    if max_depth is not None:
        check_depth(max_depth)
    a, b = ("target_id", "source_id") if incoming else ("source_id", "target_id")
    step = (
        edges.where(F.col("rel_type").isin(relationship_types(types)) & (F.col(a) != F.col(b)))
        .groupBy(F.col(a).alias("id"), F.col(b).alias("to"), "repo_id").agg(F.min("rel_type").alias("t"))
    )
    step = cut_lineage(step)
    front = seeds.select("seed", "repo_id", F.col("seed").alias("id"), F.array().cast("array<string>").alias("path_types"))
    seen = cut_lineage(front.withColumn("depth", F.lit(0).cast("bigint")))
    front = seen
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        nxt = (
            front.join(step, ["id", "repo_id"])
            .select("seed", "repo_id", F.col("to").alias("id"), F.concat("path_types", F.array("t")).alias("path_types"))
            .join(seen.select("seed", "id"), ["seed", "id"], "left_anti")
            .groupBy("seed", "repo_id", "id").agg(F.min("path_types").alias("path_types"))
            .withColumn("depth", F.lit(depth).cast("bigint"))
        )
        front = cut_lineage(nxt)
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return seen.where("depth > 0").select("seed", "id", "depth", "path_types")


def _from_one(edges: DataFrame, entity_id: str, repo_id: str | None, max_depth: int, types, incoming: bool) -> DataFrame:
    """What one entity reaches, by depth and id; the repository is read off the id if it is not given."""
    seeds = edges.sparkSession.createDataFrame([(entity_id, repo_id)], "seed string, repo_id string").withColumn("repo_id", F.coalesce("repo_id", repo_of(F.col("seed"))))
    return traverse(edges, seeds, max_depth, types, incoming).select("id", "depth", "path_types").orderBy("depth", "id")


def dependencies(edges: DataFrame, entity_id: str, repo_id: str | None = None, max_depth: int = 1, types=None) -> DataFrame:
    """(id, depth, path_types) of what an entity depends on, by depth and id."""
    return _from_one(edges, entity_id, repo_id, max_depth, types, False)


def dependents(edges: DataFrame, entity_id: str, repo_id: str | None = None, max_depth: int = 1, types=None) -> DataFrame:
    """(id, depth, path_types) of what depends on an entity, by depth and id."""
    return _from_one(edges, entity_id, repo_id, max_depth, types, True)


def direct_dependencies(edges: DataFrame, entity_id: str, repo_id: str | None = None, types=None) -> DataFrame:
    return dependencies(edges, entity_id, repo_id, 1, types)


def direct_dependents(edges: DataFrame, entity_id: str, repo_id: str | None = None, types=None) -> DataFrame:
    return dependents(edges, entity_id, repo_id, 1, types)


def transitive_dependencies(edges: DataFrame, entity_id: str, repo_id: str | None = None, max_depth: int = DEFAULT_DEPTH, types=None) -> DataFrame:
    return dependencies(edges, entity_id, repo_id, max_depth, types)


def transitive_dependents(edges: DataFrame, entity_id: str, repo_id: str | None = None, max_depth: int = DEFAULT_DEPTH, types=None) -> DataFrame:
    return dependents(edges, entity_id, repo_id, max_depth, types)


def impact(nodes: DataFrame, edges: DataFrame, requests: DataFrame, max_depth: int = DEFAULT_DEPTH, types=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Change impact of many entities at once: (envelopes, impacted, files).

    requests: repository_id, entity_id, without repeats.  envelopes has a row for
    each: repo_exists, entity_exists (in that repository), found (both, and the id
    does not name another repository), the entity's name, label and file_path,
    blast_radius, directly_impacted, transitively_impacted, affected_file_count; an
    entity not found has null names and counts of 0.  impacted: (repository_id,
    entity_id, id, label, name, file_path, depth, direct, path_types), of found
    entities only; files: (repository_id, entity_id, path), distinct.  A blank or
    repeated request is not provided for: see ``validate``.
    """
    from codeweft.operators.explore import target_entity

    check_depth(max_depth)
    key = ["repository_id", "entity_id"]
    ask = requests.select(*key).distinct()
    wanted = ask.select(F.col("repository_id").alias("id")).union(ask.select("entity_id")).distinct()
    known = cut_lineage(target_entity(nodes).join(nodes.select("id", "repo_id"), "id").join(wanted, "id", "left_semi"))
    repos = known.where("label = 'Repository'").select(F.col("id").alias("repository_id"), F.lit(True).alias("_repo"))
    ents = known.select(F.col("id").alias("entity_id"), F.col("repo_id").alias("repository_id"), "name", "label", "file_path", F.lit(True).alias("_entity"))
    told = ask.join(repos, "repository_id", "left").join(ents, key, "left")
    other = F.coalesce(repo_of(F.col("entity_id")) != F.col("repository_id"), F.lit(False))
    told = cut_lineage(told.select(*key, F.coalesce("_repo", F.lit(False)).alias("repo_exists"), F.coalesce("_entity", F.lit(False)).alias("entity_exists"), other.alias("_other"), "name", "label", "file_path"))
    told = told.withColumn("found", F.col("repo_exists") & F.col("entity_exists") & ~F.col("_other")).drop("_other")
    seeds = told.where("found").select(F.col("entity_id").alias("seed"), F.col("repository_id").alias("repo_id"))
    reached = cut_lineage(traverse(edges, seeds, max_depth, types, True))
    asked = told.where("found").select("repository_id", F.col("entity_id").alias("seed"))
    impacted = (
        reached.join(target_entity(nodes), "id").join(asked, "seed")
        .select("repository_id", F.col("seed").alias("entity_id"), "id", "label", "name", "file_path", "depth", (F.col("depth") == 1).alias("direct"), "path_types")
    )
    files = affected_files(reached, nodes).join(asked, "seed").select("repository_id", F.col("seed").alias("entity_id"), "path")
    counts = impact_summary(reached).withColumnRenamed("seed", "entity_id")
    n_files = files.groupBy(*key).agg(F.count(F.lit(1)).alias("affected_file_count"))
    zero = F.lit(0).cast("long")
    out = told.join(counts, "entity_id", "left").join(n_files, key, "left").withColumns({c: F.when(F.col("found"), F.coalesce(c, zero)).otherwise(zero) for c in ("blast_radius", "directly_impacted", "transitively_impacted", "affected_file_count")})
    return out.withColumns({c: F.when(F.col("found"), F.col(c)) for c in ("name", "label", "file_path")}), impacted, files


def impact_summary(reached: DataFrame) -> DataFrame:
    """(seed, blast_radius, directly_impacted, transitively_impacted)."""
    return reached.groupBy("seed").agg(
        F.count(F.lit(1)).alias("blast_radius"), F.sum((F.col("depth") == 1).cast("long")).alias("directly_impacted"),
        F.sum((F.col("depth") > 1).cast("long")).alias("transitively_impacted"),
    )


def affected_files(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """(seed, path): distinct files of the reached nodes; nodes without a path are left out."""
    from codeweft.functions.ids import blank_to_null, normalize_path

    path = F.coalesce(blank_to_null(F.col("file_path")), blank_to_null(F.col("path")))
    return reached.join(nodes.select("id", "file_path", "path"), "id").select("seed", normalize_path(path).alias("path")).where("path IS NOT NULL").distinct()
