"""From files to a graph: entities of all seven kinds, resolved edges between them, and what there was to count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from codeweft.functions.ids import entity_id, module_info
from codeweft.functions.validate import RELATIONSHIP_TYPES
from codeweft.operators.facts import extract_facts, table_of
from codeweft.operators.resolution import resolve_edges
from codeweft.sources.tables import cut_lineage

_TEXTS = ("name", "qualified_name", "path", "file_path", "language", "docstring", "module_name", "imported_name", "alias")
_NUMBERS = ("start_line", "end_line", "start_byte", "end_byte")
NODE_COLUMNS = ("id", "repo_id", "label", *_TEXTS, *_NUMBERS)


def _rows(df: DataFrame, label: Column | str, id_: Column, **cols: Column) -> DataFrame:
    none = {c: F.lit(None).cast("string") for c in _TEXTS} | {c: F.lit(None).cast("bigint") for c in _NUMBERS}
    have = none | cols
    order = have.pop("ord", F.lit(0)).cast("bigint")
    return df.select(id_.alias("id"), "repo_id", (F.lit(label) if isinstance(label, str) else label).alias("label"), *[have[c].alias(c) for c in (*_TEXTS, *_NUMBERS)], order.alias("ord"))


def entity_rows(facts: DataFrame) -> DataFrame:
    """Rows of all entities as they are found, repeats included (see NODE_COLUMNS), with their order in the file."""
    repo, path, python = F.col("repo_id"), F.col("file_path"), F.lit("python")
    short, dotted = module_info(path)
    span = {c: F.col(c) for c in _NUMBERS}
    imports = table_of(facts, "imports")
    tail = F.concat("file_path", F.lit("::L"), F.col("start_line").cast("string"), F.lit("::"), "imported_name")
    parts = [
        _rows(facts.select("repo_id").distinct(), "Repository", repo, name=F.regexp_replace("repo_id", "^repo::", "")),
        _rows(facts, "File", entity_id(repo, "file", path), path=path, language=python, start_line=F.lit(1), end_line=F.col("end_line"), start_byte=F.lit(0), end_byte=F.col("end_byte")),
        _rows(facts, "Module", entity_id(repo, "module", dotted), name=short, qualified_name=dotted, file_path=path),
        _rows(
            table_of(facts, "defs"), F.initcap("kind"), F.concat("repo_id", F.lit("::"), "kind", F.lit("::"), "qname"),
            name=F.col("name"), qualified_name=F.col("qname"), file_path=path, language=python, docstring=F.col("docstring"), ord=F.col("ord"), **span,
        ),
        _rows(imports, "Import", entity_id(repo, "import", tail), file_path=path, module_name=F.col("module_name"), imported_name=F.col("imported_name"), alias=F.col("alias"), ord=F.col("ord"), **span),
    ]
    return reduce(DataFrame.unionByName, parts)


def graph_of(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of facts, one row a file: the last of the entities with one id, and the resolved edges whose two ends are among them."""
    facts = cut_lineage(facts)
    rest = [c for c in NODE_COLUMNS if c != "id"]
    nodes = entity_rows(facts).groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("ord", "start_line", "file_path")).alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in rest])
    nodes = cut_lineage(nodes)
    ids = nodes.select("id")
    edges = resolve_edges(facts).join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return nodes, edges.select("repo_id", "rel_type", "source_id", "target_id").orderBy("rel_type", "source_id", "target_id")


def summary(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, files, modules, classes, functions, methods, imports, relationships): what was found, repeats included, and the edges before any is stored."""
    labels = {"files": "File", "modules": "Module", "classes": "Class", "functions": "Function", "methods": "Method", "imports": "Import", "relationships": "edge"}
    both = entity_rows(facts).select("repo_id", "label").unionByName(edges.select("repo_id", F.lit("edge").alias("label")))
    return both.groupBy("repo_id").agg(*[F.count_if(F.col("label") == v).alias(k) for k, v in labels.items()])


def analyze(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, summary) of Python files: repo_id, file_path, content, one row a file."""
    facts = cut_lineage(extract_facts(files))
    nodes, edges = graph_of(facts)
    return nodes, edges, summary(facts, edges)


def relationships(rows: DataFrame, rel_type: str | None = None) -> DataFrame:
    """Edges made from rows with source_id and target_id (and rel_type, if none is given): ids trimmed, types in upper case, metadata at least empty.

    A type of no edge, or a blank id, is an error as soon as the row is read.
    """
    if rel_type is not None and rel_type not in RELATIONSHIP_TYPES:
        raise ValueError(f"unknown relationship type: {rel_type}")
    kind = F.upper(F.trim("rel_type")) if rel_type is None else F.lit(rel_type)

    def checked(c: Column, good: Column, what: str) -> Column:
        return F.when(F.coalesce(good, F.lit(False)), c).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(c, F.lit("null")))).cast("string"))

    s, t = F.trim("source_id"), F.trim("target_id")
    meta = F.coalesce("metadata", F.create_map().cast("map<string,string>")) if "metadata" in rows.columns else F.create_map().cast("map<string,string>")
    place = [F.col("location")] if "location" in rows.columns else []
    return rows.select(
        checked(kind, kind.isin(*RELATIONSHIP_TYPES), "unknown relationship type").alias("rel_type"), checked(s, s != "", "blank source id").alias("source_id"),
        checked(t, t != "", "blank target id").alias("target_id"), *place, meta.alias("metadata"),
    )


def contains(rows: DataFrame) -> DataFrame:
    return relationships(rows, "CONTAINS")


def imports(rows: DataFrame) -> DataFrame:
    return relationships(rows, "IMPORTS")


def calls(rows: DataFrame) -> DataFrame:
    return relationships(rows, "CALLS")


def inherits(rows: DataFrame) -> DataFrame:
    return relationships(rows, "INHERITS")


def chosen_sources(*by_rank: DataFrame | None) -> DataFrame:
    """(repo_id, file_path, content): of several givers of content the first that has a file counts; null givers are left out."""
    parts = [df.select("repo_id", "file_path", "content", F.lit(i).alias("_rank")) for i, df in enumerate(by_rank) if df is not None]
    if not parts:
        raise ValueError("at least one source of content is needed")
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("repo_id", "file_path").agg(F.min_by("content", F.struct("_rank", F.xxhash64("content"))).alias("content"))
