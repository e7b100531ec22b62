"""Registered queries over the current Python files: extraction and resolution. No SQL reads Python; tests hold them against a golden fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeweft.functions.ids import entity_id
from codeweft.operators.analysis import analyze
from codeweft.operators.facts import extract_facts, syntax_nodes, table_of
from codeweft.operators.resolution import resolve_edges
from codeweft.sources.tables import table


def current_python(spark: SparkSession, d: str) -> DataFrame:
    """Current content of the .py files: keys choose the revision, content is shuffled once for those only."""
    f = table(spark, d, "parse_result").where("file_path LIKE '%.py' AND repo_id IS NOT NULL").select("repo_id", "file_path", "content", "parsed_at")
    f = f.withColumn("h", F.xxhash64("content"))
    last = f.groupBy("repo_id", "file_path").agg(F.max(F.struct("parsed_at", "h")).alias("m")).select("repo_id", "file_path", "m.parsed_at", "m.h")
    return f.join(last, ["repo_id", "file_path", "parsed_at", "h"], "left_semi").dropDuplicates(["repo_id", "file_path"])


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return extract_facts(current_python(spark, d))


def c_definitions(spark: SparkSession, d: str) -> DataFrame:
    x = table_of(_facts(spark, d), "defs")
    return x.select(F.concat("repo_id", F.lit("::"), "kind", F.lit("::"), "qname").alias("id"), "repo_id", "kind", "name", "file_path", "start_line", "end_line", "start_byte", "end_byte", "docstring")


def c_imports(spark: SparkSession, d: str) -> DataFrame:
    x = table_of(_facts(spark, d), "imports")
    tail = F.concat("file_path", F.lit("::L"), F.col("start_line").cast("string"), F.lit("::"), "imported_name")
    return x.select(entity_id(F.col("repo_id"), "import", tail).alias("id"), "repo_id", "file_path", "module_name", "imported_name", "alias", "start_line", "end_line", "start_byte", "end_byte")


def c_files(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d).select("repo_id", "file_path", "has_syntax_errors", "end_line", "end_byte", F.size("defs").alias("n_defs"), F.size("imports").alias("n_imports"))


def c_edges(spark: SparkSession, d: str) -> DataFrame:
    return resolve_edges(_facts(spark, d))


def c_edge_counts(spark: SparkSession, d: str) -> DataFrame:
    return c_edges(spark, d).groupBy("repo_id", "rel_type").agg(F.count(F.lit(1)).alias("n"))


def c_span_check(spark: SparkSession, d: str) -> DataFrame:
    """Stored functions and methods against those read from the current files: found at the stored place, moved, or gone."""
    read = c_definitions(spark, d).where("kind IN ('function', 'method')").groupBy("id").agg(F.min("start_line").alias("line"))
    cols = ["id", "repo_id", "start_line", "observed_at"]
    stored = table(spark, d, "function_node").select(*cols).unionByName(table(spark, d, "method_node").select(*cols)).where("id IS NOT NULL")
    last = stored.groupBy("id").agg(F.max(F.struct("observed_at", "repo_id", "start_line")).alias("r")).select("id", "r.repo_id", "r.start_line")
    state = F.when(F.col("line").isNull(), "gone").when(F.col("line") == F.col("start_line"), "same").otherwise("moved")
    return last.join(read, "id", "left").groupBy("repo_id", state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def c_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Entities of all seven kinds of the current files."""
    return analyze(current_python(spark, d))[0]


def c_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose two ends are among them."""
    return analyze(current_python(spark, d))[1]


def c_analysis(spark: SparkSession, d: str) -> DataFrame:
    return analyze(current_python(spark, d))[2]


def c_syntax_errors(spark: SparkSession, d: str) -> DataFrame:
    """What of the current Python files does not parse, and where."""
    return table_of(_facts(spark, d), "errors")


def c_node_types(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the trees of the current files by type and repository."""
    return syntax_nodes(current_python(spark, d)).groupBy("repo_id", "node_type").agg(F.count(F.lit(1)).alias("n"))


def c_error_handlers(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of two types: where errors are raised and caught."""
    return syntax_nodes(current_python(spark, d), ["Raise", "ExceptHandler"]).select("repo_id", "file_path", "node_type", "start_line", "start_column")


QUERIES = {f.__name__: f for f in (c_definitions, c_imports, c_files, c_edges, c_edge_counts, c_span_check, c_graph_nodes, c_graph_edges, c_analysis, c_syntax_errors, c_node_types, c_error_handlers)}
ORACLES: dict[str, str] = {}
