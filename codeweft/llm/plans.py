"""Registered queries of the text and source problems, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeweft.llm import docpairs, leakage, packing, personal, provenance, syntax
from codeweft.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_files(table(spark, d, "parse_result"))


def p1_repairs(spark: SparkSession, d: str) -> DataFrame:
    return syntax.syntax_repairs(table(spark, d, "parse_result"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return syntax.syntax_report(table(spark, d, "parse_result"))


def p1_recorded(spark: SparkSession, d: str) -> DataFrame:
    return syntax.recorded_types(table(spark, d, "parse_result"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    cols = ["id", "repo_id", "qualified_name", "file_path", "docstring", "observed_at"]
    nodes = table(spark, d, "function_node").select(*cols).unionByName(table(spark, d, "method_node").select(*cols))
    return docpairs.documented_pairs(nodes, table(spark, d, "parse_result"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("entity_id")


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).where(F.col("source").isNotNull())


def p5_doc_comments(spark: SparkSession, d: str) -> DataFrame:
    """Code-description pairs straight from the files, JavaScript too."""
    says = F.pandas_udf(docpairs.informative_batch, "boolean")
    return docpairs.extract_functions(table(spark, d, "parse_result")).where(says("doc", "qualified_name", "params")).select("repo_id", "file_path", "qualified_name", "source", "doc")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance.not_by_hand(table(spark, d, "parse_result"), table(spark, d, "upstream_file")).select("repo_id", "file_path")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return provenance.provenance_report(table(spark, d, "parse_result"), table(spark, d, "upstream_file"))


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.token_counts(table(spark, d, "documents"), "doc_id", "text"), "doc_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(p7_packing(spark, d))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "benchmark_item"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(_leaks(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.find_personal(table(spark, d, "documents")).select("doc_id", "pii_kind", "found_text").distinct()


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return personal.redact(docs, personal.find_personal(docs))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_repairs, p1_report, p1_recorded, p5_found, p5_pairs, p5_doc_comments, p6_found, p6_report,
        p7_packing, p7_report, p8_found, p8_report, p9_found, p9_redacted,
    )
}
#: No SQL reads these: the tests hold them against brute force, round trips and the readers of the languages.
ORACLES: dict[str, str] = {}
