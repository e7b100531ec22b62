"""Current content of source files, without shuffling the content."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

EXTENSIONS = {"py": "python", "js": "javascript", "json": "json", "toml": "toml"}


def with_language(files: DataFrame) -> DataFrame:
    """Adds ``lang`` by the extension of file_path (null: none of the four)."""
    ext = F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1))
    pairs = [x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.lit(v))]
    return files.withColumn("lang", F.create_map(*pairs)[ext])


def current_revisions(files: DataFrame) -> DataFrame:
    """(repo_id, file_path, _rev): which revision of each file is current, by the greatest parsed_at.

    Keys and hashes only are shuffled.  Rows with no repo_id or file_path name no
    file.  A null parsed_at is older than any other.  Revisions with the same
    parsed_at and other content: the greater content hash counts, so a rerun
    agrees.  Null content counts as an empty file.
    """
    return (
        files.where(F.col("repo_id").isNotNull() & F.col("file_path").isNotNull())
        .groupBy("repo_id", "file_path")
        .agg(F.max(F.struct("parsed_at", F.xxhash64(F.coalesce("content", F.lit(""))).alias("h"))).alias("_rev"))
    )


def keep_current(derived: DataFrame) -> DataFrame:
    """The rows of the current revision, one for each file; derived: repo_id, file_path, parsed_at, h (content hash) and small results."""
    rest = [c for c in derived.columns if c not in ("repo_id", "file_path", "parsed_at", "h")]
    return (
        derived.where(F.col("repo_id").isNotNull() & F.col("file_path").isNotNull())
        .groupBy("repo_id", "file_path")
        .agg(F.max(F.struct("parsed_at", "h", *rest)).alias("_r"))
        .select("repo_id", "file_path", *[F.col(f"_r.{c}").alias(c) for c in rest])
    )


def revisions(files: DataFrame, *more: str) -> DataFrame:
    """(repo_id, file_path, parsed_at, h, lang, content, *more) of every row that names a file, null content as ''."""
    return with_language(
        files.where(F.col("repo_id").isNotNull() & F.col("file_path").isNotNull())
        .select("repo_id", "file_path", "parsed_at", F.coalesce("content", F.lit("")).alias("content"), *more)
    ).withColumn("h", F.xxhash64("content"))
