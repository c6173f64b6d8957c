"""File listings, routing by kind, incident documents, incident lists and labels."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gapengine import fixed
from gapengine.functions.extract import pair
from gapengine.functions.text import trimmed
from gapengine.schemas import RAW_INCIDENT_SCHEMA, TEST_SCHEMA, TRUTH_SCHEMA
from gapengine.sources.code import read_source_files
from gapengine.sources.tabular import read_exports


def file_kind(path: Column) -> Column:
    """SRC-14: which reader a path belongs to, NULL for none."""
    name = F.lower(F.regexp_replace(path, r"^.*/", ""))
    return (
        F.when(name.rlike(r"\.(csv|tsv|txt)$"), F.lit("csv"))
        .when(name.rlike(r"^test_.*\.py$|_test\.py$|^conftest\.py$"), F.lit("pytest"))
        .when(name.rlike(r"\.(test|spec)\.") & name.rlike(r"\.(js|jsx|ts|tsx|mjs|cjs)$"), F.lit("jest"))
    )


def list_files(
    files: DataFrame, root: str = "", max_bytes: int | None = None, max_depth: int | None = None,
    kinds: Callable[[Column], Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """SRC-6: ``(accepted, issues)`` of a file listing ``(path, length, ...)``.

    Works on path and length alone.  No file is left out for its size or depth
    unless the caller sets a limit; one that is becomes an issue.
    """
    path = F.regexp_replace("path", r"^file:/*", "/")
    relative = F.ltrim(F.when(path.startswith(root), path.substr(len(root) + 1, 100_000)).otherwise(path), F.lit("/"))
    parts = F.split(relative, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    hidden = F.exists(folders, lambda d: d.isin(fixed.IGNORED_DIRECTORIES) | d.startswith("."))
    seen = (
        files.withColumns({"source": relative, "kind": (kinds or file_kind)(relative)})
        .filter(F.col("kind").isNotNull() & ~hidden)
    )
    reason = F.when(F.col("length") == 0, F.lit("File is empty."))
    if max_bytes is not None:
        reason = reason.when(F.col("length") > max_bytes, F.lit(f"File exceeds the {max_bytes} byte limit; skipped."))
    if max_depth is not None:
        reason = reason.when(F.size(folders) >= max_depth, F.lit(f"File lies {max_depth} folders deep or deeper; skipped."))
    marked = seen.withColumn("reason", reason)
    issues = marked.filter("reason is not null").select(F.col("source").alias("location"), "reason", F.lit("WARNING").alias("severity"))
    return marked.filter("reason is null").drop("reason"), issues


def scan(
    spark: SparkSession, root: str, kinds: Callable[[Column], Column] | None = None, max_bytes: int | None = None,
) -> DataFrame:
    """SRC-6: the files under ``root`` with their content.

    With ``kinds``, files that no reader takes, and with ``max_bytes`` larger
    ones, are left out while files are listed: the conditions are on the files'
    metadata, so content that they reject is not read.  What ``list_files`` is
    to report must be listed, so give it a scan without them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    if kinds is not None:
        files = files.filter(kinds(F.col("_metadata.file_path")).isNotNull())
    if max_bytes is not None:
        files = files.filter(F.col("_metadata.file_size") <= max_bytes)
    return files


def read_catalogue(
    files: DataFrame, source_id: Column, root: str = "", kinds: Callable[[Column], Column] = file_kind,
    readers: dict[str, Callable[[DataFrame], tuple[DataFrame, DataFrame]]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """SRC-13/SRC-14/UDF-1: every supported file through its reader, united.

    ``kinds`` names the kind of a path; ``readers`` adds readers of further
    kinds, each from files (path, content) to (tests, issues).
    """
    accepted, rejected = list_files(files, root, kinds=kinds)
    accepted = accepted.withColumn("path", F.col("source"))
    exports, export_issues = read_exports(accepted.filter("kind = 'csv'"))
    code, code_issues = read_source_files(accepted.filter("kind in ('pytest', 'jest')"))
    more = [read(accepted.filter(F.col("kind") == kind)) for kind, read in (readers or {}).items()]
    tests = unite(exports, code, *[t for t, _ in more]).withColumn("source_id", source_id)
    return tests, unite(rejected, export_issues, code_issues, *[i for _, i in more])


def unite(*frames: DataFrame) -> DataFrame:
    """SRC-13."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def unsupported(files: DataFrame) -> DataFrame:
    """SRC-14: uploads no reader takes."""
    return files.filter(file_kind(F.col("path")).isNull()).select(
        F.col("path").alias("location"), F.lit("Unsupported file type.").alias("reason"), F.lit("ERROR").alias("severity")
    )


def stored_tests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TEST_SCHEMA + ", fingerprint STRING").parquet(path)


# ---------------------------------------------------------------------- incidents


def incident_documents(docs: DataFrame) -> DataFrame:
    """SRC-9: ``(path, value)`` documents to raw incidents.  A JSON object gives
    structured fields, its text from ``description``, else ``text``, else the raw
    JSON; anything else is plain text."""
    parsed = F.from_json(
        "value", RAW_INCIDENT_SCHEMA + ", description STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    )
    is_object = F.lower("path").endswith(".json") & F.try_parse_json("value").isNotNull() & trimmed(F.col("value")).startswith("{")
    filled = lambda c: F.when(trimmed(c) != "", c)
    d = docs.withColumns({"j": F.when(is_object, parsed)})
    return d.select(
        F.coalesce("j.id", F.sha2("value", 256)).alias("incident_id"),
        F.coalesce(filled(F.col("j.description")), filled(F.col("j.text")), F.col("value")).alias("text"),
        *[F.col(f"j.{c}").alias(c) for c in ("title", "feature", "severity", "occurred_at")],
        pairs_of(F.col("j.conditions")).alias("conditions"),
    )


def pairs_of(conditions: Column) -> Column:
    """A JSON object's members as pairs, in the order they are written in."""
    entries = F.map_entries(conditions)
    return F.coalesce(
        F.transform(F.filter(entries, lambda e: e["value"].isNotNull()), lambda e: pair(e["key"], e["value"])),
        F.array().cast("array<struct<key:string,value:string>>"),
    )


def read_incident_documents(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return incident_documents(docs.filter(F.lower("path").rlike(r"\.(txt|md|log|json)$")))


def read_incident_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10."""
    return spark.read.schema(RAW_INCIDENT_SCHEMA).json(path, multiLine=True).select(
        F.col("id").alias("incident_id"), "text", "title", "feature", "severity", "occurred_at",
        pairs_of(F.col("conditions")).alias("conditions"),
    )


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11."""
    return spark.read.schema(TRUTH_SCHEMA).json(path, multiLine=True).select(F.explode("incidents").alias("t")).select(
        F.col("t.id").alias("incident_id"), "t.feature", "t.expected_coverage", "t.expected_family", "t.note"
    )
