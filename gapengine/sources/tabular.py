"""Tabular test exports: header resolution and rows to tests."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gapengine import fixed
from gapengine.functions.extract import extract_conditions, feature_from_source, first_wins, infer_scenario, pair, detect_signals
from gapengine.functions.text import expand_compat, normalize, strings, trimmed
from gapengine.operators.sizing import materialise

FIELDS = list(fixed.COLUMN_ALIASES)


def canonical(header: object) -> str:
    """TXT-24 for the handful of header cells."""
    text = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", str(header or ""))
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(re.sub(r"[^a-z0-9 ]+", " ", text.replace("_", " ").lower()).split())


def map_headers(headers: Sequence[object]) -> dict[str, int]:
    """SRC-2: canonical field -> column position: exact names first, then names
    that contain, or are contained in, a longer alias."""
    names = [canonical(h) for h in headers]
    found: dict[str, int] = {}
    for field in FIELDS:
        exact = [i for i, n in enumerate(names) if n and n in fixed.COLUMN_ALIASES[field]]
        if exact:
            found[field] = exact[0]
    for field in FIELDS:
        if field in found:
            continue
        long_aliases = [a for a in fixed.COLUMN_ALIASES[field] if len(a) > 3]
        free = (i for i, n in enumerate(names) if n and i not in found.values())
        close = next((i for i in free if any(a in names[i] or names[i] in a for a in long_aliases)), None)
        if close is not None:
            found[field] = close
    return found


def usable(headers: Sequence[object]) -> bool:
    mapping = map_headers(headers)
    return "name" in mapping or "scenario" in mapping


def cell(c: Column) -> Column:
    """SRC-5: missing is empty, whole floats lose their ``.0``, ends trimmed."""
    return trimmed(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"^(-?\d+)\.0+$", "$1"))


def parse_inputs(raw: Column) -> Column:
    """SRC-4: ``k=v; k2: v2`` to pairs, first value of a key wins."""
    pieces = F.filter(F.split(raw, r"[;,\n|]+"), lambda s: s.rlike("(?U)" + fixed.INPUT_PAIR_PATTERN))
    pattern = "(?U)" + fixed.INPUT_PAIR_PATTERN

    def to_pair(s: Column) -> Column:
        key = F.replace(trimmed(normalize(F.regexp_extract(s, pattern, 1))), F.lit(" "), F.lit("_"))
        return pair(key, trimmed(F.regexp_extract(s, pattern, 2)))

    return first_wins(F.filter(F.transform(pieces, to_pair), lambda p: (p["key"] != "") & (p["value"] != "")))


def rows_to_tests(rows: DataFrame, framework: str = "csv") -> DataFrame:
    """SRC-3: rows ``(source, row_no, id, name, scenario, expected, feature, tags,
    inputs)`` to normalised tests; rows without any text are dropped."""
    c = {f: cell(F.col(f)) for f in FIELDS}
    df = rows.select("source", "row_no", *[c[f].alias(f) for f in FIELDS]).filter(
        (F.col("name") != "") | (F.col("scenario") != "") | (F.col("expected") != "")
    )
    df = expand_compat(df, "name", "scenario", "expected", "feature", "inputs")
    stem = F.regexp_replace(F.regexp_replace("source", r"^.*/", ""), r"\.[^.]*$", "")
    prefix = F.coalesce(F.when(stem != "", F.upper(stem)), F.lit("CSV"))
    df = df.withColumn(
        "test_id", F.when(F.col("id") != "", F.col("id")).otherwise(F.concat_ws("-", prefix, F.col("row_no").cast("string")))
    )
    df = df.withColumn(
        "_name",
        F.coalesce(*[F.when(x != "", x) for x in (F.col("name"), F.col("scenario"), F.col("test_id"))]),
    )
    split_tags = F.filter(F.transform(F.split("tags", "[;,|]+"), trimmed), lambda t: t != "")
    stated = [F.col(x) for x in ("_name", "scenario", "expected")]
    return df.select(
        "test_id",
        F.col("row_no").cast("bigint").alias("seq"),
        F.col("_name").alias("name"),
        F.when(F.col("feature") != "", F.initcap("feature")).otherwise(feature_from_source(F.col("source"))).alias("feature"),
        infer_scenario(F.col("scenario"), F.col("_name"), fallback=F.col("_name")).alias("scenario"),
        first_wins(parse_inputs(F.col("inputs")), extract_conditions(*stated)).alias("inputs"),
        F.col("expected").alias("expected_behavior"),
        split_tags.alias("tags"),
        "source",
        F.lit(framework).alias("framework"),
        F.lit(None).cast("int").alias("line_number"),
        strings([]).alias("assertions"),
        strings([]).alias("literals"),
        detect_signals(*stated, F.col("inputs")).alias("signals"),
        F.create_map(F.lit("row"), F.col("row_no").cast("string")).alias("extra"),
    )


def named_columns(table: DataFrame, source: str) -> DataFrame:
    """SRC-2 for one table that already has columns, such as a Parquet export."""
    mapping = map_headers(table.columns)
    if "name" not in mapping and "scenario" not in mapping:
        raise ValueError("no recognisable name or scenario column")
    columns = table.columns
    return table.select(
        F.lit(source).alias("source"),
        F.monotonically_increasing_id().alias("row_no"),
        *[
            (F.col(f"`{columns[mapping[f]]}`").cast("string") if f in mapping else F.lit("")).alias(f) for f in FIELDS
        ],
    )


ROW_SCHEMA = "source string, row_no int, " + ", ".join(f"`{f}` string" for f in FIELDS) + ", issue string"


CORRUPT = "_corrupt"


def read_split_exports(
    spark: SparkSession, paths: str | list[str], headers: Sequence[str], delimiter: str = ",", names: str = "*", lines_in_cells: bool = False,
) -> DataFrame:
    """SRC-1 where the layout is known: rows ``(source, row_no, fields, issue)`` of exports that all have the columns ``headers``.

    Spark reads the files itself: one large file is split over many tasks,
    cells may have any length, and files whose name doesn't fit the pattern
    ``names`` are never opened.  The first line of each file is its header.  A row with too many or too few cells has
    an ``issue``.  ``lines_in_cells``: cells may hold line ends, which costs the
    splitting.  ``row_no`` ascends with the place in the file and is no line
    number.
    """
    mapping = map_headers(headers)
    if "name" not in mapping and "scenario" not in mapping:
        raise ValueError("no recognisable name or scenario column")
    schema = ", ".join(f"_c{i} string" for i in range(len(headers))) + f", {CORRUPT} string"
    # Counting cells needs all of them, so the parser may not skip columns.
    table = spark.read.schema(schema).option("columnPruning", False).csv(
        paths, sep=delimiter, header=True, enforceSchema=True, multiLine=lines_in_cells, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT,
        quote='"', escape='"', maxCharsPerColumn=-1, recursiveFileLookup=True, pathGlobFilter=names,
    )
    # Splits start at multiples of a megabyte and more; inside one, rows count up.
    split = F.shiftleft(F.shiftright(F.col("_metadata.file_block_start"), 20), 33)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return table.select(
        F.col("_metadata.file_name").alias("source"), split.bitwiseOR(inside).alias("row_no"),
        *[(F.col(f"_c{mapping[f]}") if f in mapping else F.lit("")).alias(f) for f in FIELDS],
        F.when(F.col(CORRUPT).isNotNull(), F.lit("Row doesn't have the header's cells.")).alias("issue"),
    )


def rows_reader(header_rows: int):
    """SRC-1 inside a task; the header stands in one of the first ``header_rows`` rows."""
    return lambda files: read_rows(files, header_rows)


def read_rows(files: Iterator[pd.DataFrame], header_rows: int) -> Iterator[pd.DataFrame]:
    """SRC-1 inside a task: each file's rows under canonical names, or its issue."""
    import csv
    import io
    import sys

    csv.field_size_limit(sys.maxsize)  # cells of any length

    def issue(source: str, reason: str) -> dict:
        return {"source": source, "row_no": 0, **{f: "" for f in FIELDS}, "issue": reason}

    def rows_of(path: str, content: bytes):
        source = path.rsplit("/", 1)[-1]
        text = bytes(content).decode("utf-8-sig", errors="replace")
        if not text.strip():
            yield issue(source, "File is empty.")
            return
        try:
            delimiter = csv.Sniffer().sniff(text[:8192], delimiters=fixed.CSV_DELIMITERS).delimiter
        except csv.Error:
            delimiter = "\t" if path.lower().endswith(".tsv") else ","
        header, mapping = None, {}
        try:
            for n, row in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter), start=1):
                if header is None:
                    if n > header_rows:
                        break
                    if any(c.strip() for c in row) and usable(row):
                        header, mapping = n, map_headers(row)
                    continue
                if any(c.strip() for c in row):
                    values = {f: row[i] if i < len(row) else "" for f, i in mapping.items()}
                    yield {"source": source, "row_no": n, **{f: values.get(f, "") for f in FIELDS}, "issue": None}
        except csv.Error as error:
            yield issue(source, f"Malformed CSV: {error}")
        if header is None:
            yield issue(source, "No recognisable header row (need at least a name or scenario column).")

    columns = ["source", "row_no", *FIELDS, "issue"]
    for batch in files:
        for path, content in zip(batch["path"], batch["content"]):
            block: list[dict] = []
            for r in rows_of(path, content):
                block.append(r)
                if len(block) == 10_000:
                    yield pd.DataFrame(block, columns=columns)
                    block = []
            if block:
                yield pd.DataFrame(block, columns=columns)


def read_exports(files: DataFrame, header_rows: int = 10) -> tuple[DataFrame, DataFrame]:
    """SRC-1: ``(tests, issues)`` of delimited exports given as ``(path, content)``.
    Files are parsed once, for both results; all their rows are read."""
    rows = materialise(files.select("path", "content").mapInPandas(rows_reader(header_rows), ROW_SCHEMA))
    issues = rows.filter("issue is not null").select(
        F.col("source").alias("location"), F.col("issue").alias("reason"), F.lit("ERROR").alias("severity")
    )
    return rows_to_tests(rows.filter("issue is null")), issues
