"""The stored test catalogue: fingerprints, duplicates, ids, sources, search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, functions as F

from gapengine import fixed
from gapengine.functions.text import contains_any_case
from gapengine.operators.sizing import ordinal_within


def fingerprint(name: Column, feature: Column, scenario: Column, expected: Column, inputs: Column) -> Column:
    """SNK-2: same content, same hash; input order does not matter."""
    clean = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    shown = F.array_join(
        F.array_sort(F.transform(inputs, lambda p: F.concat(p["key"], F.lit("="), p["value"]))), ";"
    )
    return F.sha2(
        F.concat_ws("|", clean(name), clean(feature), clean(scenario), clean(expected), F.coalesce(shown, F.lit(""))), 256
    )


def with_fingerprint(tests: DataFrame) -> DataFrame:
    return tests.withColumn(
        "fingerprint",
        fingerprint(*[F.col(c) for c in ("name", "feature", "scenario", "expected_behavior", "inputs")]),
    )


def without_duplicates(tests: DataFrame, others: DataFrame | None = None, seq: str = "seq") -> DataFrame:
    """SNK-3/JON-13: the first of each fingerprint, none another source already has.

    A minimum per fingerprint combines map-side, so copies making up a third of
    the catalogue collapse before the shuffle; a window would sort them in one task.
    """
    if others is not None:
        tests = tests.join(others.select("fingerprint").distinct(), "fingerprint", "left_anti")
    rest = [c for c in tests.columns if c not in ("fingerprint", seq)]
    return tests.groupBy("fingerprint").agg(
        F.min_by(F.struct(*rest), F.col(seq)).alias("_r"), F.min(seq).alias(seq)
    ).select(*[F.col(f"_r.{c}").alias(c) for c in rest], "fingerprint", seq)


def unique_ids(
    tests: DataFrame, test_id: str = "test_id", order: list | None = None, within: tuple[str, ...] = ("source_id",),
    coarse: Column | None = None,
) -> DataFrame:
    """SNK-4: ``id``, ``id#2``, ``id#3`` ... in order inside a source.  ``coarse``
    spreads an id shared by very many tests (see ``ordinal_within``)."""
    base = F.when(F.coalesce(test_id, F.lit("")) != "", F.col(test_id)).otherwise(F.lit("TEST"))
    df = ordinal_within(
        tests.withColumn("_base", base), [*within, "_base"], order or [F.col("seq")], coarse, "_turn"
    )
    shown = F.when(F.col("_turn") == 1, F.col("_base")).otherwise(F.concat_ws("#", "_base", F.col("_turn").cast("string")))
    return df.withColumn(test_id, shown).drop("_base", "_turn")


def upsert_sources(sources: DataFrame, incoming: DataFrame) -> DataFrame:
    """SNK-5: by (kind, location); a blank label keeps the old one, new sources
    get ids after the largest."""
    new = incoming.select("kind", "location", F.col("label").alias("_label")).dropDuplicates(["kind", "location"])
    both = sources.join(new, ["kind", "location"], "full_outer")
    top = sources.agg(F.coalesce(F.max("source_id"), F.lit(0)).alias("_top"))
    fresh = ordinal_within(both.filter("source_id is null").withColumn("_one", F.lit(1)), ["_one"], [F.col("kind"), F.col("location")], None, "_n")
    fresh = fresh.join(F.broadcast(top)).withColumn("source_id", (F.col("_top") + F.col("_n")).cast("bigint")).drop("_one", "_n", "_top")
    kept = both.filter("source_id is not null")
    label = F.coalesce(F.when(F.col("_label") != "", F.col("_label")), F.col("label"))
    return kept.unionByName(fresh).withColumn("label", label).drop("_label")


def replace_source_tests(tests: DataFrame, path: str) -> None:
    """SNK-1: overwrite the partitions of the sources in ``tests``, leave others.
    The raw body is never stored (FLT-7)."""
    (
        tests.drop("code").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("source_id").parquet(path)
    )


def ingest(tests: DataFrame, stored: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """SNK-1..4/SNK-13: the rows to store and the metrics of one load."""
    marked = with_fingerprint(tests)
    others = None if stored is None else stored.join(tests.select("source_id").distinct(), "source_id", "left_anti")
    kept = unique_ids(without_duplicates(marked, others))
    metrics = tests.agg(F.count(F.lit(1)).alias("discovered")).join(
        F.broadcast(kept.agg(F.count(F.lit(1)).alias("stored")))  # one row each
    )
    return kept, metrics.withColumn("duplicates", F.col("discovered") - F.col("stored"))


def ingest_in_one_pass(
    rows: DataFrame, to_tests: Callable[[DataFrame], DataFrame], path: str, others: DataFrame | None = None,
) -> dict[str, int]:
    """SNK-1..4/SNK-12/SNK-13: write the tests of ``rows`` to ``path`` and return the load's metrics, counted on the way.

    ``rows`` are a reader's, with a column ``issue``; ``to_tests`` makes tests
    with a ``source_id`` of those without.  One job reads, counts, drops
    duplicates and writes.  scanned: rows read; issues: rows with one; skipped:
    rows without any text; discovered: tests; duplicates and stored: tests left
    out and written.  Counts are exact unless a task of the reading stage ran
    again after its executor was lost: the rows written are right even then,
    and ``stored`` can be counted again from them.
    """
    read, found, kept = Observation(), Observation(), Observation()
    n = F.count(F.lit(1))
    seen = rows.observe(read, n.alias("scanned"), F.count_if(F.col("issue").isNotNull()).alias("issues"))
    tests = to_tests(seen.filter("issue is null").drop("issue")).observe(found, n.alias("discovered"))
    stored = unique_ids(without_duplicates(with_fingerprint(tests), others)).observe(kept, n.alias("stored"))
    stored.write.mode("overwrite").parquet(path)
    m = {**read.get, **found.get, **kept.get}
    return m | {"skipped": m["scanned"] - m["issues"] - m["discovered"], "duplicates": m["discovered"] - m["stored"]}


def catalogue(stored: DataFrame) -> DataFrame:
    """SRC-12: every stored test; ``seq`` carries insertion order.  The key of a
    test is its source and id together."""
    return stored.withColumn("test_key", F.concat_ws("/", F.col("source_id").cast("string"), "test_id"))


def search_tests(
    tests: DataFrame, query: str | None = None, feature: str | None = None, framework: str | None = None
) -> DataFrame:
    """FLT-1; all predicates are plain column filters, so they reach the scan."""
    if feature:
        tests = tests.filter(F.col("feature") == feature)
    if framework:
        tests = tests.filter(F.col("framework") == framework)
    if query:
        tests = tests.filter(contains_any_case(query, F.col("name"), F.col("scenario"), F.col("test_id")))
    return tests


def page(df: DataFrame, order: list, limit: int = 50, offset: int = 0) -> DataFrame:
    """LIM-1/LIM-2."""
    return df.orderBy(*order).offset(offset).limit(limit)


def counted_page(df: DataFrame, order: list, limit: int = 50, offset: int = 0) -> DataFrame:
    """LIM-1/LIM-2: a page whose rows also carry the ``total`` of all hits."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return page(df, order, limit, offset).join(F.broadcast(total))  # one row


def test_items(tests: DataFrame) -> DataFrame:
    """FLT-9: what a list of tests shows."""
    return tests.select("test_id", "name", "feature", "scenario", "framework", "source", "line_number")


def incident_items(incidents: DataFrame, shown: int = 400) -> DataFrame:
    """FLT-9: what a list of incidents shows; the description is cut for display only."""
    return incidents.withColumn("description", F.substring("description", 1, shown)).select("incident_id", "title", "feature", "severity", "description")


def search_incidents(
    incidents: DataFrame, latest: DataFrame, query: str | None = None, feature: str | None = None, coverage: str | None = None
) -> DataFrame:
    """FLT-2/JON-8: filters on incidents before the join, on the verdict after it."""
    if feature:
        incidents = incidents.filter(F.col("feature") == feature)
    if query:
        incidents = incidents.filter(contains_any_case(query, F.col("title"), F.col("description"), F.col("incident_id")))
    joined = incidents.join(latest, "incident_id", "left")
    return joined.filter(F.col("coverage") == coverage) if coverage else joined


def catalogue_stats(tests: DataFrame) -> DataFrame:
    """AGG-10 in one pass: ``(dimension, value, n)`` for the total, features and
    frameworks."""
    g = tests.groupingSets([["feature"], ["framework"], []], "feature", "framework").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g")
    )
    return g.select(
        F.when(F.col("_g") == 1, "feature").when(F.col("_g") == 2, "framework").otherwise("total").alias("dimension"),
        F.coalesce("feature", "framework", F.lit("")).alias("value"),
        "n",
    )


def verdict_mix(decided: DataFrame) -> DataFrame:
    """AGG-20."""
    return decided.groupBy("coverage").agg(F.count(F.lit(1)).alias("n"))


def sources_by_id(sources: DataFrame, source_id: int | None = None) -> DataFrame:
    """LIM-8."""
    return sources.orderBy("source_id") if source_id is None else sources.filter(F.col("source_id") == source_id)


