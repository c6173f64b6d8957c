"""Evaluation and dashboard reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gapengine import fixed
from gapengine.operators.catalogue import catalogue_stats
from gapengine.operators.history import coverage_counts, latest_analysis
from gapengine.operators.patterns import strongest


def judged_predictions(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """JON-14: predictions with their labels; unlabelled ones are skipped."""
    return predicted.join(truth.select("incident_id", "expected_coverage", "expected_family"), "incident_id").withColumn(
        "actual_family", F.coalesce("family_key", F.lit("NONE"))
    )


def confusion_matrix(judged: DataFrame) -> DataFrame:
    """AGG-18: expected by predicted verdict."""
    return judged.groupBy("expected_coverage").pivot("coverage", fixed.COVERAGES).count().na.fill(0)


def quality(judged: DataFrame) -> DataFrame:
    """AGG-18: accuracy of verdict and family, same-feature retrieval, confidence."""
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return judged.agg(
        F.count(F.lit(1)).alias("n"),
        share(F.col("coverage") == F.col("expected_coverage")).alias("coverage_accuracy"),
        share(F.col("actual_family") == F.col("expected_family")).alias("family_accuracy"),
        share(F.col("same_feature_found")).alias("retrieval_rate"),
        F.round(F.avg("confidence"), 6).alias("mean_confidence"),
    )


def mismatches(judged: DataFrame) -> DataFrame:
    return judged.filter("coverage <> expected_coverage or actual_family <> expected_family")


def dashboard(incidents: DataFrame, analyses: DataFrame, gaps: DataFrame, tests: DataFrame, patterns: DataFrame) -> DataFrame:
    """AGG-19/AGG-12: the headline numbers as ``(metric, n)`` rows."""
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("metric"), "n")
    counts = coverage_counts(latest_analysis(analyses)).select(F.lower("coverage").alias("metric"), "n")
    parts = [
        one("incidents", incidents), one("test_gaps", gaps), one("patterns", patterns),
        catalogue_stats(tests).filter("dimension = 'total'").select(F.lit("tests_indexed").alias("metric"), "n"),
    ]
    for p in parts:
        counts = counts.unionByName(p)
    return counts


def recent(df: DataFrame, by: str, limit: int, key: str = "incident_id") -> DataFrame:
    """LIM-3/LIM-4: newest first, equal times by ``key``."""
    return df.orderBy(F.desc(by), key).limit(limit)


def dashboard_sections(
    metrics: DataFrame, stats: DataFrame, patterns: DataFrame, incidents: DataFrame, latest: DataFrame, runs: DataFrame,
    n_patterns: int = 5, n_incidents: int = 8, n_runs: int = 6,
) -> DataFrame:
    """AGG-19 whole, as (section, name, value): the headline numbers, catalogue
    counts, strongest patterns, newest incidents with their verdict (LIM-3) and
    newest runs."""
    newest = recent(incidents, "arrival", n_incidents).join(latest.select("incident_id", "coverage"), "incident_id", "left")
    text = lambda c: F.col(c).cast("string")
    return (
        metrics.select(F.lit("metric").alias("section"), F.col("metric").alias("name"), text("n").alias("value"))
        .unionByName(stats.select(F.lit("catalogue").alias("section"), F.concat_ws(":", "dimension", "value").alias("name"), text("n").alias("value")))
        .unionByName(strongest(patterns, n_patterns).select(F.lit("pattern").alias("section"), F.col("label").alias("name"), text("incident_count").alias("value")))
        .unionByName(newest.select(F.lit("incident").alias("section"), text("incident_id").alias("name"), F.coalesce("coverage", F.lit("")).alias("value")))
        .unionByName(recent(runs, "started_at", n_runs, "run_id").select(F.lit("run").alias("section"), text("run_id").alias("name"), text("kind").alias("value")))
    )
