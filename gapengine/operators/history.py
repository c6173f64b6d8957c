"""Stored analyses: latest ones, recurrence, reassembly and status changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gapengine import fixed
from gapengine.functions.text import family_key, known_code, lookup, strings
from gapengine.operators.sizing import running_total


def latest_analysis(analyses: DataFrame, key: str = "incident_id", seq: str = "analysis_id") -> DataFrame:
    """RNK-6: one row per incident, the largest sequence wins; combines map-side."""
    rest = [c for c in analyses.columns if c not in (key, seq)]
    packed = analyses.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r"), F.max(seq).alias(seq))
    return packed.select(key, seq, "_r.*")


def coverage_counts(latest: DataFrame) -> DataFrame:
    """AGG-11: incidents per verdict, zero for verdicts nobody has."""
    verdicts = latest.sparkSession.range(1).select(F.explode(strings(fixed.COVERAGES)).alias("coverage"))
    counts = latest.groupBy("coverage").agg(F.count(F.lit(1)).alias("n"))
    return verdicts.join(counts, "coverage", "left").select("coverage", F.coalesce("n", F.lit(0)).alias("n"))


def gap_observations(incidents: DataFrame, analyses: DataFrame, gaps: DataFrame) -> DataFrame:
    """JON-9: gaps of each incident's latest analysis, flattened."""
    latest = latest_analysis(analyses).select("incident_id", "analysis_id", "coverage")
    return (
        latest.join(gaps, "analysis_id")
        .join(incidents.select("incident_id", "feature", "severity", "arrival"), "incident_id")
        .select(
            "incident_id", known_code(F.col("gap_type"), [g for _, m in fixed.GAP_FAMILIES.values() for g in m], "MISSING_TEST").alias("gap_type"),
            "family_key", "feature", "severity", "coverage", "arrival",
        )
    )


def recurrence_counts(gaps: DataFrame) -> DataFrame:
    """AGG-13: distinct incidents per family."""
    return gaps.select("family_key", "incident_id").distinct().groupBy("family_key").agg(
        F.count(F.lit(1)).alias("n_incidents")
    )


def implied_families(signals: Column) -> Column:
    """Families an incident's signals point at."""
    pointed = F.array_compact(
        F.array(*[F.when(F.array_contains(signals, s), F.lit(g)) for s, g in fixed.SIGNAL_GAP_TYPES])
    )
    return F.array_distinct(F.transform(pointed, family_key))


def recurrence_at_arrival(incidents: DataFrame, gaps: DataFrame, key: str = "incident_id") -> DataFrame:
    """RNK-7: for each incident, the most earlier incidents any implied family
    already has gaps in.

    ``incidents``: key, arrival, signals; ``gaps``: key, arrival, family_key.
    An incident counts once per family, at its first gap; earlier means by
    (arrival, key).  There are few families, so their running counts are formed
    over ranges of (family, arrival, key): a family may hold every row, and all
    its arrivals may differ.
    """
    firsts = gaps.groupBy("family_key", key).agg(F.min("arrival").alias("arrival")).select(
        "family_key", key, "arrival", F.lit(1).alias("is_gap")
    )
    asks = incidents.select(
        F.explode(implied_families(F.col("signals"))).alias("family_key"), key, "arrival", F.lit(0).alias("is_gap")
    ).distinct()
    # An incident asks before its own gap at the same place counts.
    counted = running_total(
        firsts.unionByName(asks).filter("family_key is not null"), ["family_key"], [F.col(c).asc() for c in ("arrival", key, "is_gap")], "is_gap", "n"
    )
    most = counted.filter("is_gap = 0").groupBy(key).agg(F.max("n").alias("similar_incidents"))
    return incidents.select(key).join(most, key, "left").select(
        key, F.coalesce("similar_incidents", F.lit(0)).cast("bigint").alias("similar_incidents")
    )


def family_incidents(gaps: DataFrame, analyses: DataFrame, incidents: DataFrame, family: str, limit: int) -> DataFrame:
    """JON-10: incidents of a family, newest first.  Duplicates of one incident
    are removed before the limit, so the page is always full."""
    hits = gaps.filter(F.col("family_key") == family).join(analyses.select("analysis_id", "incident_id"), "analysis_id")
    newest = hits.groupBy("incident_id").agg(F.max("analysis_id").alias("analysis_id"))
    return newest.join(incidents, "incident_id").orderBy(F.desc("analysis_id")).limit(limit)


def first_gap_types(gaps: DataFrame) -> DataFrame:
    """JON-12; of gaps that share an id, the first kind by name."""
    return gaps.groupBy("analysis_id").agg(F.min(F.struct("gap_id", "gap_type"))["gap_type"].alias("gap_type"))


def incident_detail(
    incidents: DataFrame, analyses: DataFrame, gaps: DataFrame, recommendations: DataFrame, evidence: DataFrame | None = None,
    candidates: DataFrame | None = None,
) -> DataFrame:
    """JON-11: each incident with its latest analysis, gaps and recommendations,
    and the evidence (analysis_id, ord, statement) and candidates (analysis_id,
    rank_key, test_id, score) stored for it.  An analysis has at most one gap, a
    gap few recommendations, and the candidates are those of the retrieval cut."""
    listed = recommendations.groupBy("gap_id").agg(
        F.array_sort(F.collect_list(F.struct("recommendation_id", "title", "status"))).alias("recommendations")
    )
    packed = gaps.join(listed, "gap_id", "left").groupBy("analysis_id").agg(
        F.array_sort(F.collect_list(F.struct("gap_id", "gap_type", "family_key", "recommendations"))).alias("gaps")
    )
    out = incidents.join(latest_analysis(analyses), "incident_id", "left").join(packed, "analysis_id", "left")
    for name, rows, fields in (("evidence", evidence, ("ord", "statement")), ("relevant_tests", candidates, ("rank_key", "test_id", "score"))):
        if rows is not None:
            out = out.join(rows.groupBy("analysis_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name)), "analysis_id", "left")
    return out


def apply_status_updates(recommendations: DataFrame, updates: DataFrame) -> DataFrame:
    """SNK-8: the latest valid update of each recommendation; other codes are ignored."""
    valid = updates.withColumn("status", F.upper("status")).filter(F.col("status").isin(fixed.RECOMMENDATION_STATUSES))
    newest = valid.groupBy("recommendation_id").agg(F.max_by("status", "update_seq").alias("new_status"))
    return recommendations.join(newest, "recommendation_id", "left").withColumn(
        "status", F.coalesce("new_status", "status")
    ).drop("new_status")


def new_incidents(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """SNK-7: an incident already stored is kept as it is."""
    return batch.dropDuplicates(["incident_id"]).join(stored.select("incident_id"), "incident_id", "left_anti")


def append(df: DataFrame, path: str) -> None:
    """SNK-7/SNK-14: analyses, gaps, recommendations and runs are only ever added."""
    df.write.mode("append").parquet(path)


def store_incidents(batch: DataFrame, path: str, stored: DataFrame | None = None) -> DataFrame:
    """SNK-7: add the incidents that ``stored`` (nothing at first) does not hold yet; the table as it then is."""
    append(batch.dropDuplicates(["incident_id"]) if stored is None else new_incidents(batch, stored), path)
    return batch.sparkSession.read.schema(batch.schema).parquet(path)


def stored_gaps_and_recommendations(gaps: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Recommendations are stored under their gap; those of a verdict without a
    gap are shown but not kept."""
    return recommendations.join(gaps.select("incident_id").distinct(), "incident_id", "left_semi")


def delete_with_children(target: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """SNK-6: one table of the cascade without the removed parents' rows."""
    return target.join(removed.select(key).distinct(), key, "left_anti")


def replace_patterns(current: DataFrame, detected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK-9/SET-5: the table to write and the families that no longer recur."""
    return detected, current.join(detected.select("family_key"), "family_key", "left_anti")


def reanalysis_input(incidents: DataFrame) -> DataFrame:
    """DEC-17: stored incidents are analysed from their stored facts."""
    return incidents.withColumn("extraction_final", F.lit(True))


def severity_points(severity: Column) -> Column:
    return lookup(F.upper(severity), fixed.SEVERITY_POINTS, 1)
