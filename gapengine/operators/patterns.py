"""Recurring patterns: the same family of gap in several incidents."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from gapengine import fixed
from gapengine.functions.text import family_label, lookup
from gapengine.operators.decide import recurrence_points, risk_level


class Partials(NamedTuple):
    """What patterns are made of; two sets of partials add up row by row."""

    incidents: DataFrame  # family_key, incident_id, first_seen, n_gaps, n_uncovered, worst
    tallies: DataFrame    # family_key, kind ("gap_type" or "feature"), v, n


_MERGE = (
    {"first_seen": F.min, "n_gaps": F.sum, "n_uncovered": F.sum, "worst": F.max},
    {"n": F.sum},
)
_KEYS = (("family_key", "incident_id"), ("family_key", "kind", "v"))


def partials_of(obs: DataFrame, order: str = "arrival") -> Partials:
    """AGG-14 input: one pass over the gaps for each table, counted map-side.

    There are few families, so nothing is grouped by family alone here."""
    obs = observations(obs)
    severity = lookup(F.upper("severity"), fixed.SEVERITY_POINTS, 1)
    incidents = obs.groupBy("family_key", "incident_id").agg(
        F.min(order).alias("first_seen"), F.count(F.lit(1)).alias("n_gaps"),
        F.count(F.when(F.col("coverage") == "NOT_COVERED", 1)).alias("n_uncovered"), F.max(severity).alias("worst"),
    )
    values = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("v")) for kind in ("gap_type", "feature")])
    tallies = obs.select("family_key", F.inline(values)).groupBy("family_key", "kind", "v").agg(F.count(F.lit(1)).alias("n"))
    return Partials(incidents, tallies)


def merged(parts: list[Partials]) -> Partials:
    """STR-2: partials of several batches as those of all their gaps together."""
    out = []
    for tables, keys, how in zip(zip(*parts), _KEYS, _MERGE):
        rows = tables[0]
        for more in tables[1:]:
            rows = rows.unionByName(more)
        out.append(rows.groupBy(*keys).agg(*[f(c).alias(c) for c, f in how.items()]))
    return Partials(*out)


def _frequencies(tallies: DataFrame, kind: str, keep: int | None = None) -> DataFrame:
    """Values of a kind per family, most frequent first, ties by value; cut to
    ``keep`` before a family's values meet."""
    counts = tallies.filter(F.col("kind") == kind)
    if keep:
        order = Window.partitionBy("family_key").orderBy(F.desc("n"), "v")
        counts = counts.withColumn("p", F.row_number().over(order)).filter(F.col("p") <= keep)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("v"))))
    return counts.groupBy("family_key").agg(ranked.alias("r"))


def observations(df: DataFrame) -> DataFrame:
    """Lenient family defaults of gap observations."""
    key = F.when(F.coalesce("family_key", F.lit("")) == "", F.lit("UNCATEGORISED")).otherwise(F.col("family_key"))
    return df.withColumn("family_key", key)


def recurring_patterns(
    obs: DataFrame, min_incidents: int = fixed.PATTERN_MIN_INCIDENTS, order: str = "arrival"
) -> DataFrame:
    """AGG-14..17: one row per family seen in enough distinct incidents.

    ``obs``: incident_id, gap_type, family_key, feature, severity, coverage and an
    arrival column."""
    return patterns_from(partials_of(obs, order), min_incidents)


def patterns_from(partials: Partials, min_incidents: int = fixed.PATTERN_MIN_INCIDENTS) -> DataFrame:
    """AGG-14..17 from partials: counts combine map-side, and examples are cut to
    12 per task before a family's incidents meet."""
    incidents, tallies = partials
    totals = incidents.groupBy("family_key").agg(
        F.count(F.lit(1)).alias("incident_count"), F.sum("n_gaps").alias("gap_count"), F.max("worst").alias("worst"),
        F.sum("n_uncovered").alias("n_uncovered"),
    )
    spread = tallies.filter("kind = 'feature'").groupBy("family_key").agg(F.count(F.lit(1)).alias("n_features"))
    first12 = Window.partitionBy("family_key").orderBy("first_seen", "incident_id")
    examples = (
        incidents.withColumn("p", F.row_number().over(first12)).filter(F.col("p") <= fixed.PATTERN_EXAMPLES)
        .groupBy("family_key").agg(F.array_sort(F.collect_list(F.struct("p", "incident_id"))).alias("e"))
        .select("family_key", F.col("e.incident_id").alias("example_incident_ids"))
    )
    types = _frequencies(tallies, "gap_type").select("family_key", F.col("r.v").alias("gap_types"))
    features = _frequencies(tallies, "feature", fixed.PATTERN_FEATURES).select(
        "family_key", F.col("r.v").alias("features"), (-F.get("r", F.lit(0))["n"]).alias("leading_n")
    )
    p = totals.filter(F.col("incident_count") >= min_incidents)
    for side in (spread, examples, types, features):
        p = p.join(side, "family_key")
    share = F.col("leading_n") / F.col("gap_count")
    leading = F.get("features", F.lit(0))
    points = pattern_points(F.col("incident_count"), F.col("worst"), F.col("n_uncovered"), F.col("gap_count"), F.col("n_features"))
    return p.select(
        "family_key",
        family_label(F.col("family_key")).alias("label"),
        "incident_count", "gap_count",
        risk_level(points, fixed.PATTERN_RISK_HIGH, fixed.PATTERN_RISK_MEDIUM).alias("risk"),
        "gap_types", "features", "example_incident_ids",
        pattern_summary(family_label(F.col("family_key")), F.col("incident_count"), share, F.col("features"), F.get("gap_types", F.lit(0))).alias("summary"),
        leading.alias("concentrated_in"),
        F.round(share, 2).alias("concentration"),
    )


def ordered(patterns: DataFrame) -> DataFrame:
    """LIM-5: strongest first."""
    return patterns.orderBy(F.desc("incident_count"), "label")


def strongest(patterns: DataFrame, n: int = 5) -> DataFrame:
    """LIM-5: the first ``n``."""
    return ordered(patterns).limit(n)


def pattern_by_key(patterns: DataFrame, identifier: str) -> DataFrame:
    """LIM-7: by family key or label."""
    return patterns.filter((F.col("family_key") == identifier) | (F.col("label") == identifier))


def pattern_points(n_incidents, worst, n_uncovered, n_gaps, n_features) -> Column:
    """AGG-15."""
    uncovered = F.when(n_uncovered / n_gaps >= 0.6, 2).when(n_uncovered > 0, 1).otherwise(0)
    return recurrence_points(n_incidents) + worst + uncovered + F.when(n_features >= 3, 1).otherwise(0)


def pattern_summary(label: Column, n: Column, share: Column, features: Column, gap_type: Column) -> Column:
    """AGG-17: size, place and usual kind of a pattern in one line."""
    leading = F.get(features, F.lit(0))
    place = (
        F.when(share >= 0.6, F.concat(F.lit("mostly "), leading, F.lit(" ("), F.floor(share * 100).cast("string"), F.lit(" %)")))
        .when(F.size(features) > 1, F.concat(F.lit("several areas: "), F.array_join(F.slice(features, 1, 3), ", ")))
        .otherwise(F.concat(F.lit("only "), leading))
    )
    kind = F.lower(F.replace(gap_type, F.lit("_"), F.lit(" ")))
    return F.concat(label, F.lit(" x"), n.cast("string"), F.lit("; "), place, F.lit("; usual gap: "), kind)


def link_gaps(gaps: DataFrame, patterns: DataFrame) -> DataFrame:
    """SNK-10: every gap with its family's pattern.  There are eleven families at
    most, so their rows go to the gaps."""
    side = patterns.select("family_key", F.col("label").alias("pattern_label"), F.col("risk").alias("pattern_risk"))
    return gaps.join(F.broadcast(side), "family_key", "left")
