"""Incident normalisation and externally proposed facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gapengine import fixed
from gapengine.functions.extract import (
    coerced_pairs,
    detect_signals,
    extract_conditions,
    failure_of,
    first_wins,
    no_pairs,
    occurred_at,
    pair,
    root_cause_of,
    scenario_of,
    severity_of,
    title_of,
)
from gapengine.functions.text import expand_compat, normalize, normalized_value, strings, trimmed
from gapengine.operators.index import classify
from gapengine.operators.sizing import materialise


def _supplied(df: DataFrame, name: str, kind: str = "string") -> Column:
    """SRC-15: a supplied field, NULL where the caller gave none."""
    if name not in df.columns:
        return F.lit(None).cast(kind)
    return F.when(trimmed(F.col(name)) != "", F.col(name)) if kind == "string" else F.col(name)


def normalize_incidents(
    raw: DataFrame, weights: DataFrame | None = None, counts: DataFrame | None = None, fold: bool = True
) -> tuple[DataFrame, DataFrame]:
    """TXT-33: ``(incidents, issues)``.

    ``raw``: incident_id, text and any of title, feature, severity, occurred_at,
    failure, root_cause, scenario, conditions (pairs), signals, arrival, extra.
    Empty reports become issues.  A supplied feature is resolved against the
    known names (TXT-38), others are classified with the learned vocabulary.
    """
    if fold:
        raw = expand_compat(raw, "text")
    issues = raw.filter(trimmed(F.coalesce("text", F.lit(""))) == "").select(
        F.col("incident_id").alias("location"), F.lit("Incident text is empty.").alias("reason"), F.lit("ERROR").alias("severity")
    )
    df = raw.filter(trimmed(F.coalesce("text", F.lit(""))) != "").withColumn("description", trimmed(F.col("text")))
    df = df.withColumns(
        {
            "title": trimmed(F.coalesce(_supplied(df, "title"), title_of(F.col("description")))),
            "root_cause": trimmed(F.coalesce(_supplied(df, "root_cause"), root_cause_of(F.col("description")))),
            "failure": trimmed(F.coalesce(_supplied(df, "failure"), failure_of(F.col("description")))),
            "_feature": _supplied(df, "feature"),
        }
    )
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    df = df.withColumn("corpus", F.concat_ws(" ", filled("title"), filled("description"), filled("failure"), filled("root_cause")))
    if weights is None:
        df = df.withColumn("feature", F.coalesce(F.initcap("_feature"), F.lit(fixed.UNKNOWN)))
    else:
        df = _with_feature(df, weights, counts)
    stated = coerced_pairs(F.col("conditions")) if "conditions" in raw.columns else no_pairs()
    df = df.withColumn(
        "conditions",
        first_wins(stated, *[extract_conditions(F.col(c)) for c in ("title", "failure", "description", "root_cause")]),
    )
    given = F.when(F.size("signals") > 0, F.col("signals")) if "signals" in raw.columns else F.lit(None).cast("array<string>")
    return df.select(
        "incident_id",
        "title",
        "description",
        "feature",
        F.coalesce(_supplied(raw, "scenario"), scenario_of(F.col("feature"), F.col("conditions"), F.col("title"))).alias("scenario"),
        "conditions",
        "failure",
        "root_cause",
        F.coalesce(given, detect_signals(F.col("corpus"))).alias("signals"),
        F.upper(F.coalesce(_supplied(raw, "severity"), severity_of(F.col("corpus")))).alias("severity"),
        (occurred_at(F.col("occurred_at")) if "occurred_at" in raw.columns else F.lit(None).cast("timestamp")).alias("occurred_at"),
        *[c for c in ("arrival", "extra") if c in raw.columns],
    ), issues


def _with_feature(df: DataFrame, weights: DataFrame, counts: DataFrame) -> DataFrame:
    counts = materialise(counts)
    known = counts.select(normalized_value(F.col("feature")).alias("_norm"), F.col("feature").alias("known")).groupBy("_norm").agg(
        F.min("known").alias("known")
    )
    guessed = classify(df.select("incident_id", "corpus"), weights, counts, "incident_id", "corpus").select(
        "incident_id", F.col("feature").alias("guessed")
    )
    df = df.withColumn("_norm", normalized_value(F.col("_feature"))).join(known, "_norm", "left")
    return df.join(guessed, "incident_id", "left").withColumn(
        "feature", F.when(F.col("_feature").isNotNull(), F.coalesce("known", F.initcap("_feature"))).otherwise(F.col("guessed"))
    )


def merge_proposed_facts(incidents: DataFrame, proposed: DataFrame, features: DataFrame, most: int | None = None) -> DataFrame:
    """DEC-18: facts proposed from outside, each backed by a verbatim quote.

    A quote needs six characters and must occur in the normalised report; a
    feature is taken only when none is known and it is a known name; conditions
    and signals only add keys not there yet, the first ``most`` of each in
    proposal order (default: all);
    signals come from the closed set.  ``provenance`` tells what was accepted.
    """
    name = F.lower(trimmed(F.col("name")))
    text = incidents.select(
        "incident_id", "feature", "conditions", "signals", normalize(F.col("description")).alias("haystack")
    )
    offered = proposed.join(text, "incident_id")
    quoted = (F.length(trimmed(F.col("quote"))) >= fixed.MIN_QUOTE_CHARS) & F.col("haystack").contains(
        normalized_value(F.col("quote"))
    )
    key = F.when(F.col("kind") == "condition", F.replace(name, F.lit(" "), F.lit("_"))).otherwise(name)
    fresh = F.when(
        F.col("kind") == "condition",
        (key != "") & F.col("value").isNotNull() & ~F.array_contains(F.col("conditions")["key"], key),
    ).when(
        F.col("kind") == "signal", key.isin(list(fixed.SIGNAL_PATTERNS)) & ~F.array_contains("signals", key)
    )
    once = Window.partitionBy("incident_id", "kind", "key").orderBy("ord")
    turn = Window.partitionBy("incident_id", "kind").orderBy("ord")
    accepted = (
        offered.filter(F.col("kind").isin("condition", "signal")).withColumn("key", key).filter(fresh & quoted)
        .withColumn("again", F.row_number().over(once)).filter("again = 1")
        .withColumn("turn", F.row_number().over(turn))
        .filter(F.lit(most is None) | (F.col("turn") <= F.lit(most)))
    )
    is_condition = F.col("kind") == "condition"
    gathered = accepted.groupBy("incident_id").agg(
        F.array_sort(F.collect_list(F.when(is_condition, F.struct("turn", "key", "value")))).alias("c"),
        F.array_sort(F.collect_list(F.when(~is_condition, F.struct("turn", "key")))).alias("s"),
        F.array_sort(F.collect_list(pair(F.concat_ws(":", "kind", "key"), F.col("quote")))).alias("p"),
    )
    named = (
        proposed.filter("kind = 'feature'").join(features.select(F.col("feature").alias("name")).distinct(), "name", "left_semi")
        .groupBy("incident_id").agg(F.min_by("name", "ord").alias("_offered"))
    )
    unknown = F.coalesce("feature", F.lit("")).isin("", fixed.UNKNOWN)
    merged = incidents.join(gathered, "incident_id", "left").join(named, "incident_id", "left")
    took = unknown & F.col("_offered").isNotNull()
    return merged.withColumns(
        {
            "conditions": F.concat("conditions", F.coalesce(F.transform("c", lambda x: pair(x["key"], x["value"])), no_pairs())),
            "signals": F.concat("signals", F.coalesce(F.col("s")["key"], strings([]))),
            "provenance": F.concat(
                F.when(took, F.array(pair(F.lit("feature"), F.lit("proposed")))).otherwise(no_pairs()), F.coalesce("p", no_pairs())
            ),
            "feature": F.when(took, F.col("_offered")).otherwise(F.col("feature")),
        }
    ).drop("c", "s", "p", "_offered")
