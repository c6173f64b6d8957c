"""Verdicts and scores as expressions over the per-incident row of ``summarise``.

Every function here is a pure expression, so a whole batch of incidents is
decided in one map-only stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gapengine import fixed
from gapengine.functions.text import family_key, family_label, lookup, strings
from gapengine.operators.compare import condition_facts, expand_best, with_status

C = F.col


def with_facts(df: DataFrame) -> DataFrame:
    """Fill the summary of incidents without candidates and add the derived
    facts decisions read: ``facts``, ``unmatched``, ``combination``."""
    empty = strings([])
    df = expand_best(df).withColumns(
        {
            "n_candidates": F.coalesce("n_candidates", F.lit(0)),
            "n_judged": F.coalesce("n_judged", F.lit(0)),
            "feature_known": F.coalesce("feature_known", F.lit(False)),
            "any_feature_match": F.coalesce("any_feature_match", F.lit(False)),
            "top_score": F.coalesce("top_score", F.lit(0.0)),
            "any_specific": F.coalesce("any_specific", F.lit(False)),
            "facts": condition_facts(C("i_conds")),
            "unmatched": F.array_except("i_decisive", F.coalesce("union_signals", empty)),
        }
    )
    return df.withColumn("combination", combination_gap())


def combination_gap() -> Column:
    """DEC-6: each behaviour is tested somewhere, no single test combines them."""
    return (
        (F.size("i_decisive") >= 2)
        & (C("n_judged") > 0)
        & (F.size("unmatched") == 0)
        & F.coalesce(C("least_missing") > 0, F.lit(False))
    )


def _best_matched() -> Column:
    return F.size(with_status(C("best.conds"), "MATCHED"))


def all_conditions_covered() -> Column:
    return (F.size("best.conds") > 0) & (_best_matched() == F.size("best.conds"))


def partial_rule() -> Column:
    """DEC-8."""
    nothing_missing = F.size("unmatched") == 0
    present = F.exists("facts", lambda c: c["matched"] | c["different"])
    mentioned = F.filter("facts", lambda c: c["mentioned"])
    owned = F.filter("i_bound", lambda b: F.array_contains(mentioned["nkey"], b["value"]))["key"]
    return C("any_feature_match") & (
        (_best_matched() > 0)
        | (F.size("best.matched_signals") > 0)
        | present
        | (nothing_missing & (F.size(mentioned) > 0))
        | F.arrays_overlap(owned, C("unmatched"))
        | (nothing_missing & (C("best.strength") >= fixed.PARTIAL_STRENGTH))
    )


def topical_rule() -> Column:
    """DEC-9: nothing structured to compare, judged on distinctive wording."""
    strong = (
        C("best.feature_match")
        & (C("best.score") >= fixed.TOPICAL_SCORE)
        & (
            (C("best.overlap") >= fixed.TOPICAL_OVERLAP)
            | (C("best.n_specific") >= fixed.TOPICAL_TERMS)
        )
    )
    return (
        F.when(~C("any_feature_match"), F.lit("NOT_COVERED"))
        .when(~C("any_specific"), F.lit("INSUFFICIENT_EVIDENCE"))
        .when(strong, F.lit("COVERED"))
        .otherwise(F.lit("PARTIAL"))
    )


def coverage() -> Column:
    """DEC-7: the verdict, first rule that applies."""
    has_conditions = F.size("best.conds") > 0
    structured = has_conditions | (F.size("i_decisive") > 0)
    nothing_to_ask = (F.size("i_conds") == 0) & (F.size("signals") == 0) & ~C("feature_known")
    complete = (
        structured
        & (~has_conditions | all_conditions_covered())
        & (F.size("best.missing_signals") == 0)
        & (has_conditions | (C("best.n_specific") > 0))
    )
    return (
        F.when(
            C("best").isNull() | (C("top_score") < fixed.RELEVANCE_FLOOR),
            F.when(nothing_to_ask, F.lit("INSUFFICIENT_EVIDENCE")).otherwise(F.lit("NOT_COVERED")),
        )
        .when(C("combination"), F.lit("NOT_COVERED"))
        .when(complete, F.lit("COVERED"))
        .when(~structured, topical_rule())
        .when(partial_rule(), F.lit("PARTIAL"))
        .otherwise(F.lit("NOT_COVERED"))
    )


def effectiveness(verdict: Column) -> Column:
    return lookup(
        verdict,
        {"COVERED": "POTENTIALLY_INEFFECTIVE", "PARTIAL": "INSUFFICIENT_COVERAGE"},
        "NO_COVERAGE",
    )


def boundary_rule() -> Column:
    """DEC-11: a numeric value of the best test's unmatched conditions lies outside
    the judged tests' range, or is an untested 0 or 100."""
    outside = lambda f: (
        f["tested"]
        & (~f["at_or_above"] | ~f["at_or_below"] | (f["num"].isin(0.0, 100.0) & ~f["same"]))
    )
    both = F.zip_with(
        "best.conds",
        "facts",
        lambda b, f: b["status"].isin("DIFFERENT", "ABSENT") & b["num"].isNotNull() & outside(f),
    )
    return F.coalesce(F.exists(both, lambda x: x), F.lit(False))


def gap_type(verdict: Column) -> Column:
    """DEC-10."""
    missing = F.array_union("unmatched", F.coalesce(C("best.missing_signals"), strings([])))
    expr = (
        F.when(verdict == "COVERED", F.lit("WEAK_ASSERTION"))
        .when(
            C("combination"),
            F.when(F.arrays_overlap("i_decisive", strings(fixed.SEQUENCE_SIGNALS)), F.lit("STATE_TRANSITION"))
            .otherwise(F.lit("INPUT_COMBINATION")),
        )
        .when(C("best").isNotNull() & boundary_rule(), F.lit("BOUNDARY_CONDITION"))
    )
    for signal, gap in fixed.SIGNAL_GAP_TYPES:
        expr = expr.when(F.array_contains(missing, signal), F.lit(gap))
    return (
        expr.when(F.size(with_status(C("best.conds"), "ABSENT")) > 0, F.lit("MISSING_TEST"))
        .when(F.array_contains("signals", "data_format"), F.lit("DATA_FORMAT"))
        .when(C("best").isNull() | ~C("any_feature_match"), F.lit("MISSING_TEST"))
        .otherwise(F.lit("TEST_DATA_MISMATCH"))
    )


def confidence_components(verdict: Column, corpus_size: Column, retrieval_top: Column) -> dict[str, Column]:
    """DEC-13, the four parts."""
    conditions = F.least(F.lit(3.0), F.size("i_conds").cast("double")) / 3.0
    signals = F.least(F.lit(3.0), F.size("i_decisive").cast("double")) / 3.0
    best = C("best")
    decisiveness = (
        F.when(best.isNull(), 0.15)
        .when((verdict == "COVERED") & all_conditions_covered(), 1.0)
        .when(C("combination"), 0.9)
        .when((verdict == "PARTIAL") & (F.size(with_status(C("best.conds"), "DIFFERENT")) > 0), 0.9)
        .when((verdict == "PARTIAL") & (F.size("best.matched_signals") > 0), 0.7)
        .when((verdict == "NOT_COVERED") & (F.size("unmatched") > 0), 0.75)
        .when((verdict == "NOT_COVERED") & ~C("any_feature_match"), 0.6)
        .otherwise(0.45)
    )
    return {
        "retrieval_strength": F.greatest(F.lit(0.0), F.least(F.lit(1.0), retrieval_top / 0.8)),
        "evidence_richness": F.when(
            C("n_candidates") > 0, F.least(F.lit(1.0), conditions * 0.6 + signals * 0.4)
        ).otherwise(0.0),
        "decisiveness": decisiveness,
        "corpus_support": F.greatest(
            F.lit(0.0), F.least(F.lit(1.0), corpus_size / float(fixed.CONFIDENT_CORPUS))
        ),
    }


def confidence(parts: dict[str, Column]) -> Column:
    total = sum((parts[k] * w for k, w in fixed.CONFIDENCE_WEIGHTS.items()), F.lit(0.0))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 3)


def confidence_level(verdict: Column, score: Column) -> Column:
    return (
        F.when(verdict == "INSUFFICIENT_EVIDENCE", F.lit("LOW"))
        .when(score >= fixed.CONFIDENCE_HIGH, F.lit("HIGH"))
        .when(score >= fixed.CONFIDENCE_MEDIUM, F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )


def recurrence_points(n: Column) -> Column:
    return F.when(n >= 6, 3).when(n >= 3, 2).when(n >= 2, 1).otherwise(0)


def risk_points(severity, verdict, feature, similar, feature_points: dict | None = None) -> Column:
    """DEC-14.  ``feature_points`` replaces the default importance table."""
    table = fixed.FEATURE_POINTS if feature_points is None else feature_points
    return (
        lookup(F.upper(severity), fixed.SEVERITY_POINTS, 1)
        + lookup(verdict, fixed.COVERAGE_POINTS, 1)
        + (lookup(feature, table, 1) if table else F.lit(1))
        + recurrence_points(similar)
    )


def risk_level(points: Column, high: int = fixed.RISK_HIGH, medium: int = fixed.RISK_MEDIUM) -> Column:
    return F.when(points >= high, F.lit("HIGH")).when(points >= medium, F.lit("MEDIUM")).otherwise(F.lit("LOW"))


def comparison_debug() -> Column:
    """DEC-16."""
    best = C("best")
    keys = lambda *statuses: F.coalesce(with_status(C("best.conds"), *statuses)["key"], strings([]))
    return F.struct(
        F.coalesce(C("best.feature_match"), F.lit(False)).alias("feature_match"),
        F.coalesce(C("best.overlap") >= fixed.TOPICAL_OVERLAP, F.lit(False)).alias("scenario_match"),
        F.coalesce(best.isNotNull() & all_conditions_covered(), F.lit(False)).alias("condition_match"),
        keys("MATCHED").alias("matched_conditions"),
        F.concat(keys("DIFFERENT"), keys("ABSENT")).alias("unmatched_conditions"),
        (best.isNotNull() & (F.size("best.missing_signals") == 0)).alias("signal_match"),
        C("unmatched").alias("unmatched_signals"),
        C("best.test_id").alias("best_test_id"),
    )


def decide(
    df: DataFrame, *, corpus_size: Column, retrieval_top: str = "top_score", feature_points: dict | None = None,
    similar: Column | None = None,
) -> DataFrame:
    """DEC-7..16 on joined (incident, summary) rows.

    An empty catalogue supports no verdict: everything is insufficient, with
    confidence 0, medium risk and no gap.
    """
    df = with_facts(df)
    empty = corpus_size == 0
    df = df.withColumn(
        "coverage", F.when(empty, F.lit("INSUFFICIENT_EVIDENCE")).otherwise(F.coalesce(coverage(), F.lit("NOT_COVERED")))
    )
    verdict = C("coverage")
    parts = confidence_components(verdict, corpus_size, F.coalesce(C(retrieval_top), F.lit(0.0)))
    df = df.withColumns(
        {
            "effectiveness": effectiveness(verdict),
            "gap_type": F.when(verdict != "INSUFFICIENT_EVIDENCE", gap_type(verdict)),
            "confidence": F.when(empty, F.lit(0.0)).otherwise(confidence(parts)),
            "comparison": comparison_debug(),
        }
    )
    df = df.withColumns(
        {
            "confidence_level": confidence_level(verdict, C("confidence")),
            "family_key": family_key(C("gap_type")),
        }
    ).withColumn("family_label", family_label(C("family_key")))
    if similar is None:
        return df
    points = risk_points(C("severity"), verdict, C("feature"), similar, feature_points)
    return df.withColumns(
        {"risk_points": points, "risk": F.when(empty, F.lit("MEDIUM")).otherwise(risk_level(points))}
    )
