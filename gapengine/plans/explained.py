"""Statements about returned lines: evidence, gaps, explanations and recommendations, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gapengine.functions import extract as X, text as T
from gapengine.operators import explain
from gapengine.operators.compare import summarise, tested_numbers, tested_values
from gapengine.operators.decide import decide
from gapengine.operators.sizing import materialise
from gapengine.plans import derived as d

C = F.col
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def explained_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEC-15/DEC-16 over returns: every distinct incident profile with the judged tests' detail and all statements.

    A profile's judged tests are the distinct values of its part in one region,
    so the gathered detail is bounded by the value domain.
    """
    incidents = materialise(d.incident_profiles(d.incident_lines(spark, sf_dir)))
    tests = materialise(d.test_profiles(d.test_lines(spark, sf_dir)))
    pairs = d.profile_pairs(incidents, tests)
    keys = [*d.CASE, *[f"test_{c}" for c in d.CASE]]
    cases = materialise(d.compared_cases(incidents, tests, pairs).select(*keys, *d.SLIM, "conds", "specific_terms"))
    compared = d.with_comparison(pairs, cases).withColumns({
        "rank_key": C("test_id"), "source": F.lit("lineitem"), "line_number": F.lit(None).cast("int"),
        "described": T.trimmed(F.concat("test_id", F.lit(", discount="), d.percent("test_discount_pct"))),
    })
    summary = summarise(compared, d.PROFILE, detail=True, best_columns=("test_id", "source", "line_number", "described", "feature"))
    corpus = tests.agg(F.sum("n_tests").alias("corpus_size"))
    rows = d.with_cases(d.with_lonely(summary, incidents, tests), incidents).join(F.broadcast(corpus))  # one row
    decided = materialise(decide(rows, corpus_size=C("corpus_size"), retrieval_top="retrieval_top"))
    blank = {c: F.lit("") for c in ("title", "failure", "root_cause") if c not in decided.columns}
    return explain.with_explanations(decided.withColumns(blank))


def _per_line(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    return d.incident_lines(spark, sf_dir).select(*LINE, *[c for c in d.PROFILE if c not in LINE]).join(rows, d.PROFILE)


def _text(pairs: Column) -> Column:
    return X.pairs_text(pairs, "=", sep=";")


def evidence_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXP-1: the kinds of evidence of each return, in order, and the last statement."""
    rows = explained_profiles(spark, sf_dir).select(
        *d.PROFILE, F.array_join(F.transform("evidence", lambda e: e["kind"]), ";").alias("kinds"),
        F.element_at("evidence", 1)["statement"].alias("first_statement"),
    )
    return _per_line(spark, sf_dir, rows).select(*LINE, "kinds", "first_statement")


def gap_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXP-2/3/4/6: gaps of returns with what is missing, a summary and the explanation."""
    rows = explained_profiles(spark, sf_dir)
    rows = explain.gap_rows(rows.withColumn("key", F.struct(*d.PROFILE, "explanation")), "key").select(
        "key.*", "gap_type", "family_key", "summary", _text(C("missing_conditions")).alias("missing"))
    return _per_line(spark, sf_dir, rows).select(*LINE, "gap_type", "family_key", "summary", "missing",
        F.split_part("explanation", F.lit(":"), F.lit(1)).alias("outcome"))


def advice_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXP-7/7a/LIM-6: recommended inputs of each kind of gap, in order, counted over profiles."""
    rows = explained_profiles(spark, sf_dir).withColumn("key", F.struct("feature", "gap_type"))
    advice = explain.recommendation_rows(rows, "key").select("key.*", C("ord").cast("bigint").alias("ord"), _text(C("suggested_inputs")).alias("inputs"), "status")
    return advice.filter("gap_type = 'BOUNDARY_CONDITION'").groupBy("feature", "ord", "inputs", "status").agg(F.count(F.lit(1)).alias("n"))


def tested_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-21/JON-6: values and numbers the judged tests give the first condition of each profile."""
    rows = explained_profiles(spark, sf_dir).filter("size(judged) > 0")
    values = F.array_sort(F.transform(tested_values(C("judged"), F.lit(0)), lambda v: F.replace(v, F.lit("%"), F.lit("")).cast("int")))
    numbers = F.transform(tested_numbers(C("judged"), F.lit(0)), lambda v: v.cast("int"))
    return rows.select(*d.PROFILE, F.array_join(values.cast("array<string>"), ",").alias("tested"), F.array_join(numbers.cast("array<string>"), ",").alias("numbers"))


QUERIES = [evidence_kinds, gap_statements, advice_given, tested_detail]


def oracles(lines: str, verdicts: str) -> dict[str, str]:
    missing = """concat_ws(';', CASE WHEN coalesce(d_same, 0) = 0 THEN 'discount=' || d || '%' END,
                     CASE WHEN coalesce(t_same, 0) = 0 THEN 'tax=' || t || '%' END, CASE WHEN low AND coalesce(low_seen, 0) = 0 THEN 'signal:boundary_min=lower limit' END)"""
    return {
        "evidence_kinds": f"""WITH {verdicts} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
          concat_ws(';', 'production_condition;production_condition', CASE WHEN low THEN 'production_signal' END,
            CASE WHEN best_test_id IS NULL THEN 'retrieval' ELSE concat_ws(';', 'feature',
              CASE WHEN d_same = 1 THEN 'condition_matched' ELSE 'condition_difference' END,
              CASE WHEN t_same = 1 THEN 'condition_matched' ELSE 'condition_difference' END,
              CASE WHEN low AND low_seen = 0 THEN 'signal_absent' END, CASE WHEN coverage = 'COVERED' THEN 'effectiveness' END) END) AS kinds,
          'incident value: discount=' || d || '%' AS first_statement FROM verdicts""",
        "gap_statements": f"""WITH {verdicts} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, gap_type, family_key,
          {missing} AS missing,
          CASE WHEN gap_type = 'WEAK_ASSERTION' THEN feature || ': ' || best_test_id || ' matches the incident and stays green'
               WHEN gap_type = 'BOUNDARY_CONDITION' AND coalesce(d_same, 0) = 0 THEN feature || ': limit discount=' || d || '% untested'
               WHEN gap_type = 'BOUNDARY_CONDITION' AND coalesce(t_same, 0) = 0 THEN feature || ': limit tax=' || t || '% untested'
               WHEN coalesce(d_same, 0) = 0 OR coalesce(t_same, 0) = 0 THEN feature || ': untested values: ' || concat_ws('; ',
                 CASE WHEN coalesce(d_same, 0) = 0 THEN 'discount=' || d || '%' END, CASE WHEN coalesce(t_same, 0) = 0 THEN 'tax=' || t || '%' END)
               WHEN low AND coalesce(low_seen, 0) = 0 THEN feature || ': untested behaviour: lower limit'
               WHEN coverage = 'NOT_COVERED' THEN feature || ': nothing comparable in the catalogue'
               ELSE feature || ': catalogue and incident disagree in substance' END AS summary,
          CASE WHEN best_test_id IS NULL THEN 'Gap' WHEN coverage = 'COVERED' THEN 'Covered' ELSE 'Partly covered' END AS outcome FROM verdicts""",
        "advice_given": f"""WITH {verdicts}, o AS (SELECT DISTINCT l_partkey, feature, d, t FROM verdicts WHERE gap_type = 'BOUNDARY_CONDITION'),
          k AS (SELECT l_partkey, feature, list(DISTINCT d) AS ds FROM tests GROUP BY ALL),
          x AS (SELECT o.feature, list_concat(list_transform(list_filter([0, 50, 100], lambda v: NOT list_contains(coalesce(ds, []), v)),
                  lambda v: 'discount=' || v || '%'), ['discount=-1', 'discount=invalid']) AS l FROM o LEFT JOIN k USING (l_partkey, feature)),
          u AS (SELECT feature, unnest(l) AS inputs, generate_subscripts(l, 1) - 1 AS ord FROM x)
          SELECT feature, CAST(ord AS BIGINT) AS ord, inputs, 'PROPOSED' AS status, count(*) AS n FROM u GROUP BY ALL""",
        "tested_detail": f"""WITH {lines}, p AS (SELECT DISTINCT l_partkey, feature, d, t FROM inc)
          SELECT p.l_partkey, p.feature, p.d AS discount_pct, p.t AS tax_pct,
                 array_to_string(list_sort(list(DISTINCT k.d)), ',') AS tested, array_to_string(list_sort(list(DISTINCT k.d)), ',') AS numbers
          FROM p JOIN tests k ON k.l_partkey = p.l_partkey AND k.feature = p.feature GROUP BY ALL""",
    }
