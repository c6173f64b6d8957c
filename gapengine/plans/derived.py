"""The driver's tables seen as a test catalogue and as production incidents.

Shipped line items that came back (``R``) are the incidents, the others the
catalogue; a supplier's region is the feature, discount and tax are the inputs,
and the part is what both are about.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gapengine.functions.extract import detect_signals, exercised_signals, pair
from gapengine.operators.compare import (
    compare_pairs,
    prepare_incidents,
    prepare_tests,
    summarise,
)
from gapengine.operators.decide import decide
from gapengine.operators.retrieve import blend
from gapengine.operators.sizing import BROADCAST_ROWS, blocks_for, materialise
from gapengine.functions.text import strings

PROFILE = ["l_partkey", "feature", "discount_pct", "tax_pct"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_region(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    """Attach the supplier's region.  No broadcast is forced: the optimizer sends
    the dimension tables to every task only while they are small."""
    suppliers = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", F.col("r_name").alias("feature"))
    )
    return lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).drop("s_suppkey")


def _lines(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    whole = lambda c: F.round(F.col(c) * 100).cast("int")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", *extra,
        whole("l_discount").alias("discount_pct"), whole("l_tax").alias("tax_pct"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("line_id"),
    )


def test_lines(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return with_region(spark, sf_dir, _lines(spark, sf_dir, *extra).filter("l_returnflag <> 'R'"))


def incident_lines(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return with_region(spark, sf_dir, _lines(spark, sf_dir, *extra).filter("l_returnflag = 'R'"))


def percent(c: str) -> Column:
    return F.concat(F.col(c).cast("string"), F.lit("%"))


def inputs_of_line() -> Column:
    return F.array(
        pair(F.lit("discount"), percent("discount_pct")), pair(F.lit("tax"), percent("tax_pct"))
    )


def report_text() -> Column:
    """What a reporter would write about a returned line."""
    return F.concat(F.lit("Returned with discount "), percent("discount_pct"), F.lit(" and tax "), percent("tax_pct"))


def test_profiles(lines: DataFrame) -> DataFrame:
    """Tests that drive the same values for the same part and feature compare
    alike; one profile with the smallest id stands for all of them."""
    return lines.groupBy(*PROFILE).agg(F.min("line_id").alias("test_id"), F.count(F.lit(1)).alias("n_tests"))


def incident_profiles(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*PROFILE).agg(F.count(F.lit(1)).alias("n_incidents"))


CASE = ["feature", "discount_pct", "tax_pct"]


def incident_cases(profiles: DataFrame, text_columns: bool = False) -> DataFrame:
    """The distinct (feature, values) combinations, prepared for comparison."""
    cases = profiles.select(*CASE).distinct()
    return prepare_incidents(
        cases.withColumns({"conditions": inputs_of_line(), "signals": detect_signals(report_text())}),
        text_columns=text_columns,
    )


def test_cases(profiles: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    t = prepare_tests(
        profiles.select(*CASE).distinct().withColumns(
            {"inputs": inputs_of_line(), "name": F.lit("return"), "scenario": F.lit(""), "signals": strings([])}
        ),
        text_columns=False,
    )
    return t.select(*[F.col(c).alias(f"test_{c}") for c in CASE], *[c for c in t.columns if c.startswith("t_")])


def profile_pairs(incidents: DataFrame, tests: DataFrame) -> DataFrame:
    """Candidate pairs: profiles of the same part.

    Both sides are reduced to distinct (part, feature, values) before they meet,
    with map-side combining, so a part that holds a third of all lines costs at
    most its distinct value combinations squared, never lines times lines.  The
    pairs are counted first, and a task gets about ``PAIRS_A_TASK`` of them:
    adaptive execution would merge the small sides into tasks whose pairs aren't.
    """
    t = tests.select("l_partkey", "test_id", *[F.col(c).alias(f"test_{c}") for c in CASE])
    i = incidents.select(*PROFILE)
    n = blocks_for(_n_pairs(i, t), PAIRS_A_TASK)
    if n > 1:
        i, t = i.repartition(n, "l_partkey"), t.repartition(n, "l_partkey")
    return i.join(t, "l_partkey")


# Pairs of one task; they are sorted there and take some 300 bytes each.
PAIRS_A_TASK = 1_000_000


def _n_pairs(incidents: DataFrame, tests: DataFrame) -> int:
    many = lambda df, name: df.groupBy("l_partkey").agg(F.count(F.lit(1)).alias(name))
    both = many(incidents, "n_i").join(many(tests, "n_t"), "l_partkey")
    return both.agg(F.coalesce(F.sum(F.col("n_i") * F.col("n_t")), F.lit(0))).first()[0]


def with_comparison(pairs: DataFrame, cases: DataFrame) -> DataFrame:
    """Pairs with the comparison of their cases, a stored table that goes to the pairs
    while it has few rows, so pairs stay spread by part and are summed up where they are."""
    keys = [*CASE, *[f"test_{c}" for c in CASE]]
    return pairs.join(F.broadcast(cases) if cases.count() <= BROADCAST_ROWS else cases, keys)


def compared_cases(incidents: DataFrame, tests: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each combination of cases that occurs in some pair, compared once; all combinations, where
    these are fewer than the profiles, so that pairs needn't be built to find them."""
    test_case = [f"test_{c}" for c in CASE]
    distinct = _all_combinations(incidents, tests)
    distinct = pairs.select(*CASE, *test_case).distinct() if distinct is None else distinct
    both = distinct.join(incident_cases(incidents), CASE).join(test_cases(tests), test_case)
    both = both.withColumn("rank_key", F.lit("")).withColumn(
        "score",
        blend(
            F.lit(1.0), F.lit(0.0),
            feature_match=F.col("i_feature") == F.col("t_feature"),
            shares_condition=F.arrays_overlap(F.col("i_conds")["nkey"], F.col("t_inputs")["nkey"]),
            shares_signal=F.arrays_overlap("signals", "t_signals"),
        ),
    )
    return compare_pairs(both, condition_words=1).drop("rank_key")


def _all_combinations(incidents: DataFrame, tests: DataFrame) -> DataFrame | None:
    i = materialise(incidents.select(*CASE).distinct())
    t = materialise(tests.select(*[F.col(c).alias(f"test_{c}") for c in CASE]).distinct())
    if i.count() * t.count() > min(BROADCAST_ROWS, incidents.count() + tests.count()):
        return None
    return i.crossJoin(F.broadcast(t))  # far fewer rows than the bound above


def with_cases(rows: DataFrame, incidents: DataFrame) -> DataFrame:
    """Rows with the prepared columns of their case, which go to the rows while there are few."""
    cases = materialise(incident_cases(incidents))
    return rows.join(F.broadcast(cases) if cases.count() <= BROADCAST_ROWS else cases, CASE)


def with_lonely(summary: DataFrame, incidents: DataFrame, tests: DataFrame) -> DataFrame:
    """Summaries, and the profiles whose part has no test, with nulls.

    Those are looked for by part, so the summaries, the widest rows here, stay where they are."""
    tested = tests.dropna(subset=CASE).select("l_partkey").distinct()
    return summary.unionByName(incidents.select(*PROFILE).join(tested, "l_partkey", "left_anti"), allowMissingColumns=True)


SLIM = [
    "i_known", "t_known", "feature_match", "score", "strength", "overlap", "n_missing_signals", "n_specific",
    "_matched", "_word0",
]


def compared_profiles(incidents: DataFrame, tests: DataFrame) -> DataFrame:
    """Every candidate pair of profiles with its comparison."""
    pairs = profile_pairs(incidents, tests)
    keys = [*CASE, *[f"test_{c}" for c in CASE]]
    cases = compared_cases(incidents, tests, pairs).select(*keys, *SLIM)
    return with_comparison(pairs, materialise(cases)).withColumn("rank_key", F.col("test_id"))


def profile_verdicts(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """One decided row per incident profile."""
    # Both tables are read several times below and are far smaller than the lines.
    incidents = materialise(incident_profiles(incident_lines(spark, sf_dir) if lines is None else lines))
    tests = materialise(test_profiles(test_lines(spark, sf_dir)))
    summary = summarise(compared_profiles(incidents, tests), PROFILE, detail=False)
    corpus = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'").agg(
        F.count(F.lit(1)).alias("corpus_size")
    )
    rows = with_cases(with_lonely(summary, incidents, tests), incidents).join(F.broadcast(corpus))  # one row
    return decide(rows, corpus_size=F.col("corpus_size"), retrieval_top="retrieval_top")


VERDICT_COLUMNS = ["coverage", "effectiveness", "gap_type", "family_key", "confidence", "confidence_level"]


def incident_verdicts(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """The verdict of every incident line: profiles are decided once and fanned
    back out, a join in which each line meets exactly one profile."""
    lines = incident_lines(spark, sf_dir, *extra)
    verdicts = profile_verdicts(spark, sf_dir, lines).select(
        *PROFILE, *VERDICT_COLUMNS, F.col("best.test_id").alias("best_test_id"),
        F.round("best.strength", 6).alias("best_strength"),
    )
    return lines.join(verdicts, PROFILE)
