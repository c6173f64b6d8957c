"""Whole analyses as registered queries: line items that stayed are the catalogue, returned ones the incidents.

Every line has a report sentence made from its values.  Equal sentences are one
test or one incident; the verdict of an incident goes back to all its lines.
Retrieval, comparison, decision and explanation run as for any caller; texts
and scores have no SQL form, the tests hold small catalogues against verdicts
worked out by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gapengine.functions import extract as X, text as T
from gapengine.operators.sizing import materialise
from gapengine.plans.analysis import analyze_batch, index_catalogue
from gapengine.plans.derived import table

C = F.col
FEATURES = ["Checkout", "Cart", "Orders", "Refunds", "Sessions", "Pricing", "Accounts", "Parsing"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their sentence and feature; untaxed returned ones say nothing that could be compared."""
    from gapengine.plans.queries import _sentences

    feature = F.element_at(T.strings(FEATURES), F.pmod(C("l_orderkey") + C("l_linenumber"), F.lit(8)).cast("int") + 1)
    lines = _sentences(spark, sf_dir, C("l_returnflag"), C("l_tax"), feature.alias("feature"))
    vague = (C("l_returnflag") == "R") & (C("l_tax") == 0)
    return materialise(lines.withColumns({
        "sentence": F.when(vague, F.lit("Something looked odd.")).otherwise(C("sentence")), "feature": F.when(~vague, C("feature")),
    }))


def _catalogue(lines: DataFrame) -> DataFrame:
    """Each distinct sentence of a line that stayed, as a test that has its conditions as inputs.

    Sessions have no tests, and those of carts know a timeout or a retry, never both."""
    kept = lines.filter("l_returnflag <> 'R' and feature <> 'Sessions'")
    half = F.when(C("l_linenumber") % 2 == 0, F.lit(" timed out")).otherwise(F.lit(" after a retry"))
    kept = kept.withColumn("name", F.replace(C("sentence"), F.lit(" timed out after a retry"), half))
    kept = kept.groupBy("name", "feature").agg(F.min(C("l_orderkey") * 10 + C("l_linenumber")).alias("seq"))
    none = T.strings([])
    return kept.select(
        F.lit(1).cast("bigint").alias("source_id"), F.concat(F.lit("TC-"), F.md5("name")).alias("test_id"), "seq", "name", "feature",
        C("name").alias("scenario"), X.extract_conditions(C("name")).alias("inputs"), F.lit("").alias("expected_behavior"),
        *[none.alias(c) for c in ("tags", "assertions", "literals", "signals")], F.lit("lineitem").alias("source"), F.lit("table").alias("framework"),
        F.lit(None).cast("int").alias("line_number"), F.create_map().cast("map<string,string>").alias("extra"),
    ).withColumn("doc_id", F.concat_ws("/", "source_id", "test_id"))


def analyzed_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEC-15/DEC-20, EXP-1..7: every returned line with the verdict of its report, the evidence and the advice."""
    lines = _lines(spark, sf_dir)
    tests, index = index_catalogue(_catalogue(lines))
    returned = lines.filter("l_returnflag = 'R'")
    raw = returned.groupBy(C("sentence").alias("text")).agg(
        F.max("feature").alias("feature"), F.min(C("l_orderkey") * 10 + C("l_linenumber")).alias("arrival")
    )
    raw = materialise(raw.withColumn("incident_id", F.concat(F.lit("I-"), F.md5("text"))))
    analysed = analyze_batch(raw, tests, index)[0].join(raw.select("incident_id", C("text").alias("sentence")), "incident_id")
    verdicts = analysed.select(
        "sentence", "incident_id", C("feature").alias("incident_feature"), "coverage", "gap_type", "family_key", "confidence", "risk", "similar_incidents",
        C("best.test_id").alias("best_test"), C("comparison.scenario_match").alias("topical"), "candidate_count", "gap_summary", "gap_detail", "explanation",
        F.array_join(F.transform("evidence", lambda e: e["kind"]), ";").alias("evidence"),
        F.array_join(F.transform("missing_conditions", lambda m: m["key"]), ";").alias("missing"),
        F.array_join(F.transform("recommendations", lambda r: r["title"]), ";").alias("advice"),
    )
    return returned.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "sentence").join(verdicts, "sentence")


QUERIES = [analyzed_returns]
