"""Exported test rows, incident records and phrases from the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gapengine import fixed
from gapengine.functions import extract as X, text as T
from gapengine.operators import catalogue as cat
from gapengine.operators.incidents import normalize_incidents
from gapengine.plans.derived import table
from gapengine.sources.tabular import named_columns, rows_to_tests

C = F.col


def exported_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-2..5: parts as an export with headers of its own, read into tests."""
    export = table(spark, sf_dir, "part").select(
        F.concat(F.lit("P-"), "p_partkey").alias("Test Case ID"), F.concat_ws(" ", "p_name", "p_type").alias("TestTitle"),
        F.lit("Return it. Then count.").alias("Test_Steps"), F.lit("Money is back").alias("Expected-Result"), F.lower("p_brand").alias("Module"),
        F.concat_ws("; ", "p_type", F.lit(""), "p_name").alias("labels"),
        F.concat(F.lit("pack size = "), C("p_size"), F.lit("; shelf: row "), C("p_partkey") % 7, F.lit("; pack size = 0")).alias("Test Data"),
    )
    tests = rows_to_tests(named_columns(export, "exports/returns.csv"))
    return tests.select(
        "test_id", "name", "feature", "scenario", "expected_behavior", X.pairs_text(C("inputs"), "=", sep=";").alias("inputs"),
        F.array_join("tags", "|").alias("tags"),
    )


def incident_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-26..33/SRC-15: orders as reports, normalised with a supplied feature and time."""
    reach = T.lookup(C("o_orderpriority"), {"1-URGENT": "Outage.", "2-HIGH": "Many customers.", "5-LOW": "Cosmetic."}, "One shop.")
    raw = table(spark, sf_dir, "orders").select(
        C("o_orderkey").cast("string").alias("incident_id"),
        F.concat(F.lit("Parcel held up. "), reach, F.lit(" It failed at the border of zone "), C("o_custkey") % 9,
                 F.lit(" again.\nRoot cause: papers of client  "), C("o_custkey"), F.lit(" unread")).alias("text"),
        F.concat(F.lit("status "), F.lower("o_orderstatus")).alias("feature"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("occurred_at"),
    )
    incidents, _ = normalize_incidents(raw)
    return incidents.select("incident_id", "title", "feature", "failure", "root_cause", "severity", F.date_format("occurred_at", "yyyy-MM-dd").alias("day"))


def event_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-34/35: what each user did, as one phrase; codes without a phrase are spelt out."""
    codes = {"error": "error_handling", "login": "permission", "logout": "state_transition"}
    kinds = table(spark, sf_dir, "events").select("user_id", F.coalesce(T.lookup(C("event_type"), codes), F.concat(C("event_type"), F.lit("_event"))).alias("code")).distinct()
    # At most the event types of the table for each user.
    return kinds.groupBy("user_id").agg(T.join_words(F.transform(F.array_sort(F.collect_list("code")), T.signal_phrase)).alias("phrase"))


def part_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-10/12/24/37: names of parts as test names, headers and locations."""
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey", X.humanize_test_name(F.concat(F.lit("test_"), F.replace("p_name", F.lit(" "), F.lit("_")))).alias("readable"),
        T.canonical_header(F.concat(F.lit("  Price/"), "p_type", F.lit(" (net)"))).alias("header"),
        T.location(F.lower("p_brand"), F.when(C("p_size") % 2 == 0, C("p_size"))).alias("location"),
        T.humanize(F.when(C("p_size") > 10, C("p_type"))).alias("shown"),
    )


def sources_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-5/LIM-8: part types come as sources beside a few known ones; ids go on, labels stay unless given."""
    known = table(spark, sf_dir, "region").select(
        C("r_regionkey").cast("bigint").alias("source_id"), F.lit("region").alias("kind"), C("r_name").alias("location"), F.lit("old").alias("label"))
    parts = table(spark, sf_dir, "part").groupBy("p_type").count().select(F.lit("type").alias("kind"), C("p_type").alias("location"), F.lit("new").alias("label"))
    again = table(spark, sf_dir, "region").select(F.lit("region").alias("kind"), C("r_name").alias("location"), F.when(C("r_regionkey") > 2, F.lit("seen")).otherwise(F.lit("")).alias("label"))
    return cat.upsert_sources(known, parts.union(again)).select("source_id", "kind", "location", "label")


QUERIES = [exported_tests, incident_records, event_phrases, part_labels, sources_of_parts]

_PHRASE = "CASE code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.SIGNAL_PHRASES.items()) + " ELSE replace(code, '_', ' ') END"
ORACLES = {
    "exported_tests": """SELECT 'P-' || p_partkey AS test_id, p_name || ' ' || p_type AS name, upper(lower(p_brand)[1]) || lower(p_brand)[2:] AS feature,
      'Return it.' AS scenario, 'Money is back' AS expected_behavior, 'pack_size=' || p_size || ';shelf=row ' || (p_partkey % 7) AS inputs,
      p_type || '|' || p_name AS tags FROM part""",
    "incident_records": """SELECT CAST(o_orderkey AS VARCHAR) AS incident_id, 'Parcel held up. ' || CASE o_orderpriority WHEN '1-URGENT' THEN 'Outage.' WHEN '2-HIGH' THEN 'Many customers.'
        WHEN '5-LOW' THEN 'Cosmetic.' ELSE 'One shop.' END || ' It failed at the border of zone ' || (o_custkey % 9) || ' again.' AS title,
      'Status ' || upper(o_orderstatus) AS feature, 'It failed at the border of zone ' || (o_custkey % 9) || ' again' AS failure,
      'papers of client ' || o_custkey || ' unread' AS root_cause,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '5-LOW' THEN 'LOW' ELSE 'MEDIUM' END AS severity,
      strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""",
    "event_phrases": f"""WITH c AS (SELECT DISTINCT user_id, CASE event_type WHEN 'error' THEN 'error_handling' WHEN 'login' THEN 'permission'
        WHEN 'logout' THEN 'state_transition' ELSE event_type || '_event' END AS code FROM events),
      l AS (SELECT user_id, list({_PHRASE} ORDER BY code) AS l FROM c GROUP BY user_id)
      SELECT user_id, CASE WHEN len(l) = 1 THEN l[1] ELSE array_to_string(l[:-2], ', ') || ' and ' || l[-1] END AS phrase FROM l""",
    "part_labels": """SELECT p_partkey, p_name AS readable, 'price ' || trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) || ' net' AS header,
      lower(p_brand) || CASE WHEN p_size % 2 = 0 AND p_size <> 0 THEN ':' || p_size ELSE '' END AS location,
      CASE WHEN p_size > 10 THEN p_type ELSE 'none' END AS shown FROM part""",
    "sources_of_parts": """WITH t AS (SELECT DISTINCT p_type FROM part)
      SELECT CAST(r_regionkey AS BIGINT) AS source_id, 'region' AS kind, r_name AS location, CASE WHEN r_regionkey > 2 THEN 'seen' ELSE 'old' END AS label FROM region
      UNION ALL SELECT CAST((SELECT max(r_regionkey) FROM region) + row_number() OVER (ORDER BY p_type) AS BIGINT), 'type', p_type, 'new' FROM t""",
}
