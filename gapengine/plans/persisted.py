"""Tables written to the shared folder and read back, pages, lookups and the whole dashboard, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from gapengine.functions import text as T
from gapengine.operators import catalogue as cat, history as hist, patterns as pat
from gapengine.operators.sizing import shared_folder
from gapengine.plans import report
from gapengine.plans.analysis import candidate_of
from gapengine.plans.derived import table

C = F.col


def _new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"


def stored_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-7: two batches of orders as incidents; one that is stored already stays as it is."""
    orders = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("incident_id"), C("o_orderpriority").alias("severity"))
    path = _new_folder(spark)
    stored = hist.store_incidents(orders.filter("incident_id % 3 <> 0").withColumn("batch", F.lit("first")), path)
    return hist.store_incidents(orders.withColumn("batch", F.lit("second")), path, stored)


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-14/LIM-4: events as runs, appended kind by kind, the newest read back."""
    runs = table(spark, sf_dir, "events").select(C("event_id").alias("run_id"), C("event_type").alias("kind"), C("ts").alias("started_at"))
    path = _new_folder(spark)
    hist.append(runs.filter("kind = 'error'"), path)
    hist.append(runs.filter("kind <> 'error'"), path)
    return report.recent(spark.read.schema(runs.schema).parquet(path), "started_at", 12, "run_id")


def incident_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-11/JON-12: customers as incidents, orders as analyses, lines as gaps, evidence and candidates."""
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").select(
        C("l_orderkey").alias("analysis_id"), ((C("l_orderkey") * 10 + C("l_linenumber")) * 1_000_000 + C("l_partkey")).alias("gap_id"), C("l_returnflag").alias("gap_type"),
        F.lit("f").alias("family_key"), C("l_linenumber").alias("ord"), C("l_returnflag").alias("statement"),
        C("l_partkey").alias("test_id"), C("l_quantity").alias("score"))
    detail = hist.incident_detail(
        table(spark, sf_dir, "customer").select(C("c_custkey").alias("incident_id")),
        orders.select(C("o_orderkey").alias("analysis_id"), C("o_custkey").alias("incident_id")), lines,
        lines.select("gap_id", C("gap_id").alias("recommendation_id"), F.lit("t").alias("title"), F.lit("PROPOSED").alias("status")),
        lines, lines.withColumn("rank_key", C("ord")))
    first = hist.first_gap_types(lines).withColumnRenamed("gap_type", "first_gap")
    return detail.join(first, "analysis_id", "left").select(
        "incident_id", "analysis_id", "first_gap", F.coalesce(F.size("gaps"), F.lit(0)).cast("bigint").alias("n_gaps"),
        F.array_join(F.transform("evidence", lambda e: e["statement"]), ",").alias("evidence"),
        F.array_join(F.transform("relevant_tests", lambda t: t["test_id"].cast("string")), ",").alias("tests"))


def part_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-1/LIM-1/FLT-9: a page of matching parts with the total of all matches."""
    tests = table(spark, sf_dir, "part").select(
        C("p_partkey").alias("test_id"), C("p_name").alias("name"), C("p_brand").alias("feature"), F.lit("").alias("scenario"),
        C("p_type").alias("framework"), F.lit("part").alias("source"), C("p_size").alias("line_number"), C("p_partkey").alias("seq"))
    hits = cat.search_tests(tests, query="WIDGET")
    page = cat.counted_page(hits, [C("seq")], 20, 10)
    return cat.test_items(page).join(page.select("test_id", "total"), "test_id").select("test_id", "name", "feature", "line_number", "total")


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-9: documents as a list of incidents."""
    docs = table(spark, sf_dir, "documents").select(
        C("doc_id").alias("incident_id"), C("source").alias("title"), C("lang").alias("feature"), F.lit("LOW").alias("severity"), C("text").alias("description"))
    return cat.incident_items(docs)


def parsed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-41: parts stored as candidates' JSON, some fields left out, read back."""
    stored = table(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(
        C("p_partkey").cast("string").alias("test_id"), F.when(C("p_size") > 20, C("p_name")).alias("name"),
        F.when(C("p_size") > 10, C("p_retailprice")).alias("score"), F.array("p_type", "p_brand").alias("matched_terms"),
        F.create_map(F.lit("size"), C("p_size").cast("string")).alias("inputs"))).alias("json"))
    c = stored.select("p_partkey", candidate_of(C("json")).alias("c"))
    return c.select("p_partkey", "c.test_id", "c.name", "c.score", "c.feature_match", F.array_join("c.matched_terms", "|").alias("terms"), F.element_at("c.inputs", "size").alias("size"))


def _part_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(C("p_type").alias("family_key")).agg(F.count(F.lit(1)).alias("incident_count")).withColumn(
        "label", F.concat(F.lit("Parts: "), F.initcap("family_key")))


def strongest_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIM-5 and LIM-7: the five largest part types, and one looked up by key and by label."""
    p = _part_patterns(spark, sf_dir)
    shown = pat.strongest(p).withColumn("how", F.lit("top"))
    by_key = pat.pattern_by_key(p, "ECONOMY").withColumn("how", F.lit("key"))
    return shown.union(by_key).union(pat.pattern_by_key(p, "Parts: Economy").withColumn("how", F.lit("label"))).select("how", "family_key", "label", "incident_count")


def dashboard_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-19 whole: customers as incidents, orders as analyses, parts as tests, events as runs."""
    tests = table(spark, sf_dir, "part").select(C("p_brand").alias("feature"), C("p_type").alias("framework"))
    incidents = table(spark, sf_dir, "customer").select(C("c_custkey").alias("incident_id"), C("c_custkey").alias("arrival"))
    analyses = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("analysis_id"), C("o_custkey").alias("incident_id"),
        T.lookup(C("o_orderstatus"), {"F": "COVERED", "O": "PARTIAL"}, "NOT_COVERED").alias("coverage"))
    patterns, runs = _part_patterns(spark, sf_dir), table(spark, sf_dir, "events").select(C("event_id").alias("run_id"), C("event_type").alias("kind"), C("ts").alias("started_at"))
    metrics = report.dashboard(incidents, analyses, table(spark, sf_dir, "lineitem"), tests, patterns)
    return report.dashboard_sections(metrics, cat.catalogue_stats(tests), patterns, incidents, hist.latest_analysis(analyses), runs)


QUERIES = [stored_incidents, run_log, incident_details, part_page, document_items, parsed_candidates, strongest_patterns, dashboard_sections]
_PATTERNS = "p AS (SELECT p_type AS family_key, count(*) AS incident_count, 'Parts: ' || upper(p_type[1]) || lower(p_type[2:]) AS label FROM part GROUP BY p_type)"
_LATEST = "l AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey, CASE max_by(o_orderstatus, o_orderkey) WHEN 'F' THEN 'COVERED' WHEN 'O' THEN 'PARTIAL' ELSE 'NOT_COVERED' END AS coverage FROM orders GROUP BY o_custkey)"
ORACLES = {
    "stored_incidents": "SELECT o_orderkey AS incident_id, o_orderpriority AS severity, CASE WHEN o_orderkey % 3 <> 0 THEN 'first' ELSE 'second' END AS batch FROM orders",
    "run_log": "SELECT event_id AS run_id, event_type AS kind, ts AS started_at FROM events ORDER BY ts DESC, event_id LIMIT 12",
    "incident_details": f"""WITH {_LATEST}, g AS (SELECT l_orderkey, count(*) AS n, first(l_returnflag ORDER BY l_linenumber * 1000000 + l_partkey, l_returnflag) AS f,
        string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS e, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS t FROM lineitem GROUP BY l_orderkey)
      SELECT c_custkey AS incident_id, o_orderkey AS analysis_id, f AS first_gap, coalesce(n, 0) AS n_gaps, e AS evidence, t AS tests
      FROM customer LEFT JOIN l ON c_custkey = o_custkey LEFT JOIN g ON o_orderkey = l_orderkey""",
    "part_page": """WITH h AS (SELECT * FROM part WHERE contains(lower(p_name), 'widget')) SELECT p_partkey AS test_id, p_name AS name, p_brand AS feature, p_size AS line_number,
      (SELECT count(*) FROM h) AS total FROM h ORDER BY p_partkey LIMIT 20 OFFSET 10""",
    "document_items": "SELECT doc_id AS incident_id, source AS title, lang AS feature, 'LOW' AS severity, substr(text, 1, 400) AS description FROM documents",
    "parsed_candidates": """SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS test_id, CASE WHEN p_size > 20 THEN p_name ELSE '' END AS name,
      CASE WHEN p_size > 10 THEN p_retailprice ELSE 0.0 END AS score, false AS feature_match, p_type || '|' || p_brand AS terms, CAST(p_size AS VARCHAR) AS size FROM part""",
    "strongest_patterns": f"""WITH {_PATTERNS}, t AS (SELECT * FROM p ORDER BY incident_count DESC, label LIMIT 5)
      SELECT 'top' AS how, family_key, label, incident_count FROM t UNION ALL SELECT 'key', family_key, label, incident_count FROM p WHERE family_key = 'ECONOMY'
      UNION ALL SELECT 'label', family_key, label, incident_count FROM p WHERE family_key = 'ECONOMY'""",
    "dashboard_sections": f"""WITH {_PATTERNS}, {_LATEST}, t AS (SELECT * FROM p ORDER BY incident_count DESC, label LIMIT 5),
      i AS (SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 8), r AS (SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 6)
      SELECT 'metric' AS section, lower(v) AS name, CAST(count(coverage) AS VARCHAR) AS value
        FROM (VALUES ('COVERED'), ('PARTIAL'), ('NOT_COVERED'), ('INSUFFICIENT_EVIDENCE')) AS c(v) LEFT JOIN l ON coverage = v GROUP BY v
      UNION ALL SELECT 'metric', 'incidents', CAST(count(*) AS VARCHAR) FROM customer UNION ALL SELECT 'metric', 'test_gaps', CAST(count(*) AS VARCHAR) FROM lineitem
      UNION ALL SELECT 'metric', 'patterns', CAST(count(*) AS VARCHAR) FROM p UNION ALL SELECT 'metric', 'tests_indexed', CAST(count(*) AS VARCHAR) FROM part
      UNION ALL SELECT 'catalogue', 'total:', CAST(count(*) AS VARCHAR) FROM part UNION ALL SELECT 'catalogue', 'feature:' || p_brand, CAST(count(*) AS VARCHAR) FROM part GROUP BY p_brand
      UNION ALL SELECT 'catalogue', 'framework:' || p_type, CAST(count(*) AS VARCHAR) FROM part GROUP BY p_type
      UNION ALL SELECT 'pattern', label, CAST(incident_count AS VARCHAR) FROM t
      UNION ALL SELECT 'incident', CAST(c_custkey AS VARCHAR), coalesce(coverage, '') FROM i LEFT JOIN l ON c_custkey = o_custkey
      UNION ALL SELECT 'run', CAST(event_id AS VARCHAR), event_type FROM r""",
}
