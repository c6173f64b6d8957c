"""A small catalogue, one incident for each kind of verdict."""

import pytest
from pyspark.sql import functions as F

from gapengine.operators.explain import evidence_rows, gap_rows, guarded_text, recommendation_rows
from gapengine.operators.incidents import merge_proposed_facts, normalize_incidents
from gapengine.operators.index import describe_index, load_index, save_index
from gapengine.plans.analysis import analyze, analyze_batch, index_catalogue
from gapengine.schemas import PROPOSED_FACT_SCHEMA, TEST_SCHEMA

TESTS = [
    ("T-1", "ten percent discount", "Checkout", "apply a ten percent discount", {"discount": "10%"}),
    ("T-2", "twenty percent discount", "Checkout", "apply a twenty percent discount", {"discount": "20%"}),
    ("T-3", "retry payment", "Payments", "payment is retried after decline", {"payment": "declined"}),
    ("T-4", "payment timeout", "Payments", "payment request timed out", {"timeout": "30"}),
    ("T-5", "update email", "Profile", "changing the account email address", {}),
    ("T-6", "filter by category", "Search", "filtering search results by category", {}),
    ("T-7", "locked login", "Authentication", "login with a locked account", {"username": "locked"}),
]
REPORTS = [
    ("I1", "Checkout failed when a 100% discount was applied to the cart.", "Checkout"),
    ("I2", "Payment timed out and the immediate retry charged the card twice.", "Payments"),
    ("I3", "Saving broke. The email is null.", "Profile"),
    ("I4", "Something looked odd.", None),
    ("I5", "Checkout with a 10% discount gave the wrong total.", "Checkout"),
    ("I6", "  ", None),
    ("I7", "A concurrent search deadlock.", "Search"),
]


@pytest.fixture(scope="module")
def loaded(spark):
    rows = [
        (1, i, n, name, feature, scenario, [{"key": k, "value": v} for k, v in inputs.items()], "", [], "suite.csv", "csv", None, [], [], [], {})
        for n, (i, name, feature, scenario, inputs) in enumerate(TESTS)
    ]
    tests = spark.createDataFrame(rows, TEST_SCHEMA).withColumn("doc_id", F.concat_ws("/", "source_id", "test_id"))
    tests, index = index_catalogue(tests)
    raw = spark.createDataFrame(REPORTS, "incident_id string, text string, feature string")
    incidents, issues = normalize_incidents(raw, index.vocabulary, index.feature_counts)
    return tests, index, incidents.checkpoint(), issues


@pytest.fixture(scope="module")
def analysed(loaded):
    tests, index, incidents, _ = loaded
    return analyze(incidents, tests, index).checkpoint()


def test_empty_report_is_an_issue(loaded):
    assert [r.location for r in loaded[3].collect()] == ["I6"]


def test_verdicts(analysed):
    got = {r.incident_id: (r.coverage, r.gap_type) for r in analysed.collect()}
    assert got == {
        "I1": ("PARTIAL", "BOUNDARY_CONDITION"),
        "I2": ("NOT_COVERED", "STATE_TRANSITION"),
        "I3": ("PARTIAL", "NULL_HANDLING"),
        "I4": ("INSUFFICIENT_EVIDENCE", None),
        "I5": ("COVERED", "WEAK_ASSERTION"),
        "I7": ("NOT_COVERED", "CONCURRENCY"),
    }


def test_evidence_names_only_candidates(analysed):
    rows = evidence_rows(analysed).collect()
    kinds = [r.kind for r in sorted(rows, key=lambda r: r.ord) if r.incident_id == "I1"]
    assert kinds == ["production_condition", "production_signal", "feature", "condition_difference", "signal_absent"]
    assert any(r.incident_id == "I2" and r.kind == "combination" for r in rows)
    assert {r.test_id for r in rows if r.test_id} <= {t[0] for t in TESTS}


def test_recommendations_and_gaps(analysed):
    rows = recommendation_rows(analysed).collect()
    per = {}
    for r in rows:
        per.setdefault(r.incident_id, []).append(r)
    assert all(len(v) <= 6 for v in per.values())
    values = [p["value"] for r in per["I1"] for p in r.suggested_inputs]
    assert values == ["0%", "50%", "100%", "-1", "invalid"]
    assert len(per["I4"]) == 3
    assert {r.incident_id for r in gap_rows(analysed).collect()} == {"I1", "I2", "I3", "I5", "I7"}
    missing = {r.incident_id: [p["key"] for p in r.missing_conditions] for r in gap_rows(analysed).collect()}
    assert missing["I1"] == ["discount", "signal:boundary_max"] and missing["I2"] == ["combination"]


def test_index_round_trip(spark, loaded, tmp_path):
    index = loaded[1]
    save_index(index, str(tmp_path))
    again = load_index(spark, str(tmp_path))
    assert describe_index(again).first().tests == len(TESTS)
    again.corpus.limit(0).write.mode("overwrite").parquet(str(tmp_path / "vectors"))
    assert load_index(spark, str(tmp_path)) is None
    assert load_index(spark, str(tmp_path / "nowhere")) is None


def test_proposed_facts(spark, loaded):
    facts = spark.createDataFrame(
        [
            ("I4", "feature", "Search", None, "", 1),
            ("I4", "condition", "Page Size", "9", "looked odd", 2),
            ("I4", "condition", "offset", "9", "never written", 3),
            ("I4", "signal", "retry", None, "Something looked", 4),
            ("I4", "signal", "made_up", None, "Something looked", 5),
            ("I1", "condition", "discount", "5%", "Checkout failed", 1),
        ],
        PROPOSED_FACT_SCHEMA,
    )
    known = spark.createDataFrame([("Search",)], "feature string")
    got = {r.incident_id: r for r in merge_proposed_facts(loaded[2], facts, known).collect()}
    assert got["I4"].feature == "Search" and got["I4"].signals == ["retry"]
    assert [(p["key"], p["value"]) for p in got["I4"].conditions] == [("page_size", "9")]
    assert [p["value"] for p in got["I1"].conditions if p["key"] == "discount"] == ["100%"]


def test_guarded_text(spark):
    df = spark.sql("select 'see TC-1' as a, 'see TC-9' as b, 'old' as o, array('TC-1') as ids")
    row = df.select(*[guarded_text(F.col(c), F.col("o"), F.col("ids")) for c in "ab"]).first()
    assert tuple(row) == ("see TC-1", "old")


def test_any_number_of_conditions(spark, loaded):
    tests, index, _, _ = loaded
    many = [{"key": f"field_{i}", "value": str(i)} for i in range(40)]
    raw = spark.createDataFrame([("M1", "Checkout failed.", "Checkout", many)], "incident_id string, text string, feature string, conditions array<struct<key:string,value:string>>")
    incidents, _ = normalize_incidents(raw, index.vocabulary, index.feature_counts)
    row = analyze(incidents, tests, index).first()
    assert len(row.facts) == 40 and row.coverage in ("PARTIAL", "NOT_COVERED")


def test_batch_with_supplied_fields_and_arrivals(spark, loaded, analysed):
    tests, index, _, _ = loaded
    raw = spark.createDataFrame(
        [(i, t, f, n, "LOW" if i == "I5" else None) for n, (i, t, f) in enumerate(REPORTS)] + [(f"B{n}", REPORTS[6][1], "Search", 10 + n, None) for n in range(3)],
        "incident_id string, text string, feature string, arrival bigint, severity string",
    )
    rows, issues = analyze_batch(raw, tests, index)
    got = {r.incident_id: r for r in rows.collect()}
    assert [r.location for r in issues.collect()] == ["I6"]
    one_by_one = {r.incident_id: (r.coverage, r.gap_type, r.confidence) for r in analysed.collect()}
    assert {i: (r.coverage, r.gap_type, r.confidence) for i, r in got.items() if i in one_by_one} == one_by_one
    # Each deadlock report knows of those that came before it.
    assert [got[i].similar_incidents for i in ("I7", "B0", "B1", "B2")] == [0, 1, 2, 3]
    assert got["B2"].risk_points > got["B0"].risk_points and got["I5"].severity == "LOW"
    bounded, _ = analyze_batch(raw, tests, index, plain_postings=0)
    assert {r.incident_id: (r.coverage, r.confidence, r.candidate_count) for r in bounded.collect()} == {i: (r.coverage, r.confidence, r.candidate_count) for i, r in got.items()}
