"""Table schemas.  Ordered maps are arrays of pairs; nothing is inferred."""

PAIRS = "ARRAY<STRUCT<key: STRING, value: STRING>>"

TEST_SCHEMA = (
    f"source_id BIGINT, test_id STRING, seq BIGINT, name STRING, feature STRING, scenario STRING, inputs {PAIRS}, "
    "expected_behavior STRING, tags ARRAY<STRING>, source STRING, framework STRING, line_number INT, "
    "assertions ARRAY<STRING>, literals ARRAY<STRING>, signals ARRAY<STRING>, extra MAP<STRING, STRING>"
)
RAW_INCIDENT_SCHEMA = (
    "id STRING, text STRING, title STRING, feature STRING, severity STRING, occurred_at STRING, "
    "conditions MAP<STRING, STRING>"
)
TRUTH_SCHEMA = (
    "incidents ARRAY<STRUCT<id: STRING, key: STRING, feature: STRING, expected_coverage: STRING, "
    "expected_family: STRING, note: STRING>>"
)
OBSERVATION_SCHEMA = (
    "incident_id STRING, gap_type STRING, family_key STRING, feature STRING, severity STRING, coverage STRING, "
    "arrival BIGINT"
)
PROPOSED_FACT_SCHEMA = "incident_id STRING, kind STRING, name STRING, value STRING, quote STRING, ord INT"
SOURCE_SCHEMA = "source_id BIGINT, kind STRING, location STRING, label STRING, test_count BIGINT, indexed_at TIMESTAMP"
RUN_SCHEMA = "kind STRING, status STRING, detail MAP<STRING, STRING>, duration_ms BIGINT, started_at TIMESTAMP"
