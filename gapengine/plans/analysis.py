"""Analysis of many incidents against one catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gapengine.functions.extract import incident_text, no_pairs
from gapengine.functions.text import normalize, strings
from gapengine.operators.compare import PER_WORD, compare_pairs, describe_columns, prepare_incidents, prepare_tests, summarise
from gapengine.operators.decide import decide
from gapengine.operators.explain import with_explanations
from gapengine.operators.history import recurrence_at_arrival
from gapengine.operators.incidents import normalize_incidents
from gapengine.operators.index import Index, build_index, searchable_tests, with_index_signals
from gapengine.operators.retrieve import retrieve
from gapengine.operators.sizing import materialise

TEXT = ("title", "feature", "scenario", "description", "failure", "root_cause", "conditions", "signals")


def index_catalogue(tests: DataFrame) -> tuple[DataFrame, Index]:
    """AGG-24: tests with derived signals, and their index.  Both are written once
    (see ``materialise``), so every analysis starts from stored tables."""
    tests = materialise(with_index_signals(tests))
    index = build_index(searchable_tests(tests))
    return tests, index._replace(**{n: materialise(getattr(index, n)) for n in ("vectors", "vocabulary", "feature_counts")})


def candidates_for(incidents: DataFrame, tests: DataFrame, index: Index, **how) -> tuple[DataFrame, DataFrame]:
    """RNK-1..5 for normalised incidents and a catalogue keyed by ``doc_id``;
    ``how``: settings of ``retrieve``."""
    queries = incidents.select("incident_id", incident_text(*[F.col(c) for c in TEXT]).alias("text")).filter("trim(text) <> ''")
    i = incidents.select(
        "incident_id",
        normalize(F.col("feature")).alias("i_feature"),
        F.transform("conditions", lambda p: normalize(p["key"])).alias("i_keys"),
        F.col("signals").alias("i_signals"),
    )
    t = tests.select(
        "doc_id",
        normalize(F.col("feature")).alias("t_feature"),
        F.transform(F.coalesce("inputs", no_pairs()), lambda p: normalize(p["key"])).alias("t_keys"),
        F.coalesce("signals", strings([])).alias("t_signals"),
    )
    return retrieve(index, queries, i, t, "incident_id", **how)


def with_distinctive_terms(prepared: DataFrame, index: Index) -> DataFrame:
    """FLT-6/JON-15: the incident's terms that are rare in the catalogue."""
    rare = (
        prepared.select("incident_id", F.explode("i_terms").alias("term"))
        .join(index.term_stats.filter("is_distinctive").select("term"), "term")
        .groupBy("incident_id").agg(F.collect_list("term").alias("i_distinctive"))
    )
    return prepared.join(rare, "incident_id", "left").withColumn("i_distinctive", F.coalesce("i_distinctive", strings([])))


def compared(prepared: DataFrame, candidates: DataFrame, tests: DataFrame, condition_words: int) -> DataFrame:
    """JON-4/DEC-5: the candidates with both sides' attributes, compared.  Only
    tests that are candidates are prepared."""
    needed = tests.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    t = prepare_tests(needed)
    t = t.select(
        "doc_id", "test_id", F.col("feature").alias("test_feature"), "source", "line_number",
        describe_columns().alias("described"), *[c for c in t.columns if c.startswith("t_")],
    )
    i = prepared.select("incident_id", *[c for c in prepared.columns if c.startswith("i_")])
    pairs = candidates.drop("feature_match").join(t, "doc_id").join(i, "incident_id")
    return compare_pairs(pairs, condition_words)


def compared_incidents(incidents: DataFrame, tests: DataFrame, index: Index, **how) -> DataFrame:
    """One row per incident with all that its verdict is decided from; ``how``: settings of ``retrieve``."""
    incidents = materialise(incidents)
    candidates, stats = candidates_for(incidents, tests, index, **how)
    candidates = materialise(candidates)
    prepared = materialise(with_distinctive_terms(prepare_incidents(incidents), index))
    most = prepared.agg(F.coalesce(F.max(F.size("i_conds")), F.lit(0))).first()[0]
    pairs = compared(prepared, candidates, tests, max(1, -(-most // PER_WORD))).withColumn("feature", F.col("test_feature"))
    summary = summarise(
        pairs, "incident_id", detail=True,
        best_columns=("test_id", "feature", "source", "line_number", "described"),
    ).drop("retrieval_top")
    return (
        prepared.join(summary, "incident_id", "left").join(stats, "incident_id", "left")
        .join(F.broadcast(index.corpus.select(F.col("n_docs").alias("corpus_size"))))  # one row
    )


def _decided(rows: DataFrame, similar: DataFrame | None, feature_points: dict | None) -> DataFrame:
    rows = rows.withColumn("similar_incidents", F.lit(0)) if similar is None else rows.join(similar, "incident_id", "left")
    return decide(
        rows, corpus_size=F.col("corpus_size"), retrieval_top="retrieval_top", feature_points=feature_points,
        similar=F.coalesce("similar_incidents", F.lit(0)),
    )


def analyze(
    incidents: DataFrame, tests: DataFrame, index: Index, *, similar: DataFrame | None = None,
    feature_points: dict | None = None, explain: bool = True, **how,
) -> DataFrame:
    """DEC-15: one analysed row per incident.

    ``similar``: (incident_id, similar_incidents), the recurrence known on arrival.
    ``how``: settings of ``retrieve`` (top_k, oversample, search, embed).
    """
    decided = _decided(compared_incidents(incidents, tests, index, **how), similar, feature_points)
    return with_explanations(materialise(decided)) if explain else decided


def analyze_batch(
    raw: DataFrame, tests: DataFrame, index: Index, *, feature_points: dict | None = None, explain: bool = True, **how
) -> tuple[DataFrame, DataFrame]:
    """DEC-20: (analysed incidents, issues) of a list of raw reports with any supplied fields.

    ``raw``: as for ``normalize_incidents``, with ``arrival``, the place in the
    list.  Verdicts don't depend on recurrence, so all are decided at once; the
    gaps found give each incident its recurrence on arrival, and that its risk.
    """
    incidents, issues = normalize_incidents(raw, index.vocabulary, index.feature_counts)
    incidents = materialise(incidents)
    rows = materialise(compared_incidents(incidents, tests, index, **how))
    gaps = _decided(rows, None, feature_points).filter("gap_type is not null").select("incident_id", "family_key")
    gaps = materialise(gaps).join(incidents.select("incident_id", "arrival"), "incident_id")
    similar = recurrence_at_arrival(incidents.select("incident_id", "arrival", "signals"), gaps)
    decided = materialise(_decided(rows, similar, feature_points))
    return with_explanations(decided) if explain else decided, issues


def relevant_tests(candidates: DataFrame, tests: DataFrame, matched: DataFrame) -> DataFrame:
    """FLT-8: the stored projection of each candidate."""
    fields = ("test_id", "name", "feature", "scenario", "inputs", "expected_behavior", "source", "framework", "line_number")
    return (
        candidates.join(tests.select("doc_id", *fields), "doc_id").join(matched, ["incident_id", "doc_id"], "left")
        .select(
            "incident_id", "rank_key", *fields, "score", "vector_score", "lexical_score", "feature_match",
            F.coalesce("matched_terms", strings([])).alias("matched_terms"),
        )
    )


CANDIDATE = (
    "test_id STRING, name STRING, feature STRING, scenario STRING, inputs MAP<STRING, STRING>, expected_behavior STRING, source STRING, "
    "framework STRING, line_number INT, score DOUBLE, vector_score DOUBLE, lexical_score DOUBLE, feature_match BOOLEAN, matched_terms ARRAY<STRING>"
)


def candidate_of(stored: Column) -> Column:
    """TXT-41: a stored candidate's JSON as a struct; absent fields are empty, zero or false."""
    c = F.from_json(stored, CANDIDATE)
    texts = ("test_id", "name", "feature", "scenario", "expected_behavior", "source", "framework")
    return F.struct(
        *[F.coalesce(c[f], F.lit("")).alias(f) for f in texts], c["line_number"].alias("line_number"),
        F.coalesce(c["inputs"], F.create_map().cast("map<string,string>")).alias("inputs"),
        *[F.coalesce(c[f], F.lit(0.0)).alias(f) for f in ("score", "vector_score", "lexical_score")],
        F.coalesce(c["feature_match"], F.lit(False)).alias("feature_match"),
        F.coalesce(c["matched_terms"], strings([])).alias("matched_terms"),
    )
