"""Evidence, gaps, explanations and recommendations.

Short statements over the decided per-incident row (with ``judged`` detail): each
names an extracted value and, where it names a test, a retrieved one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gapengine import fixed
from gapengine.functions.extract import joined_phrases, pair, pairs_text, phrases
from gapengine.functions.text import let, number_text, signal_phrase, strings
from gapengine.operators.compare import first_with, tested_numbers, tested_values, with_status

C = F.col
EVIDENCE = (
    "struct<kind:string,statement:string,production_value:string,test_value:string,test_id:string,"
    "test_source:string,test_line:int>"
)


def fmt(*parts) -> Column:
    """Concatenate; plain strings are literals, NULL pieces vanish."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _evidence(kind: str, statement: Column, production=None, tested=None, cited: Column | None = None) -> Column:
    text = lambda v: (F.lit(None) if v is None else v).cast("string")
    return F.struct(
        F.lit(kind).alias("kind"),
        statement.alias("statement"),
        text(production).alias("production_value"),
        text(tested).alias("test_value"),
        text(None if cited is None else cited["test_id"]).alias("test_id"),
        text(None if cited is None else cited["source"]).alias("test_source"),
        (F.lit(None) if cited is None else cited["line_number"]).cast("int").alias("test_line"),
    )


def _listed(when: Column, item: Column) -> Column:
    return F.when(when, F.array(item)).otherwise(F.array().cast(f"array<{EVIDENCE}>"))


def condition_detail(judged: Column) -> Column:
    """Per production condition: what the judged tests do with it, and which
    values they use.  Reads ``facts``."""

    def detail(f: Column, i: Column) -> Column:
        return F.struct(
            *[f[n].alias(n) for n in ("key", "value", "num", "matched", "different", "mentioned")],
            tested_values(judged, i).alias("tested"),
            tested_numbers(judged, i).alias("numbers"),
            first_with(judged, i, "DIFFERENT").alias("differs_in"),
            first_with(judged, i, "MENTIONED").alias("mentioned_in"),
        )

    return F.transform("facts", detail)


def evidence() -> Column:
    """EXP-1: ordered evidence items."""
    best, verdict = C("best"), C("coverage")
    vague = (verdict == "INSUFFICIENT_EVIDENCE") & (C("n_candidates") > 0)
    thin = F.concat(
        _listed(F.lit(True), _evidence(
            "insufficient_evidence",
            F.lit("report: no value and no behaviour to compare"),
        )),
        _listed(best.isNotNull(), _evidence(
            "insufficient_evidence",
            fmt("nearest test ", best["test_id"], ": only common words shared, neither coverage nor gap"), cited=best,
        )),
    )
    stated = F.transform(
        "i_conds",
        lambda c: _evidence("production_condition", fmt("incident value: ", c["key"], "=", c["value"]), c["value"]),
    )
    behaved = F.transform(
        "i_decisive", lambda s: _evidence("production_signal", fmt("incident behaviour: ", signal_phrase(s)))
    )
    feature = _evidence(
        "feature",
        F.when(
            best["feature_match"],
            fmt("nearest test ", best["test_id"], ": feature ", best["feature"], ", as the incident"),
        ).otherwise(
            fmt("nearest test ", best["test_id"], ": feature ", best["feature"], ", incident: ", C("feature"))
        ),
        cited=best,
    )

    def about(c: Column) -> Column:
        untested = F.size(c["tested"]) == 0
        listed = F.array_join(c["tested"], ", ")
        return (
            F.when(untested & c["mentioned_in"].isNotNull(), _evidence(
                "condition_mentioned",
                fmt(c["key"], ": named without a value in ", c["mentioned_in"]["test_id"], ", incident: ", c["value"]),
                c["value"], cited=c["mentioned_in"]))
            .when(untested, _evidence(
                "condition_absent", fmt(c["key"], ": in no judged test, incident: ", c["value"]), c["value"]))
            .when(c["matched"], _evidence(
                "condition_matched", fmt(c["key"], ": tests and incident: ", c["value"]),
                c["value"], c["value"]))
            .otherwise(_evidence(
                "condition_difference",
                fmt(c["key"], ": tests: ", listed, ", incident: ", c["value"]),
                c["value"], listed, c["differs_in"]))
        )

    absent = F.transform(
        "unmatched", lambda s: _evidence("signal_absent", fmt("in no judged test: ", signal_phrase(s)))
    )
    combined = _evidence(
        "combination",
        fmt("tested apart, never in one test: ", joined_phrases(C("i_decisive"))),
    )
    ineffective = _evidence(
        "effectiveness",
        fmt("test ", best["test_id"], ": same scenario, yet the incident happened; doubt its checks or its data"), cited=best,
    )
    nothing = _evidence("retrieval", F.lit("retrieval: no test for this scenario"))
    full = F.concat(
        stated, behaved,
        F.when(best.isNull(), F.array(nothing)).otherwise(
            F.concat(
                F.array(feature), F.transform("condition_detail", about), absent,
                _listed(C("combination"), combined), _listed(verdict == "COVERED", ineffective),
            )
        ),
    )
    return F.when(vague, thin).otherwise(full)


def _unmatched_pairs() -> Column:
    return F.transform(F.filter("facts", lambda f: ~f["matched"]), lambda f: pair(f["key"], f["value"]))


def missing_conditions() -> Column:
    """EXP-3: unmatched production values, untested signals, the combination."""
    signals = F.transform("unmatched", lambda s: pair(F.concat(F.lit("signal:"), s), signal_phrase(s)))
    together = F.when(
        C("combination"), F.array(pair(F.lit("combination"), F.array_join(phrases(C("i_decisive")), " + ")))
    ).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    return F.concat(_unmatched_pairs(), signals, together)


def gap_summary() -> Column:
    """EXP-4: what is uncovered, most specific fact first."""
    open_pairs = _unmatched_pairs()
    first = F.get(open_pairs, F.lit(0))
    shown = F.array_join(F.transform(open_pairs, lambda p: F.concat(p["key"], F.lit("="), p["value"])), "; ")
    feature = C("feature")
    return (
        F.when(C("combination"), fmt(feature, ": untested together: ", F.array_join(phrases(C("i_decisive")), " + ")))
        .when(C("gap_type") == "WEAK_ASSERTION", fmt(feature, ": ", C("best.test_id"), " matches the incident and stays green"))
        .when((C("gap_type") == "BOUNDARY_CONDITION") & (F.size(open_pairs) > 0), fmt(feature, ": limit ", first["key"], "=", first["value"], " untested"))
        .when(F.size(open_pairs) > 0, fmt(feature, ": untested values: ", shown))
        .when(F.size("unmatched") > 0, fmt(feature, ": untested behaviour: ", F.array_join(phrases(C("unmatched")), "; ")))
        .when(C("coverage") == "NOT_COVERED", fmt(feature, ": nothing comparable in the catalogue"))
        .otherwise(fmt(feature, ": catalogue and incident disagree in substance"))
    )


def gap_detail() -> Column:
    """EXP-5: the nearest test in numbers."""
    used = F.filter("best.conds", lambda c: c["test_value"].isNotNull())
    values = F.array_join(F.transform(used, lambda c: F.concat(c["key"], F.lit("="), c["test_value"])), "; ")
    return F.when(C("best").isNull(), F.lit("nearest test: none")).otherwise(
        F.concat_ws(
            " | ",
            fmt("nearest test: ", C("best.described")),
            F.when(F.size(used) > 0, fmt("its inputs: ", values)),
            F.when(F.size("best.missing_signals") > 0, fmt("not in it: ", F.array_join(phrases(C("best.missing_signals")), "; "))),
        )
    )


def explanation() -> Column:
    """EXP-6: the verdict and the fact it rests on."""
    feature, verdict, best = C("feature"), C("coverage"), C("best")
    differing = F.filter(
        F.zip_with("best.conds", "condition_detail", lambda b, d: F.when(
            (b["status"] == "DIFFERENT") | ((b["status"] == "ABSENT") & (F.size(d["tested"]) > 0)),
            F.struct(b["key"].alias("key"), b["value"].alias("value"),
                     F.when(F.size(d["tested"]) > 0, d["tested"]).otherwise(F.array(b["test_value"])).alias("tested")))),
        lambda x: x.isNotNull(),
    )
    first = F.get(differing, F.lit(0))
    absent = with_status(C("best.conds"), "ABSENT")["key"]
    listed = lambda names: F.array_join(names, "; ")
    return (
        F.when(C("corpus_size") == 0, F.lit("Undecided: the catalogue is empty."))
        .when((verdict == "INSUFFICIENT_EVIDENCE") & (C("n_candidates") == 0), F.lit("Undecided: retrieval returned no test to compare with."))
        .when(verdict == "INSUFFICIENT_EVIDENCE", F.lit(
            "Undecided: neither a value nor a behaviour could be read from the report. A field name, a value or a sequence of steps would decide it."))
        .when(best.isNull() | ((verdict == "NOT_COVERED") & ~C("any_feature_match")), fmt("Gap: the catalogue has nothing on this part of ", feature, "."))
        .when(C("combination"), fmt("Gap: each of ", listed(phrases(C("i_decisive"))), " has a test of its own; the incident needed all at once."))
        .when(verdict == "COVERED", fmt(
            "Covered: ", best["test_id"], " runs with the incident's values. As the incident happened anyway, look at what that test checks and feeds."))
        .when(F.size(differing) > 0, fmt(
            "Partly covered: ", first["key"], " was ", first["value"], " in the incident; tests try ", F.array_join(first["tested"], "; "), "."))
        .when(F.size("unmatched") > 0, fmt("Partly covered: within ", feature, ", untested behaviour is ", listed(phrases(C("unmatched"))), "."))
        .when(F.size(absent) > 0, fmt("Partly covered: within ", feature, ", no test mentions ", listed(absent), "."))
        .otherwise(fmt("Partly covered: tests of ", feature, " come near without the incident's circumstances."))
    )


# ---------------------------------------------------------------- recommendations


def _advice(title: Column, rationale, inputs: list[tuple] = (), given: Column | None = None) -> Column:
    as_col = lambda v: F.lit(v) if isinstance(v, str) else v
    pairs = given if given is not None else (
        F.array(*[pair(as_col(k), as_col(v)) for k, v in inputs]) if inputs
        else F.array().cast("array<struct<key:string,value:string>>")
    )
    return F.struct(as_col(title).alias("title"), as_col(rationale).alias("rationale"), pairs.alias("suggested_inputs"))


def _case(*what) -> Column:
    """Title of a proposed test case of the incident's feature."""
    return fmt("New case, ", C("feature"), ": ", *what)


def _boundary_advice() -> Column:
    """EXP-7a: boundary values around the first numeric production condition."""
    target = F.get(F.filter("condition_detail", lambda c: c["num"].isNotNull()), F.lit(0))

    def around(c: Column) -> Column:
        percent = c["value"].contains("%")
        upper = F.greatest(F.coalesce(F.array_max(c["numbers"]), c["num"]), c["num"])
        proposed = F.when(percent, F.array(F.lit(0.0), F.lit(50.0), F.lit(100.0))).otherwise(
            F.array(F.lit(0.0), upper, upper + 1)
        )
        tested = F.array_join(F.transform(c["numbers"], number_text), "; ")
        fresh = F.filter(proposed, lambda v: ~F.array_contains(c["numbers"], v))
        steps = F.transform(
            fresh,
            lambda v: let(
                F.concat(number_text(v), F.when(percent, F.lit("%")).otherwise(F.lit(""))),
                lambda shown: _advice(
                    _case(c["key"], "=", shown),
                    fmt("incident: ", c["value"], ", tests: ", F.when(tested != "", tested).otherwise(F.lit("-"))),
                    [(c["key"], shown)],
                ),
            ),
        )
        return F.concat(steps, F.array(
            _advice(_case(c["key"], " below zero"), "the sign of a number is a limit too", [(c["key"], "-1")]),
            _advice(_case(c["key"], " that is no number"), "shows where unreadable input is stopped", [(c["key"], "invalid")]),
        ))

    return F.when(target.isNotNull(), let(target, around))


def _empty_advice(value: str) -> Column:
    """EXP-7b."""
    keys = _keys_or("input")
    first = F.get(keys, F.lit(0))
    return F.concat(
        F.transform(F.slice(keys, 1, 3), lambda k: _advice(
            _case(k, f" {value}"), fmt(f"seen {value} in the incident, in no test: ", k), [(k, value)])),
        F.array(_advice(_case(first, " of blanks only"), "absent, empty and blank take different paths", [(first, "'   '")])),
    )


def _keys_or(default: str) -> Column:
    keys = C("i_conds")["key"]
    return F.when(F.size(keys) > 0, keys).otherwise(strings([default]))


def _condition_value(key: str) -> Column:
    return F.get(F.filter("i_conds", lambda c: c["key"] == key), F.lit(0))["value"]


def _sequence_advice() -> Column:
    """EXP-7c."""
    steps = F.when(F.size("i_decisive") > 0, F.array_join(phrases(C("i_decisive")), " > ")).otherwise(F.lit("steps of the incident"))
    return F.array(
        _advice(_case("in this order: ", steps), "single steps have tests, the order has none", [("sequence", steps)]),
        _advice(_case("compare the state behind the last step"), "a wrong order rarely raises, it leaves wrong data"),
        _advice(_case("start the next step while one is pending"), "overlap is another case than repetition", [("delay", "0ms")]),
    )


def _concurrency_advice() -> Column:
    return F.array(
        _advice(_case("the same call from two workers"), "tests run one caller, the incident had several", [("concurrency", "2")]),
        _advice(_case("count results after parallel calls"), "look for doubled or lost records"),
    )


def _permission_advice() -> Column:
    role = F.coalesce(_condition_value("role"), _condition_value("permission"), F.lit("each role"))
    return F.array(
        _advice(_case("as ", role), "this right is exercised by no test", [("role", role)]),
        _advice(_case("refusal without the right"), "grants say nothing about refusals", [("expected_status", "403")]),
        _advice(_case("own and foreign records for each role"), "rights depend on role and owner"),
    )


def _unicode_advice() -> Column:
    key = F.get(_keys_or("text"), F.lit(0))
    return F.array(
        _advice(_case(key, " in several scripts"), "tests keep to one alphabet", [(key, "Žluťoučký Ελλάδα שלום")]),
        _advice(_case(key, " with characters of several code points"), "length in bytes, code points and glyphs differs", [(key, "é\U0001F468‍\U0001F469")]),
        _advice(_case("write and read back the same text"), "a round trip shows a wrong encoding"),
    )


def _error_advice() -> Column:
    cause = F.when(F.coalesce("root_cause", F.lit("")) != "", C("root_cause")).otherwise(F.lit("cause of the incident"))
    return F.array(
        _advice(_case("provoke: ", cause), "tests end well, the incident did not"),
        _advice(_case("expect a defined error"), "callers rely on a code, not on a stack trace", [("expected_status", "4xx")]),
    )


def _assertion_advice() -> Column:
    test = F.coalesce(C("best.test_id"), F.lit("matching test"))
    symptom = F.when(F.coalesce("failure", F.lit("")) != "", C("failure")).otherwise(F.lit("symptom of the incident"))
    return F.array(
        _advice(fmt(test, ": check more of the result"), "green although the scenario broke"),
        _advice(fmt(test, ": fail on: ", symptom), "makes the incident visible to this test"),
        _advice(fmt(test, ": feed recorded input"), "made-up input can avoid the fault"),
    )


def _invalid_advice() -> Column:
    key = F.get(_keys_or("input"), F.lit(0))
    return F.array(
        _advice(_case("unreadable ", key), "tests send well-formed input only", [(key, "invalid")]),
        _advice(_case("message for unreadable ", key), "names the field and leaves data unchanged", [("expected_status", "400")]),
    )


def _generic_advice() -> Column:
    """EXP-7f."""
    pairs = F.transform("i_conds", lambda c: pair(c["key"], c["value"]))
    failure = F.coalesce("failure", F.lit(""))
    subject = F.when(F.coalesce("title", F.lit("")) != "", C("title")).otherwise(failure)
    title = F.when(F.size("i_conds") > 0, _case(pairs_text(pairs))).otherwise(_case(subject))
    first = F.array(_advice(title, C("gap_summary"), given=pairs))
    more = F.array(_advice(_case("absence of: ", failure), "the symptom itself as an expectation"))
    return F.when(failure != "", F.concat(first, more)).otherwise(first)


def _report_advice() -> Column:
    area = F.when((F.coalesce("feature", F.lit("")) != "") & (C("feature") != fixed.UNKNOWN), C("feature")).otherwise(F.lit("system"))
    return F.array(
        _advice("Report: add field names with their values", "a verdict compares values"),
        _advice(fmt("Report: say which step of the ", area, " went wrong"), "equal symptoms have different causes"),
        _advice("Then run the analysis over the longer report", "stored verdicts are replaced"),
    )


def recommendations(most: int = fixed.MAX_RECOMMENDATIONS) -> Column:
    """EXP-7/LIM-6: by gap type, the first ``most``."""
    gap = C("gap_type")
    chosen = (
        F.when(C("coverage") == "INSUFFICIENT_EVIDENCE", _report_advice())
        .when(gap == "BOUNDARY_CONDITION", F.coalesce(_boundary_advice(), _generic_advice()))
        .when(gap == "NULL_HANDLING", _empty_advice("null"))
        .when(gap == "EMPTY_INPUT", _empty_advice("empty"))
        .when(gap == "MISSING_FIELD", _empty_advice("missing"))
        .when(gap.isin("RETRY_BEHAVIOR", "TIMEOUT_BEHAVIOR", "STATE_TRANSITION", "INPUT_COMBINATION"), _sequence_advice())
        .when(gap == "CONCURRENCY", _concurrency_advice())
        .when(gap == "PERMISSION", _permission_advice())
        .when(gap == "UNICODE_ENCODING", _unicode_advice())
        .when(gap.isin("DATA_FORMAT", "INVALID_INPUT"), _invalid_advice())
        .when(gap == "ERROR_HANDLING", _error_advice())
        .when(gap.isin("WEAK_ASSERTION", "TEST_DATA_MISMATCH"), _assertion_advice())
        .otherwise(_generic_advice())
    )
    return F.when(C("corpus_size") > 0, F.slice(chosen, 1, most))


def with_explanations(df: DataFrame) -> DataFrame:
    """EXP-1..7 on rows decided with ``judged`` detail and ``corpus_size``."""
    judged = F.coalesce(C("judged"), F.array().cast(df.schema["judged"].dataType))
    df = df.withColumn("condition_detail", condition_detail(judged))
    has_gap = C("gap_type").isNotNull()
    df = df.withColumns(
        {
            "evidence": F.when(C("corpus_size") > 0, evidence()),
            "missing_conditions": F.when(has_gap, missing_conditions()),
            "gap_summary": F.when(has_gap, gap_summary()),
            "gap_detail": F.when(has_gap, gap_detail()),
            "explanation": explanation(),
        }
    )
    return df.withColumn("recommendations", recommendations()).drop("condition_detail")


def evidence_rows(df: DataFrame, key: str = "incident_id") -> DataFrame:
    return df.select(key, F.posexplode("evidence").alias("ord", "e")).select(key, "ord", "e.*")


def recommendation_rows(df: DataFrame, key: str = "incident_id") -> DataFrame:
    """One row per recommendation; its priority is the incident's risk."""
    priority = C("risk") if "risk" in df.columns else F.lit("MEDIUM")
    return df.select(key, priority.alias("priority"), F.posexplode("recommendations").alias("ord", "r")).select(
        key, "ord", "priority", F.lit("PROPOSED").alias("status"), "r.*"
    )


def gap_rows(df: DataFrame, key: str = "incident_id") -> DataFrame:
    """EXP-2: one gap per decided incident, none when evidence is insufficient."""
    return df.filter("gap_type is not null").select(
        key, "gap_type", "family_key", "family_label", F.col("gap_summary").alias("summary"),
        F.col("gap_detail").alias("detail"), "missing_conditions",
    )


def guarded_text(proposed: Column, original: Column, candidate_ids: Column) -> Column:
    """DEC-19: accept a rewritten explanation only when every test id it names is
    a candidate."""
    named = F.regexp_extract_all(proposed, F.lit("(" + fixed.TEST_ID_PATTERN + ")"), F.lit(1))
    sound = (F.trim(proposed) != "") & (F.size(F.array_except(named, candidate_ids)) == 0)
    return F.when(sound, F.trim(proposed)).otherwise(original)
