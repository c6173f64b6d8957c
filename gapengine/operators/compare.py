"""Comparison of incidents with candidate tests, and its per-incident summary.

Everything that can be computed once per incident or once per test is computed
before the pair join (``prepare_incidents``, ``prepare_tests``); the pair itself
only matches prepared values.  The summary uses aggregates of bounded size
(bit masks, counts, one best row), so it combines map-side and a hot incident
never has to be collected in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gapengine import fixed
from gapengine.functions.extract import (
    describe_test,
    exercised_signals,
    first_wins,
    incident_text,
    no_pairs,
    pair,
    test_text,
    value_signal,
)
from gapengine.functions.text import (
    U,
    as_number,
    keep_when,
    let,
    normalize,
    normalized_value,
    same_value,
    split_values,
    strings,
    tokens,
    words,
)

# What the judged tests do with one production condition, one bit each.
FACTS = ("matched", "different", "mentioned", "tested", "at_or_above", "at_or_below", "same")
# Conditions whose facts fit one 63-bit word.
PER_WORD = 8
KEY_SPLIT = U + r"[_\s]+"


def _key_tokens(nkey: Column, shortest: int) -> Column:
    return F.filter(F.split(nkey, KEY_SPLIT), lambda t: F.length(t) >= shortest)


def known_feature(feature: Column) -> Column:
    return (F.coalesce(feature, F.lit("")) != "") & (feature != fixed.UNKNOWN)


# ------------------------------------------------------------------ preparation


def key_bound_signals(conditions: Column) -> Column:
    """DEC-1: (signal, normalised key) for values that are signals; first key wins."""
    return first_wins(
        F.filter(
            F.transform(
                conditions,
                lambda p: pair(let(normalized_value(p["value"]), value_signal), normalize(p["key"])),
            ),
            lambda p: p["key"].isNotNull(),
        )
    )


def decisive_signals(signals: Column) -> Column:
    """FLT-5."""
    return F.array_intersect(signals, strings(fixed.DECISIVE_SIGNALS))


def prepare_conditions(conditions: Column, feature: Column) -> Column:
    """Production conditions with everything a pair needs about them."""
    feature_tokens = F.split(normalize(feature), KEY_SPLIT)

    def prepared(p: Column, i: Column) -> Column:
        return let(
            normalize(p["key"]),
            lambda nkey: F.struct(
                p["key"].alias("key"),
                p["value"].alias("value"),
                nkey.alias("nkey"),
                normalized_value(p["value"]).alias("norm"),
                as_number(p["value"]).alias("num"),
                _key_tokens(nkey, 3).alias("tokens"),
                F.array_except(_key_tokens(nkey, 4), feature_tokens).alias("naming"),
                F.floor(i / PER_WORD).cast("int").alias("word"),
                F.call_function(
                    "shiftleft", F.lit(1).cast("bigint"), ((i % PER_WORD) * len(FACTS)).cast("int")
                ).alias("unit"),
            ),
        )

    return F.transform(conditions, prepared)


def prepare_incidents(incidents: DataFrame, text_columns: bool = True) -> DataFrame:
    """Add the ``i_*`` columns comparison works on."""
    df = incidents.withColumns(
        {
            "i_feature": normalize(F.col("feature")),
            "i_known": known_feature(F.col("feature")),
            "i_conds": prepare_conditions(F.coalesce("conditions", no_pairs()), F.col("feature")),
            "i_decisive": decisive_signals(F.col("signals")),
            "i_bound": key_bound_signals(F.coalesce("conditions", no_pairs())),
        }
    )
    if not text_columns:
        return df.withColumns({"i_words": strings([]), "i_terms": strings([])})
    searchable = incident_text(
        *[
            F.col(c)
            for c in (
                "title", "feature", "scenario", "description", "failure", "root_cause", "conditions", "signals",
            )
        ]
    )
    return df.withColumns(
        {
            "i_words": words(F.concat_ws(" ", normalize(F.col("scenario")), normalize(F.col("title")))),
            "i_terms": F.array_distinct(tokens(searchable)),
        }
    )


def prepare_inputs(inputs: Column) -> Column:
    """Test inputs with their comma-separated values prepared for comparison."""

    def prepared(p: Column) -> Column:
        values = F.transform(
            split_values(p["value"]),
            lambda v: F.struct(normalized_value(v).alias("norm"), as_number(v).alias("num")),
        )
        return let(
            F.struct(normalize(p["key"]).alias("nkey"), values.alias("values")),
            lambda x: F.struct(
                x["nkey"].alias("nkey"),
                p["value"].alias("value"),
                _key_tokens(x["nkey"], 3).alias("tokens"),
                x["values"].alias("values"),
                F.array_compact(x["values"]["num"]).alias("numbers"),
            ),
        )

    return F.transform(inputs, prepared)


def prepare_tests(tests: DataFrame, text_columns: bool = True) -> DataFrame:
    """Add the ``t_*`` columns comparison works on.  Signals are derived where
    the catalogue carries none."""
    df = tests.withColumns(
        {
            "t_feature": normalize(F.col("feature")),
            "t_known": known_feature(F.col("feature")),
            "t_inputs": prepare_inputs(F.coalesce("inputs", no_pairs())),
            "t_signals": F.coalesce(
                F.when(F.size("signals") > 0, F.col("signals")),
                exercised_signals(F.col("name"), F.col("scenario"), F.coalesce("inputs", no_pairs())),
            ),
            "t_words": words(
                normalize(F.concat_ws(" ", F.col("name"), F.col("scenario"))), "[^a-z0-9]+"
            ),
        }
    )
    if not text_columns:
        return df.withColumns({"t_text_words": strings([]), "t_terms": strings([])})
    searchable = test_text(
        *[
            F.col(c)
            for c in ("name", "feature", "scenario", "expected_behavior", "tags", "inputs", "assertions")
        ]
    )
    return df.withColumns(
        {
            "t_text_words": words(normalize(searchable)),
            "t_terms": F.array_except(tokens(searchable), tokens(F.col("feature"), keep_stopwords=True)),
        }
    )


# ------------------------------------------------------------------ one pair


def align_input(cond: Column, inputs: Column) -> Column:
    """JON-5: the test input meaning the same as a production key: the exact
    normalised key, else the first input sharing a token of three characters."""
    exact = F.filter(inputs, lambda x: x["nkey"] == cond["nkey"])
    shared = F.filter(inputs, lambda x: F.arrays_overlap(x["tokens"], cond["tokens"]))
    return F.coalesce(F.get(exact, F.lit(0)), F.get(shared, F.lit(0)))


def compare_conditions(conds: Column, inputs: Column, test_words: Column) -> Column:
    """JON-6/7: per production condition its status, the aligned test value and
    numbers, and the fact bits summed per incident later."""

    def judged(c: Column) -> Column:
        def against(x: Column) -> Column:
            hit = F.exists(x["values"], lambda v: same_value(c["norm"], c["num"], v["norm"], v["num"]))
            return let(
                F.when(x.isNull(), F.when(F.arrays_overlap(c["naming"], test_words), 2).otherwise(-1))
                .when(hit, 0)
                .otherwise(1),
                lambda s: F.struct(
                    s.alias("code"),
                    x["value"].alias("test_value"),
                    x["numbers"].alias("numbers"),
                    (
                        F.when(s >= 0, F.call_function("shiftleft", F.lit(1), s)).otherwise(0)
                        + F.when(
                            F.size(x["numbers"]) > 0,
                            F.lit(8)
                            + F.when(F.array_max(x["numbers"]) >= c["num"], 16).otherwise(0)
                            + F.when(F.array_min(x["numbers"]) <= c["num"], 32).otherwise(0)
                            + F.when(F.array_contains(x["numbers"], c["num"]), 64).otherwise(0),
                        ).otherwise(0)
                    ).alias("facts"),
                ),
            )

        return let(align_input(c, inputs), against)

    return F.transform(conds, judged)


def with_status(conds: Column, *statuses: str) -> Column:
    """FLT-10."""
    return F.filter(conds, lambda c: c["status"].isin(list(statuses)))


_BIT = {s: 1 << i for i, s in enumerate(fixed.SIGNAL_PATTERNS)}


def signal_mask(signals: Column) -> Column:
    """A set of signals as bits, in rule order."""
    zero = F.lit(0).cast("bigint")
    return sum((F.when(F.array_contains(signals, s), F.lit(bit)).otherwise(zero) for s, bit in _BIT.items()), zero)


def mask_signals(mask: Column) -> Column:
    """The reverse of ``signal_mask``."""
    return keep_when([(s, mask.bitwiseAND(F.lit(bit)) != 0) for s, bit in _BIT.items()])


def unmet_bound_signals(bound: Column, i_conds: Column, conds: Column) -> Column:
    """DEC-2: key-bound signals whose own condition this test does not match."""
    matched = F.filter(
        F.zip_with(i_conds, conds, lambda c, r: F.when(r["code"] == 0, c["nkey"])), lambda k: k.isNotNull()
    )
    return let(matched, lambda keys: F.filter(bound, lambda b: ~F.array_contains(keys, b["value"]))["key"])


def matched_signals(decisive: Column, test_signals: Column, bound: Column, i_conds: Column, conds: Column) -> Column:
    """DEC-2 as an array: decisive signals this test covers."""
    return F.array_except(
        F.array_intersect(decisive, test_signals), unmet_bound_signals(bound, i_conds, conds)
    )


def coverage_strength(n_conds, n_matched, n_signals, n_matched_signals, score, overlap, feature_ok) -> Column:
    """DEC-4."""
    by_conditions = n_matched / n_conds
    by_signals = n_matched_signals / n_signals
    topical = F.when(feature_ok, 0.6).otherwise(0.2) * F.least(F.lit(1.0), score + overlap)
    structured = (
        F.when((n_conds > 0) & (n_signals > 0), (by_conditions + by_signals) / 2)
        .when(n_conds > 0, by_conditions)
        .when(n_signals > 0, by_signals)
    )
    return F.coalesce(structured * F.when(feature_ok, 1.0).otherwise(0.7), topical)


def compare_pairs(pairs: DataFrame, condition_words: int) -> DataFrame:
    """DEC-5, first half: compare every (incident, test) pair, row by row.

    Needs the ``i_*`` and ``t_*`` columns, ``score`` and ``rank_key`` (candidate
    order).  ``i_distinctive`` (terms of the incident rare in the corpus) is
    optional; without it every shared term counts as distinctive.

    One word holds the facts of ``PER_WORD`` conditions; ``condition_words`` must
    be enough for the incident with most of them (``analyze`` counts them).
    """
    distinctive = "i_distinctive" if "i_distinctive" in pairs.columns else "i_terms"
    zero = F.lit(0).cast("bigint")

    def word(w: int) -> Column:
        total = F.aggregate(
            F.zip_with("i_conds", "conds", lambda c, r: F.when(c["word"] == w, r["facts"] * c["unit"]).otherwise(zero)),
            zero, lambda acc, x: acc + x,
        )
        return F.when(F.size("i_conds") > PER_WORD * w, total).otherwise(zero)

    fits = F.when(F.size("i_conds") <= PER_WORD * condition_words, F.col("i_conds")).otherwise(
        F.raise_error(F.lit("more conditions than condition_words can hold")).cast(pairs.schema["i_conds"].dataType)
    )
    df = pairs.withColumn("i_conds", fits).withColumns(
        {
            "feature_match": (F.col("i_feature") != "") & (F.col("i_feature") == F.col("t_feature")),
            "conds": compare_conditions(F.col("i_conds"), F.col("t_inputs"), F.col("t_words")),
            "overlap": F.when(
                F.size("i_words") > 0,
                F.size(F.array_intersect("i_words", "t_text_words")) / F.size("i_words"),
            ).otherwise(F.lit(0.0)),
            "specific_terms": F.array_sort(F.array_intersect(distinctive, "t_terms")),
            "_decisive": signal_mask(F.col("i_decisive")),
        }
    )
    unmet = F.when(
        F.size("i_bound") > 0,
        let(unmet_bound_signals(F.col("i_bound"), F.col("i_conds"), F.col("conds")), signal_mask),
    ).otherwise(zero)
    covered = F.col("_decisive").bitwiseAND(signal_mask(F.col("t_signals")))
    df = df.withColumns(
        {
            "_matched": covered.bitwiseAND(F.bitwise_not(unmet)),
            **{f"_word{w}": word(w) for w in range(condition_words)},
        }
    )
    matched_bits = sum(1 << (len(FACTS) * k) for k in range(PER_WORD))
    n_matched = sum(F.bit_count(F.col(f"_word{w}").bitwiseAND(F.lit(matched_bits))) for w in range(condition_words))
    # A judged test never contradicts the incident's feature, so the strength
    # that ranks judged tests carries no feature penalty.
    return df.withColumns(
        {
            "n_missing_signals": F.bit_count(F.col("_decisive").bitwiseXOR(F.col("_matched"))),
            "n_specific": F.size("specific_terms"),
            "strength": coverage_strength(
                F.size("i_conds"), n_matched, F.bit_count("_decisive"), F.bit_count("_matched"),
                F.col("score"), F.col("overlap"), F.lit(True),
            ),
        }
    )


# ------------------------------------------------------------- all pairs of one incident


def summarise(
    compared: DataFrame, by: list[str] | str = "incident_id", *, detail: bool = True,
    best_columns: tuple[str, ...] = ("test_id",),
) -> DataFrame:
    """DEC-5, second half: one row per incident.

    ``judged`` (FLT-4) means same-feature tests when feature names are usable
    and every candidate otherwise.  Whether they are usable is only known once
    all candidates are seen, so tests without a feature are summed apart and
    joined in at the end; no second pass is needed.

    ``detail`` also gathers the judged tests' condition comparisons.  It is meant
    for candidates after the retrieval cut, whose number is bounded.
    """
    by = [by] if isinstance(by, str) else list(by)
    n_words = sum(1 for c in compared.columns if c.startswith("_word"))
    known, match = F.col("i_known"), F.col("feature_match")
    df = compared.withColumns({"_judged": ~known | match, "_apart": known & ~match & ~F.col("t_known")})

    best = F.struct(
        F.when(F.col("score") >= fixed.RELEVANCE_FLOOR, 0).otherwise(1).alias("below_floor"),
        (-F.col("strength")).alias("neg_strength"),
        (-F.col("score")).alias("neg_score"),
        F.col("rank_key"),
        F.col("feature_match"),
        F.col("overlap"),
        F.col("n_specific"),
        F.col("_matched"),
        F.array(*[F.col(f"_word{w}") for w in range(n_words)]).alias("words"),
        *([F.col("conds"), F.col("specific_terms")] if detail else []),
        *[F.col(c) for c in best_columns],
    )
    per_part = {
        "n": lambda on: F.count(F.when(on, 1)),
        "top": lambda on: F.max(F.when(on, F.col("score"))),
        "least_missing": lambda on: F.min(F.when(on, F.col("n_missing_signals"))),
        "specific": lambda on: F.max(F.when(on, F.col("n_specific"))),
        "signals": lambda on: F.bit_or(F.when(on, F.col("_matched"))),
        "best": lambda on: F.min(F.when(on, best)),
        **{
            f"word{w}": (lambda on, w=w: F.bit_or(F.when(on, F.col(f"_word{w}"))))
            for w in range(n_words)
        },
    }
    aggregates = [
        F.count(F.lit(1)).alias("n_candidates"),
        F.max("score").alias("retrieval_top"),
        F.max("t_known").alias("_any_known"),
        F.max("i_known").alias("_known"),
        F.max("feature_match").alias("_any_match"),
    ]
    for part, on in (("j", F.col("_judged")), ("a", F.col("_apart"))):
        aggregates += [make(on).alias(f"_{part}_{name}") for name, make in per_part.items()]
    if detail:
        item = F.struct("rank_key", "_apart", "test_id", "source", "line_number", "conds")
        aggregates.append(
            F.array_sort(F.collect_list(F.when(F.col("_judged") | F.col("_apart"), item))).alias("_items")
        )
    g = df.groupBy(*by).agg(*aggregates)

    use_apart = ~F.col("_any_known")
    zero = F.lit(0).cast("bigint")

    def pick(name, how):
        return how(F.col(f"_j_{name}"), F.when(use_apart, F.col(f"_a_{name}")))

    def bits(name):
        return pick(name, lambda j, a: F.coalesce(j, zero).bitwiseOR(F.coalesce(a, zero)))

    feature_known = F.col("_known") & F.col("_any_known")
    cols = [
        *by,
        "n_candidates",
        "retrieval_top",
        pick("n", lambda j, a: j + F.coalesce(a, zero)).alias("n_judged"),
        feature_known.alias("feature_known"),
        F.when(feature_known, F.col("_any_match")).otherwise(F.lit(True)).alias("any_feature_match"),
        F.coalesce(pick("top", F.greatest), F.lit(0.0)).alias("top_score"),
        pick("least_missing", F.least).alias("least_missing"),
        (F.coalesce(pick("specific", F.greatest), F.lit(0)) > 0).alias("any_specific"),
        pick("best", F.least).alias("_best"),
        mask_signals(bits("signals")).alias("union_signals"),
        F.array(*[bits(f"word{w}") for w in range(n_words)]).alias("fact_words"),
    ]
    if detail:
        cols.append(F.filter("_items", lambda t: use_apart | ~t["_apart"]).alias("judged"))
    return g.select(*cols)


def _fact(c: Column, words: Column, name: str) -> Column:
    word = F.coalesce(F.get(words, c["word"]), F.lit(0).cast("bigint"))
    return word.bitwiseAND(c["unit"] * (1 << FACTS.index(name))) != 0


def pair_conditions(i_conds: Column, words: Column, conds: Column | None = None) -> Column:
    """JON-6: one pair's condition comparisons with key, value and status name,
    and the tested value where the full comparison was kept."""

    def named(c: Column, i: Column) -> Column:
        status = (
            F.when(_fact(c, words, "matched"), F.lit("MATCHED"))
            .when(_fact(c, words, "different"), F.lit("DIFFERENT"))
            .when(_fact(c, words, "mentioned"), F.lit("MENTIONED"))
            .otherwise(F.lit("ABSENT"))
        )
        tested = F.get(conds, i)["test_value"] if conds is not None else F.lit(None).cast("string")
        return F.struct(
            *[c[f].alias(f) for f in ("key", "nkey", "value", "num")],
            status.alias("status"), tested.alias("test_value"),
        )

    return F.transform(i_conds, named)


def expand_best(df: DataFrame) -> DataFrame:
    """Turn the packed best row into ``best`` with named conditions and signals;
    needs the incident's ``i_conds`` and ``i_decisive``."""
    b = F.col("_best")
    packed = df.schema["_best"].dataType.fieldNames()
    own = ("conds", "words", "_matched", "below_floor", "neg_strength", "neg_score")
    best = F.when(
        b.isNotNull(),
        F.struct(
            (-b["neg_strength"]).alias("strength"),
            (-b["neg_score"]).alias("score"),
            pair_conditions(F.col("i_conds"), b["words"], b["conds"] if "conds" in packed else None).alias("conds"),
            mask_signals(b["_matched"]).alias("matched_signals"),
            F.array_except("i_decisive", mask_signals(b["_matched"])).alias("missing_signals"),
            *[b[c].alias(c) for c in packed if c not in own],
        ),
    )
    return df.withColumn("best", best).drop("_best")


def condition_facts(i_conds: Column) -> Column:
    """AGG-22: for each production condition, what the judged tests do with it."""
    return F.transform(
        i_conds,
        lambda c: F.struct(
            *[c[f].alias(f) for f in ("key", "nkey", "value", "num")],
            *[_fact(c, F.col("fact_words"), name).alias(name) for name in FACTS],
        ),
    )


def tested_values(judged: Column, position: Column) -> Column:
    """AGG-21: distinct values the judged tests give one condition, candidate order."""
    found = F.transform(judged, lambda t: F.get(t["conds"], position)["test_value"])
    return F.array_distinct(F.filter(found, lambda v: v.isNotNull()))


def tested_numbers(judged: Column, position: Column) -> Column:
    """AGG-21: the sorted set of numbers."""
    found = F.flatten(F.transform(judged, lambda t: F.get(t["conds"], position)["numbers"]))
    return F.array_sort(F.array_distinct(found))


def first_with(judged: Column, position: Column, status: str) -> Column:
    """First judged test, in candidate order, having the status on a condition."""
    code = {"MATCHED": 0, "DIFFERENT": 1, "MENTIONED": 2, "ABSENT": -1}[status]
    return F.get(
        F.filter(judged, lambda t: F.get(t["conds"], position)["code"] == code), F.lit(0)
    )


def describe_columns() -> Column:
    return describe_test(*[F.col(c) for c in ("test_id", "scenario", "expected_behavior", "name", "inputs")])
