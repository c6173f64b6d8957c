"""Facts read out of engineering English: conditions, signals, features, incident fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gapengine import fixed
from gapengine.functions.text import (
    U,
    join_words,
    keep_when,
    leading_number,
    let,
    normalize,
    normalized_value,
    squeezed,
    strings,
    trim_number,
    trimmed,
)

PAIR = "struct<key:string,value:string>"
PAIRS = f"array<{PAIR}>"


def pair(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def no_pairs() -> Column:
    return F.array().cast(PAIRS)


def first_wins(*pair_arrays: Column) -> Column:
    """TXT-22: ordered merge of pair arrays, earliest value of a key wins."""
    merged = F.concat(*[F.coalesce(p, no_pairs()) for p in pair_arrays])
    return let(
        merged,
        lambda all_pairs: F.filter(
            all_pairs, lambda p, i: F.array_position(all_pairs.getField("key"), p["key"]) == i + 1
        ),
    )


def coerced_pairs(pairs: Column) -> Column:
    """TXT-32: drop pairs without a key or value."""
    return F.filter(F.coalesce(pairs, no_pairs()), lambda p: p["key"].isNotNull() & p["value"].isNotNull())


def pairs_text(pairs: Column, between: str = " = ", sort: bool = False, sep: str = ", ") -> Column:
    """Pairs as text, in order or sorted by key."""
    shown = F.array_sort(pairs) if sort else pairs
    return F.array_join(F.transform(shown, lambda p: F.concat(p["key"], F.lit(between), p["value"])), sep)


# -------------------------------------------------------------------- conditions


def _singular(word: Column) -> Column:
    stem = F.regexp_replace(word, "s$", "")
    return F.when(word.endswith("s") & stem.isin(fixed.CONDITION_NOUNS), stem).otherwise(word)


def condition_key(phrase: Column) -> Column:
    """TXT-18: the condition named by a one- or two-word phrase, NULL when none is.

    The right-most recognised noun is the head; a plain word in front of it
    makes a compound, a describing word does not, and a generic head gives way
    to the word in front.
    """
    nouns = fixed.CONDITION_NOUNS

    def resolve(parts: Column) -> Column:
        first = _singular(F.get(parts, F.lit(0)))
        last = _singular(F.get(parts, F.size(parts) - 1))
        compound = F.concat_ws("_", first, last)
        return (
            F.when(
                (F.size(parts) >= 2) & last.isin(nouns),
                F.when(first.isin(fixed.STOP_BEFORE_NOUN) | first.isin(fixed.QUALIFIERS), last)
                .when(last.isin(fixed.GENERIC_NOUNS), F.when(first.isin(nouns), first).otherwise(compound))
                .otherwise(compound),
            )
            .when(first.isin(nouns), first)
        )

    return let(F.split(trimmed(phrase), U + r"\s+"), resolve)


def _rule_pairs(haystack: Column, pattern: str, noun: int, value: int, kind: str) -> Column:
    found = F.arrays_zip(
        F.regexp_extract_all(haystack, F.lit(U + pattern), F.lit(noun)).alias("noun"),
        F.regexp_extract_all(haystack, F.lit(U + pattern), F.lit(value)).alias("value"),
    )

    def to_pair(m: Column) -> Column:
        raw = m["value"]
        shown = {
            "percent": lambda: F.concat(trim_number(raw), F.lit("%")),
            "number": lambda: trim_number(raw),
            "text": lambda: raw,
        }[kind]()
        return pair(condition_key(m["noun"]), shown)

    return F.transform(found, to_pair)


def conditions_in(haystack: Column) -> Column:
    """TXT-17 on already normalised text."""
    candidates = F.concat(*[_rule_pairs(haystack, *rule) for rule in fixed.CONDITION_RULES])
    return first_wins(F.filter(candidates, lambda p: p["key"].isNotNull()))


def extract_conditions(*texts: Column) -> Column:
    """TXT-17: ordered ``(key, value)`` pairs stated in the text."""
    return conditions_in(normalize(_joined(*texts)))


def _joined(*texts: Column) -> Column:
    return F.concat_ws(" ", *[F.when(t != "", t) for t in texts])


# ----------------------------------------------------------------------- signals


def signals_in(haystack: Column) -> Column:
    """TXT-16 on already normalised text."""
    return keep_when([(s, haystack.rlike(U + p)) for s, p in fixed.SIGNAL_PATTERNS.items()])


def detect_signals(*texts: Column) -> Column:
    """TXT-16: behavioural signals present in the text, in rule order."""
    return signals_in(normalize(_joined(*texts)))


def value_signal(normalized: Column, table: dict = fixed.VALUE_SIGNALS) -> Column:
    """The signal a value is by itself, NULL for ordinary values."""
    named: dict[str, list[str]] = {}
    for value, signal in table.items():
        named.setdefault(signal, []).append(value)
    expr = F
    for signal, members in named.items():
        expr = expr.when(normalized.isin(members), F.lit(signal))
    return expr.otherwise(F.lit(None).cast("string"))


def exercised_signals(name: Column, text: Column, inputs: Column) -> Column:
    """TXT-19: signals of a test's wording and of the values it drives, in rule order."""

    def at_limit(number: Column, value: Column) -> Column:
        return (
            F.when((number == 100) & value.contains("%"), F.lit("boundary_max"))
            .when(number <= 0, F.lit("boundary_min"))
        )

    def from_value(p: Column) -> Column:
        return let(
            normalized_value(p["value"]),
            lambda norm: F.array(
                value_signal(norm, fixed.TEST_VALUE_SIGNALS),
                let(leading_number(norm), lambda n: at_limit(n, p["value"])),
            ),
        )

    found = F.concat(detect_signals(name, text), F.flatten(F.transform(inputs, from_value)))
    return let(found, lambda s: keep_when([(n, F.array_contains(s, n)) for n in fixed.SIGNAL_PATTERNS]))


# ---------------------------------------------------------------------- features


def feature_from_source(source: Column, default: str = fixed.UNKNOWN) -> Column:
    """TXT-15: a feature name from where a test lives.

    A trailing ``[sheet]`` speaks for itself; otherwise the nearest directory
    that is not noise, then the file stem; at most three capitalised words.
    """
    sheet = F.regexp_extract(source, r"\[([^\]]+)\]\s*$", 1)
    path = F.when(sheet != "", sheet).otherwise(source)
    segments = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: trimmed(s) != "")

    def named(segment: Column) -> Column:
        parts = F.filter(
            F.split(normalize(segment), "[^A-Za-z0-9]+"),
            lambda w: (w != "") & ~w.isin(fixed.FEATURE_NOISE) & ~w.rlike("^[0-9]+$"),
        )
        return F.initcap(F.array_join(F.slice(parts, 1, fixed.FEATURE_WORDS), " "))

    def pick(parts: Column) -> Column:
        n = F.size(parts)
        stem = F.regexp_replace(F.get(parts, n - 1), r"\.[^.]*$", "")
        nearest_first = F.concat(F.reverse(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0)))), F.array(stem))
        return F.get(F.filter(F.transform(nearest_first, named), lambda f: f != ""), F.lit(0))

    return F.coalesce(F.when(F.size(segments) > 0, let(segments, pick)), F.lit(default))


# -------------------------------------------------------------------- test names


def humanize_test_name(name: Column) -> Column:
    """TXT-12: a readable phrase, one leading verb stripped."""
    prefix = "^(?:" + "|".join(fixed.TEST_NAME_PREFIXES) + ") "
    return squeezed(F.regexp_replace(trimmed(normalize(name)), prefix, ""))


def infer_scenario(*texts: Column, fallback: Column | None = None) -> Column:
    """TXT-13: the first sentence of the first non-blank text."""
    first = F.coalesce(*[F.when(trimmed(t) != "", trimmed(t)) for t in texts])
    sentence = trimmed(F.get(F.split(first, r"(?<=[.!?])\s", 2), F.lit(0)))
    return F.coalesce(sentence, fallback if fallback is not None else F.lit(""))


# ----------------------------------------------------------------- searchable text


def _feature_text(feature: Column) -> Column:
    return F.when((feature != fixed.UNKNOWN) & (feature != ""), feature)


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def test_text(name, feature, scenario, expected, tags, inputs, assertions) -> Column:
    """TXT-21 for tests: metadata only, never code."""
    return trimmed(
        F.concat_ws(
            "  ",
            _filled(F.replace(name, F.lit("_"), F.lit(" "))),
            _feature_text(feature),
            _filled(scenario),
            _filled(expected),
            _filled(F.array_join(tags, " ")),
            _filled(pairs_text(inputs, " ", sep=" ")),
            _filled(F.array_join(assertions, " ")),
        )
    )


def incident_text(title, feature, scenario, description, failure, root_cause, conditions, signals) -> Column:
    """TXT-21 for incidents."""
    return trimmed(
        F.concat_ws(
            "  ",
            _filled(title),
            _feature_text(feature),
            _filled(scenario),
            _filled(description),
            _filled(failure),
            _filled(root_cause),
            _filled(pairs_text(conditions, " ", sep=" ")),
            _filled(F.array_join(signals, " ")),
        )
    )


def describe_test(test_id, scenario, expected, name, inputs) -> Column:
    """TXT-23: one line with sorted inputs."""
    detail = F.coalesce(_filled(scenario), _filled(expected), _filled(name))
    rendered = _filled(pairs_text(inputs, "=", sort=True))
    shown = F.coalesce(F.concat(detail, F.lit(" ("), rendered, F.lit(")")), detail, rendered, F.lit(""))
    return trimmed(F.concat(test_id, F.lit(", "), shown))


# ---------------------------------------------------------------- incident fields


def title_of(description: Column) -> Column:
    """TXT-26."""
    line = trimmed(F.get(F.split(trimmed(description), r"\r\n|\r|\n"), F.lit(0)))
    sentence = F.get(F.split(line, r"(?<=[.!?])\s+"), F.lit(0))
    return F.when(F.length(line) <= 120, line).otherwise(sentence)


def root_cause_of(description: Column) -> Column:
    """TXT-27."""
    return squeezed(F.regexp_extract(description, "(?is)" + fixed.ROOT_CAUSE_PATTERN, 1))


def failure_of(description: Column) -> Column:
    """TXT-28: root-cause text is taken out before the failing clause is looked for."""
    body = F.regexp_replace(description, "(?is)" + fixed.ROOT_CAUSE_PATTERN, " ")
    return squeezed(F.regexp_extract(body, "(?i)" + fixed.FAILURE_PATTERN, 1))


def scenario_of(feature: Column, conditions: Column, title: Column) -> Column:
    """TXT-29."""
    stated = F.concat(feature, F.lit(": "), pairs_text(conditions, sort=True))
    return F.when(F.size(conditions) > 0, stated).otherwise(
        F.coalesce(_filled(title), feature)
    )


def severity_of(corpus: Column) -> Column:
    """TXT-30: plain substrings, so ``low`` also fires inside ``slow``."""
    text = F.lower(corpus)
    expr = F
    for level, needles in fixed.SEVERITY_KEYWORDS:
        expr = expr.when(text.rlike("|".join(needles)), F.lit(level))
    return expr.otherwise(F.lit("MEDIUM"))


def occurred_at(value: Column) -> Column:
    """TXT-31: ISO-8601, NULL when unreadable."""
    return F.try_to_timestamp(F.replace(value, F.lit("Z"), F.lit("+00:00")))


def phrases(signals: Column) -> Column:
    from gapengine.functions.text import signal_phrase

    return F.transform(signals, signal_phrase)


def joined_phrases(signals: Column) -> Column:
    return join_words(phrases(signals))
