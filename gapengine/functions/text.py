"""Text and value functions.  All of them are native column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gapengine import fixed

# ``(?U)`` makes \w, \d, \s and \b follow Unicode on every JDK.
U = "(?U)"


def strings(values) -> Column:
    """A literal array<string>."""
    quoted = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    return F.expr(f"cast(array({quoted}) as array<string>)")


def let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable so ``body`` may use it many times
    without it being computed again for every use."""
    return F.transform(F.array(value), lambda bound: body(bound)).getItem(0)


def keep_when(pairs) -> Column:
    """array<string> of the names whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in pairs]))


# --------------------------------------------------------------- accent folding


# Blocks folded inside the JVM: Latin, Greek, Cyrillic and general punctuation.
_BLOCKS = ((0x80, 0x24F), (0x300, 0x52F), (0x1E00, 0x1FFF), (0x2010, 0x2027))


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, str, str]:
    """Derived from the Unicode tables for those blocks: single-character
    decompositions (from, to), the class of combining marks, and the class of
    all characters that need full decomposition."""
    source, target, marks, hard = [], [], [], []
    for cp in (cp for low, high in _BLOCKS for cp in range(low, high + 1)):
        ch = chr(cp)
        base = _decomposed(ch)
        if unicodedata.combining(ch):
            marks.append(cp)
        elif len(base) == 1 and base != ch:
            source.append(ch)
            target.append(base)
        elif base != ch:
            hard.append(cp)
    outside = "[^\\x00-\\x7F" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in _BLOCKS) + "]"
    return "".join(source), "".join(target), _char_class(marks), outside + "|" + _char_class(hard)


# What ``token_letters`` has for a combining mark.
MARK = 1


@lru_cache(maxsize=1)
def token_letters() -> bytes:
    """TXT-1/TXT-2 by code point: the ASCII letter, digit, ``%`` or ``.`` that ``normalize`` leaves of a character, ``MARK``
    for marks that it drops and 0 where a token ends.  The last entry stands for all code points behind it."""
    known = "abcdefghijklmnopqrstuvwxyz0123456789%."
    out = bytearray(0x2200)
    for cp in range(len(out) - 1):
        ch = chr(cp)
        if any(low <= cp <= high for low, high in _BLOCKS):
            if unicodedata.combining(ch):
                out[cp] = MARK
                continue
            base = _decomposed(ch)
            ch = base if len(base) == 1 else ch
        low = ch.lower()
        out[cp] = ord(low) if low in known and len(low) == 1 else 0
    return bytes(out)


def _decomposed(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _char_class(points: list[int]) -> str:
    ranges: list[list[int]] = []
    for p in points:
        if ranges and p == ranges[-1][1] + 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def fold_accents(text: Column) -> Column:
    """Compatibility folding inside the JVM, exact for characters of the blocks
    above that decompose to one base character.  Text with other characters
    (ligatures, fractions, CJK forms) goes through ``expand_compat`` first."""
    source, target, marks, _ = _folding()
    folded = F.regexp_replace(F.translate(text, source, target), marks, "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), folded).otherwise(text)


def _decompose_series(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else _decomposed(t))


def expand_compat(df: DataFrame, *columns: str) -> DataFrame:
    """Full compatibility decomposition of ``columns`` where the JVM folding is
    not enough.

    Only such rows reach Python; all others pass NULL.  Run it once where text
    enters, everything later stays in the JVM.
    """
    hard = _folding()[3]
    nfkd = F.pandas_udf(_decompose_series, T.StringType())
    return df.withColumns(
        {c: F.coalesce(nfkd(F.when(F.col(c).rlike(hard), F.col(c))), F.col(c)) for c in columns}
    )


# ----------------------------------------------------------------- normalising


def normalize(text: Column) -> Column:
    """TXT-1: split camelCase, fold accents, ``_`` and word hyphens to spaces, lower case.

    Text already in that form, as most keys and values are, is passed through
    after one look.
    """
    text = F.coalesce(text, F.lit(""))
    spaced = F.regexp_replace(text, r"(?<=[a-z0-9])(?=[A-Z])", " ")
    folded = F.replace(fold_accents(spaced), F.lit("_"), F.lit(" "))
    full = F.lower(F.regexp_replace(folded, r"-(?!\d)", " "))
    return F.when(text.rlike(r"^[a-z0-9 %.,:;=/()]*$"), text).otherwise(full)


def normalized_value(text: Column) -> Column:
    return trimmed(normalize(text))


_SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def trimmed(text: Column) -> Column:
    """Strip any white space at both ends."""
    return F.btrim(text, F.lit(_SPACES))


def squeezed(text: Column) -> Column:
    """Collapse runs of white space and strip the ends."""
    return trimmed(F.regexp_replace(text, U + r"\s+", " "))


def words(text: Column, pattern: str = r"\s+") -> Column:
    """Distinct non-empty pieces of already normalised text."""
    return F.array_distinct(F.filter(F.split(text, pattern), lambda w: w != ""))


def _is_token(token: Column, keep_stopwords: bool) -> Column:
    ok = (F.length(token) >= 2) | token.rlike("^[0-9]$")
    return ok if keep_stopwords else ok & ~token.isin(fixed.STOPWORDS)


def tokens(text: Column, keep_stopwords: bool = False) -> Column:
    """TXT-2: ordered tokens as an array."""
    parts = F.split(normalize(text), fixed.TOKEN_SPLIT)
    return F.filter(
        F.transform(parts, lambda t: F.btrim(t, F.lit("."))), lambda t: _is_token(t, keep_stopwords)
    )


def explode_tokens(df: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """TXT-2 as rows ``(key, *more, pos, term)``; splitting, trimming and filtering all
    run inside generated code, so long documents never build token arrays in
    interpreted lambdas."""
    return (
        df.select(key, *more, F.posexplode(F.split(normalize(F.col(text)), fixed.TOKEN_SPLIT)).alias("pos", "raw"))
        .select(key, *more, "pos", F.btrim("raw", F.lit(".")).alias("term"))
        .filter(_is_token(F.col("term"), False))
    )


def synonym_map() -> Column:
    quoted = lambda words: ", ".join(f"'{w}'" for w in words)
    return F.expr(
        "map(" + ", ".join(f"'{h}', array({quoted(r)})" for h, r in fixed.SYNONYMS.items()) + ")"
    )


def expand(token_array: Column) -> Column:
    """TXT-3: the distinct tokens plus their one-level synonyms."""
    heads = F.array_intersect(token_array, strings(fixed.SYNONYMS))
    related = F.flatten(F.transform(heads, lambda t: F.element_at(synonym_map(), t)))
    return F.array_distinct(F.concat(token_array, related))


def bigrams(token_array: Column) -> Column:
    """TXT-4: adjacent pairs ``a_b``."""
    return F.when(
        F.size(token_array) >= 2,
        F.zip_with(
            F.slice(token_array, F.lit(1), F.size(token_array) - 1),
            F.slice(token_array, F.lit(2), F.size(token_array) - 1),
            lambda a, b: F.concat_ws("_", a, b),
        ),
    ).otherwise(F.array().cast("array<string>"))


def jaccard(left: Column, right: Column) -> Column:
    """TXT-5: 0 when either side is empty."""
    union = F.size(F.array_union(left, right))
    return F.when(
        (F.size(left) > 0) & (F.size(right) > 0), F.size(F.array_intersect(left, right)) / union
    ).otherwise(F.lit(0.0))


def keywords(text: Column, limit: int = 25) -> Column:
    """TXT-14: the first distinct tokens."""
    return F.slice(F.array_distinct(tokens(text)), 1, limit)


# ---------------------------------------------------------------------- numbers


def _all_numbers(text: Column, pattern: str) -> Column:
    return F.transform(
        F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(U + pattern), F.lit(1)),
        lambda x: x.cast("double"),
    )


def percentages(text: Column) -> Column:
    """TXT-6.  A bare ``100%`` yields nothing: ``%`` must meet a word character."""
    return _all_numbers(text, fixed.PERCENT_PATTERN)


def numbers(text: Column) -> Column:
    """TXT-7."""
    return _all_numbers(text, fixed.NUMBER_PATTERN)


def as_number(value: Column) -> Column:
    """TXT-8: first percentage, else a lone number that is the whole text or sits
    in at most 12 characters, else NULL."""

    def parsed(text: Column) -> Column:
        percent = F.regexp_extract(text, U + fixed.PERCENT_PATTERN, 1)
        found = F.regexp_extract_all(text, F.lit(U + fixed.NUMBER_PATTERN), F.lit(1))
        whole = F.replace(text, F.lit(","), F.lit("")).rlike(U + "^" + fixed.NUMBER_PATTERN + "$")
        lone = let(
            found,
            lambda n: F.when((F.size(n) == 1) & ((F.length(text) <= 12) | whole), F.get(n, F.lit(0)).cast("double")),
        )
        return F.coalesce(F.when(percent != "", percent.cast("double")), lone)

    return F.when(value.rlike("[0-9]"), let(trimmed(value), parsed))


def same_value(left_norm: Column, left_num: Column, right_norm: Column, right_num: Column) -> Column:
    """TXT-9 on prepared values: numeric when both are numeric, else normalised text."""
    return F.when(
        left_num.isNotNull() & right_num.isNotNull(), F.abs(left_num - right_num) < 1e-9
    ).otherwise(left_norm == right_norm)


def values_equivalent(left: Column, right: Column) -> Column:
    """TXT-9 on raw values."""
    return same_value(normalized_value(left), as_number(left), normalized_value(right), as_number(right))


def humanize(value: Column) -> Column:
    """TXT-10."""
    return F.when(value.isNull() | (value == ""), F.lit("none")).otherwise(value)


def trim_number(value: Column) -> Column:
    """TXT-11 on number text: ``100.0`` -> ``100``, ``12.50`` -> ``12.5``."""
    shortest = F.regexp_replace(value, r"(\.\d*?)0+$", "$1")
    shortest = F.regexp_replace(F.regexp_replace(shortest, r"\.$", ""), r"^(-?)0+(\d)", "$1$2")
    return F.when(shortest == "-0", F.lit("0")).otherwise(shortest)


def number_text(value: Column) -> Column:
    """TXT-11 on a double."""
    return F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def leading_number(text: Column) -> Column:
    """TXT-20."""
    return F.regexp_extract(text, r"^(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def split_values(value: Column) -> Column:
    """TXT-25: the non-blank comma parts, or the value itself when there are none."""
    parts = F.filter(F.transform(F.split(value, ","), trimmed), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(value))


# --------------------------------------------------------------------- phrasing


def join_words(items: Column) -> Column:
    """TXT-34: ``a, b and c``."""
    n = F.size(items)
    return (
        F.when(n == 0, F.lit(""))
        .when(n == 1, F.get(items, F.lit(0)))
        .otherwise(
            F.concat(
                F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(" and "), F.get(items, n - 1)
            )
        )
    )


def signal_phrase(signal: Column) -> Column:
    """TXT-35."""
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in fixed.SIGNAL_PHRASES.items())
    return F.coalesce(F.try_element_at(F.expr(f"map({pairs})"), signal), F.replace(signal, F.lit("_"), F.lit(" ")))


def canonical_header(header: Column) -> Column:
    """TXT-24."""
    return squeezed(F.regexp_replace(normalize(header), r"[^a-z0-9 ]+", " "))


def location(source: Column, line: Column) -> Column:
    """TXT-37: ``source:line``, NULL without a source."""
    shown = F.when((line.isNotNull()) & (line != 0), F.concat_ws(":", source, line.cast("string")))
    return F.when(F.coalesce(source, F.lit("")) != "", F.coalesce(shown, source))


def contains_any_case(needle: str, *columns: Column) -> Column:
    """TXT-39: the needle, taken literally, occurs in one of the columns."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(needle.lower()), F.lit(False))
    return hit


def known_code(code: Column, known, default: str) -> Column:
    """TXT-40: unknown codes fall back to the default."""
    return F.when(code.isin(list(known)), code).otherwise(F.lit(default))


def coverage_label(code: Column) -> Column:
    """TXT-42 for verdicts."""
    table = F.create_map(*[F.lit(x) for kv in fixed.COVERAGE_LABELS.items() for x in kv])
    return F.try_element_at(table, code)


def code_label(code: Column) -> Column:
    """TXT-42 for gap types: ``NULL_HANDLING`` -> ``Null Handling``."""
    return F.initcap(F.replace(code, F.lit("_"), F.lit(" ")))


def lookup(code: Column, table: dict, default=None) -> Column:
    """A fixed dict as a CASE expression."""
    if len(table) > 8 and all(isinstance(k, str) and isinstance(v, str) for k, v in table.items()):
        pairs = ", ".join(f"'{k}', '{v}'" for k, v in table.items())
        return F.coalesce(F.try_element_at(F.expr(f"map({pairs})"), code), F.lit(default))
    expr = F
    for k, v in table.items():
        expr = expr.when(code == k, F.lit(v))
    return expr.otherwise(F.lit(default))


def family_key(gap_type: Column) -> Column:
    """TXT-36, key."""
    table = {g: k for k, (_, members) in fixed.GAP_FAMILIES.items() for g in members}
    return F.when(gap_type.isNotNull(), lookup(gap_type, table, "UNCATEGORISED"))


def family_label(key: Column) -> Column:
    """TXT-36, label of a family key; an unknown key labels itself."""
    return F.coalesce(lookup(key, {k: label for k, (label, _) in fixed.GAP_FAMILIES.items()}), key)
