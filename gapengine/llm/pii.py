"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Column expressions only.  Positions are code points: splitting a text at a
pattern gives what lies between its matches, so the starts are running sums of
the lengths of both.  The patterns are the plain ones with two changes that
keep every match and make long texts cheap: repetitions that nothing behind
them can shorten are possessive, and a match of a repeated class starts only
where the class's run starts or where the previous match ended (\\G), instead
of at every position inside the run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gapengine.llm.common import C

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

# Cheap conditions that every text with a match meets.
GATES = {
    "email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), "phone": lambda t: t.contains("+"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"), "ssn": lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
}
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "ssn": SSN}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)

# Score of a confirmed span, and what a context word near it adds.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.5, "iban": 0.9, "ssn": 0.3}
CONTEXT = {
    "email": r"mail|contact|write to", "ip": r"\bip\b|address|host|server|login", "card": r"card|visa|mastercard|amex|payment|credit",
    "phone": r"phone|call|tel\b|mobile|fax|dial", "iban": r"iban|account|bank|transfer", "ssn": r"ssn|social security",
}
CONTEXT_BONUS = 0.2
CONTEXT_CHARS = 40
# A method span below this score is not reported; base spans always are.
LEAST_SCORE = 0.5

_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def luhn(digits: Column) -> Column:
    """Luhn checksum of a string of digits."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + digit - F.when(digit > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(number: Column) -> Column:
    """The check of bank account numbers: country and check digits moved behind, letters read as 10 to 35."""
    plain = F.replace(number, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.regexp_extract_all(turned, F.lit("."), F.lit(0)), F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    """Does the kind's validator accept the matched text?"""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(match)
    return F.lit(True)


def found(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind: array of (kind, start, end, text, score), by start."""
    pattern = PATTERNS[kind]
    between = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), matches, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    none = F.lit(None).cast("array<struct<start:int,end:int,text:string>>")

    def walk(state: Column, pair: Column) -> Column:
        start = state.getField("at") + pair.getField("gap")
        end = start + F.length(pair.getField("m"))
        span = F.struct(start.alias("start"), end.alias("end"), pair.getField("m").alias("text"))
        spans = F.when(confirmed(kind, pair.getField("m")), F.concat(state.getField("spans"), F.array(span))).otherwise(state.getField("spans"))
        return F.struct(end.alias("at"), spans.alias("spans"))

    first = F.struct(F.lit(0).alias("at"), F.coalesce(none, F.array().cast("array<struct<start:int,end:int,text:string>>")).alias("spans"))
    spans = F.aggregate(pairs, first, walk, lambda state: state.getField("spans"))
    scored = F.transform(spans, lambda s: F.struct(
        F.lit(kind).alias("kind"), s.getField("start").alias("start"), s.getField("end").alias("end"), s.getField("text").alias("text"),
        _score(text, kind, s).alias("score"),
    ))
    if kind not in BASE:
        scored = F.filter(scored, lambda s: s.getField("score") >= LEAST_SCORE)
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,text:string,score:double>>")
    return F.when(GATES[kind](text), scored).otherwise(empty)


def _score(text: Column, kind: str, span: Column) -> Column:
    start, end = span.getField("start"), span.getField("end")
    behind = F.greatest(start - CONTEXT_CHARS, F.lit(0))
    near = F.concat(F.substring(text, behind + 1, start - behind), F.lit(" "), F.substring(text, end + 1, F.lit(CONTEXT_CHARS)))
    return F.lit(SCORES[kind]) + F.when(F.lower(near).rlike(CONTEXT[kind]), CONTEXT_BONUS).otherwise(0.0)


def find_pii(docs: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with ``out``: all spans (kind, start, end, text, score), by kind as in ``KINDS``, then start.

    Starts are code points from 0, ends exclusive.  Spans of one kind never
    overlap; of different kinds they may.  Base kinds keep every confirmed
    match whatever its score; the further kinds (bank accounts, social security
    numbers) need a score of ``LEAST_SCORE``, so a bare three-two-four number
    counts only near words that name it.  A null or empty text has no spans;
    nothing of a text is left out, however long.  Repeated rows get equal
    results, other columns pass through; one named ``out`` is replaced.
    """
    text = F.coalesce(C(text_col).cast("string"), F.lit(""))
    parts = {f"_pii_{k}": found(text, k) for k in KINDS}
    return docs.withColumns(parts).withColumn(out, F.concat(*parts)).drop(*parts)


def redacted(text_col: str = "text", spans_col: str = "pii") -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans merge under the first one's kind."""
    text = C(text_col).cast("string")
    ordered = F.array_sort(F.transform(spans_col, lambda s: F.struct(
        s.getField("start").alias("start"), (-s.getField("end")).alias("back"), s.getField("kind").alias("kind"))))
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def walk(state: Column, s: Column) -> Column:
        at, end = state.getField("at"), -s.getField("back")
        piece = F.concat(F.substring(text, at + 1, s.getField("start") - at), F.lit("["), F.upper(s.getField("kind")), F.lit("]"))
        done = F.when(s.getField("start") >= at, F.concat(state.getField("done"), piece)).otherwise(state.getField("done"))
        return F.struct(F.greatest(at, end).alias("at"), done.alias("done"))

    whole = F.aggregate(ordered, first, walk, lambda s: F.concat(s.getField("done"), F.substring(text, s.getField("at") + 1, F.length(text))))
    return F.when(F.size(spans_col) > 0, whole).otherwise(text)


def of_kinds(*kinds: str, spans_col: str = "pii") -> Column:
    return F.filter(spans_col, lambda s: s.getField("kind").isin(*kinds))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.getField("kind"), s.getField("start"), s.getField("end"))), ",")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of the spans, one row for each row of ``docs``."""
    spans = find_pii(docs.select(C(id_col).alias("doc_id"), C(text_col).alias("text"))).drop("text")
    return spans.select(
        "doc_id", *[F.size(of_kinds(k)).cast("bigint").alias(f"n_{k}") for k in BASE],
        F.sha2(digest(of_kinds(*BASE)).cast("binary"), 256).alias("base_sha256"),
        digest(C("pii")).alias("spans"), F.coalesce(F.array_max(F.transform("pii", lambda s: s.getField("score"))), F.lit(0.0)).alias("top_score"),
    )
