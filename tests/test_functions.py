import pytest
from pyspark.sql import functions as F

from gapengine.functions import extract as X, text as T


def pairs(v):
    return {p["key"]: p["value"] for p in v}


def test_normalize_and_tokens(spark, one):
    assert one(T.normalize, "fooBar_baz sign-up at -5 Crème", None) == ["foo bar baz sign up at -5 creme", ""]
    assert one(T.tokens, "The page returned 7.5% of a. x 3 results.") == [["page", "returned", "7.5%", "3"]]
    df = spark.createDataFrame([("ﬁx ½",)], "t string")
    assert T.expand_compat(df, "t").select(T.normalize(F.col("t"))).first()[0] == "fix 1⁄2"


def test_token_helpers(one):
    assert one(lambda c: T.bigrams(T.tokens(c)), "alpha beta gamma", "alpha") == [["alpha_beta", "beta_gamma"], []]
    assert set(one(lambda c: T.expand(T.tokens(c)), "cart broke")[0]) == {"cart", "broke", "checkout", "basket"}
    assert one(lambda c: T.jaccard(T.tokens(c), T.strings(["alpha", "beta"])), "beta delta", "") == [pytest.approx(1 / 3), 0.0]


@pytest.mark.parametrize(
    "value, number",
    [("100%", 100.0), ("1,000", None), ("12 percent of all orders", 12.0), ("10% off the whole price", None),
     ("abc 3", 3.0), ("", None), ("none", None), ("-5", -5.0)],
)
def test_as_number(one, value, number):
    assert one(T.as_number, value) == [number]


def test_value_equivalence(one):
    same = lambda other: (lambda c: T.values_equivalent(c, F.lit(other)))
    assert one(same("10"), "10%", "10.0", "ten") == [True, True, False]
    assert one(same("NULL"), "null", "nil") == [True, False]
    assert one(T.trim_number, "100.0", "12.50", "007", "-0") == ["100", "12.5", "7", "0"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("A 50% discount was used", {"discount": "50%"}),
        ("the page size: 40 was ignored", {"page_size": "40"}),
        ("quantity = 0", {"quantity": "0"}),
        ("an expired coupon", {"coupon": "expired"}),
        ("their email was empty", {"their_email": "empty"}),
        ("currency = 'EUR'", {"currency": "eur"}),
        ("negative discount", {"discount": "negative"}),
        ("nothing of interest", {}),
    ],
)
def test_conditions(one, text, expected):
    assert pairs(one(X.extract_conditions, text)[0]) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("request timed out, then a retry", ["timeout", "retry"]),
        ("100% of it", ["boundary_max"]),
        ("division by zero", ["error_handling"]),
        ("zero items", ["boundary_min"]),
        ("after unsubscribing", ["state_transition"]),
        ("authorised users", ["permission"]),
        ("all is well", []),
    ],
)
def test_signals(one, text, expected):
    assert one(X.detect_signals, text)[0] == expected


def test_exercised_signals(spark):
    df = spark.sql("select 'apply it' as n, '' as s, array(struct('discount' as key, '100%' as value), struct('email' as key, 'nil' as value), struct('n' as key, '0' as value)) as i")
    assert df.select(X.exercised_signals(F.col("n"), F.col("s"), F.col("i"))).first()[0] == ["null", "boundary_max", "boundary_min"]


def test_features_from_provenance(one):
    got = one(X.feature_from_source, "tests/billing/test_tax.py", "test_orders.py", "book.xlsx[Claims Desk]", "claimsIntake/unit/x.py", "", "tests/unit")
    assert got == ["Billing", "Orders", "Claims Desk", "Claims Intake", "Unknown", "Unknown"]


def test_incident_fields(one):
    text = "Saving failed for one page. More text\n\nRoot cause: stale cache entry\n\nthanks"
    assert one(X.root_cause_of, text) == ["stale cache entry"]
    assert one(X.failure_of, text) == ["Saving failed for one page"]
    assert one(X.title_of, text) == ["Saving failed for one page. More text"]
    assert one(X.severity_of, "full outage", "sev2", "a typo", "hmm", "slow page") == ["CRITICAL", "HIGH", "LOW", "MEDIUM", "LOW"]
    assert one(X.humanize_test_name, "test_addsTwo_items") == ["adds two items"]
    assert one(X.occurred_at, "yesterday") == [None]
    assert one(X.occurred_at, "2024-02-03T04:05:06Z")[0].year == 2024


def test_phrasing(spark, one):
    df = spark.sql("select array() as a, array('x') as b, array('x','y','z') as c")
    row = df.select(*[T.join_words(F.col(k)) for k in "abc"]).first()
    assert tuple(row) == ("", "x", "x, y and z")
    assert one(T.family_key, "EMPTY_INPUT", None, "whatever") == ["NULL_EMPTY_INPUTS", None, "UNCATEGORISED"]
    assert one(T.code_label, "NULL_HANDLING") == ["Null Handling"]
    assert one(lambda c: T.location(c, F.lit(7)), "a.py", "") == ["a.py:7", None]
