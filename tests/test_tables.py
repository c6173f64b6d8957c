"""Sources, catalogue maintenance, history, patterns and numbering."""

from pyspark.sql import functions as F

from gapengine.functions.extract import no_pairs
from gapengine.functions.text import strings
from gapengine.operators import catalogue as cat, history as hist, patterns as pat, retrieve as ret
from gapengine.operators.sizing import ordinal_within
from gapengine.schemas import OBSERVATION_SCHEMA
from gapengine.sources.files import incident_documents, read_catalogue, scan
from gapengine.sources.tabular import map_headers, rows_to_tests, usable


def test_headers():
    assert map_headers(["TestID", "Test Case Name", "Module", "Expected Result (UI)"]) == {"id": 0, "name": 1, "feature": 2, "expected": 3}
    assert not usable(["foo", "bar"])


def test_read_catalogue(spark, tmp_path):
    (tmp_path / "billing").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "exports.csv").write_text(
        'Report\n\nID,Title,Module,Test Data,Labels\nA-1,pays now,payment desk,"amount=5; a:b",\n\n,second case,,,\n'
    )
    (tmp_path / "plain.tsv").write_text("Key\tName\nB-1\tfirst\nB-2\tsecond\n")
    (tmp_path / "empty.csv").write_text(" \n")  # file scans skip zero-length files
    (tmp_path / "odd.csv").write_text("q,w\n1,2\n")
    (tmp_path / "node_modules" / "test_x.py").write_text("def test_hidden(): pass\n")
    (tmp_path / "billing" / "test_tax.py").write_text(
        "import pytest\n@pytest.mark.parametrize('rate', [0, 10, 10])\ndef test_tax_rate(rate):\n    \"\"\"Tax is added.\n\n    Expected: total grows\n    \"\"\"\n"
        "    assert add(amount=5.0, note='') == 5\n\nclass TestMore:\n    def test_fails(self):\n        with pytest.raises(ValueError):\n            add(None)\n\ndef helper(): pass\n"
    )
    (tmp_path / "billing" / "test_bad.py").write_text("def broken(:\n")
    (tmp_path / "cart.test.ts").write_text("describe('Cart totals', () => {\n  it('adds a 5% discount', () => {\n    expect(total).toBe(2);\n  });\n  test.skip('later', () => {});\n});\n")
    tests, issues = read_catalogue(scan(spark, str(tmp_path)), F.lit(1).cast("bigint"), str(tmp_path))
    by = {r.test_id: r for r in tests.collect()}
    assert set(by) == {"A-1", "EXPORTS-6", "B-1", "B-2", "test_tax::test_tax_rate", "test_tax::TestMore::test_fails", "cart.test::Cart totals::adds a 5% discount", "cart.test::Cart totals::later"}
    tax = by["test_tax::test_tax_rate"]
    values = {p["key"]: p["value"] for p in tax.inputs}
    assert values["amount"] == "5" and values["note"] == "empty" and values["rate"] == "0, 10"
    assert tax.feature == "Billing" and tax.expected_behavior == "total grows" and tax.tags == ["parametrize"]
    assert by["test_tax::TestMore::test_fails"].assertions == ["raises ValueError"]
    assert by["A-1"].feature == "Payment Desk" and [p["key"] for p in by["A-1"].inputs] == ["amount", "a"]
    js = by["cart.test::Cart totals::adds a 5% discount"]
    assert js.feature == "Cart Totals" and js.assertions == ["expect(total).toBe(2)"] and js.line_number == 2
    assert by["cart.test::Cart totals::later"].tags == ["skipped"]
    assert {r.location for r in issues.collect()} == {"empty.csv", "odd.csv", "billing/test_bad.py"}


def test_incident_documents(spark):
    docs = spark.createDataFrame(
        [("a.json", '{"id":"X","description":"It broke","feature":"Cart","conditions":{"b":"2","a":"1"}}'), ("b.json", "{oops"), ("c.txt", "plain")],
        "path string, value string",
    )
    rows = {r.text: r for r in incident_documents(docs).collect()}
    assert set(rows) == {"It broke", "{oops", "plain"}
    assert rows["It broke"].incident_id == "X" and rows["It broke"].feature == "Cart"


def test_duplicates_and_ids(spark):
    df = spark.createDataFrame([(1, "x", "A", 1), (1, "x", "B", 2), (1, "x", "A", 3), (1, "", "C", 4)], "source_id long, test_id string, name string, seq long")
    full = df.select("*", F.lit("F").alias("feature"), F.lit("").alias("scenario"), F.lit("").alias("expected_behavior"), no_pairs().alias("inputs"))
    kept, metrics = cat.ingest(full, None)
    assert sorted(r.test_id for r in kept.collect()) == ["TEST", "x", "x#2"]
    assert metrics.first().duplicates == 1


def test_ordinal_is_the_same_with_steps(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), (F.hash("id") % 50).alias("v"), "id")
    plain = ordinal_within(df, ["k"], [F.col("v"), F.col("id")]).select("id", F.col("ordinal").cast("long").alias("n"))
    stepped = ordinal_within(df, ["k"], [F.col("v"), F.col("id")], F.floor(F.col("v") / 7)).select("id", F.col("ordinal").alias("n"))
    assert plain.exceptAll(stepped).count() == 0 and stepped.exceptAll(plain).count() == 0


def test_sources_and_status(spark):
    old = spark.createDataFrame([(4, "CSV", "a.csv", "first")], "source_id long, kind string, location string, label string")
    new = spark.createDataFrame([("CSV", "a.csv", ""), ("CSV", "b.csv", "b")], "kind string, location string, label string")
    assert sorted((r.source_id, r.label) for r in cat.upsert_sources(old, new).collect()) == [(4, "first"), (5, "b")]
    recs = spark.createDataFrame([(1, "PROPOSED"), (2, "PROPOSED")], "recommendation_id int, status string")
    ups = spark.createDataFrame([(1, "accepted", 1), (1, "bogus", 2)], "recommendation_id int, status string, update_seq int")
    assert sorted((r.recommendation_id, r.status) for r in hist.apply_status_updates(recs, ups).collect()) == [(1, "ACCEPTED"), (2, "PROPOSED")]


def test_patterns(spark):
    rows = [(f"i{n}", "NULL_HANDLING" if n % 2 else "EMPTY_INPUT", "NULL_EMPTY_INPUTS", "Pay" if n < 6 else "Cart", "HIGH", "NOT_COVERED", n) for n in range(7)]
    rows += [("i0", "EMPTY_INPUT", "NULL_EMPTY_INPUTS", "Pay", "LOW", "PARTIAL", 9), ("z", "PERMISSION", "PERMISSION_COMBINATIONS", "Pay", "LOW", "PARTIAL", 1)]
    p = pat.recurring_patterns(spark.createDataFrame(rows, OBSERVATION_SCHEMA)).collect()
    assert len(p) == 1
    assert (p[0].incident_count, p[0].gap_count, p[0].concentrated_in, p[0].concentration, p[0].risk) == (7, 8, "Pay", 0.88, "HIGH")
    assert p[0].gap_types == ["EMPTY_INPUT", "NULL_HANDLING"] and "mostly Pay (87 %)" in p[0].summary


def test_recurrence_against_brute_force(spark):
    gaps = [(f"g{n}", n % 9, "CONCURRENCY" if n % 2 else "ENVIRONMENT") for n in range(40)]
    asks = [(f"g{n}", n % 9, ["concurrency"] if n % 3 else []) for n in range(40)]
    g = spark.createDataFrame(gaps, "incident_id string, arrival int, family_key string")
    i = spark.createDataFrame(asks, "incident_id string, arrival int, signals array<string>")
    want = {
        a: sum(1 for b, bt, f in gaps if f == "CONCURRENCY" and (bt, b) < (at, a)) if s else 0 for a, at, s in asks
    }
    got = {r.incident_id: r.similar_incidents for r in hist.recurrence_at_arrival(i, g).collect()}
    assert got == want


def test_recurrence_of_one_family_is_spread(spark):
    # One family holds every row and every arrival differs.
    from gapengine.operators.sizing import running_total

    n = 4000
    rows = spark.range(n).select(F.format_string("g%05d", "id").alias("incident_id"), (F.col("id") * 7 % n).alias("arrival"), F.lit("CONCURRENCY").alias("family_key"))
    asks = rows.select("incident_id", "arrival", F.array(F.lit("concurrency")).alias("signals"))
    got = hist.recurrence_at_arrival(asks, rows)
    assert got.join(rows, "incident_id").filter("similar_incidents <> arrival").count() == 0 and got.count() == n
    totals = running_total(rows.withColumn("one", F.lit(1)), ["family_key"], [F.col("arrival").asc()], "one", "before")
    parts = totals.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < n / 2


def test_lexical_blocks_do_not_change_scores(spark):
    terms = spark.createDataFrame([(d, t, 1, 2) for d in range(6) for t in ("a", f"t{d}")], "doc_id int, term string, tf long, doc_length long")
    stats = spark.createDataFrame([("a", 0.5), *[(f"t{d}", 1.0) for d in range(6)]], "term string, idf double")
    corpus = spark.createDataFrame([(6, 2.0)], "n_docs int, avg_length double")
    words = spark.createDataFrame([(q, t, 1.0) for q in range(5) for t in ("a", f"t{q}")], "query_id int, term string, weight double")
    whole = ret.bm25_scores(terms, stats, corpus, words).collect()
    blocks = ret.bm25_scores(terms, stats, corpus, words, rows=3).collect()
    assert len(whole) == 30 and sorted(whole) == sorted(blocks)


def test_witnesses(spark):
    rows = [(1, d, s, True, ["retry", "timeout"], sig) for d, s, sig in ((1, 0.9, []), (2, 0.2, ["retry", "timeout"]), (3, 0.1, ["timeout"]))]
    scored = spark.createDataFrame(rows, "query_id int, doc_id int, score double, feature_match boolean, i_signals array<string>, t_signals array<string>")
    final = ret.finalists(scored)
    kept = ret.keep_candidates(final)
    assert [r.doc_id for r in kept.collect()] == [1]
    assert sorted((r.turn, r.doc_id) for r in ret.signal_witnesses(final, kept).collect()) == [(0, 2), (1, 3)]


def test_empty_strings_helper(spark):
    assert spark.range(1).select(strings([])).first()[0] == []


def test_no_row_limit_in_exports(spark, tmp_path):
    for name, n in (("small", 60_000), ("large", 300_000)):
        lines = "\n".join(f"{name}-{i},checks value {i} of the long export" for i in range(n))
        (tmp_path / f"{name}.csv").write_text("ID,Title\n" + lines + "\n")
    tests, issues = read_catalogue(scan(spark, str(tmp_path)), F.lit(1).cast("bigint"), str(tmp_path))
    assert {r.source: r["count"] for r in tests.groupBy("source").count().collect()} == {"small.csv": 60_000, "large.csv": 300_000}
    assert issues.count() == 0


def test_long_ids_stay_different(spark):
    ids = ["x" * 130 + e for e in "ab"]
    df = spark.createDataFrame([(1, i, n) for n, i in enumerate(ids)], "source_id bigint, test_id string, seq bigint")
    assert {r.test_id for r in cat.unique_ids(df).collect()} == set(ids)


def test_conditions_keep_their_written_order(spark):
    docs = spark.createDataFrame([("a.json", '{"text":"t","conditions":{"zeta":"2","alpha":"1"}}')], "path string, value string")
    assert [p["key"] for p in incident_documents(docs).first().conditions] == ["zeta", "alpha"]


def test_both_sides_fold_compatibility_characters(spark):
    rows = spark.createDataFrame([("s.csv", 1, "T", "ﬁlter by ＩＤ", "", "", "", "", "")], "source string, row_no int, id string, name string, scenario string, expected string, feature string, tags string, inputs string")
    assert rows_to_tests(rows).first().name == "filter by ID"
