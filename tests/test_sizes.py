"""Work that is dealt over tasks by its size, with the same results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapengine.operators import index as ix, vectors as vec
from gapengine.plans import derived as d


def test_many_queries_are_not_sent_to_many_groups(spark):
    rows = np.random.default_rng(3).normal(size=(4_000, 8))
    vectors = spark.createDataFrame([(i, list(range(8)), [float(x) for x in r]) for i, r in enumerate(rows)], "doc_id long, buckets array<int>, weights array<double>")
    index = vec.build_vector_index(vectors, rows_per_group=10, part_rows=50, plain_rows=0, n_queries=4_000)
    copies = index.parts.count()
    assert copies <= 4 * vec.COPIES and index.parts.agg(F.sum(F.size("rows"))).first()[0] == 4_000
    asked = vectors.filter("doc_id % 80 = 0").withColumnRenamed("doc_id", "query_id")
    scores = np.round(rows[::80] @ rows.T, 9)
    found = {}
    for r in vec.search(index, asked, 5).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = r.doc_id
    for at, row in enumerate(scores):
        best = np.lexsort((np.arange(4_000), -row))[:5]
        assert [found[80 * at][k] for k in range(1, 6)] == best.tolist()


@pytest.mark.parametrize("width", [3, 40, 700])
def test_best_of_keeps_ties_in_order(width):
    scores = np.random.default_rng(width).integers(0, 6, size=(30, width)) / 4.0
    scores[0, 1] = np.nan
    k = min(9, width - 1)
    q, at, found = vec._best_of(scores, k)
    for row in range(30):
        order = np.lexsort((np.arange(width), -np.nan_to_num(scores[row], nan=-1.0)))[:k]
        assert at[q == row].tolist() == order.tolist() and found[q == row].tolist() == scores[row, order].tolist()


def test_texts_are_dealt_by_their_size(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} common " * 50) for i in range(300)], "doc_id long, text string")
    dealt = ix.by_document(docs, task_bytes=10_000)
    assert dealt.rdd.getNumPartitions() >= 20  # adaptive execution leaves a named number alone
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, docs.collect()))


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(d, "PAIRS_A_TASK", 100)
    rows = [(p, "x", a, 1, f"{p}-{a}") for p in range(40) for a in range(10)]
    tests = spark.createDataFrame(rows, "l_partkey long, feature string, discount_pct int, tax_pct int, test_id string")
    pairs = d.profile_pairs(tests, tests)
    assert pairs.count() == 4_000 and pairs.rdd.getNumPartitions() >= 20


def test_summaries_stay_where_they_are(spark):
    profile = "l_partkey long, feature string, discount_pct int, tax_pct int"
    incidents = spark.createDataFrame([(p, "x", 5, 1) for p in range(50)] + [(50, "x", None, 1), (51, "x", 5, 1)], profile)
    tests = spark.createDataFrame([(p, "x", 5, 1) for p in range(40)] + [(51, "x", None, 1)], profile)
    summary = incidents.filter("l_partkey < 40").repartition(7, "l_partkey").withColumn("judged", F.array("tax_pct"))
    rows = d.with_lonely(summary, incidents, tests)
    got = {r.l_partkey: r.judged for r in rows.collect()}
    assert rows.count() == 52 and got == {p: [1] if p < 40 else None for p in range(52)}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "judged" not in "".join(x for x in plan.splitlines() if "Join" in x) and plan.count("Join") == 1


def test_few_combinations_are_compared_without_pairs(spark):
    rows = [(p, "x", a, 1, f"{p}-{a}") for p in range(40) for a in range(3)]
    profiles = spark.createDataFrame(rows, "l_partkey long, feature string, discount_pct int, tax_pct int, test_id string")
    cases = d.compared_cases(profiles, profiles, None).select(*d.CASE, *[f"test_{c}" for c in d.CASE])
    assert cases.count() == cases.distinct().count() == 9
    apart = spark.createDataFrame([(p, "x", p, p, str(p)) for p in range(30)], profiles.schema)
    pairs = d.profile_pairs(apart, apart)
    assert d.compared_cases(apart, apart, pairs).count() == 30  # 900 combinations, 60 profiles: only what meets


def test_vocabulary_words_are_counted_where_the_text_is(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} common " * 50, "ab" if i % 3 else None) for i in range(300)], "doc_id long, text string, feature string")
    counted = ix.counted_words(docs)
    assert counted.count() == 600 and {r.n for r in counted.select("n").distinct().collect()} == {50}
    for words in (counted, ix.feature_words(docs).groupBy("doc_id", "feature", "term").count()):
        plan = words._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.index("Exchange") > plan.index("Generate")  # of texts, before they are split
    both = ix.with_feature_names(counted, docs)
    joined = ix.feature_words(docs.withColumn("text", F.concat_ws(" ", "text", "feature")))
    assert sorted(map(tuple, both.groupBy("feature", "term").agg(F.sum("n")).collect())) == sorted(map(tuple, joined.groupBy("feature", "term").count().collect()))


def test_verdicts_behind_recurrence_are_worked_out_once(spark, monkeypatch):
    from gapengine.plans import queries as q

    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [(f"i{i}", float(i), ["retry"], "CONCURRENCY", "extra") for i in range(200)]
    schema = "incident_id string, arrival double, signals array<string>, family_key string, more string"
    monkeypatch.setattr(q, "_observations", lambda *_: spark.createDataFrame(rows, schema).mapInArrow(counted, schema))
    assert q.recurrence_on_arrival(spark, "").count() == 200 and made.value == 200


def test_search_index_learns_no_vocabulary(spark):
    docs = spark.createDataFrame([(i, f"alpha beta{i % 5} {'cart basket' if i % 2 else 'invoice'}", "checkout" if i % 2 else "billing") for i in range(60)], "doc_id long, text string, feature string")
    whole, bare = ix.build_index(docs), ix.build_index(docs, learn=False)
    assert whole.vocabulary.count() > 0 and bare.vocabulary.count() == 0 and bare.feature_counts.count() == 0
    for name in ("doc_terms", "term_stats", "corpus", "vectors", "bucket_idf"):
        assert sorted(map(repr, getattr(whole, name).collect())) == sorted(map(repr, getattr(bare, name).collect()))
