"""Pruned lexical and vector search: the same results as without bounds, for less work."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapengine.operators import impact as im, index as ix, retrieve as ret
from gapengine.operators.sizing import materialise
from gapengine.operators.vectors import build_vector_index, planned_visits, search


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts over a few hundred words, most of them rare; every third query copies part of a text."""
    rng = random.Random(4)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 900}"
    docs = [(i, " ".join(word() for _ in range(rng.randrange(3, 60))), ["A", "B"][i % 2]) for i in range(900)]
    docs += [(2000 + i, docs[5][1], "A") for i in range(40)] + [(3000, "", "A"), (3001, None, "B")]
    queries = [(i, docs[i * 7][1] if i % 3 == 0 else " ".join(word() for _ in range(rng.randrange(1, 12)))) for i in range(40)]
    queries += [(90, ""), (91, "nowhere"), (92, docs[5][1]), (93, "checkout discount " + docs[9][1])]
    docs = spark.createDataFrame(docs, "doc_id int, text string, feature string")
    return docs, spark.createDataFrame(queries, "query_id int, text string")


@pytest.fixture(scope="module")
def lexical(corpus):
    terms, one, stats = ix.lexical_index(corpus[0])
    words = materialise(ret.query_terms(corpus[1]))
    return terms, stats, one, words, materialise(im.impact_blocks(terms, stats, one))


def best_of(rows, k):
    out = {}
    for r in rows:
        out.setdefault(r.query_id, []).append((-round(r.bm25, 6), r.doc_id))
    return {q: sorted(v)[:k] for q, v in out.items()}


@pytest.mark.parametrize("k", [1, 15, 5000])
def test_pruned_scores_equal_full_sums(lexical, k):
    terms, stats, one, words, blocks = lexical
    full = ret.bm25_scores(terms, stats, one, words).collect()
    got = im.pruned_scores(blocks, terms, stats, one, words, k).collect()
    assert best_of(got, k) == best_of(full, k)
    if k < 100:
        assert 5 * len(got) < len(full)


def test_lists_and_levels_are_left_out(lexical):
    terms, stats, one, words, blocks = lexical
    levels = materialise(im.asked_levels(blocks, words))
    seeds = im.score_pairs(im.seed_pairs(levels, blocks), terms, stats, one, words)
    thresholds = levels.select("query_id").distinct().join(im.kth_best(seeds, 3), "query_id")
    kept = im.kept_levels(levels, thresholds)
    read, there = (d.agg(F.sum("n")).first()[0] for d in (kept, levels))
    assert read < 0.7 * there
    pairs = im.survivors(materialise(kept), blocks).count()
    assert 5 * pairs < ret.bm25_scores(terms, stats, one, words).count()


def test_blocks_hold_every_posting_once(lexical, monkeypatch):
    terms, stats, one, _, blocks = lexical
    monkeypatch.setattr(im, "BLOCK_POSTINGS", 8)
    small = materialise(im.impact_blocks(terms, stats, one))
    for b in (blocks, small):
        rows = b.select("term", F.inline("rows"))
        assert rows.count() == terms.count() == rows.select("term", "doc_id").distinct().count()
    assert small.agg(F.max("n_blocks")).first()[0] > 5 and small.agg(F.max("n")).first()[0] < 40


def test_candidates_equal_those_of_all_pairs(spark, corpus):
    docs, queries = corpus
    index = ix.build_index(docs)
    pick = lambda c, n: F.when(c % n == 0, F.array(F.lit("retry"))).when(c % n == 1, F.array(F.lit("null"), F.lit("retry"))).otherwise(F.array().cast("array<string>"))
    keys = lambda c: F.when(c % 4 == 0, F.array(F.lit("k"))).otherwise(F.array().cast("array<string>"))
    incidents = queries.select("query_id", F.when(F.col("query_id") % 5 == 0, "").otherwise("A").alias("i_feature"), keys(F.col("query_id")).alias("i_keys"), pick(F.col("query_id"), 3).alias("i_signals"))
    sides = docs.select("doc_id", F.col("feature").alias("t_feature"), keys(F.col("doc_id")).alias("t_keys"), pick(F.col("doc_id"), 40).alias("t_signals"))
    kept, stats = ret.retrieve(index, queries, incidents, sides, top_k=4, oversample=2, plain_postings=0)
    # The same from every pair that shares a term.
    words = ret.query_terms(queries)
    scores = ret.bm25_scores(index.doc_terms, index.term_stats, index.corpus, words)
    lexical = ret.scaled_lexical(scores, ret.lexical_best(scores))
    asked = ret.query_vectors(queries, index.bucket_idf, index.corpus)
    hits = materialise(ret.vector_top_k(index.vectors, asked, 8))
    final = materialise(ret.finalists(ret.scored_candidates(lexical, hits, incidents, sides), top_k=4))
    plain = ret.keep_candidates(final, top_k=4)
    witnesses = ret.signal_witnesses(final, plain)
    want = sorted([(r.query_id, r.doc_id, r.score) for r in plain.collect()] + [(r.query_id, r.doc_id, r.score) for r in witnesses.collect()])
    assert sorted((r.query_id, r.doc_id, r.score) for r in kept.collect()) == want
    assert witnesses.count() > 5
    short, _ = ret.retrieve(index, queries, incidents, sides, top_k=4, oversample=2)
    assert sorted((r.query_id, r.doc_id, r.score) for r in short.collect()) == want
    n = {r.query_id: r.candidate_count for r in stats.collect()}
    pairs = scores.select("query_id", "doc_id").unionByName(hits.select("query_id", "doc_id")).distinct()
    assert n == {r.query_id: r["count"] for r in pairs.groupBy("query_id").count().collect()}


def clustered(rng, centres, n, width, noise):
    out = []
    for i in range(n):
        v = centres[i % len(centres)] + rng.normal(size=width) * noise
        out.append((i, list(range(width)), (v * rng.uniform(0.2, 3) if i % 50 == 0 else v / np.linalg.norm(v)).tolist()))
    return out


@pytest.mark.parametrize("noise", [0.02, 1.0])
def test_vector_search_visits_few_groups_and_misses_nothing(spark, noise):
    rng = np.random.default_rng(3)
    rows = clustered(rng, rng.normal(size=(12, 16)), 1500, 16, noise)
    rows += [(5000 + i, rows[7][1], rows[7][2]) for i in range(300)] + [(9000, [], []), (9001, [40], [2.0])]
    vectors = spark.createDataFrame(rows, "doc_id int, buckets array<int>, weights array<double>")
    queries = vectors.filter("doc_id % 97 = 0 or doc_id > 8000").withColumnRenamed("doc_id", "query_id")
    index = build_vector_index(vectors, rows_per_group=60, part_rows=50, plain_rows=0)
    got = {}
    for r in search(index, queries, 5).collect():
        got.setdefault(r.query_id, []).append((-r.similarity, r.doc_id))
    dense = np.zeros((len(rows), 41))
    for at, (_, b, w) in enumerate(rows):
        dense[at, b] = w
    ids = [r[0] for r in rows]
    for q, found in got.items():
        scores = np.round(dense @ dense[ids.index(q)], 9)
        assert [d for _, d in sorted(found)] == [d for _, d in sorted(zip((-scores).tolist(), ids))[:5]]
    assert len(got) == queries.count()
    assert index.parts.groupBy("group").count().agg(F.max("count")).first()[0] > 4  # copies are split
    kth = spark.createDataFrame([(q, -max(f)[0]) for q, f in got.items()], "query_id int, threshold double")
    n = planned_visits(index, queries, 5).count() + planned_visits(index, queries, 5, thresholds=kth).count()
    every = index.groups.count() * queries.count()
    plain = search(build_vector_index(vectors, part_rows=50), queries, 5).collect()
    assert sorted((r.query_id, -r.similarity, r.doc_id) for r in plain) == sorted((q, s, d) for q, f in got.items() for s, d in f)
    assert n <= every if noise > 0.5 else 4 * n < every


def test_vector_search_of_little(spark):
    schema = "doc_id int, buckets array<int>, weights array<double>"
    none, one = spark.createDataFrame([], schema), spark.createDataFrame([(1, [0], [1.0])], schema)
    queries = lambda d: d.withColumnRenamed("doc_id", "query_id")
    for plain in (0, 9):
        index = lambda d: build_vector_index(d, plain_rows=plain)  # noqa: B023, E731
        assert search(index(none), queries(one), 3).count() == 0
        assert search(index(one), queries(none), 3).count() == 0
        assert [tuple(r)[:3] for r in search(index(one), queries(one), 3).collect()] == [(1, 1, 1.0)]
