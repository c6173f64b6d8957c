"""Words counted slice by slice, and searches that meet texts and vectors where they are: the same results for less work."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gapengine.functions.text import tokens
from gapengine.operators import counting as ct, index as ix, retrieve as ret, scan as sc, vectors as vec
from gapengine.operators.sizing import materialise

ODD = [
    "", None, "...", ". .5 5. a. .a b", "camelCaseHTML5Thing aB1C é́Éx áB aB́ x̀Y", "it's 50% -5 a-5 x_y __ non-ascii", "Kelvin K İstanbul ﬁne ½ ١٢",
    "the and of", "a a a a", "cart checkout null timeout order cart order", "日本語 text", "\x00a\x00b", "emoji😀x", "A", "9", "%", "%%", "1.5.", "..x..y..", "ab" * 500,
]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(1)
    letters = ["a", "B", "é", "É", "́", ".", "..", " ", "-", "_", "%", "7", "ß", "K", "cart ", " retry", " the ", "\n", "Ω", "x", "y"]
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, "".join(rng.choice(letters) for _ in range(rng.randrange(200)))) for i in range(400)]
    rows += [(1000 + i, " ".join(f"a{c}b A{c}B x{c} {c}y {c}" for c in map(chr, range(i, i + 64)))) for i in range(0, 0x3000, 64)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_counted_words_equal_split_ones(texts, monkeypatch):
    monkeypatch.setattr(ct, "SLICE_CHARS", 700)
    counted = materialise(ct.counted_texts(texts.repartition(3, "doc_id")))
    rows = lambda df: sorted(map(tuple, df.collect()))
    got = counted.select("doc_id", F.inline(F.arrays_zip("terms", "tfs")), "doc_length")
    assert rows(got) == rows(ix.doc_terms(texts).select("doc_id", "term", "tf", "doc_length"))
    assert rows(counted.select("doc_id", "doc_length")) == rows(texts.select("doc_id", F.size(tokens(F.col("text"))).cast("bigint")))
    # Buckets of words, neighbours and borrowed synonyms.
    raw = {(r.doc_id, r.bucket): r.raw for r in ix.raw_buckets(ix.weighted_features(texts)).collect()}
    sums = {(r.doc_id, r.buckets): r.raws for r in counted.select("doc_id", F.inline(F.arrays_zip("buckets", "raws"))).collect()}
    assert sums.keys() == raw.keys() and all(abs(sums[k] - raw[k]) < 1e-9 for k in raw)


def test_texts_of_one_id_count_together(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (1, "beta gamma."), (2, None), (2, "alpha")], "doc_id int, text string")
    counted = ix.counted_docs(docs)
    got = {r.doc_id: (r.doc_length, dict(zip(r.terms, r.tfs))) for r in counted.collect()}
    assert got == {1: (4, {"alpha": 1, "beta": 2, "gamma": 1}), 2: (1, {"alpha": 1})}
    few = ix.counted_docs(docs, spark.createDataFrame([("beta",), ("nowhere",)], "term string")).collect()
    assert {r.doc_id: (r.doc_length, r.terms, r.tfs) for r in few} == {1: (4, ["beta"], [2]), 2: (1, [], [])}


def test_index_from_lists_equals_the_plain_one(texts):
    docs = texts.withColumn("feature", F.lit("A"))
    index = ix.build_index(docs, learn=False)
    terms, corpus, stats = ix.lexical_index(docs)
    buckets = materialise(ix.raw_buckets(ix.weighted_features(docs)))
    vectors = ix.packed_vectors(ix.weighted_vectors(buckets, ix.bucket_idf(buckets, corpus), corpus))
    for a, b in ((index.doc_terms, terms), (index.corpus, corpus), (index.term_stats, stats)):
        assert a.exceptAll(b.select(a.columns)).count() == b.select(a.columns).exceptAll(a).count() == 0
    want = {r.doc_id: (r.buckets, r.weights) for r in vectors.collect()}
    got = {r.doc_id: (r.buckets, r.weights) for r in index.vectors.collect()}
    assert got.keys() == want.keys() and all(got[d][0] == want[d][0] and np.allclose(got[d][1], want[d][1], atol=1e-12) for d in want)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 900}"
    docs = [(i, " ".join(word() for _ in range(rng.randrange(3, 60))), ["A", "B"][i % 2]) for i in range(900)]
    docs += [(2000 + i, docs[5][1], "A") for i in range(40)] + [(3000, "", "A"), (3001, None, "B")]
    queries = [(i, docs[i * 7][1] if i % 3 == 0 else " ".join(word() for _ in range(rng.randrange(1, 12)))) for i in range(40)]
    queries += [(90, ""), (91, "nowhere"), (92, docs[5][1]), (93, "checkout discount " + docs[9][1])]
    return spark.createDataFrame(docs, "doc_id int, text string, feature string"), spark.createDataFrame(queries, "query_id int, text string")


def test_texts_scored_in_place_give_the_same_candidates(corpus, monkeypatch):
    docs, queries = corpus
    monkeypatch.setattr(sc, "SCORES", 10_000)
    monkeypatch.setattr(sc, "PARTS", 5_000)
    counted = ix.counted_docs(docs, ret.query_terms(queries))
    index = ix.build_index(docs, learn=False, counted=counted)
    words = materialise(ret.query_terms(queries))
    full = {(r.query_id, r.doc_id): r.bm25 for r in ret.bm25_scores(index.doc_terms, index.term_stats, index.corpus, words).collect()}
    asked = sc.asked_words(words, index.term_stats, index.corpus)
    best = sc.best_listed(counted, asked, words, 3).collect()
    assert 2 * len(best) < len(full) and all(abs(full[r.query_id, r.doc_id] - r.bm25) < 1e-9 for r in best)
    # What leaves the tasks holds the three best, and above a threshold everything.
    third = {}
    for q in {q for q, _ in full}:
        scores = sorted((s for (p, _), s in full.items() if p == q), reverse=True)
        third[q] = scores[min(2, len(scores) - 1)]
        assert np.allclose(sorted((r.bm25 for r in best if r.query_id == q), reverse=True)[:3], scores[:3])
    above = sc.listed_above(counted, asked, words, docs.sparkSession.createDataFrame(list(third.items()), "query_id int, threshold double"))
    assert {(r.query_id, r.doc_id) for r in above.collect()} == {p for p, s in full.items() if s >= third[p[0]] - 1e-9}
    pairs = docs.sparkSession.createDataFrame([p for i, p in enumerate(sorted(full)) if i % 7 == 0] + [(91, 5), (0, 3001)], "query_id int, doc_id int")
    assert {(r.query_id, r.doc_id) for r in sc.listed_pairs(counted, asked, words, pairs).collect()} == set(sorted(full)[::7])
    # End to end, with signals and keys.
    pick = lambda c, n: F.when(c % n == 0, F.array(F.lit("retry"))).when(c % n == 1, F.array(F.lit("null"), F.lit("retry"))).otherwise(F.array().cast("array<string>"))
    keys = lambda c: F.when(c % 4 == 0, F.array(F.lit("k"))).otherwise(F.array().cast("array<string>"))
    incidents = queries.select("query_id", F.when(F.col("query_id") % 5 == 0, "").otherwise("A").alias("i_feature"), keys(F.col("query_id")).alias("i_keys"), pick(F.col("query_id"), 3).alias("i_signals"))
    sides = docs.select("doc_id", F.col("feature").alias("t_feature"), keys(F.col("doc_id")).alias("t_keys"), pick(F.col("doc_id"), 40).alias("t_signals"))
    found = lambda **how: sorted((r.query_id, r.doc_id, r.score, r.rank_key) for r in ret.retrieve(index, queries, incidents, sides, top_k=4, oversample=2, **how)[0].collect())
    plain = found()
    assert found(plain_postings=0, lists=counted) == plain and len(plain) > 100
    assert sc.asked_words(words, index.term_stats, index.corpus, rows=10) is None  # more than a task may hold: through blocks


def test_hybrid_splits_no_text_by_pattern(spark, monkeypatch):
    from gapengine.plans import queries as q

    asked = []
    explode = ix.explode_tokens
    monkeypatch.setattr(ix, "explode_tokens", lambda df, key, *a: asked.append(key) or explode(df, key, *a))
    monkeypatch.setattr(q.ix, "doc_terms", None)
    assert q.hybrid_candidates_by_bounds(spark, "/root/testdata/sf0.001").count() > 0
    assert asked.count("doc_id") <= 1  # the vocabulary's, of no text


@pytest.mark.parametrize("k", [1, 5, 400])
def test_few_queries_meet_every_vector(spark, k, monkeypatch):
    monkeypatch.setattr(vec, "PART_ROWS", 100)
    rng = np.random.default_rng(3)
    rows = [(f"d{i}", sorted(rng.choice(40, 6, replace=False).tolist()), rng.normal(size=6).tolist()) for i in range(1200)]
    rows += [(f"e{i}", rows[7][1], rows[7][2]) for i in range(300)] + [("z", [], []), ("y", [60], [2.0])]
    vectors = spark.createDataFrame(rows, "doc_id string, buckets array<int>, weights array<double>").repartition(3)
    queries = vectors.filter("doc_id in ('d7', 'd8', 'd999', 'z', 'y')").withColumnRenamed("doc_id", "query_id")
    found = lambda df: sorted((r.query_id, r["rank"], r.doc_id, r.similarity) for r in df.collect())
    got = vec.scan(vectors, queries, k)
    assert found(got) == found(vec.search(vec.build_vector_index(vectors, part_rows=50), queries, k))
    assert found(ret.vector_top_k(vectors, queries, k).select(*got.columns)) == found(got)
    assert vec.scan(vectors, queries.limit(0), k).count() == 0 and vec.scan(vectors.limit(0), queries, k).count() == 0


def test_long_features_hash_like_short_ones():
    import hashlib

    features = ["", "a", "a_b", "x" * 55, "x" * 56, "y" * 300, *[f"w{i}_v{i}" for i in range(500)]]
    bucket, sign = ct._hashed(pa.array(features), 512)
    for f, b, s in zip(features, bucket, sign):
        digest = hashlib.md5(f.encode()).hexdigest()
        assert b == int(digest[:15], 16) % 512 and s == (1.0 if digest[15] >= "8" else -1.0)
