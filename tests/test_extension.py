"""Caller-supplied embeddings, vector search and readers."""

from pyspark.sql import functions as F

from gapengine.operators.index import build_index
from gapengine.operators.retrieve import retrieve, vector_top_k
from gapengine.sources.files import file_kind, read_catalogue


def test_own_embedding_and_search(spark):
    def embed(texts):
        key = texts.columns[0]
        return texts.select(key, F.array(F.length("text") % 5).alias("buckets"), F.array(F.lit(1.0)).alias("weights"))

    asked = []

    def search(vectors, queries, k, key):
        asked.append(k)
        return vector_top_k(vectors, queries, k, key, part=4)

    docs = spark.createDataFrame([(f"d{i}", "w" * (i + 2) + " common", "f") for i in range(12)], "doc_id string, text string, feature string")
    index = build_index(docs, embed=embed)
    assert {r.doc_id: r.buckets[0] for r in index.vectors.collect()} == {f"d{i}": (i + 9) % 5 for i in range(12)}
    queries = spark.createDataFrame([(i, "q" * i + " common") for i in range(7)], "query_id int, text string")
    empty = "array<string>"
    incidents = queries.select("query_id", F.lit("f").alias("i_feature"), *[F.array().cast(empty).alias(c) for c in ("i_keys", "i_signals")])
    sides = docs.select("doc_id", F.lit("f").alias("t_feature"), *[F.array().cast(empty).alias(c) for c in ("t_keys", "t_signals")])
    kept, _ = retrieve(index, queries, incidents, sides, top_k=2, search=search, embed=embed, oversample=3)
    assert asked == [6] and {r.query_id for r in kept.collect()} == set(range(7))


def test_vector_blocks_do_not_change_results(spark):
    import random

    rng = random.Random(1)
    rows = [(i, sorted(rng.sample(range(40), 6)), [rng.choice([0.5, 1.0]) for _ in range(6)]) for i in range(200)]
    vectors = spark.createDataFrame(rows, "doc_id int, buckets array<int>, weights array<double>")
    queries = vectors.filter("doc_id < 50").withColumnRenamed("doc_id", "query_id")
    whole = sorted(map(tuple, vector_top_k(vectors, queries, 4).collect()))
    assert whole == sorted(map(tuple, vector_top_k(vectors, queries, 4, part=7).collect())) and len(whole) == 200
    dense = {i: dict(zip(b, w)) for i, b, w in rows}
    for q in range(5):
        sims = sorted(((-round(sum(w * dense[d].get(b, 0) for b, w in dense[q].items()), 9), d) for d in dense))[:4]
        assert [(r[1], r[2]) for r in sorted((x for x in whole if x[0] == q), key=lambda x: x[3])] == [(d, -s) for s, d in sims]


def test_own_reader(spark):
    files = spark.createDataFrame([("a/notes.list", 9, bytearray(b"one\ntwo"))], "path string, length bigint, content binary")
    kinds = lambda path: F.when(path.endswith(".list"), F.lit("list")).otherwise(file_kind(path))

    def read(found):
        lines = found.select(F.col("source"), F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("seq", "name"))
        tests = lines.select(F.col("name").alias("test_id"), F.col("seq").cast("bigint").alias("seq"), "name", "source")
        return tests, found.select(F.col("source").alias("location"), F.lit("r").alias("reason"), F.lit("ERROR").alias("severity")).limit(0)

    tests, issues = read_catalogue(files, F.lit(1).cast("bigint"), kinds=kinds, readers={"list": read})
    assert {r.test_id for r in tests.collect()} == {"one", "two"} and issues.count() == 0
