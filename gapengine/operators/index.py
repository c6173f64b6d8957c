"""Catalogue index: lexical statistics, hashed TF-IDF vectors, feature vocabulary.

Documents are spread by their own key once; counting a document's terms,
weighting its features and building its vector then all happen where the
document is, and only statistics (one row per term, bucket or feature word) are
shuffled, after map-side combining.
"""

from __future__ import annotations

from collections.abc import Callable

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gapengine import fixed
from gapengine.functions.extract import exercised_signals, no_pairs, test_text
from gapengine.operators.counting import counted_texts
from gapengine.operators.impact import impact_blocks
from gapengine.operators.sizing import BROADCAST_ROWS, blocks_for, materialise
from gapengine.functions.text import explode_tokens, let, synonym_map, strings


class Index(NamedTuple):
    """The retrieval tables (SNK-11).  ``doc_id`` is the test key."""

    doc_terms: DataFrame    # doc_id, term, tf, doc_length
    term_stats: DataFrame   # term, df, idf, share, is_distinctive
    corpus: DataFrame       # one row: n_docs, avg_length
    vectors: DataFrame      # doc_id, buckets ARRAY<INT>, weights ARRAY<DOUBLE>
    bucket_idf: DataFrame   # bucket, idf
    vocabulary: DataFrame   # feature, term, weight
    feature_counts: DataFrame  # feature, n_tests
    blocks: DataFrame       # term, level, block, n_blocks, highest, n, rows ARRAY<STRUCT<impact, doc_id>>


# ------------------------------------------------------------------- lexical half


# Text of one task.  Its terms and neighbours take up to some 120 times as much memory while they are counted.
TASK_BYTES = 2_000_000
# Bucket sums of one task.
TASK_ROWS = 2_000_000
# Text of a task that counts slice by slice.
SLICED_BYTES = 8_000_000


def by_document(docs: DataFrame, key: str = "doc_id", text: str = "text", task_bytes: int = TASK_BYTES) -> DataFrame:
    """Documents spread by key over as many tasks as their text asks for.

    The number is named because adaptive execution merges small partitions by their bytes and doesn't know
    what their terms will take."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    if size <= task_bytes:
        return docs.repartition(key)
    return docs.repartition(max(blocks_for(size, task_bytes), docs.sparkSession.sparkContext.defaultParallelism), key)


def doc_terms(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """AGG-1: term frequencies and document length.

    Spreading the documents first lets both counts finish locally: no posting
    crosses the network, and no term gathers its documents anywhere.
    """
    counts = explode_tokens(by_document(docs, key, text), key, text).groupBy(key, "term").agg(
        F.count(F.lit(1)).alias("tf")
    )
    length = F.sum("tf").over(Window.partitionBy(key))
    return counts.withColumn("doc_length", length)


def corpus_stats(docs: DataFrame, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """AGG-1: number of documents and average length, token-less documents included."""
    total = terms.agg(F.sum("tf").alias("n_tokens"))
    return docs.agg(F.count(F.lit(1)).alias("n_docs")).join(F.broadcast(total)).select(  # one row each
        "n_docs", (F.coalesce("n_tokens", F.lit(0)) / F.greatest("n_docs", F.lit(1))).alias("avg_length")
    )


def term_stats(terms: DataFrame, corpus: DataFrame) -> DataFrame:
    """AGG-1/AGG-3/FLT-6: document frequency, idf, share, distinctiveness.

    A term is distinctive when at most 2 % of the documents (or one document)
    hold it; a term in every document never is."""
    return term_weights_of(terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")), corpus)


def term_weights_of(counts: DataFrame, corpus: DataFrame) -> DataFrame:
    """The same from document frequencies ``(term, df)``."""
    n = F.col("n_docs")
    share = F.col("df") / n
    return (
        counts.join(F.broadcast(corpus.select("n_docs")))  # one row
        .select(
            "term",
            "df",
            F.log(1.0 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"),
            share.alias("share"),
            ((share < 1.0) & (share <= F.greatest(F.lit(fixed.DISTINCTIVE_SHARE), 1.0 / n))).alias("is_distinctive"),
        )
    )


def lexical_index(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings, corpus row and term statistics, texts split once."""
    terms = materialise(doc_terms(docs))
    corpus = materialise(corpus_stats(docs, terms))
    return terms, corpus, materialise(term_stats(terms, corpus))


# -------------------------------------------------------------------- vector half


def bucket_of(feature: Column, dimensions: int = fixed.VECTOR_DIMENSIONS) -> Column:
    """AGG-5: hash bucket of a feature; any stable hash serves, this one reads the
    same in SQL engines that know md5."""
    return F.pmod(F.conv(F.substring(F.md5(feature), 1, 15), 16, 10).cast("bigint"), F.lit(dimensions)).cast("int")


def sign_of(feature: Column) -> Column:
    return F.when(F.substring(F.md5(feature), 16, 1) >= "8", F.lit(1.0)).otherwise(F.lit(-1.0))


def synonyms_table(df: DataFrame) -> DataFrame:
    """(term, synonym) rows of the fixed synonym list, derived beside ``df``."""
    heads = list(fixed.SYNONYMS)
    return df.sparkSession.range(1).select(
        F.explode(strings(heads)).alias("term")
    ).select("term", F.explode(F.element_at(synonym_map(), F.col("term"))).alias("synonym"))


def weighted_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """AGG-4: ``(key, feature, count)``: words 1.0 each, neighbours 0.7 each, and
    0.4 once for a synonym the text does not hold by itself."""
    ordered = Window.partitionBy(key).orderBy("pos")
    terms = explode_tokens(by_document(docs, key, text), key, text).withColumn("next", F.lead("term").over(ordered))
    related = F.when(
        F.col("term").isin(list(fixed.SYNONYMS)), F.try_element_at(synonym_map(), F.col("term"))
    )
    word = lambda c: F.struct(c.alias("feature"), F.lit(fixed.UNIGRAM_WEIGHT).alias("w"), F.lit(0.0).alias("s"))
    gram = F.struct(
        F.concat_ws("_", "term", "next").alias("feature"), F.lit(fixed.BIGRAM_WEIGHT).alias("w"), F.lit(0.0).alias("s")
    )
    syn = F.transform(
        F.coalesce(related, strings([])),
        lambda t: F.struct(t.alias("feature"), F.lit(0.0).alias("w"), F.lit(fixed.SYNONYM_WEIGHT).alias("s")),
    )
    pieces = F.concat(
        F.array(word(F.col("term"))), F.when(F.col("next").isNotNull(), F.array(gram)).otherwise(F.filter(syn, lambda s: F.lit(False))), syn
    )
    return (
        terms.select(key, F.explode(pieces).alias("p"))
        .groupBy(key, F.col("p.feature").alias("feature"))
        .agg(F.sum("p.w").alias("own"), F.max("p.s").alias("borrowed"))
        .select(key, "feature", F.when(F.col("own") > 0, F.col("own")).otherwise(F.col("borrowed")).alias("count"))
    )


def raw_buckets(features: DataFrame, key: str = "doc_id", dimensions: int = fixed.VECTOR_DIMENSIONS) -> DataFrame:
    """AGG-5: signed, sublinear bucket sums, touched buckets only."""
    damped = F.when(F.col("count") > 1, 1.0 + F.log("count")).otherwise(F.col("count"))
    return features.groupBy(key, bucket_of(F.col("feature"), dimensions).alias("bucket")).agg(
        F.sum(sign_of(F.col("feature")) * damped).alias("raw")
    )


def bucket_idf(buckets: DataFrame, corpus: DataFrame) -> DataFrame:
    """AGG-6: smoothed idf; at most ``dimensions`` rows, however large the catalogue."""
    return bucket_weights_of(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("df")), corpus)


def bucket_weights_of(counts: DataFrame, corpus: DataFrame) -> DataFrame:
    """The same from document frequencies ``(bucket, df)``."""
    return counts.join(F.broadcast(corpus.select("n_docs"))).select(  # one row
        "bucket", (F.log((F.col("n_docs") + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf")
    )


def weighted_vectors(buckets: DataFrame, idf: DataFrame, corpus: DataFrame, key: str = "doc_id") -> DataFrame:
    """AGG-6: L2-normalised sparse vectors as rows.  A bucket no catalogue test
    touches has document frequency 0, so its idf is the one of an empty bucket.
    ``buckets`` are counted first: rows of one task are sorted there."""
    n = blocks_for(buckets.count(), TASK_ROWS)
    buckets = buckets.repartition(n, key) if n > 1 else buckets
    weighted = (
        buckets.join(F.broadcast(idf), "bucket", "left")  # bounded by the vector dimension
        .join(F.broadcast(corpus.select((F.log(F.col("n_docs") + 1.0) + 1.0).alias("unseen"))))  # one row
        .withColumn("w", F.col("raw") * F.coalesce("idf", "unseen"))
    )
    norm = F.greatest(F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key))), F.lit(1e-12))
    return weighted.select(key, "bucket", (F.col("w") / norm).alias("w"))


def packed_vectors(weighted: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document; a document has at most ``dimensions`` buckets."""
    return weighted.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("bucket", "w"))).alias("v")).select(
        key, F.col("v.bucket").alias("buckets"), F.col("v.w").alias("weights")
    )


def vectors_of(counted: DataFrame, idf: DataFrame, corpus: DataFrame, key: str = "doc_id", dimensions: int = fixed.VECTOR_DIMENSIONS) -> DataFrame:
    """AGG-6: the same from the lists of ``counted_texts``, where they are."""
    places = idf.sparkSession.range(dimensions).select(F.col("id").cast("int").alias("bucket"))
    weights = places.join(idf, "bucket", "left").agg(F.array_sort(F.collect_list(F.struct("bucket", "idf"))).alias("idf")).select("idf.idf")
    one = weights.join(F.broadcast(corpus.select((F.log(F.col("n_docs") + 1.0) + 1.0).alias("unseen"))))  # one row each
    weighted = F.zip_with("buckets", "raws", lambda b, r: r * F.coalesce(F.get(F.col("idf"), b), F.col("unseen")))
    norm = lambda w: F.greatest(F.sqrt(F.aggregate(w, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-12))
    return counted.filter(F.size("buckets") > 0).join(F.broadcast(one)).select(
        key, "buckets", let(weighted, lambda w: let(norm(w), lambda n: F.transform(w, lambda x: x / n))).alias("weights")
    )


# --------------------------------------------------------------------- vocabulary


def _named(tests: DataFrame, feature: str = "feature") -> DataFrame:
    return tests.withColumn(feature, F.trim(feature)).filter((F.col(feature) != "") & (F.col(feature) != "Unknown"))


def feature_words(tests: DataFrame, feature: str = "feature", text: str = "text", key: str = "doc_id") -> DataFrame:
    """AGG-7 input: tokens of tests whose feature is known."""
    named = _named(tests.select(key, F.col(feature).alias("feature"), text))
    return explode_tokens(by_document(named, key, text), key, text, "feature").select(key, "feature", "term")


def counted_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, feature, term, n): how often each text holds a word; counted where the text is."""
    return explode_tokens(by_document(docs, key, text), key, text, "feature").groupBy(key, "feature", "term").agg(F.count(F.lit(1)).alias("n"))


def with_feature_names(words: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """AGG-7 input: ``counted_words`` of ``docs`` whose feature is known, and the words of its name as if they stood in the text."""
    names = docs.select(key, "feature", F.col("feature").alias("name"))
    own = explode_tokens(_named(names), key, "name", "feature").select(key, "feature", "term", F.lit(1).cast("bigint").alias("n"))
    return _named(words).unionByName(own)


def vocabulary(words: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """AGG-7: words characteristic of each feature by lift, and tests per feature.

    All counts combine map-side; after them only (feature, word) rows remain.
    The 40 best words per feature are cut before rows of one feature meet.
    ``words`` that have a count ``n`` are taken as they are.
    """
    per_test = words if "n" in words.columns else materialise(words.groupBy(key, "feature", "term").agg(F.count(F.lit(1)).alias("n")))
    tests = per_test.select(key, "feature").distinct().groupBy("feature").agg(F.count(F.lit(1)).alias("n_tests"))
    pairs = materialise(per_test.groupBy("feature", "term").agg(F.sum("n").alias("n")))
    per_feature = pairs.groupBy("feature").agg(F.sum("n").alias("feature_total"))
    per_term = pairs.groupBy("term").agg(F.sum("n").alias("term_total"))
    total = pairs.agg(F.sum("n").alias("total"))
    trusted = tests.filter(F.col("n_tests") >= fixed.VOCABULARY_MIN_TESTS)
    scored = (
        pairs.join(per_term, "term")
        .join(per_feature.join(trusted.select("feature"), "feature"), "feature")
        .join(F.broadcast(total))  # one row
        .withColumn("lift", (F.col("n") / F.col("feature_total")) / (F.col("term_total") / F.col("total")))
        .filter(F.col("lift") >= fixed.VOCABULARY_MIN_LIFT)
        # Rounded so that equal scores stay equal whatever the engine, and ties go by name.
        .withColumn("raw", F.round(F.log1p("n") * F.col("lift"), 9))
    )
    best_first = Window.partitionBy("feature").orderBy(F.desc("raw"), "term")
    kept = scored.withColumn("place", F.row_number().over(best_first)).filter(
        F.col("place") <= fixed.VOCABULARY_MAX_TERMS
    )
    highest = F.max("raw").over(Window.partitionBy("feature"))
    weights = kept.select("feature", "term", F.round(F.col("raw") / highest, 4).alias("weight"))
    counts = trusted.join(weights.select("feature").distinct(), "feature")
    return weights, counts


def classify(
    items: DataFrame, weights: DataFrame, counts: DataFrame, key: str = "doc_id", text: str = "text",
    default: str = fixed.UNKNOWN, words: DataFrame | None = None,
) -> DataFrame:
    """AGG-8: the best-scoring feature of each text: ``(key, feature, score)``.

    The vocabulary holds at most 40 words per feature; it is broadcast when that
    is small and shuffled by word otherwise.  ``words``: (key, term) already split.
    """
    weights, counts = materialise(weights), materialise(counts)
    if words is None:
        words = explode_tokens(by_document(items, key, text), key, text).select(key, "term")
    # Only words of the vocabulary are told apart by text: the others don't leave their task.
    scores = (
        words.select(key, "term").join(weights, "term").select(key, "feature", "term", "weight").distinct()
        .groupBy(key, "feature").agg(F.round(F.sum("weight"), 6).alias("score"))
        .filter("score > 0")
    )
    ranked = scores.join(counts, "feature").groupBy(key).agg(
        F.max(F.struct("score", "n_tests", "feature")).alias("best")
    )
    return items.select(key).join(ranked, key, "left").select(
        key,
        F.coalesce("best.feature", F.lit(default)).alias("feature"),
        F.coalesce("best.score", F.lit(0.0)).alias("score"),
    )


# -------------------------------------------------------------------- whole index


def searchable_tests(tests: DataFrame) -> DataFrame:
    """FLT-7/TXT-21: the metadata text of every test under its unique key."""
    return tests.select(
        "doc_id",
        "feature",
        test_text(
            *[F.coalesce(F.col(c), F.lit("")) for c in ("name", "feature", "scenario", "expected_behavior")],
            F.coalesce("tags", strings([])), F.coalesce("inputs", no_pairs()), F.coalesce("assertions", strings([])),
        ).alias("text"),
        F.concat_ws(" ", "name", "scenario", "feature").alias("vocabulary_text"),
    )


def with_index_signals(tests: DataFrame) -> DataFrame:
    """AGG-24: signals are derived anew from name, scenario and inputs."""
    return tests.withColumn(
        "signals", exercised_signals(F.col("name"), F.col("scenario"), F.coalesce("inputs", no_pairs()))
    )


def counted_docs(docs: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Every text's counted words and features, worked out once: what ``build_index`` starts from.

    Where all queries are known, ``asked`` (term) names their words: other words can't change a result and aren't
    listed, unless the words asked for are more than a task can hold."""
    only = None
    if asked is not None:
        asked = materialise(asked.select("term").distinct())
        only = pa.array([r.term for r in asked.collect()], pa.string()) if asked.count() <= BROADCAST_ROWS else None
    return materialise(counted_texts(by_document(docs.select("doc_id", "text"), task_bytes=SLICED_BYTES), only=only))


def build_index(
    docs: DataFrame, feature: str = "feature", vocabulary_text: str = "vocabulary_text",
    embed: Callable[[DataFrame], DataFrame] | None = None, learn: bool = True, counted: DataFrame | None = None,
) -> Index:
    """AGG-24: all retrieval tables of documents ``(doc_id, text, feature)``.
    ``embed`` (UDF-2) turns (doc_id, text) into (doc_id, buckets, weights)
    instead of the hashed features.  ``blocks`` are only worked out where a search needs them.
    Without ``learn`` the vocabulary stays empty: searching doesn't need it.
    With ``counted``, what ``counted_docs`` gave for the documents, postings are read off its lists where a search needs them."""
    if vocabulary_text not in docs.columns:
        docs = docs.withColumn(vocabulary_text, F.concat_ws(" ", "text", feature))
    lists = counted_docs(docs) if counted is None else counted
    terms = lists.select("doc_id", "doc_length", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))))
    terms = terms.select("doc_id", "term", "tf", "doc_length")
    terms = materialise(terms) if counted is None else terms
    corpus = materialise(corpus_stats(docs, lists.select(F.col("doc_length").alias("tf"))))
    stats = materialise(term_stats(lists.select(F.explode("terms").alias("term")), corpus))
    idf = materialise(bucket_idf(lists.select(F.explode("buckets").alias("bucket")), corpus))
    weights, counts = vocabulary(feature_words(docs if learn else docs.limit(0), feature, vocabulary_text))
    vectors = vectors_of(lists, idf, corpus) if embed is None else embed(docs.select("doc_id", "text"))
    return Index(terms, stats, corpus, vectors, idf, weights, counts, impact_blocks(terms, stats, corpus))


SCHEMA_VERSION = 1


def save_index(index: Index, path: str) -> None:
    """SNK-11: write every table, the manifest last; a reader that finds no
    manifest, another version or other counts knows the copy is unusable."""
    for name in Index._fields:
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")
    spark = index.corpus.sparkSession
    manifest(spark, path).write.mode("overwrite").parquet(f"{path}/manifest")


def manifest(spark, path: str) -> DataFrame:
    count = lambda t, alias: spark.read.parquet(f"{path}/{t}").agg(F.count(F.lit(1)).alias(alias))
    return (
        spark.read.parquet(f"{path}/corpus").select("n_docs")
        .join(F.broadcast(count("doc_terms", "n_postings")))  # one row each
        .join(F.broadcast(count("vectors", "n_vectors")))
        .join(F.broadcast(count("feature_counts", "n_features")))
        .withColumns({"schema_version": F.lit(SCHEMA_VERSION), "dimensions": F.lit(fixed.VECTOR_DIMENSIONS)})
    )


def load_index(spark, path: str) -> Index | None:
    """SNK-11: the stored index, or None when it is stale or inconsistent."""
    from pyspark.errors import AnalysisException

    try:
        stored = spark.read.parquet(f"{path}/manifest")
        fresh = manifest(spark, path)
        same = stored.join(fresh, ["n_docs", "n_postings", "n_vectors", "n_features", "schema_version", "dimensions"])
        if same.limit(1).count() == 0:
            return None
        return Index(*[spark.read.parquet(f"{path}/{name}") for name in Index._fields])
    except AnalysisException:
        return None


def describe_index(index: Index) -> DataFrame:
    """AGG-25: test count, features most-tested first, dimensions."""
    features = index.feature_counts.agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n_tests")).alias("n"), "feature"))).alias("f")
    )
    return index.corpus.join(F.broadcast(features)).select(  # one row each
        F.col("n_docs").alias("tests"), F.col("f.feature").alias("features"),
        F.lit(fixed.VECTOR_DIMENSIONS).alias("dimensions"),
    )
