"""Retrieval tables kept in segments, one for each source.

Numbers of documents, lengths and document frequencies add up over segments, so
a source that is deleted drops out of the sums and one that is loaded again
replaces its own part; no other text is split into terms again.

A load writes files of its own under a new version and names its segments in the
manifest last: a load that is lost half-way changes nothing, and a reader sees a
segment's old rows until the new ones are complete.  One writer at a time.  The
keys of documents are unique over all sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gapengine.operators.index import bucket_weights_of, doc_terms, raw_buckets, term_weights_of, weighted_features

C = F.col
MANIFEST = "segment string, version bigint, n_docs bigint, n_tokens bigint, live boolean"
TABLES = ("postings", "term_counts", "buckets", "bucket_counts")


def create_segments(spark: SparkSession, path: str) -> None:
    """An index without segments."""
    spark.createDataFrame([], MANIFEST).write.parquet(f"{path}/manifest")


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def _next_version(spark: SparkSession, path: str) -> int:
    return _manifest(spark, path).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0] + 1


def live_segments(spark: SparkSession, path: str) -> DataFrame:
    """(segment, version, n_docs, n_tokens): the newest version of every segment that was not dropped."""
    newest = _manifest(spark, path).groupBy("segment").agg(
        F.max("version").alias("version"), F.max_by(F.struct("n_docs", "n_tokens", "live"), "version").alias("_m")
    )
    return newest.filter("_m.live").select("segment", "version", "_m.n_docs", "_m.n_tokens")


def load_segments(docs: DataFrame, path: str) -> None:
    """Add the segments of ``docs`` (segment, doc_id, text), or replace them where they exist.

    A null segment is a segment like others.  One that has no documents any more
    isn't in ``docs``; drop it.
    """
    spark = docs.sparkSession
    version = _next_version(spark, path)
    keyed = docs.select(F.struct("segment", "doc_id").alias("key"), "text")
    plain = ["key.segment", "key.doc_id"]

    def write(table: DataFrame, name: str) -> DataFrame:
        folder = f"{path}/{name}/version={version}"
        table.write.mode("overwrite").parquet(folder)
        return spark.read.schema(table.schema).parquet(folder)

    terms = write(doc_terms(keyed, "key").select(*plain, "term", "tf", "doc_length"), "postings")
    write(terms.groupBy("segment", "term").agg(F.count(F.lit(1)).alias("df")), "term_counts")
    buckets = write(raw_buckets(weighted_features(keyed, "key"), "key").select(*plain, "bucket", "raw"), "buckets")
    write(buckets.groupBy("segment", "bucket").agg(F.count(F.lit(1)).alias("df")), "bucket_counts")
    sizes = docs.select("segment", F.lit(1).alias("n_docs"), F.lit(0).alias("n_tokens")).unionByName(
        terms.select("segment", F.lit(0).alias("n_docs"), C("tf").alias("n_tokens")))
    sizes = sizes.groupBy("segment").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    _name(sizes, path, version, live=True)


def _name(segments: DataFrame, path: str, version: int, live: bool) -> None:
    rows = segments.select(
        C("segment").cast("string"), F.lit(version).cast("bigint").alias("version"), C("n_docs").cast("bigint"), C("n_tokens").cast("bigint"),
        F.lit(live).alias("live"))
    rows.coalesce(1).write.mode("append").parquet(f"{path}/manifest")  # one file is there whole or not at all


def drop_segments(gone: DataFrame, path: str) -> None:
    """Delete the segments named by ``gone`` (segment); others, and unknown names, are left alone."""
    spark = gone.sparkSession
    names = gone.select(C("segment").alias("_gone")).distinct()
    live = live_segments(spark, path).join(names, C("segment").eqNullSafe(C("_gone")), "left_semi")
    _name(live, path, _next_version(spark, path), live=False)


def live_rows(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table's rows of live segments; folders of versions that none needs are not read."""
    live = live_segments(spark, path).select(C("segment").alias("_segment"), C("version").alias("_version"))
    return spark.read.parquet(f"{path}/{name}").join(
        live, C("segment").eqNullSafe(C("_segment")) & (C("version") == C("_version")), "left_semi"
    ).drop("version")


def segment_corpus(spark: SparkSession, path: str) -> DataFrame:
    """AGG-1: number of documents and average length, from the manifest alone."""
    n = F.coalesce(F.sum("n_docs"), F.lit(0))
    return live_segments(spark, path).agg(n.alias("n_docs"), (F.coalesce(F.sum("n_tokens"), F.lit(0)) / F.greatest(n, F.lit(1))).alias("avg_length"))


def segment_terms(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings, corpus row and term statistics, as of an index built anew."""
    corpus = segment_corpus(spark, path)
    counts = live_rows(spark, path, "term_counts").groupBy("term").agg(F.sum("df").alias("df"))
    return live_rows(spark, path, "postings").drop("segment"), corpus, term_weights_of(counts, corpus)


def segment_buckets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Bucket sums of every document, and the idf of every bucket."""
    counts = live_rows(spark, path, "bucket_counts").groupBy("bucket").agg(F.sum("df").alias("df"))
    return live_rows(spark, path, "buckets").drop("segment"), bucket_weights_of(counts, segment_corpus(spark, path))


def compact_segments(spark: SparkSession, path: str) -> None:
    """All live rows under one new version, so that many small loads read like a single one."""
    version = _next_version(spark, path)
    for name in TABLES:
        live_rows(spark, path, name).write.mode("overwrite").parquet(f"{path}/{name}/version={version}")
    _name(live_segments(spark, path), path, version, live=True)
