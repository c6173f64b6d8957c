"""An index kept up to date by source, and exports read in splits with the metrics of their load; with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from gapengine.operators import catalogue as cat, index as ix, retrieve as ret, segments as seg
from gapengine.operators.sizing import materialise, shared_folder
from gapengine.plans.derived import table
from gapengine.sources.tabular import read_split_exports, rows_to_tests

C = F.col
RELOADED = " reloaded catalogue entry"


def _changed_index(spark: SparkSession, sf_dir: str) -> str:
    """Documents by source; the first source is deleted, the second one loaded again with longer texts."""
    docs = table(spark, sf_dir, "documents").select(C("source").alias("segment"), "doc_id", "text")
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    seg.create_segments(spark, path)
    seg.load_segments(docs, path)
    first = docs.agg(F.min("segment").alias("segment"))
    second = docs.join(F.broadcast(first.select(C("segment").alias("_first"))), C("segment") > C("_first")).agg(F.min("segment").alias("segment"))  # one row
    seg.drop_segments(first, path)
    again = docs.join(F.broadcast(second), "segment", "left_semi").withColumn("text", F.concat("text", F.lit(RELOADED)))  # one row
    seg.load_segments(again, path)
    return path


def terms_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-16/AGG-24: term statistics after a source was deleted and another reloaded, no other text split again."""
    _, _, stats = seg.segment_terms(spark, _changed_index(spark, sf_dir))
    return stats.select("term", "df", F.round("idf", 6).alias("idf"), F.round("share", 6).alias("share"), "is_distinctive")


def bm25_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-16: the 20 best documents of each query among the sources that are left."""
    path = _changed_index(spark, sf_dir)
    seg.compact_segments(spark, path)
    terms, corpus, stats = seg.segment_terms(spark, path)
    words = materialise(ret.query_terms(table(spark, sf_dir, "benchmark").select(C("item_id").alias("query_id"), "text")))
    scores = ret.best_scores(terms, materialise(stats), materialise(corpus), words, 20)
    top = ret.best_per_query(scores.withColumn("score", F.round("bm25", 6)), 20, score="score")
    return top.select("query_id", "doc_id", "score", C("rank").cast("bigint").alias("rank"))


def buckets_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-16/AGG-6: bucket weights of the sources that are left."""
    return seg.segment_buckets(spark, _changed_index(spark, sf_dir))[1].select("bucket", F.round("idf", 6).alias("idf"))


HEADERS = ["Test ID", "Title", "Shelf", "Module", "Steps"]


def _exported(spark: SparkSession, sf_dir: str) -> str:
    """Parts as CSV text: one of each size over 45 lacks a text, sizes of 45 have a cell too many, names repeat."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    text = lambda c: F.when(C("p_size") > 45, "").otherwise(quoted(c))
    cells = [C("p_partkey").cast("string"), text(C("p_name")), C("p_size").cast("string"), text(C("p_brand")), text(C("p_type"))]
    line = F.concat_ws(",", *cells, F.when(C("p_size") == 45, F.lit("x")))
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    table(spark, sf_dir, "part").select(line.alias("value")).write.option("header", True).csv(path, quote="", escapeQuotes=False, sep="\u0001")
    return path


def load_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-1/SNK-12/SNK-13: parts exported as CSV, read in splits, stored and counted in one job."""
    rows = read_split_exports(spark, _exported(spark, sf_dir), HEADERS, names="*.csv")
    to_tests = lambda r: rows_to_tests(r).withColumn("source_id", F.lit(1).cast("bigint"))
    found = cat.ingest_in_one_pass(rows, to_tests, f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}")
    order = ["scanned", "issues", "skipped", "discovered", "duplicates", "stored"]
    return spark.createDataFrame([[found[k] for k in order]], ", ".join(f"{k} bigint" for k in order))


QUERIES = [terms_after_changes, bm25_after_changes, buckets_after_changes, load_metrics]


def oracles(terms: str, words: str, vectors: str) -> dict[str, str]:
    """SQL over the documents that are left, from the same parts as the index built at once."""
    first = "(SELECT min(source) FROM documents)"
    second = f"(SELECT min(source) FROM documents WHERE source > {first})"
    left = (f"SELECT doc_id, CASE WHEN source = {second} THEN text || '{RELOADED}' ELSE text END AS text, lang AS feature "
            f"FROM documents WHERE source IS DISTINCT FROM {first}")
    terms = terms.replace("SELECT doc_id, text, lang AS feature FROM documents", left)
    return {
        "terms_after_changes": f"WITH {terms} SELECT term, df, round(idf, 6) AS idf, round(share, 6) AS share, is_distinctive FROM stats",
        "bm25_after_changes": f"""WITH {terms}{words}, r AS (SELECT query_id, doc_id, round(bm25, 6) AS score,
          row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, doc_id) AS rank FROM bm25)
          SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 20""",
        "buckets_after_changes": f"WITH {terms}{vectors} SELECT bucket, round(idf, 6) AS idf FROM bidf",
        "load_metrics": """SELECT count(*) AS scanned, count(*) FILTER (p_size = 45) AS issues, count(*) FILTER (p_size > 45) AS skipped,
            count(*) FILTER (p_size < 45) AS discovered,
            count(*) FILTER (p_size < 45) - count(DISTINCT (lower(trim(p_name)), lower(p_brand), lower(trim(p_type)))) FILTER (p_size < 45) AS duplicates,
            count(DISTINCT (lower(trim(p_name)), lower(p_brand), lower(trim(p_type)))) FILTER (p_size < 45) AS stored FROM part""",
    }
