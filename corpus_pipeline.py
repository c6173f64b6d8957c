"""The corpus pipeline: from ``documents`` to piece ids, one stage after another, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gapengine.llm.common import stored, table
from gapengine.llm.kneserney import with_quality
from gapengine.llm.mixing import with_mix
from gapengine.llm.neardup import near_duplicates
from gapengine.llm.pieces import encode_pieces
from gapengine.llm.pii import find_pii, redacted
from gapengine.llm.queries import VOCABULARY, prepared

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model of the trusted ones doesn't reject; null and empty texts stay."""
    trusted = table(prepared(spark), sf_dir, "labels").filter(F.col("quality") == 1)
    return with_quality(docs, trusted).filter("kept").select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (five words, 0.8).

    Rows that repeat an id are one document and become one row, the smallest by text, lang, source and n_chars, nulls
    first; rows without id all stay.  An empty table stays empty.
    """
    prepared(spark)
    kept = near_duplicates(docs).filter(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    chosen = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("_row"))
    return chosen.select("doc_id", "_row.*").union(docs.filter(F.col("doc_id").isNull()).select(COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every span of personal data replaced by its kind; ``n_chars`` follows a changed text; null texts stay null."""
    prepared(spark)
    found = find_pii(docs, out="_pii")
    masked = found.withColumn("text", redacted("text", "_pii"))
    return masked.withColumn("n_chars", F.when(F.size("_pii") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, up to three rows each; those that it doesn't take go."""
    prepared(spark)
    mixed = with_mix(docs.select(COLUMNS))
    return mixed.filter(F.col("times") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether they decode to exactly that text; a null text has no pieces; n_chars goes."""
    prepared(spark)
    coded = encode_pieces(docs.select("doc_id", "lang", "source", "text"), VOCABULARY, decode=True)
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("bigint").alias("n_pieces"), F.col("decoded").eqNullSafe(F.col("text")).alias("exact"))


STAGES = [
    ("quality classifier", quality), ("MinHash near-dedup", one_of_each_group), ("PII", personal_data),
    ("mixing sources", mixing), ("SentencePiece encoding", pieces),
]
# Perplexities, signatures and piece ids have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read back."""
    docs = table(prepared(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
