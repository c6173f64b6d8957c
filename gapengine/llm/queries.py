"""Registered queries of the training-data operators; each reads its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gapengine.llm import bitsliced, decontam, hardneg, merkle, mixing, neardup, rotation, vectordup
from gapengine.llm.bitsliced import exact_top_k
from gapengine.llm.common import table
from gapengine.llm.decontam import contamination_report
from gapengine.llm.hardneg import hard_negatives, relabelled
from gapengine.llm.kneserney import score_quality
from gapengine.llm.licences import licence_report
from gapengine.llm.merkle import merkle_report
from gapengine.llm.mixing import mix_sources
from gapengine.llm.neardup import near_duplicates
from gapengine.llm.pages import main_text
from gapengine.llm.pieces import encode_pieces
from gapengine.llm.pii import pii_report
from gapengine.llm.rotation import rotate_perspectives
from gapengine.llm.vectordup import near_vectors
from gapengine.session import tune


# Vocabulary file on the driver; every caller may name another.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def prepared(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, as one text may be long."""
    tune(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return spark


def op1_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mix_sources(table(prepared(spark), sf, "documents"))


def op2_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(prepared(spark), sf, "documents"), words=2)


def op6_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return exact_top_k(table(prepared(spark), sf, "embeddings"))


def op9_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return pii_report(table(prepared(spark), sf, "documents"))


def op3_perspectives(spark: SparkSession, sf: str) -> DataFrame:
    return rotate_perspectives(table(prepared(spark), sf, "conversations"))


def op4_licences(spark: SparkSession, sf: str) -> DataFrame:
    return licence_report(table(prepared(spark), sf, "documents"))


def op5_quality(spark: SparkSession, sf: str) -> DataFrame:
    trusted = table(prepared(spark), sf, "labels").filter(F.col("quality") == 1)
    return score_quality(table(spark, sf, "documents"), trusted)


def op7_near_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return near_vectors(table(prepared(spark), sf, "embeddings"))


def op8_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return main_text(table(prepared(spark), sf, "pages"))


def op10_pieces(spark: SparkSession, sf: str, model: str = VOCABULARY) -> DataFrame:
    """Ids of every text, and whether they decode to exactly that text."""
    docs = table(prepared(spark), sf, "documents").select("doc_id", "text")
    out = encode_pieces(docs, model, decode=True)
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("exact"))


def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(prepared(spark), sf, "embeddings")
    return hard_negatives(vectors.withColumn("label", relabelled(F.col("label"), F.col("vec_id"))))


def op12_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return merkle_report(table(prepared(spark), sf, "documents"))


def op13_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contamination_report(table(prepared(spark), sf, "documents"), table(spark, sf, "benchmark"))


QUERIES = [
    op1_mix_sources, op2_near_duplicates, op3_perspectives, op4_licences, op5_quality, op6_exact_top_k, op7_near_vectors, op8_main_text,
    op9_personal_data, op10_pieces, op11_hard_negatives, op12_merkle_manifest, op13_decontamination,
]
ORACLES = {
    "op1_mix_sources": mixing.ORACLE, "op2_near_duplicates": neardup.ORACLE, "op3_perspectives": rotation.ORACLE, "op6_exact_top_k": bitsliced.ORACLE, "op7_near_vectors": vectordup.ORACLE,
    "op11_hard_negatives": hardneg.ORACLE, "op12_merkle_manifest": merkle.ORACLE, "op13_decontamination": decontam.ORACLE,
}
