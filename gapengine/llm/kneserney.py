"""Quality classifier: perplexity under Kneser-Ney models of trusted text, and its quantiles by language and length.

A text has two perplexities: that of its words (``wordmodel``), and that of
their shapes and repetitions (``shapes``).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gapengine.llm.common import C, stored
from gapengine.llm.shapes import SYMBOLS, coded, symbols, train  # noqa: F401
from gapengine.llm.wordmodel import word_scores

# Name of all languages together; others begin with "l" or are empty.
ALL = "*"
BANDS = 64


def _band(n_words: str) -> Column:
    return F.floor(F.log2(F.greatest(C(n_words), F.lit(1)))).cast("int")


def _pooled(least: int):
    """The pool of every band: neighbouring bands, from the shortest on, until ``least`` texts are together; the last rest joins the pool before it."""

    def run(sizes: pd.DataFrame) -> pd.DataFrame:
        n = dict(zip(sizes["_band"], sizes["n"], strict=True))
        pools, pool, held, left = [], 0, 0, sum(n.values())
        for band in range(BANDS):
            if held >= least and left >= least:
                pool, held = pool + 1, 0
            held, left = held + n.get(band, 0), left - n.get(band, 0)
            pools.append(pool)
        return pd.DataFrame({"_language": sizes["_language"].iloc[0], "_band": range(BANDS), "_pool": pools})

    return run


def with_quality(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    quantile: float = 0.99, spread: float = 3.0, band_texts: int = 100,
) -> DataFrame:
    """``docs`` with n_words, log_perplexity and threshold, the same of shapes, and kept.

    ``trusted`` has the ids (``id_col``) of the texts to learn from; all of them
    are counted.  The perplexity of a text is that of its words and its end, for
    a trusted text without the n-grams that only it has.  Thresholds are of a
    language and a band of lengths, the lengths from one power of two to the
    next; bands of fewer than ``band_texts`` trusted texts are pooled with
    their neighbours.  A threshold is the median of the band's trusted texts
    plus ``spread`` times the distance from there to their ``quantile``, both
    exact on values rounded to three decimals; a language without trusted texts
    takes that of all.  Texts above either threshold, of words or of shapes,
    are rejected, ``kept`` is false.

    A null, empty or blank text has no perplexity and is kept, as nothing
    speaks against it; null languages are one language.  Without trusted texts
    nothing is rejected.  Rows that share an id are each scored, and are all
    trusted if the id is.  Columns of ``docs`` with the names of the result's
    are replaced.
    """
    docs = docs.drop("n_words", "log_perplexity", "threshold", "shape_log_perplexity", "shape_threshold", "kept")
    rows = docs.select(C(id_col).cast("bigint").alias("id"), C(lang_col).cast("string").alias("lang"), C(text_col).cast("string").alias("text"))
    ids = trusted.select(C(id_col).cast("bigint").alias("id")).filter(C("id").isNotNull()).distinct()
    name = F.xxhash64(F.coalesce("text", F.lit("")))
    language = F.coalesce(F.concat(F.lit("l"), C("lang")), F.lit(""))
    # A trusted text is judged by what the other ones say of it.
    scores = word_scores(rows.select("id", name.alias("name"), "text"), ids).join(ids.withColumn("_trusted", F.lit(True)), "id", "left")
    scores = stored(scores.select(
        C("id").alias("_id"), C("name").alias("_of"), "n_words", F.when(C("_trusted"), C("others")).otherwise(C("plain")).alias("log_perplexity"),
        F.when(C("_trusted"), C("other_shape")).otherwise(C("shape")).alias("shape_log_perplexity"), "_trusted",
    ).dropDuplicates(["_id", "_of"]))
    known = stored(rows.select("id", name.alias("name"), language.alias("language")).join(
        scores.filter(C("_trusted") & C("log_perplexity").isNotNull()), (C("id") == C("_id")) & (C("name") == C("_of"))
    ).select(F.explode(F.array("language", F.lit(ALL))).alias("_language"), _band("n_words").alias("_band"), F.round("log_perplexity", 3).alias("x"), F.round("shape_log_perplexity", 3).alias("y")))
    # A row for each language and band: small whatever the data.
    sizes = known.groupBy("_language", "_band").agg(F.count(F.lit(1)).alias("n"))
    pools = stored(sizes.groupBy("_language").applyInPandas(_pooled(band_texts), "_language string, _band int, _pool int"))
    cut = [F.percentile(v, q).alias(f"_{name}_{v}") for v in "xy" for name, q in (("middle", 0.5), ("high", quantile))]
    cuts = stored(pools.join(known.join(pools, ["_language", "_band"]).groupBy("_language", "_pool").agg(*cut), ["_language", "_pool"]).drop("_pool"))
    overall = cuts.filter(C("_language") == ALL).select("_band", *[C(f"_{n}_{v}").alias(f"_{n}0_{v}") for v in "xy" for n in ("middle", "high")])
    judged = docs.withColumns({
        "_name": F.xxhash64(F.coalesce(C(text_col).cast("string"), F.lit(""))), "_language": F.coalesce(F.concat(F.lit("l"), C(lang_col).cast("string")), F.lit("")),
    })
    judged = judged.join(scores.drop("_trusted"), (C("_name") == C("_of")) & C(id_col).cast("bigint").eqNullSafe(C("_id")), "left").withColumn("_band", _band("n_words"))
    judged = judged.join(F.broadcast(cuts), ["_language", "_band"], "left").join(F.broadcast(overall), "_band", "left")

    def threshold(v: str) -> Column:
        middle, high = F.coalesce(f"_middle_{v}", f"_middle0_{v}"), F.coalesce(f"_high_{v}", f"_high0_{v}")
        return F.round(middle + spread * F.greatest(high - middle, F.lit(LEAST_ROOM)), 6)

    kept = (C("log_perplexity") <= C("threshold")) & (C("shape_log_perplexity") <= C("shape_threshold"))
    return judged.select(
        *docs.columns, "n_words", "log_perplexity", threshold("x").alias("threshold"), "shape_log_perplexity", threshold("y").alias("shape_threshold"),
    ).withColumn("kept", F.coalesce(kept, F.lit(True)))


def score_quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **settings) -> DataFrame:
    """(doc_id, lang, n_words, log_perplexity, threshold, shape_log_perplexity, shape_threshold, kept), one row for each row of ``docs``; see ``with_quality``."""
    narrow = docs.select(C(id_col).alias("doc_id"), C(lang_col).alias("lang"), C(text_col).alias("text"))
    return with_quality(narrow, trusted.select(C(id_col).alias("doc_id")), **settings).drop("text")


# Least distance between a band's median and its quantile.
LEAST_ROOM = 0.01
