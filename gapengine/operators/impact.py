"""Pruned lexical search: posting blocks in order of impact, and bounds that leave most of them out.

What a posting adds to a document's BM25 score, its impact, is fixed when the
index is built.  The postings of a term lie in levels of falling impact; a level
with many of them is split into blocks.  A query first reads the blocks of
highest impact, which gives documents whose full scores set a threshold.  Up to
a share of that threshold may then go unseen: whole lists are skipped, those
first that hold most postings for the score they can give, and of the next list
the lower levels.  A document whose seen part and the most it can have unseen
stay below the threshold is dropped; the rest, few, are scored in full.  Exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gapengine import fixed
from gapengine.operators.sizing import materialise

LEVELS = 16
BLOCK_POSTINGS = 1_024
# Documents looked at for a first threshold: at least this many postings.
SEEDS = 128
# Share of the threshold that may go unseen.  More skips more postings and
# leaves more documents to score in full.
UNSEEN = 0.35
# More than rounding to six digits and the order of sums can change.
SLACK = 2e-6


def impact_of(tf: Column, length: Column, idf: Column, average: Column) -> Column:
    """What one posting adds to a score, for query weight 1."""
    k1, b = fixed.BM25_K1, fixed.BM25_B
    relative = F.greatest(length, F.lit(1)) / F.when(average > 0, average).otherwise(1.0)
    return idf * tf.cast("double") * (k1 + 1) / (tf.cast("double") + k1 * (1 - b + b * relative))


def with_impacts(terms: DataFrame, stats: DataFrame, corpus: DataFrame) -> DataFrame:
    """(doc_id, term, impact, idf, df) of every posting."""
    one = F.broadcast(corpus.select("avg_length"))  # one row
    return terms.join(stats.select("term", "idf", "df"), "term").join(one).select(
        "doc_id", "term", impact_of(F.col("tf"), F.col("doc_length"), F.col("idf"), F.col("avg_length")).alias("impact"), "idf", "df"
    )


def impact_blocks(terms: DataFrame, stats: DataFrame, corpus: DataFrame) -> DataFrame:
    """AGG-1: (term, level, block, n_blocks, highest, n, rows): postings by falling impact, in one pass.

    A level is a sixteenth of the impact a term can have at all, so lists need no
    sorting; a frequent term's levels are dealt into blocks, each of at most about
    ``BLOCK_POSTINGS`` rows, so no list meets in one task."""
    reach = F.col("idf") * (fixed.BM25_K1 + 1)
    level = (LEVELS - 1) - F.least(F.floor(F.when(reach > 0, F.col("impact") / reach).otherwise(0.0) * LEVELS), F.lit(LEVELS - 1))
    n_blocks = F.ceil(F.col("df") / BLOCK_POSTINGS).cast("int")
    placed = with_impacts(terms, stats, corpus).select("doc_id", "term", "impact", level.cast("int").alias("level"), n_blocks.alias("n_blocks"))
    return (
        placed.groupBy("term", "level", "n_blocks", F.pmod(F.xxhash64("doc_id"), F.col("n_blocks")).cast("int").alias("block"))
        .agg(F.max("impact").alias("highest"), F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("impact", "doc_id")).alias("rows"))
    )


def score_pairs(pairs: DataFrame, terms: DataFrame, stats: DataFrame, corpus: DataFrame, words: DataFrame, key: str = "query_id") -> DataFrame:
    """JON-1/AGG-2: full (key, doc_id, bm25) of the given pairs that share a term.

    The query's terms come to the pairs first, so only postings that count are met."""
    wanted = pairs.select(key, "doc_id").join(words.select(key, "term", "weight"), key)
    weighted = wanted.join(stats.select("term", "idf"), "term").join(F.broadcast(corpus.select("avg_length")))  # one row
    part = F.col("weight") * impact_of(F.col("tf"), F.col("doc_length"), F.col("idf"), F.col("avg_length"))
    return weighted.join(terms, ["doc_id", "term"]).groupBy(key, "doc_id").agg(F.sum(part).alias("bm25"))


def asked_levels(blocks: DataFrame, words: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, term, weight, level, n_blocks, high, n): what each query could read, with the most a posting there adds."""
    levels = blocks.groupBy("term", "level", "n_blocks").agg(F.max("highest").alias("highest"), F.sum("n").alias("n"))
    return words.join(levels, "term").select(key, "term", "weight", "level", "n_blocks", (F.col("weight") * F.col("highest")).alias("high"), "n")


def _read(chosen: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """(key, doc_id, part): postings of the chosen blocks."""
    met = chosen.join(blocks.select("term", "level", "block", "rows"), ["term", "level", "block"])
    return met.select(key, "weight", F.inline("rows")).select(key, "doc_id", (F.col("weight") * F.col("impact")).alias("part"))


def seed_pairs(levels: DataFrame, blocks: DataFrame, key: str = "query_id", seeds: int = SEEDS) -> DataFrame:
    """Documents of one block of each of a query's strongest levels, until ``seeds`` postings are read."""
    strongest = Window.partitionBy(key).orderBy(F.desc("high"), "term", "level").rowsBetween(Window.unboundedPreceding, -1)
    first = levels.withColumn("before", F.coalesce(F.sum("n").over(strongest), F.lit(0))).filter(F.col("before") < seeds)
    return _read(first.withColumn("block", F.lit(0)), blocks, key).select(key, "doc_id").distinct()


def kept_levels(levels: DataFrame, thresholds: DataFrame, key: str = "query_id", unseen: float = UNSEEN) -> DataFrame:
    """What each query still reads, and ``spent``, the most a document can have in what it skips."""
    budget = F.lit(unseen) * F.greatest("threshold", F.lit(0.0))
    lists = levels.groupBy(key, "term").agg(F.max("high").alias("most"), F.sum("n").alias("length")).join(thresholds, key)
    longest = Window.partitionBy(key).orderBy(F.desc(F.col("length") / F.col("most")), "term")
    lists = lists.withColumn("through", F.sum("most").over(longest.rowsBetween(Window.unboundedPreceding, 0)))
    # ``left``: what the budget still has before this list.
    lists = lists.withColumn("skipped", F.col("through") <= budget).withColumn("left", F.greatest(budget - (F.col("through") - F.col("most")), F.lit(0.0)))
    # Only the first list that doesn't fit may lose its lower levels.
    part = F.when(F.row_number().over(longest) == F.sum(F.col("skipped").cast("int")).over(Window.partitionBy(key)) + 1, F.col("left")).otherwise(0.0)
    lists = lists.withColumn("cut", part).withColumn("spent", F.max(F.when(F.col("skipped"), F.col("through")).otherwise(0.0)).over(Window.partitionBy(key)) + F.max("cut").over(Window.partitionBy(key)))
    return levels.join(lists.filter("not skipped").select(key, "term", "cut", "spent", "threshold"), [key, "term"]).filter(F.col("high") > F.col("cut"))


def survivors(kept: DataFrame, blocks: DataFrame, key: str = "query_id") -> DataFrame:
    """Pairs that may still reach their query's threshold."""
    every = kept.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    need = kept.groupBy(key).agg(F.first(F.col("threshold") - F.col("spent")).alias("need"))
    seen = _read(every, blocks, key).groupBy(key, "doc_id").agg(F.sum("part").alias("seen"))
    return seen.join(need, key).filter(F.col("seen") >= F.col("need") - SLACK).select(key, "doc_id")


def kth_best(scored: DataFrame, k: int, score: str = "bm25", key: str = "query_id") -> DataFrame:
    """(key, threshold): each query's k-th best score; queries with fewer are left out."""
    order = Window.partitionBy(key).orderBy(F.desc(score))
    return scored.withColumn("p", F.row_number().over(order)).filter(F.col("p") == k).select(key, F.col(score).alias("threshold"))


def pruned_scores(
    blocks: DataFrame, terms: DataFrame, stats: DataFrame, corpus: DataFrame, words: DataFrame, k: int, key: str = "query_id",
    levels: DataFrame | None = None, seeds: DataFrame | None = None, thresholds: DataFrame | None = None, unseen: float = UNSEEN,
) -> DataFrame:
    """JON-1/AGG-2: (key, doc_id, bm25) of every document that scores at least its query's k-th best.

    ``words``: key, term, weight.  ``thresholds`` (key, threshold) may name other
    bounds, 0 for all documents that share a term; ``seeds`` are pairs scored
    already.  Ties at the bound are all there, and so are scores that round to it.
    """
    levels = materialise(asked_levels(blocks, words, key)) if levels is None else levels
    if thresholds is None:
        if seeds is None:
            seeds = materialise(score_pairs(seed_pairs(levels, blocks, key, max(SEEDS, 4 * k)), terms, stats, corpus, words, key))
        thresholds = kth_best(seeds, k, key=key)
    every = levels.select(key).distinct().join(thresholds, key, "left").select(key, F.coalesce("threshold", F.lit(0.0)).alias("threshold"))
    kept = materialise(kept_levels(levels, every, key, unseen))
    scored = score_pairs(survivors(kept, blocks, key), terms, stats, corpus, words, key)
    every = kept.groupBy(key).agg(F.first("threshold").alias("threshold"))
    return scored.join(every, key).filter(F.col("bm25") >= F.col("threshold") - SLACK).select(key, "doc_id", "bm25")
