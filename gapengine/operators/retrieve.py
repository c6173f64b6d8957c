"""Hybrid candidate retrieval: exact BM25 plus exact hashed TF-IDF cosine.

Both halves leave out what their bounds show to be too weak (see ``impact`` and
``vectors``), so only pairs that may still enter a result meet.  ``bm25_scores``
is the plain form: every document that shares a term.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from gapengine import fixed
from gapengine.functions.text import explode_tokens, synonym_map
from gapengine.operators.impact import asked_levels, impact_blocks, impact_of, kth_best, pruned_scores, score_pairs, seed_pairs
from gapengine.operators.scan import asked_words, best_listed, listed_above, listed_pairs
from gapengine.operators.sizing import BROADCAST_ROWS, blocks_for, materialise
from gapengine.operators.vectors import CENTRES, PART_ROWS, PLAIN_ROWS, VectorIndex, build_vector_index, scan, search as search_vectors


def blend(
    vector: Column, lexical: Column, *, feature_match: Column, shares_condition: Column, shares_signal: Column
) -> Column:
    """RNK-3: weighted halves, boosts, cap at 1, four digits."""
    score = fixed.VECTOR_WEIGHT * F.greatest(F.lit(0.0), vector) + fixed.LEXICAL_WEIGHT * lexical
    for applies, boost in (
        (feature_match, fixed.FEATURE_BOOST),
        (shares_condition, fixed.CONDITION_BOOST),
        (shares_signal, fixed.SIGNAL_BOOST),
    ):
        score = score * F.when(F.coalesce(applies, F.lit(False)), boost).otherwise(1.0)
    return F.round(F.least(score, F.lit(1.0)), 4)


# ------------------------------------------------------------------- lexical half


def query_terms(queries: DataFrame, key: str = "query_id", text: str = "text") -> DataFrame:
    """AGG-2: distinct terms of each query, literal ones at 1.0 and their
    synonyms at 0.5; ``pos`` is the first place a literal term stands."""
    literal = explode_tokens(queries, key, text).groupBy(key, "term").agg(F.min("pos").alias("pos"))
    related = literal.filter(F.col("term").isin(list(fixed.SYNONYMS))).select(
        key, F.explode(F.element_at(synonym_map(), F.col("term"))).alias("term"), F.lit(None).cast("int").alias("pos")
    )
    return (
        literal.unionByName(related)
        .groupBy(key, "term").agg(F.min("pos").alias("pos"))
        .withColumn("weight", F.when(F.col("pos").isNotNull(), 1.0).otherwise(fixed.SYNONYM_QUERY_WEIGHT))
    )


def _in_blocks(df: DataFrame, key: str, rows: int, score):
    """Apply ``score`` to blocks of ``df`` that fit a broadcast and union the
    results.  One block is the normal case; the number of blocks, not their
    size, grows with the queries."""
    n = blocks_for(df.count(), rows)
    if n == 1:
        return score(df)
    block = F.pmod(F.xxhash64(key), F.lit(n))
    parts = [score(df.filter(block == b)) for b in range(n)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bm25_scores(
    terms: DataFrame, stats: DataFrame, corpus: DataFrame, queries: DataFrame, key: str = "query_id",
    rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """JON-1/AGG-2: ``(key, doc_id, bm25)`` for every document sharing a term.

    ``terms`` is spread by document, the query terms come to it, so the sum over
    a pair's terms closes locally and a term held by a third of the documents is
    no hot spot: its postings stay spread with their documents.
    """
    terms = terms.repartition("doc_id")
    weighted = queries.join(stats.select("term", "idf"), "term").select(key, "term", "weight", "idf").join(F.broadcast(corpus.select("avg_length")))  # one row

    def score(block: DataFrame) -> DataFrame:
        part = F.col("weight") * impact_of(F.col("tf"), F.col("doc_length"), F.col("idf"), F.col("avg_length"))
        return (
            terms.join(F.broadcast(block), "term")  # at most ``rows`` rows, checked
            .groupBy("doc_id", key).agg(F.sum(part).alias("bm25"))
        )

    return _in_blocks(weighted, key, rows, score).select(key, "doc_id", "bm25")


def lexical_best(scores: DataFrame, key: str = "query_id") -> DataFrame:
    """RNK-2: each query's maximum and number of hits; combines map-side."""
    return scores.groupBy(key).agg(F.max("bm25").alias("best"), F.count(F.lit(1)).alias("n_hits"))


def scaled_lexical(scores: DataFrame, best: DataFrame, key: str = "query_id") -> DataFrame:
    """RNK-2: scores divided by their query's maximum."""
    return scores.join(best.select(key, "best"), key).withColumn(
        "lexical", F.when(F.col("best") > 0, F.col("bm25") / F.col("best")).otherwise(F.col("bm25"))
    ).drop("best")


def matched_terms(kept: DataFrame, terms: DataFrame, queries: DataFrame, key: str = "query_id", limit: int = 8) -> DataFrame:
    """RNK-9: the first literal query terms a kept document holds, in query order."""
    literal = queries.filter(F.col("pos").isNotNull()).select(key, "term", "pos")
    found = (
        terms.select("doc_id", "term").join(kept.select(key, "doc_id"), "doc_id")
        .join(literal, [key, "term"])
        .groupBy(key, "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("t"))
    )
    return found.select(key, "doc_id", F.slice(F.col("t.term"), 1, limit).alias("matched_terms"))


# -------------------------------------------------------------------- vector half


def best_per_query(df: DataFrame, k: int, key: str = "query_id", score: str = "similarity") -> DataFrame:
    """RNK-1: the k best rows of each query; the cut runs before the shuffle too."""
    order = Window.partitionBy(key).orderBy(F.desc(score), "doc_id")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def vector_top_k(
    vectors: DataFrame, queries: DataFrame, k: int, key: str = "query_id", part: int = PART_ROWS, plain_rows: int = PLAIN_ROWS
) -> DataFrame:
    """JON-2/RNK-1: exact inner-product top k over packed vectors that have no index yet.

    Similarities are rounded to 9 digits so that equal texts tie whatever the
    layout.  Fewer queries than an index has centres meet every vector; ``plain_rows`` 0 asks for the index."""
    queries = materialise(queries.select(key, "buckets", "weights"))
    n = queries.count()
    if plain_rows and n <= CENTRES:
        return scan(vectors, queries, k, key)
    return search_vectors(build_vector_index(vectors, part_rows=part, plain_rows=plain_rows, n_queries=n), queries, k, key)


def indexed_search(index: VectorIndex) -> Callable[[DataFrame, DataFrame, int, str], DataFrame]:
    """UDF-3: the search of ``retrieve`` over an index built once."""
    return lambda _, queries, k, key: search_vectors(index, queries, k, key)


def query_vectors(queries: DataFrame, idf: DataFrame, corpus: DataFrame, key: str = "query_id", text: str = "text") -> DataFrame:
    """AGG-6 for queries, weighted by the catalogue's idf."""
    from gapengine.operators.index import packed_vectors, raw_buckets, weighted_features, weighted_vectors

    buckets = materialise(raw_buckets(weighted_features(queries, key, text), key))
    return packed_vectors(weighted_vectors(buckets, idf, corpus, key), key)


# ------------------------------------------------------------------------- hybrid


def scored_candidates(lexical: DataFrame, hits: DataFrame, incidents: DataFrame, docs: DataFrame, key: str = "query_id") -> DataFrame:
    """JON-3/JON-4/RNK-3: union of both halves with the blended score.

    ``lexical``: key, doc_id, lexical; ``hits``: key, doc_id, similarity, at most k
    per query.  ``incidents``: key, i_feature, i_keys, i_signals; ``docs``: doc_id,
    t_feature, t_keys, t_signals.
    """
    nothing = F.lit(None).cast("double")
    both = lexical.select(key, "doc_id", "lexical", nothing.alias("similarity")).unionByName(
        hits.select(key, "doc_id", nothing.alias("lexical"), "similarity")
    )
    pairs = both.groupBy(key, "doc_id").agg(F.coalesce(F.max("lexical"), F.lit(0.0)).alias("lexical"), F.max("similarity").alias("similarity"))
    pairs = pairs.join(docs, "doc_id").join(incidents, key)
    vector_score = F.greatest(F.lit(0.0), F.coalesce("similarity", F.lit(0.0)))
    match = (F.col("i_feature") != "") & (F.col("i_feature") == F.col("t_feature"))
    return pairs.select(
        key, "doc_id",
        blend(
            vector_score, F.col("lexical"), feature_match=match,
            shares_condition=F.arrays_overlap("i_keys", "t_keys"),
            shares_signal=F.arrays_overlap("i_signals", "t_signals"),
        ).alias("score"),
        F.round(vector_score, 4).alias("vector_score"),
        F.round("lexical", 4).alias("lexical_score"),
        match.alias("feature_match"),
        "i_signals", "t_signals",
    )


def best_boost(incidents: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, boost): the most that the boosts of RNK-3 can multiply a query's scores with."""
    product = F.lit(1.0)
    for applies, boost in (
        (F.col("i_feature") != "", fixed.FEATURE_BOOST), (F.size("i_keys") > 0, fixed.CONDITION_BOOST), (F.size("i_signals") > 0, fixed.SIGNAL_BOOST),
    ):
        product = product * F.when(F.coalesce(applies, F.lit(False)), boost).otherwise(1.0)
    return incidents.select(key, product.alias("boost"))


# Postings that queries touch up to which adding up all of them is less work than the steps of a bounded search.
PLAIN_POSTINGS = 20_000_000


def touched_postings(stats: DataFrame, words: DataFrame) -> int:
    return words.join(stats.select("term", "df"), "term").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]


def best_scores(
    terms: DataFrame, stats: DataFrame, corpus: DataFrame, words: DataFrame, k: int, key: str = "query_id", blocks: DataFrame | None = None,
    plain_postings: int = PLAIN_POSTINGS,
) -> DataFrame:
    """JON-1/AGG-2: scores among which each query's ``k`` best are, through bounds
    where queries touch many postings.  Both ways give the same best."""
    if touched_postings(stats, words) <= plain_postings:
        return bm25_scores(terms, stats, corpus, words, key)
    blocks = materialise(impact_blocks(terms, stats, corpus)) if blocks is None else blocks
    return pruned_scores(blocks, terms, stats, corpus, words, k, key)


def lexical_candidates(
    index, words: DataFrame, hits: DataFrame, incidents: DataFrame, docs: DataFrame, key: str = "query_id", keep: int = fixed.TOP_K,
    plain_postings: int = PLAIN_POSTINGS, lists: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """JON-1/RNK-2: (key, doc_id, lexical) of every document that can be among a
    query's ``keep`` best or is one of its vector hits, and (key, best), the
    largest score of each query.

    The seeds and the vector hits, scored in full, set a threshold on the blended
    score; with it goes the least a document without vector hit needs of BM25.
    Documents that carry one of the query's signals compete for places of their
    own (RNK-5), so where a query has signals all of these are scored.  Where
    queries touch few postings, all documents that share a term are given.
    With ``lists`` (doc_id, doc_length, terms, tfs), the counted words of each text, texts are
    scored where they are instead of through posting blocks, as long as a task can hold all queries."""
    if touched_postings(index.term_stats, words) <= plain_postings:
        scores = materialise(bm25_scores(index.doc_terms, index.term_stats, index.corpus, words, key))
        best = materialise(lexical_best(scores, key))
        return scaled_lexical(scores, best, key).select(key, "doc_id", "lexical"), best
    asked = None if lists is None else asked_words(words, index.term_stats, index.corpus, key)
    if asked is not None:
        found = materialise(best_listed(lists, asked, words, keep, key))
        best = materialise(lexical_best(found, key).select(key, "best"))
        seeds = materialise(found.unionByName(listed_pairs(lists, asked, words, hits, key)).dropDuplicates([key, "doc_id"]))
    else:
        parts, blocks = (index.doc_terms, index.term_stats, index.corpus), materialise(index.blocks)
        levels = materialise(asked_levels(blocks, words, key))
        seeds = seed_pairs(levels, blocks, key).unionByName(hits.select(key, "doc_id")).distinct()
        seeds = materialise(score_pairs(seeds, *parts, words, key))
        first = pruned_scores(blocks, *parts, words, 1, key, levels=levels, seeds=seeds)
        best = materialise(first.groupBy(key).agg(F.max("bm25").alias("best")))
    known = scored_candidates(scaled_lexical(seeds, best, key), hits, incidents, docs, key)
    # Blended scores have four digits; a document below all of this can't be kept.
    least = kth_best(known, keep, "score", key).join(best, key).join(best_boost(incidents, key), key)
    need = (F.col("threshold") - 1e-4) / (fixed.LEXICAL_WEIGHT * F.col("boost")) * F.col("best")
    thresholds = least.select(key, F.greatest(need, F.lit(0.0)).alias("threshold"))
    carriers = signal_carriers(incidents, docs, key)
    if asked is not None:
        strong, carried = listed_above(lists, asked, words, thresholds, key), listed_pairs(lists, asked, words, carriers, key)
    else:
        strong = pruned_scores(blocks, *parts, words, keep, key, levels=levels, thresholds=thresholds)
        carried = score_pairs(carriers, *parts, words, key)
    every = seeds.unionByName(strong).unionByName(carried).dropDuplicates([key, "doc_id"])
    return scaled_lexical(every, best, key).select(key, "doc_id", "lexical"), best


def signal_carriers(incidents: DataFrame, docs: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, doc_id) of the documents of a query's feature that carry one of its signals."""
    asks = incidents.filter((F.col("i_feature") != "") & (F.size("i_signals") > 0)).select(key, F.col("i_feature").alias("t_feature"), F.explode("i_signals").alias("signal"))
    held = docs.filter(F.size("t_signals") > 0).select("doc_id", "t_feature", F.explode("t_signals").alias("signal"))
    return asks.join(held, ["t_feature", "signal"]).select(key, "doc_id").distinct()


def most_kept(top_k: int = fixed.TOP_K) -> int:
    """Places of one list of ``finalists``."""
    return max(top_k, fixed.FALLBACK_KEEP, len(fixed.SIGNAL_PATTERNS))


def finalists(scored: DataFrame, key: str = "query_id", top_k: int = fixed.TOP_K) -> DataFrame:
    """The rows any cut can still need: the best of each query, and for each
    signal it carries the 16 best same-feature carriers (a query has at most 16
    signals, and no test is picked twice).  Cut before the shuffle, so the
    result is small whatever the number of scored pairs."""
    every = F.array(F.lit(""))
    carried = F.when(F.col("feature_match"), F.array_intersect("i_signals", "t_signals")).otherwise(
        F.array().cast("array<string>")
    )
    order = Window.partitionBy(key, "label").orderBy(F.desc("score"), "doc_id")
    most = most_kept(top_k)
    return (
        scored.withColumn("label", F.explode(F.concat(every, carried)))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= most)
    )


def retrieval_stats(final: DataFrame, index, words: DataFrame, hits: DataFrame, key: str = "query_id") -> DataFrame:
    """AGG-26: best score of each query, and how many documents either half finds;
    counted only where the number is asked for."""
    top = final.filter("label = ''").groupBy(key).agg(F.max("score").alias("retrieval_top"))
    sharing = index.doc_terms.select("doc_id", "term").join(words.select(key, "term"), "term").select(key, "doc_id")
    found = sharing.unionByName(hits.select(key, "doc_id")).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return top.join(found, key, "left").select(key, "retrieval_top", F.coalesce("n", F.lit(0)).alias("candidate_count"))


def keep_candidates(final: DataFrame, key: str = "query_id", top_k: int = fixed.TOP_K) -> DataFrame:
    """RNK-4: the first ``top_k`` above the floor, or the best three when none is."""
    ranked = final.filter("label = ''").withColumn(
        "top", F.max("score").over(Window.partitionBy(key))
    )
    floor = F.greatest(F.lit(fixed.MIN_SCORE), F.col("top") * fixed.RELATIVE_FLOOR)
    clears = (F.col("score") >= floor) & (F.col("rank") <= top_k)
    return ranked.filter(clears | ((F.col("top") < floor) & (F.col("rank") <= fixed.FALLBACK_KEEP))).drop("top")


def signal_witnesses(final: DataFrame, kept: DataFrame, key: str = "query_id") -> DataFrame:
    """RNK-5: for each incident signal no kept test shows, the best same-feature
    test that does, no test twice.  The sequential choice runs over the bounded
    lists of ``finalists`` inside one row per query."""
    shown = kept.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("t_signals"))).alias("shown"))
    kept_ids = kept.groupBy(key).agg(F.collect_list("doc_id").alias("kept_ids"))
    missing = (
        final.filter("label <> ''").join(shown, key).join(kept_ids, key)
        .filter(~F.array_contains("shown", F.col("label")))
    )
    lists = (
        missing.groupBy(key, F.col("label").alias("signal"))
        .agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("tests"), F.first("kept_ids").alias("kept_ids"))
        .groupBy(key)
        .agg(
            F.array_sort(F.collect_list(F.struct("signal", F.col("tests.doc_id").alias("tests")))).alias("wanted"),
            F.first("kept_ids").alias("kept_ids"),
        )
    )
    # Starts from the kept tests and drops them again: a witness is never one of them.
    chosen = F.aggregate(
        "wanted",
        F.col("kept_ids"),
        lambda acc, w: F.concat(acc, F.slice(F.filter(w["tests"], lambda d: ~F.array_contains(acc, d)), 1, 1)),
    )
    picks = lists.select(key, F.posexplode(F.array_except(chosen, F.col("kept_ids"))).alias("turn", "doc_id"))
    rows = final.filter("label <> ''").drop("label", "rank").dropDuplicates([key, "doc_id"])
    return picks.join(rows, [key, "doc_id"])


def retrieve(
    index, queries: DataFrame, incidents: DataFrame, docs: DataFrame, key: str = "query_id", top_k: int = fixed.TOP_K,
    search: Callable[[DataFrame, DataFrame, int, str], DataFrame] = vector_top_k, embed: Callable[[DataFrame], DataFrame] | None = None,
    oversample: int = fixed.VECTOR_OVERSAMPLE, plain_postings: int = PLAIN_POSTINGS, lists: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """RNK-1..5 end to end: ``(candidates, stats)``.  ``lists``: see ``lexical_candidates``.

    ``queries``: key, text.  Candidates carry ``rank_key``, their place in the
    result: kept ones by score, witnesses after them.  ``search`` (UDF-3) finds
    the ``top_k * oversample`` nearest documents, (key, doc_id, similarity);
    ``embed`` (UDF-2) turns (key, text) into (key, buckets, weights) and must be
    the one the index was built with.
    """
    words = materialise(query_terms(queries, key))
    asked = query_vectors(queries, index.bucket_idf, index.corpus, key) if embed is None else embed(queries)
    hits = materialise(search(index.vectors, asked, top_k * oversample, key).select(key, "doc_id", "similarity"))
    lexical, _ = lexical_candidates(index, words, hits, incidents, docs, key, most_kept(top_k), plain_postings, lists)
    final = materialise(finalists(scored_candidates(lexical, hits, incidents, docs, key), key, top_k))
    stats = retrieval_stats(final, index, words, hits, key)
    kept = keep_candidates(final, key, top_k)
    columns = [key, "doc_id", "score", "vector_score", "lexical_score", "feature_match", "rank_key"]
    first = kept.withColumn("rank_key", F.col("rank"))
    more = signal_witnesses(final, kept, key).withColumn("rank_key", F.lit(1000) + F.col("turn"))
    return first.select(*columns).unionByName(more.select(*columns)), stats
