"""Registered queries over the driver's tables; each reads them whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gapengine import fixed
from gapengine.functions import extract as X, text as T
from gapengine.operators import catalogue as cat, history as hist, index as ix, patterns as pat, retrieve as ret
from gapengine.operators.compare import with_status
from gapengine.operators.decide import confidence_level, recurrence_points, risk_level, risk_points
from gapengine.operators.incidents import merge_proposed_facts
from gapengine.operators.sizing import materialise, ordinal_within
from gapengine.plans import derived as d, endtoend, explained, maintained, persisted, records, report
from gapengine.plans.derived import table

C = F.col


def joined(c: Column | str, sep: str = "|") -> Column:
    return F.array_join(c, sep)


# ------------------------------------------------------------------ coverage of returns


def coverage_verdicts(spark, sf):
    return d.incident_verdicts(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "feature", "coverage", "effectiveness", "gap_type",
        "family_key", "best_test_id", "best_strength",
    )


def confidence_scores(spark, sf):
    return d.incident_verdicts(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "coverage", "confidence", "confidence_level"
    )


def _observations(spark, sf) -> DataFrame:
    """Gaps of returned lines with the order's urgency as severity."""
    severity = T.lookup(
        C("o_orderpriority"), {"1-URGENT": "CRITICAL", "2-HIGH": "HIGH", "3-MEDIUM": "MEDIUM"}, "LOW"
    )
    orders = table(spark, sf, "orders").select("o_orderkey", severity.alias("severity"))
    lines = d.incident_verdicts(spark, sf, "l_shipdate")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).withColumns(
        {
            "incident_id": C("line_id"), "arrival": C("l_shipdate"),
            "signals": F.when((C("discount_pct") == 0) | (C("tax_pct") == 0), T.strings(["boundary_min"])).otherwise(T.strings([])),
        }
    )


def _recurrence(obs: DataFrame) -> DataFrame:
    incidents = obs.groupBy("incident_id").agg(F.min("arrival").alias("arrival"), F.max("signals").alias("signals"))
    return hist.recurrence_at_arrival(incidents, obs.select("incident_id", "arrival", "family_key"))


def recurrence_on_arrival(spark, sf):
    # Read several times below, for sampling ranges too; the verdicts behind it are worked out once.
    return _recurrence(materialise(_observations(spark, sf).select("incident_id", "arrival", "signals", "family_key")))


def risk_scores(spark, sf):
    obs = materialise(_observations(spark, sf).select(
        "incident_id", "arrival", "signals", "severity", "coverage", "feature", "family_key", "l_partkey", "l_suppkey"))
    with_n = obs.join(_recurrence(obs), "incident_id")
    points = risk_points(C("severity"), C("coverage"), C("feature"), C("similar_incidents"))
    return with_n.select(
        "incident_id", "l_partkey", "l_suppkey", "severity", "coverage", "similar_incidents",
        points.cast("bigint").alias("points"), risk_level(points).alias("risk"),
    )


def _pattern_columns(p: DataFrame) -> DataFrame:
    return p.select(
        "family_key", "label", "incident_count", "gap_count", "risk", joined("gap_types").alias("gap_types"),
        joined("features").alias("features"), joined("example_incident_ids").alias("examples"), "summary",
        "concentrated_in", "concentration",
    )


def recurring_patterns(spark, sf):
    obs = materialise(_observations(spark, sf).select(
        "incident_id", "gap_type", "family_key", "feature", "severity", "coverage", "arrival"))
    return _pattern_columns(pat.recurring_patterns(obs))


def gap_pattern_links(spark, sf):
    obs = materialise(_observations(spark, sf).select(
        "incident_id", "gap_type", "family_key", "feature", "severity", "coverage", "arrival"))
    linked = pat.link_gaps(obs, pat.recurring_patterns(obs))
    return linked.groupBy("family_key", "gap_type", "pattern_label", "pattern_risk").agg(F.count(F.lit(1)).alias("n"))


def verdict_mix(spark, sf):
    return cat.verdict_mix(d.incident_verdicts(spark, sf))


def catalogue_statistics(spark, sf):
    tests = d.test_lines(spark, sf).withColumn("framework", C("l_returnflag"))
    return cat.catalogue_stats(tests)


def evidence_by_condition(spark, sf):
    """EXP-1 over returns: what the related tests do with each condition."""
    facts = d.profile_verdicts(spark, sf).select(*d.PROFILE, F.explode("facts").alias("f"))
    kind = (
        F.when(C("f.matched"), F.lit("condition_matched")).when(C("f.different"), F.lit("condition_difference"))
        .when(C("f.mentioned"), F.lit("condition_mentioned")).otherwise(F.lit("condition_absent"))
    )
    lines = d.incident_lines(spark, sf)
    return lines.join(facts, d.PROFILE).groupBy("feature", C("f.key").alias("key"), kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("n")
    )


def missing_conditions(spark, sf):
    """EXP-3 over returns: production values no related test uses."""
    rows = d.profile_verdicts(spark, sf).select(
        *d.PROFILE, X.pairs_text(F.transform(F.filter("facts", lambda f: ~f["matched"]), lambda f: X.pair(f["key"], f["value"])), "=", sep=";").alias("missing"),
        joined("unmatched").alias("missing_signals"),
    )
    return d.incident_lines(spark, sf).join(rows, d.PROFILE).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "missing", "missing_signals"
    )


def tested_ranges(spark, sf):
    """AGG-21: which values a part's tests use, per region and input."""
    tests = d.test_profiles(d.test_lines(spark, sf))
    values = tests.select("l_partkey", "feature", F.explode(F.array(
        F.struct(F.lit("discount").alias("key"), C("discount_pct").alias("v")),
        F.struct(F.lit("tax").alias("key"), C("tax_pct").alias("v")))).alias("x"))
    return values.groupBy("l_partkey", "feature", C("x.key").alias("key")).agg(
        F.min("x.v").cast("bigint").alias("lowest"), F.max("x.v").cast("bigint").alias("highest"),
        joined(F.transform(F.array_sort(F.collect_set("x.v")), lambda v: v.cast("string")), ",").alias("tested"),
    )


def boundary_recommendations(spark, sf):
    """EXP-7a: percentages 0, 50 and 100 no related test tries, per open boundary gap."""
    v = d.profile_verdicts(spark, sf).filter("gap_type = 'BOUNDARY_CONDITION'").select(*d.PROFILE)
    tests = d.test_profiles(d.test_lines(spark, sf)).select("l_partkey", "feature", "discount_pct")
    # Distinct values of one percentage: bounded by the value domain, not by the rows.
    tested = tests.groupBy("l_partkey", "feature").agg(F.collect_set(C("discount_pct").cast("int")).alias("tested"))
    proposed = F.filter(
        F.array(*[F.lit(x) for x in (0, 50, 100)]),
        lambda x: ~F.array_contains(F.coalesce("tested", F.array().cast("array<int>")), x),
    )
    rows = v.join(tested, ["l_partkey", "feature"], "left")
    return rows.select(*d.PROFILE, F.explode(proposed).alias("p")).groupBy("feature", F.concat(C("p").cast("string"), F.lit("%")).alias("suggested")).agg(
        F.count(F.lit(1)).alias("n")
    )


def return_profiles(spark, sf):
    """Distinct production scenarios and how many incidents each stands for."""
    return d.incident_profiles(d.incident_lines(spark, sf))


# ------------------------------------------------------------------ ids and duplicates


def unique_test_ids(spark, sf):
    """SNK-4 over all catalogue lines."""
    lines = table(spark, sf, "lineitem").filter("l_returnflag <> 'R'").withColumn(
        "test_id", F.concat_ws("-", C("l_orderkey").cast("string"), C("l_linenumber").cast("string"))
    )
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    ids = cat.unique_ids(lines, order=[C(c) for c in order], within=(), coarse=C("l_shipdate"))
    return ids.select("test_id", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


def document_duplicates(spark, sf):
    """SNK-2/SNK-3 over whole texts: the first document of each fingerprint."""
    docs = table(spark, sf, "documents")
    tests = docs.select(
        C("doc_id").alias("seq"), "doc_id", "n_chars",
        cat.fingerprint(C("text"), F.lit(""), F.lit(""), F.lit(""), X.no_pairs()).alias("fingerprint"),
    )
    return cat.without_duplicates(tests).select("doc_id", "n_chars", "fingerprint")


def cross_source_duplicates(spark, sf):
    """SNK-3/JON-13: per source, documents another source with a smaller name has not."""
    docs = table(spark, sf, "documents").select(
        "doc_id", "source", F.sha2(F.lower(F.trim("text")), 256).alias("fingerprint")
    )
    owner = docs.groupBy("fingerprint").agg(F.min("source").alias("owner"))
    kept = docs.join(owner, "fingerprint").filter("source = owner")
    return kept.groupBy("source").agg(F.countDistinct("fingerprint").alias("stored"))


def catalogue_search(spark, sf):
    """FLT-1/LIM-1: one page of parts by text and size, insertion order."""
    parts = table(spark, sf, "part").select(
        C("p_partkey").alias("seq"), C("p_name").alias("name"), C("p_type").alias("feature"),
        C("p_brand").alias("framework"), C("p_name").alias("scenario"), C("p_partkey").cast("string").alias("test_id"),
    )
    return cat.page(cat.search_tests(parts, "RED", "ECONOMY"), [C("seq")], 50, 10).select("seq", "name", "feature", "framework")


# ------------------------------------------------------------------------------- texts


def normalized_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalize(C("text")).alias("normalized"))


def document_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", joined(T.tokens(C("text")), " ").alias("tokens"))


def document_bigrams(spark, sf):
    toks = table(spark, sf, "documents").select("doc_id", T.tokens(C("text")).alias("t"))
    return toks.select("doc_id", F.size(T.bigrams(C("t"))).cast("bigint").alias("n"), joined(F.slice(T.bigrams(C("t")), 1, 2147483647), " ").alias("bigrams"))


def document_keywords(spark, sf):
    return table(spark, sf, "documents").select("doc_id", joined(T.keywords(C("text")), " ").alias("keywords"))


def document_numbers(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", C("text"))
    return docs.select(
        "doc_id",
        F.size(T.numbers(C("text"))).cast("bigint").alias("n_numbers"),
        F.array_max(T.numbers(C("text"))).alias("largest"),
        F.size(T.percentages(C("text"))).cast("bigint").alias("n_percentages"),
    )


def value_numbers(spark, sf):
    """TXT-8/TXT-11 over prices and rates written as text."""
    v = table(spark, sf, "part").select("p_partkey", F.concat(C("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit(" per item")).alias("a"), F.concat(C("p_size").cast("string"), F.lit("%")).alias("b"), C("p_retailprice").cast("decimal(12,2)").cast("string").alias("c"))
    return v.select("p_partkey", *[T.as_number(C(x)).alias(f"number_{x}") for x in "abc"], T.trim_number(C("c")).alias("trimmed"))


def token_overlap(spark, sf):
    """TXT-5: overlap of each user turn with the reply that follows."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", T.tokens(C("text")).alias("t"))
    reply = turns.select("conv_id", (C("turn") - 1).alias("turn"), C("t").alias("r"))
    pairs = turns.filter("role = 'user'").join(reply, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", F.round(T.jaccard(C("t"), C("r")), 6).alias("jaccard"))


def incident_fields(spark, sf):
    """TXT-13/26/30 and friends over user turns."""
    u = table(spark, sf, "conversations").filter("role = 'user'")
    return u.select(
        "conv_id", "turn", X.title_of(C("text")).alias("title"), X.severity_of(C("text")).alias("severity"),
        X.infer_scenario(C("text")).alias("scenario"),
    )


def url_features(spark, sf):
    """TXT-15: page addresses as provenance."""
    return table(spark, sf, "pages").select("page_id", X.feature_from_source(C("url")).alias("feature"))


def code_labels(spark, sf):
    """TXT-42 over event types and order priorities."""
    e = table(spark, sf, "events").select(F.upper("event_type").alias("code"))
    p = table(spark, sf, "orders").select(F.upper(F.replace("o_orderpriority", F.lit("-"), F.lit("_"))).alias("code"))
    return e.unionByName(p).groupBy("code", T.code_label(C("code")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def _sentences(spark, sf, *more: Column) -> DataFrame:
    """One report sentence per line item, its wording chosen by the line's values; ``more``: other columns of the line."""
    li = table(spark, sf, "lineitem")
    pct = F.round(C("l_discount") * 100).cast("int").cast("string")
    tax = F.round(C("l_tax") * 100).cast("int").cast("string")
    qty = C("l_quantity").cast("int").cast("string")
    kind = F.pmod(C("l_orderkey") + C("l_linenumber"), F.lit(8))
    s = (
        F.when(kind == 0, F.concat(F.lit("Checkout failed when a "), pct, F.lit("% discount was applied, quantity was "), qty))
        .when(kind == 1, F.concat(F.lit("The cart quantity = "), qty, F.lit(" and tax rate of "), tax, F.lit(" timed out after a retry")))
        .when(kind == 2, F.concat(F.lit("Order total was invalid, page size: "), qty, F.lit(", coupon is expired")))
        .when(kind == 3, F.concat(F.lit("Refund of "), qty, F.lit(" percent was rejected because the email is null")))
        .when(kind == 4, F.concat(F.lit("Two concurrent requests with session_token missing value and items "), qty))
        .when(kind == 5, F.concat(F.lit("Empty cart, tax "), tax, F.lit("% of the price and shipping = "), qty, F.lit(" exceeded the maximum")))
        .when(kind == 6, F.concat(F.lit("A user without permission saw status "), qty, F.lit(" in staging; unknown username")))
        .otherwise(F.concat(F.lit("Retry count of "), qty, F.lit(" followed by a server error in the xml parser, discount at "), pct, F.lit(" pct")))
    )
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", s.alias("sentence"), *more)


LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def sentence_signals(spark, sf):
    s = _sentences(spark, sf)
    distinct = s.select("sentence").distinct().select("sentence", joined(X.detect_signals(C("sentence"))).alias("signals"))
    return s.join(distinct, "sentence").select(*LINE, "signals")


def sentence_conditions(spark, sf):
    s = _sentences(spark, sf)
    distinct = s.select("sentence").distinct().select("sentence", X.pairs_text(X.extract_conditions(C("sentence")), "=", sep=";").alias("conditions"))
    return s.join(distinct, "sentence").select(*LINE, "conditions")


def synonym_expansion(spark, sf):
    """TXT-3: how many words each sentence has with its synonyms."""
    s = _sentences(spark, sf)
    toks = s.select("sentence").distinct().withColumn("t", T.tokens(C("sentence")))
    rows = toks.select("sentence", F.size(F.array_distinct("t")).cast("bigint").alias("n_tokens"), F.size(T.expand(C("t"))).cast("bigint").alias("n_expanded"))
    return s.join(rows, "sentence").groupBy("n_tokens", "n_expanded").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------- retrieval


def _docs(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", C("lang").alias("feature"))


def _queries(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(C("item_id").alias("query_id"), "text")


def term_statistics(spark, sf):
    docs = _docs(spark, sf)
    terms = ix.doc_terms(docs)
    return ix.term_stats(terms, ix.corpus_stats(docs, terms)).select(
        "term", "df", F.round("idf", 6).alias("idf"), F.round("share", 6).alias("share"), "is_distinctive"
    )


def postings(spark, sf):
    return ix.doc_terms(_docs(spark, sf)).select("doc_id", "term", "tf", "doc_length")


def _lexical(spark, sf):
    docs, queries = _docs(spark, sf), _queries(spark, sf)
    return *ix.lexical_index(docs), materialise(ret.query_terms(queries))


def _best_20(scores: DataFrame) -> DataFrame:
    top = ret.best_per_query(scores.withColumn("score", F.round("bm25", 6)), 20, score="score")
    return top.select("query_id", "doc_id", "score", C("rank").cast("bigint").alias("rank"))


def bm25_top(spark, sf):
    """JON-1/AGG-2: the 20 best documents of each query."""
    terms, corpus, stats, words = _lexical(spark, sf)
    return _best_20(ret.best_scores(terms, stats, corpus, words, 20))


def bm25_top_by_bounds(spark, sf):
    """JON-1/AGG-2: the same, reached through impact blocks and bounds whatever the size."""
    terms, corpus, stats, words = _lexical(spark, sf)
    return _best_20(ret.best_scores(terms, stats, corpus, words, 20, plain_postings=0))


def lexical_maxima(spark, sf):
    """RNK-2."""
    terms, corpus, stats, words = _lexical(spark, sf)
    return ret.lexical_best(ret.bm25_scores(terms, stats, corpus, words)).select("query_id", F.round("best", 6).alias("best"), "n_hits")


def bucket_weights(spark, sf):
    docs = _docs(spark, sf)
    buckets = ix.raw_buckets(ix.weighted_features(docs))
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    return ix.bucket_idf(buckets, n).select(C("bucket").cast("bigint").alias("bucket"), F.round("idf", 6).alias("idf"))


def _vector_hits(spark, sf, k, **how):
    docs, queries = _docs(spark, sf), _queries(spark, sf)
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    buckets = materialise(ix.raw_buckets(ix.weighted_features(docs)))
    idf = materialise(ix.bucket_idf(buckets, n))
    vectors = ix.packed_vectors(ix.weighted_vectors(buckets, idf, n))
    return ret.vector_top_k(vectors, ret.query_vectors(queries, idf, n), k, **how)


def text_vector_top(spark, sf):
    """JON-2 over hashed TF-IDF vectors."""
    return _vector_hits(spark, sf, 10).select("query_id", "doc_id", F.round("similarity", 5).alias("similarity"))


def text_vector_top_by_bounds(spark, sf):
    """JON-2: the same through groups and bounds whatever the size."""
    return _vector_hits(spark, sf, 10, plain_rows=0).select("query_id", "doc_id", F.round("similarity", 5).alias("similarity"))


def _embedding_hits(spark, sf, **how):
    e = table(spark, sf, "embeddings")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    v = e.select(C("vec_id").alias("doc_id"), F.transform("embedding", lambda x, i: i).alias("buckets"), C("embedding"), norm.alias("n")).select(
        "doc_id", "buckets", F.transform("embedding", lambda x: x.cast("double") / C("n")).alias("weights"))
    top = ret.vector_top_k(v, v.withColumnRenamed("doc_id", "query_id"), 10, **how)
    return top.select("query_id", "doc_id", F.round("similarity", 6).alias("similarity"))


def embedding_top(spark, sf):
    """JON-2/RNK-1: the ten nearest vectors of every labelled embedding."""
    return _embedding_hits(spark, sf)


def embedding_top_by_bounds(spark, sf):
    """JON-2/RNK-1: the same through groups and bounds whatever the size."""
    return _embedding_hits(spark, sf, plain_rows=0)


def _hybrid(spark, sf, **how):
    queries = _queries(spark, sf)
    counted = ix.counted_docs(_docs(spark, sf), ret.query_terms(queries))
    index = ix.build_index(_docs(spark, sf), learn=False, counted=counted)
    incidents = queries.select("query_id", F.lit("en").alias("i_feature"), T.strings([]).alias("i_keys"), T.strings([]).alias("i_signals"))
    docs = _docs(spark, sf).select("doc_id", C("feature").alias("t_feature"), T.strings([]).alias("t_keys"), T.strings([]).alias("t_signals"))
    kept, _ = ret.retrieve(index, queries, incidents, docs, lists=counted, **how)
    return kept.select("query_id", "doc_id", "score", "feature_match")


def hybrid_candidates(spark, sf):
    """RNK-1..5 end to end: benchmark items against documents."""
    return _hybrid(spark, sf)


def hybrid_candidates_by_bounds(spark, sf):
    """RNK-1..5: the same, with the bounds of the lexical half whatever the size."""
    return _hybrid(spark, sf, plain_postings=0)


def learned_vocabulary(spark, sf):
    words = ix.feature_words(_docs(spark, sf).withColumn("text", F.concat_ws(" ", "text", "feature")))
    return ix.vocabulary(words)[0].select("feature", "term", "weight")


def _classified(spark, sf) -> DataFrame:
    docs = _docs(spark, sf)
    words = materialise(ix.counted_words(docs))  # texts are split once
    weights, counts = ix.vocabulary(ix.with_feature_names(words, docs))
    return ix.classify(docs, weights, counts, words=words)


def classified_documents(spark, sf):
    return _classified(spark, sf)


def classification_matrix(spark, sf):
    """AGG-18's matrix: language by learned feature."""
    both = _classified(spark, sf).withColumnRenamed("feature", "guess").join(_docs(spark, sf).select("doc_id", "feature"), "doc_id")
    return both.groupBy("feature").pivot("guess", ["en", "fr", "de", "es", "Unknown"]).count().na.fill(0)


# ------------------------------------------------------------- stored analyses and streams


def _analyses(spark, sf) -> DataFrame:
    verdict = T.lookup(C("event_type"), {"purchase": "COVERED", "view": "PARTIAL", "error": "NOT_COVERED"}, "NOT_COVERED")
    return table(spark, sf, "events").select(
        C("user_id").alias("incident_id"), C("event_id").alias("analysis_id"), verdict.alias("coverage"), "event_type", "ts",
        F.round(C("value") / 100, 4).alias("confidence"),
    )


def latest_analyses(spark, sf):
    return hist.latest_analysis(_analyses(spark, sf)).select("incident_id", "analysis_id", "coverage", "confidence")


def coverage_counts(spark, sf):
    return hist.coverage_counts(hist.latest_analysis(_analyses(spark, sf)))


GAP_OF_EVENT = {"signup": "MISSING_FIELD", "view": "WEAK_ASSERTION", "error": "ERROR_HANDLING", "click": "CONCURRENCY", "purchase": "BOUNDARY_CONDITION"}


def _event_observations(events: DataFrame) -> DataFrame:
    gap = T.lookup(C("event_type"), GAP_OF_EVENT, "MISSING_TEST")
    severity = F.when(C("value") >= 50, F.lit("CRITICAL")).when(C("value") >= 20, F.lit("HIGH")).otherwise(F.lit("LOW"))
    return events.select(
        C("user_id").cast("string").alias("incident_id"), gap.alias("gap_type"), T.family_key(gap).alias("family_key"),
        F.concat(F.lit("Team "), F.pmod("user_id", F.lit(7)).cast("string")).alias("feature"), severity.alias("severity"),
        T.lookup(C("event_type"), {"error": "NOT_COVERED", "click": "NOT_COVERED"}, "PARTIAL").alias("coverage"),
        C("event_id").alias("arrival"),
    )


def event_patterns(spark, sf):
    return _pattern_columns(pat.recurring_patterns(_event_observations(table(spark, sf, "events"))))


def _event_stream(spark, sf) -> tuple[DataFrame, str]:
    """The events as a stream of four files in their order, one a batch, and the folder of the run."""
    import uuid

    from gapengine.operators.sizing import shared_folder

    run = f"{shared_folder(spark)}/intake-{uuid.uuid4().hex}"
    events = table(spark, sf, "events")
    low, high = events.agg(F.coalesce(F.min("event_id"), F.lit(0)), F.coalesce(F.max("event_id"), F.lit(0))).first()
    step = (high - low) // 4 + 1
    for k in range(4):  # one after another: a file source reads by time of writing
        events.filter(F.floor((C("event_id") - low) / step) == k).coalesce(1).write.mode("append").parquet(f"{run}/events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{run}/events")
    return stream, run


def streamed_patterns(spark, sf):
    """STR-1/STR-2: the same patterns, reached by streaming the events in."""
    from gapengine.streaming.intake import current_patterns, start_intake

    stream, run = _event_stream(spark, sf)
    q = start_intake(stream, _event_observations, f"{run}/observations", f"{run}/patterns", f"{run}/checkpoint")
    q.awaitTermination()
    return _pattern_columns(current_patterns(spark, f"{run}/patterns"))


def streamed_recurrence(spark, sf):
    """STR-3: the counts of ``event_recurrence``, as each user's first event comes in."""
    from gapengine.streaming.recurrence import recurrence_so_far, start_recurrence

    stream, run = _event_stream(spark, sf)
    facts = _event_observations(stream).withColumn("signals", T.strings(["retry", "error_handling"]))
    start_recurrence(facts, f"{run}/recurrence", f"{run}/checkpoint").awaitTermination()
    return recurrence_so_far(spark, f"{run}/recurrence")


def streamed_trend(spark, sf):
    """STR-3: gaps of each family and day; the events come in order, so none is late."""
    from gapengine.streaming.trends import current_trend, start_trend

    stream, run = _event_stream(spark, sf)
    gap = T.lookup(C("event_type"), GAP_OF_EVENT, "MISSING_TEST")
    gaps = stream.select("ts", T.family_key(gap).alias("family_key"), T.lookup(C("event_type"), {"error": "NOT_COVERED", "click": "NOT_COVERED"}, "PARTIAL").alias("coverage"))
    start_trend(gaps, f"{run}/trend", f"{run}/checkpoint").awaitTermination()
    return current_trend(spark, f"{run}/trend").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "family_key", "n", "n_uncovered")


def family_recurrence(spark, sf):
    """AGG-13."""
    return hist.recurrence_counts(_event_observations(table(spark, sf, "events")))


def event_recurrence(spark, sf):
    """RNK-7: earlier users already hit by the family each user's events imply."""
    obs = _event_observations(table(spark, sf, "events"))
    incidents = obs.groupBy("incident_id").agg(F.min("arrival").alias("arrival")).withColumn("signals", T.strings(["retry", "error_handling"]))
    return hist.recurrence_at_arrival(incidents, obs)


def family_page(spark, sf):
    """JON-10: the twelve newest incidents of one family."""
    obs = _event_observations(table(spark, sf, "events")).withColumnRenamed("arrival", "analysis_id")
    incidents = obs.groupBy("incident_id").agg(F.max("feature").alias("feature"))
    page = hist.family_incidents(obs.select("analysis_id", "family_key"), obs.select("analysis_id", "incident_id"), incidents, "CONCURRENCY", 12)
    return page.select("incident_id", "analysis_id", "feature")


def status_updates(spark, sf):
    """SNK-8: order states as status changes of recommendations (parts)."""
    recs = table(spark, sf, "part").select(C("p_partkey").alias("recommendation_id"), F.lit("PROPOSED").alias("status"))
    code = T.lookup(C("l_returnflag"), {"A": "accepted", "N": "ignored"}, "someday")
    updates = table(spark, sf, "lineitem").select(
        C("l_partkey").alias("recommendation_id"), code.alias("status"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("update_seq"))
    return hist.apply_status_updates(recs, updates)


def dashboard(spark, sf):
    """AGG-19 over events as analyses and parts as the catalogue."""
    analyses = _analyses(spark, sf)
    obs = _event_observations(table(spark, sf, "events"))
    tests = table(spark, sf, "part").select(C("p_type").alias("feature"), C("p_brand").alias("framework"))
    return report.dashboard(analyses.select("incident_id").distinct(), analyses, obs, tests, pat.recurring_patterns(obs))


def recent_runs(spark, sf):
    """LIM-4."""
    return report.recent(table(spark, sf, "events").select("event_id", "event_type", "ts"), "ts", 6, "event_id")


def incident_page(spark, sf):
    """FLT-2/LIM-2: customers as incidents with their latest order as analysis."""
    incidents = table(spark, sf, "customer").select(
        C("c_custkey").alias("incident_id"), C("c_name").alias("title"), C("c_mktsegment").alias("feature"), C("c_name").alias("description"))
    analyses = table(spark, sf, "orders").select(
        C("o_custkey").alias("incident_id"), C("o_orderkey").alias("analysis_id"),
        T.lookup(C("o_orderstatus"), {"F": "COVERED", "O": "NOT_COVERED"}, "PARTIAL").alias("coverage"))
    found = cat.search_incidents(incidents, hist.latest_analysis(analyses), coverage="COVERED", query="9")
    return cat.page(found, [F.desc("incident_id")], 25, 5).select("incident_id", "title", "feature", "coverage", "analysis_id")


def proposed_facts(spark, sf):
    """DEC-18: every turn is offered its own words and those of the turn before as quotes; both count where they stand in it."""
    docs = table(spark, sf, "conversations").select(
        F.concat_ws("-", C("conv_id").cast("string"), C("turn").cast("string")).alias("incident_id"), "text", "role",
        C("conv_id"), "turn")
    incidents = docs.select("incident_id", F.lit("Unknown").alias("feature"), X.no_pairs().alias("conditions"), T.strings([]).alias("signals"), C("text").alias("description"))
    before = docs.select("conv_id", (C("turn") + 1).alias("turn"), C("text").alias("quote"))
    own = docs.select("incident_id", C("text").alias("quote"), C("role").alias("name"), F.lit(1).alias("ord"))
    other = docs.join(before, ["conv_id", "turn"]).select("incident_id", "quote", F.concat(C("role"), F.lit(" before")).alias("name"), F.lit(2).alias("ord"))
    facts = own.unionByName(other).select("incident_id", F.lit("condition").alias("kind"), "name", F.lit("x").alias("value"), "quote", "ord")
    offered = docs.select("incident_id", F.lit("feature").alias("kind"), C("role").alias("name"), F.lit(None).cast("string").alias("value"), F.lit("").alias("quote"), F.lit(0).alias("ord"))
    known = docs.filter("role <> 'system'").select(C("role").alias("feature"))
    merged = merge_proposed_facts(incidents, facts.unionByName(offered), known)
    return merged.select("incident_id", "feature", X.pairs_text(C("conditions"), "=", sep=";").alias("conditions"))


QUERIES = [
    coverage_verdicts, confidence_scores, recurrence_on_arrival, risk_scores, recurring_patterns, gap_pattern_links,
    verdict_mix, catalogue_statistics, evidence_by_condition, missing_conditions, tested_ranges,
    boundary_recommendations, return_profiles, unique_test_ids, document_duplicates, cross_source_duplicates,
    catalogue_search, normalized_documents, document_tokens, document_bigrams, document_keywords, document_numbers,
    value_numbers, token_overlap, incident_fields, url_features, code_labels, sentence_signals, sentence_conditions,
    synonym_expansion, term_statistics, postings, bm25_top, bm25_top_by_bounds, lexical_maxima, bucket_weights, text_vector_top,
    text_vector_top_by_bounds, embedding_top, embedding_top_by_bounds, hybrid_candidates, hybrid_candidates_by_bounds, learned_vocabulary, classified_documents, classification_matrix,
    latest_analyses, coverage_counts, event_patterns, streamed_patterns, streamed_recurrence, streamed_trend, family_recurrence, event_recurrence,
    family_page, status_updates, dashboard, recent_runs, incident_page, proposed_facts,
    *explained.QUERIES, *endtoend.QUERIES, *records.QUERIES, *persisted.QUERIES, *maintained.QUERIES,
]
