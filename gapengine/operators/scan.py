"""Lexical search where the texts are: each text's counted words meet the words of all queries in its task.

For queries that come once, scoring the words of a text costs less than bringing postings together.  Only
documents that can still be among a query's best leave their task: first those above the running floor of their
task, which set a threshold, then those that reach it.  Exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gapengine import fixed
from gapengine.operators.impact import SLACK
from gapengine.operators.sizing import BROADCAST_ROWS

# Scores held at a time, and what their words add up from.
SCORES = 500_000
PARTS = 4_000_000


class Asked(NamedTuple):
    """The words of all queries, which every task holds: at most ``BROADCAST_ROWS``."""

    terms: pa.Array      # different words
    idf: np.ndarray
    first: np.ndarray    # where each word's queries start in ``query`` and ``weight``
    query: np.ndarray    # number of the query
    weight: np.ndarray
    keys: pa.Array       # the queries, by number
    average: float


def asked_words(words: DataFrame, stats: DataFrame, corpus: DataFrame, key: str = "query_id", rows: int = BROADCAST_ROWS) -> Asked | None:
    """Queries with words in the catalogue, or None where these are more than ``rows`` words."""
    weighted = words.filter(F.col(key).isNotNull()).join(stats.select("term", "idf"), "term").select(key, "term", "weight", "idf")
    if weighted.count() > rows:
        return None
    table = weighted.orderBy("term", key).toArrow().combine_chunks()
    term, keys = (pa.concat_arrays(table.column(c).chunks or [pa.array([], table.schema.field(c).type)]).dictionary_encode() for c in ("term", key))
    number = term.indices.to_numpy()
    first = np.searchsorted(number, np.arange(len(term.dictionary) + 1))
    idf, weight = (table.column(c).to_numpy() for c in ("idf", "weight"))
    return Asked(term.dictionary, idf[first[:-1]], first, keys.indices.to_numpy(), weight, keys.dictionary, corpus.select("avg_length").first()[0])


def _scores(asked: Asked, rows: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids of some rows and the scores of each with each query, 0 where they share no word."""
    terms = rows.column("terms")
    number = pc.index_in(terms.flatten(), value_set=asked.terms).fill_null(-1).to_numpy()
    doc = np.repeat(np.arange(rows.num_rows), pc.list_value_length(terms).to_numpy())
    at = number >= 0
    number, doc, tf = number[at], doc[at], rows.column("tfs").flatten().to_numpy()[at].astype(np.float64)
    times = asked.first[number + 1] - asked.first[number]
    if times.sum() > PARTS and rows.num_rows > 1:
        half = rows.num_rows // 2
        yield from _scores(asked, rows.slice(0, half))
        yield from _scores(asked, rows.slice(half))
        return
    k1, b = fixed.BM25_K1, fixed.BM25_B
    relative = np.maximum(rows.column("doc_length").to_numpy(), 1) / (asked.average if asked.average > 0 else 1.0)
    impact = asked.idf[number] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * relative[doc]))
    place = np.arange(times.sum()) + np.repeat(asked.first[number] - (np.cumsum(times) - times), times)
    n = len(asked.keys)
    parts = asked.weight[place] * np.repeat(impact, times)
    scores = np.bincount(np.repeat(doc, times) * n + asked.query[place], weights=parts, minlength=rows.num_rows * n)
    yield rows.column("doc_id"), scores.reshape(rows.num_rows, n)


def _emitted(asked: Asked, key: str, chosen, *more: str):
    """Rows (key, doc_id, bm25) of the pairs that ``chosen`` names by their place in the scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pick = chosen()
        step = max(1, SCORES // max(1, len(asked.keys)))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                rows = batch.slice(start, step)
                done = 0
                for ids, scores in _scores(asked, rows):
                    d, q = pick(scores, *[rows.column(c).slice(done, len(ids)) for c in more])
                    done += len(ids)
                    yield pa.record_batch([asked.keys.take(pa.array(q)), ids.take(pa.array(d)), pa.array(scores[d, q], pa.float64())], [key, "doc_id", "bm25"])

    return run


def _over_lists(lists: DataFrame, asked: Asked, words: DataFrame, key: str, chosen, *more: str) -> DataFrame:
    kinds = words.schema[key].dataType.simpleString(), lists.schema["doc_id"].dataType.simpleString()
    found = lists.select("doc_id", "doc_length", "terms", "tfs", *more)
    return found.mapInArrow(_emitted(asked, key, chosen, *more), "{} {}, doc_id {}, bm25 double".format(key, *kinds))


def _best(k: int):
    """Picks a slice's k best of each query that are above the k best seen before."""

    def start():
        floor = None

        def pick(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            nonlocal floor
            floor = np.zeros(scores.shape[1]) if floor is None else floor
            if len(scores) <= k:
                return np.nonzero(scores > floor)
            top = np.argpartition(-scores, k - 1, axis=0)[:k]
            found = np.take_along_axis(scores, top, axis=0)
            rank, q = np.nonzero(found > floor)
            floor = np.maximum(floor, found.min(axis=0))
            return top[rank, q], q

        return pick

    return start


def best_listed(lists: DataFrame, asked: Asked, words: DataFrame, k: int, key: str = "query_id") -> DataFrame:
    """JON-1/AGG-2: full (key, doc_id, bm25) of documents that hold the k best scores of each query, and some more.

    ``lists``: doc_id, doc_length, terms, tfs."""
    return _over_lists(lists, asked, words, key, _best(k))


def listed_above(lists: DataFrame, asked: Asked, words: DataFrame, thresholds: DataFrame, key: str = "query_id") -> DataFrame:
    """JON-1/AGG-2: full (key, doc_id, bm25) of every document that shares a word and reaches its query's threshold, 0 if it has none."""
    least = dict(map(tuple, thresholds.select(key, "threshold").collect()))  # a number for each of the queries that the tasks hold
    need = np.array([least.get(q, 0.0) - SLACK for q in asked.keys.to_pylist()])
    return _over_lists(lists, asked, words, key, lambda: lambda scores: np.nonzero((scores > 0) & (scores >= need)))


def listed_pairs(lists: DataFrame, asked: Asked, words: DataFrame, pairs: DataFrame, key: str = "query_id") -> DataFrame:
    """JON-1/AGG-2: full (key, doc_id, bm25) of the given pairs that share a word."""
    wanted = lists.join(pairs.select(key, "doc_id").distinct().groupBy("doc_id").agg(F.collect_list(key).alias("_keys")), "doc_id")

    def pick(scores: np.ndarray, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        q = pc.index_in(keys.flatten(), value_set=asked.keys).fill_null(-1).to_numpy()
        d = np.repeat(np.arange(len(keys)), pc.list_value_length(keys).to_numpy())
        some = (q >= 0) & (scores[d, q] > 0)
        return d[some], q[some]

    return _over_lists(wanted, asked, words, key, lambda: pick, "_keys")
