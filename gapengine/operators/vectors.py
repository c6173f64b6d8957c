"""Exact vector search that visits only the parts of a catalogue whose bound can still enter a query's best k.

Vectors are grouped around centres; a group larger than ``PART_ROWS`` lies in
several parts, so copies of one text are no hot spot.  For each group the index
keeps its centre's direction, how far along it its vectors reach at least and
at most, and how far across at most.  With q split the same way, no vector of the
group scores more than

    max(q_along * low, q_along * high) + |q_across| * across,

which holds for vectors of any length.  A query first visits the groups it points
at until k vectors are seen; their k-th score is a threshold, and only groups
whose bound reaches it are visited then.  Queries travel to the parts; no vector
is copied for a block of queries.  How many parts are left out depends on how
well the vectors cluster, the result doesn't.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData, Window, functions as F

from gapengine.operators.sizing import blocks_for, materialise

# Vectors of a part and queries of a block: their product takes some 16 MB.
PART_ROWS = 2_048
QUERY_BLOCK = 1_000
# The centres, the only thing every task holds, are at most this many; they are
# fitted on some ``SAMPLE`` vectors, twice that at most.  All vectors are indexed.
CENTRES = 1_024
SAMPLE = 8_192
ROUNDS = 5
# Up to so many vectors all parts together are less work than centres and visits.
PLAIN_ROWS = 50_000
# Queries are sent to their groups; all copies together are at most this many times the rows of both sides.
COPIES = 4
# Queries one task meets a part with; a part goes to as many tasks as that takes.
TASK_QUERIES = 32_000
# A part never holds more than this many bytes of buckets and weights.
PART_BYTES = 64_000_000
# Scores held at a time.
SCORES = 2_000_000
# More than what rounding can add to a bound or a score.
SLACK = 1e-7


class VectorIndex(NamedTuple):
    """Parts of vectors and the bounds of their groups."""

    parts: DataFrame   # group, part, rows ARRAY<STRUCT<doc_id, buckets, weights>>
    groups: DataFrame  # group, n, n_parts, low, high, across
    centres: np.ndarray  # directions of the groups, one row each


def _dense(buckets: pa.ListArray, weights: pa.ListArray, width: int = 0) -> np.ndarray:
    """Sparse rows as a matrix of at least ``width`` columns."""
    sizes = np.nan_to_num(buckets.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    at = buckets.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), max(width, 1 + (int(at.max()) if len(at) else 0))))
    out[np.repeat(np.arange(len(sizes)), sizes), at] = weights.flatten().to_numpy(zero_copy_only=False)
    return out


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = min(a.shape[1], b.shape[1])
    return a[:, :width], b[:, :width]


def fit_centres(sample: np.ndarray, n: int) -> np.ndarray:
    """Directions of ``n`` groups: rounds of assignment and averaging, starting from the first vectors."""
    lengths = np.linalg.norm(sample, axis=1, keepdims=True)
    units = sample[lengths[:, 0] > 0] / lengths[lengths > 0][:, None]
    if not len(units):
        return np.zeros((1, sample.shape[1]))
    different: dict[bytes, int] = {}
    for at, row in enumerate(np.round(units, 9)):
        different.setdefault(row.tobytes(), at)
        if len(different) == n:
            break
    centres = units[list(different.values())]
    for _ in range(ROUNDS):
        nearest = (units @ centres.T).argmax(axis=1)
        sums = (nearest == np.arange(len(centres))[:, None]).astype(np.float64) @ units
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return centres


def _split(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centre of each vector, and its lengths along and across it."""
    a, b = _same_width(vectors, centres)
    scores = a @ b.T
    group = scores.argmax(axis=1)
    along = scores[np.arange(len(vectors)), group]
    across = np.sqrt(np.maximum((vectors * vectors).sum(axis=1) - along * along, 0.0))
    return group, along, across


def _assigned(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, along, across = _split(_dense(batch.column("buckets"), batch.column("weights"), centres.shape[1]), centres)
            more = [pa.array(group.astype(np.int32)), pa.array(along), pa.array(across)]
            yield pa.record_batch([*batch.columns, *more], [*batch.schema.names, "group", "along", "across"])

    return run


def build_vector_index(
    vectors: DataFrame, rows_per_group: int = 512, part_rows: int = PART_ROWS, plain_rows: int = PLAIN_ROWS, n_queries: int = 0
) -> VectorIndex:
    """The index of ``(doc_id, buckets, weights)``; every vector is in exactly one part.

    ``plain_rows`` vectors or fewer are one group, which every query visits.  Where many
    queries (``n_queries``) will come, groups and parts are fewer and larger, so that
    sending queries to them stays in proportion to the rows."""
    vectors = materialise(vectors.select("doc_id", "buckets", "weights"))
    n, n_numbers = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("buckets")), F.lit(0))).first()
    most = max(1, COPIES * (n + n_queries) // max(1, n_queries))
    part_rows = max(part_rows, min(-(-n // most), PART_BYTES * n // max(1, 12 * n_numbers)))
    if n <= plain_rows:
        one = F.lit(0).alias("group")
        parts = vectors.groupBy(one, F.pmod(F.xxhash64("doc_id"), F.lit(-(-n // part_rows) or 1)).cast("int").alias("part"))
        groups = vectors.sparkSession.range(1).select(
            one, F.lit(n).alias("n"), *[F.lit(0.0).alias(c) for c in ("low", "high", "across")], F.lit(-(-n // part_rows) or 1).alias("n_parts")
        )
        return VectorIndex(materialise(_packed(parts)), groups, np.zeros((1, 1)))
    # About ``SAMPLE`` of them, for the centres only.
    few = vectors.filter(F.pmod(F.xxhash64("doc_id"), F.lit(-(-n // SAMPLE) or 1)) == 0).limit(2 * SAMPLE)
    sample = few.select("buckets", "weights").toArrow().combine_chunks()
    dense = _dense(*[c.chunk(0) for c in sample.columns]) if sample.num_rows else np.zeros((0, 1))
    centres = fit_centres(dense, min(CENTRES, most, max(1, n // rows_per_group)))
    schema = vectors.schema.simpleString()[7:-1].replace(":", " ")
    placed = materialise(vectors.mapInArrow(_assigned(centres), f"{schema}, group int, along double, across double"))
    groups = materialise(
        placed.groupBy("group").agg(
            F.count(F.lit(1)).alias("n"), F.min("along").alias("low"), F.max("along").alias("high"), F.max("across").alias("across")
        ).withColumn("n_parts", F.ceil(F.col("n") / part_rows).cast("int"))
    )
    part = F.pmod(F.xxhash64("doc_id"), F.col("n_parts")).cast("int")
    # At most ``CENTRES`` rows; a part holds about ``part_rows`` vectors.
    parts = placed.join(F.broadcast(groups.select("group", "n_parts")), "group").groupBy("group", part.alias("part"))
    return VectorIndex(materialise(_packed(parts)), groups, centres)


def _packed(parts: GroupedData) -> DataFrame:
    return parts.agg(F.array_sort(F.collect_list(F.struct("doc_id", "buckets", "weights"))).alias("rows"))


# ------------------------------------------------------------------------ visits


def _bounds(queries: np.ndarray, index: pd.DataFrame, centres: np.ndarray) -> np.ndarray:
    """Upper bound of the score of each query with each group of ``index``."""
    a, b = _same_width(queries, centres[index["group"].to_numpy()])
    along = a @ b.T
    across = np.sqrt(np.maximum((queries * queries).sum(axis=1, keepdims=True) - along * along, 0.0))
    reach = np.maximum(along * index["low"].to_numpy(), along * index["high"].to_numpy())
    return reach + across * index["across"].to_numpy() + SLACK


def _planned(index: pd.DataFrame, centres: np.ndarray, key: str, k: int):
    """Groups each query visits: the best ones until k vectors are seen, or, with a threshold, all others that can reach it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, sizes = index["group"].to_numpy(), index["n"].to_numpy()
        for batch in batches:
            bounds = _bounds(_dense(batch.column("buckets"), batch.column("weights"), centres.shape[1]), index, centres)
            order = np.argsort(-bounds, axis=1, kind="stable")
            seen = np.cumsum(sizes[order], axis=1) - sizes[order]
            first = np.zeros_like(bounds, dtype=bool)
            np.put_along_axis(first, order, seen < k, axis=1)
            chosen = first
            if "threshold" in batch.schema.names:
                floor = batch.column("threshold").fill_null(-np.inf).to_numpy(zero_copy_only=False)
                chosen = ~first & (bounds >= floor[:, None])
            q, g = np.nonzero(chosen)
            yield pa.record_batch([batch.column(key).take(pa.array(q)), pa.array(groups[g], pa.int32())], [key, "group"])

    return run


def planned_visits(index: VectorIndex, queries: DataFrame, k: int, key: str = "query_id", thresholds: DataFrame | None = None) -> DataFrame:
    """(key, group): the first visits, or with ``thresholds`` (key, threshold) the remaining ones."""
    bounds = index.groups.toPandas()  # at most ``CENTRES`` rows
    asked = queries.select(key, "buckets", "weights")
    if thresholds is not None:
        asked = asked.join(thresholds, key, "left")
    kind = queries.schema[key].dataType.simpleString()
    return asked.mapInArrow(_planned(bounds, index.centres, key, k), f"{key} {kind}, group int")


def _best_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the k best of each row, ties by column; rounded so that equal vectors tie."""
    n, width = scores.shape
    # The k-th best maximum of strips is at most the k-th best score, and far less has to be ordered for it.
    strip = max(1, min(64, width // (4 * k)))
    across = width // strip
    tops = scores[:, : strip * across].reshape(n, strip, across).max(axis=1)
    tops = scores if np.isnan(tops).any() else tops
    floor = np.round(-np.partition(-tops, k - 1, axis=1)[:, k - 1], 9)
    q, d = np.nonzero(scores >= (floor - 1e-9)[:, None])
    found = np.round(scores[q, d], 9)
    order = np.lexsort((d, -found, q))
    q, d, found = q[order], d[order], found[order]
    first = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[first], d[first], found[first]


def _visited(key: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                # Rows lie in order of their ids.
                rows, every = (pa.concat_arrays([batch.column(c)[at].values]) for c in (0, 1))
                right = _dense(rows.field("buckets"), rows.field("weights"))
                step = max(1, SCORES // len(right))
                for start in range(0, len(every), step):
                    asked = every.slice(start, step)
                    # Fields of a slice are taken through flatten, which minds its offset.
                    names = [f.name for f in asked.type]
                    fields = dict(zip(names, asked.flatten()))
                    a, b = _same_width(_dense(fields["buckets"], fields["weights"]), right)
                    q, d, found = _best_of(a @ b.T, min(k, len(right)))
                    yield pa.record_batch(
                        [fields[key].take(pa.array(q)), rows.field("doc_id").take(pa.array(d)), pa.array(found)], [key, "doc_id", "similarity"]
                    )

    return run


def visit(index: VectorIndex, queries: DataFrame, visits: DataFrame, k: int, key: str = "query_id", block: int = QUERY_BLOCK) -> DataFrame:
    """(key, doc_id, similarity): the k best of every part that each query visits."""
    kind, doc = queries.schema[key].dataType.simpleString(), index.parts.schema["rows"].dataType.elementType["doc_id"].dataType.simpleString()
    n = blocks_for(queries.count(), block)
    number = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    shares = blocks_for(n * block, TASK_QUERIES)
    # A block holds about ``block`` queries; each goes to all parts of its group.
    asked = (
        visits.join(queries.select(key, "buckets", "weights"), key).groupBy("group", number.alias("block"))
        .agg(F.collect_list(F.struct(key, "buckets", "weights")).alias("asked"))
        .join(F.broadcast(index.groups.select("group", "n_parts")), "group")  # at most ``CENTRES`` rows
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
        .withColumn("share", F.pmod("block", F.lit(shares)).cast("int"))
    )
    parts = index.parts.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    pairs = parts.join(asked.select("group", "part", "share", "asked"), ["group", "part", "share"])
    return pairs.select("rows", "asked").mapInArrow(_visited(key, k), f"{key} {kind}, doc_id {doc}, similarity double")


def _ranked(found: DataFrame, k: int, key: str) -> DataFrame:
    order: list[Column] = [F.desc("similarity"), F.col("doc_id")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k)


def _scanned(asked: np.ndarray, ids: pa.Array, key: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What a document has to reach: each query's best k-th score of any slice so far.
        floor = np.full(len(ids), -np.inf)
        step = max(1, min(PART_ROWS, SCORES // max(1, len(ids))))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                rows = batch.slice(start, step)
                rows = rows.take(pc.sort_indices(rows.column("doc_id")))  # ties go by id
                a, b = _same_width(asked, _dense(rows.column("buckets"), rows.column("weights"), asked.shape[1]))
                q, d, found = _best_of(a @ b.T, min(k, rows.num_rows))
                if rows.num_rows >= k:
                    np.maximum.at(floor, q[k - 1 :: k], found[k - 1 :: k])
                over = found >= floor[q]
                yield pa.record_batch([ids.take(pa.array(q[over])), rows.column("doc_id").take(pa.array(d[over])), pa.array(found[over])], [key, "doc_id", "similarity"])

    return run


def scan(vectors: DataFrame, queries: DataFrame, k: int, key: str = "query_id") -> DataFrame:
    """JON-2/RNK-1: what ``search`` gives, by meeting every vector with every query where the vectors are.

    For at most ``CENTRES`` queries, which every task holds: less work than finding each vector's centre.  Vectors
    don't move; of a slice, only what may be among a query's best k leaves its task."""
    rows = queries.select(key, "buckets", "weights").toArrow().combine_chunks()
    kind, doc = queries.schema[key].dataType.simpleString(), vectors.schema["doc_id"].dataType.simpleString()
    if not rows.num_rows:
        return vectors.sparkSession.createDataFrame([], f"{key} {kind}, doc_id {doc}, similarity double, rank int")
    ids, buckets, weights = (c.chunk(0) for c in rows.columns)
    found = vectors.select("doc_id", "buckets", "weights").mapInArrow(_scanned(_dense(buckets, weights), ids, key, k), f"{key} {kind}, doc_id {doc}, similarity double")
    return _ranked(found, k, key)


def search(index: VectorIndex, queries: DataFrame, k: int, key: str = "query_id") -> DataFrame:
    """JON-2/RNK-1: exact (key, doc_id, similarity, rank), the k best by inner product, ties by id.

    Similarities are rounded to nine digits.  A query with fewer than k vectors
    in all gets every one."""
    queries = materialise(queries.select(key, "buckets", "weights"))
    if len(index.centres) == 1:
        return _ranked(visit(index, queries, queries.select(key, F.lit(0).alias("group")), k, key), k, key)
    near = materialise(visit(index, queries, planned_visits(index, queries, k, key), k, key))
    kth = _ranked(near, k, key).filter(F.col("rank") == k).select(key, F.col("similarity").alias("threshold"))
    far = visit(index, queries, planned_visits(index, queries, k, key, kth), k, key)
    return _ranked(near.unionByName(far), k, key)
