"""Exact top-k by inner product over a bit-sliced index.

Attributes become integers.  A block of rows holds, for every attribute and
every binary digit of it, one bitmap over the block's rows.  The score of a
query for all rows of a block is a sum of such bitmaps, each at the weight of
its digit times one digit of the query; carry-save adders reduce them to the
score's own bitmaps with bitwise operations on 64 rows at a time.  The best
rows are then picked from the most significant score bitmap downward, and rows
equal in all of them, the boundary, are resolved by their id.  Everything is
integer arithmetic, so the result is exact.

Index blocks and blocks of queries meet pairwise; each pair yields at most k
rows for each query, and those of all blocks are ranked at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from gapengine.llm.common import C, partitions, stored

U = np.uint64


def bit_slices(values: np.ndarray) -> tuple[int, np.ndarray]:
    """(lowest value, bitmaps [digit, attribute, word]) of rows x attributes."""
    n, d = values.shape
    low = int(values.min()) if values.size else 0
    above = (values - low).astype(U)
    digits = max(1, int(above.max()).bit_length()) if values.size else 1
    words = -(-n // 64)
    out = np.zeros((digits, d, words * 8), dtype=np.uint8)
    for s in range(digits):
        packed = np.packbits(((above >> U(s)) & U(1)).astype(np.uint8).T, axis=1, bitorder="little")
        out[s, :, : packed.shape[1]] = packed
    return low, out.view(U)


def _signed_digits(query: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(power, attributes with digit 1, attributes with digit -1): few digits are not 0 in this form."""
    left, power = query.astype(np.int64), 0
    while left.any():
        digit = np.where(left & 1, 2 - (left & 3), 0)
        if digit.any():
            yield power, np.flatnonzero(digit == 1), np.flatnonzero(digit == -1)
        left, power = (left - digit) >> 1, power + 1


def score_bitmaps(low: int, slices: np.ndarray, query: np.ndarray) -> tuple[int, list[np.ndarray]]:
    """(constant, bitmaps by weight): a row's score is the constant plus its bits' weights.

    A digit -1 adds the complements of the attribute's bitmaps; what they are
    too large by goes into the constant.
    """
    digits = slices.shape[0]
    constant = low * int(query.sum())
    columns: dict[int, list[np.ndarray]] = {}
    for power, plus, minus in _signed_digits(query):
        both = np.concatenate([slices[:, plus], ~slices[:, minus]], axis=1)
        constant -= len(minus) * ((1 << digits) - 1) << power
        for s in range(digits):
            columns.setdefault(power + s, []).append(both[s])
    out, weight = [], 0
    while columns:
        rows = np.concatenate(columns.pop(weight, [np.zeros((0, slices.shape[2]), dtype=U)]))
        while len(rows) > 1:
            m = max(1, len(rows) // 3)
            a, b = rows[:m], rows[m : 2 * m]
            half = a ^ b
            carry = a & b
            if len(rows) > 2:
                c = rows[2 * m : 3 * m]
                carry |= half & c
                half ^= c
            rows = np.concatenate([half, rows[3 * m :]])
            columns.setdefault(weight + 1, []).append(carry)
        out.append(rows[0] if len(rows) else np.zeros(slices.shape[2], dtype=U))
        weight += 1
    return constant, out


def top_rows(bitmaps: list[np.ndarray], rows: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest of ``rows`` (a bitmap); earlier positions win ties."""
    sure, open_, n_sure = np.zeros_like(rows), rows, 0
    for bits in reversed(bitmaps):
        high = open_ & bits
        n = n_sure + int(np.bitwise_count(high).sum())
        if n > k:
            open_ = high
            continue
        sure, n_sure = sure | high, n
        open_ = open_ & ~bits
        if n == k:
            break
    chosen = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
    if n_sure < k:
        boundary = np.flatnonzero(np.unpackbits(open_.view(np.uint8), bitorder="little"))
        chosen = np.concatenate([chosen, boundary[: k - n_sure]])
    return chosen


_INDEX = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("low", pa.int64()), ("shape", pa.list_(pa.int64())), ("slices", pa.binary())])
_QUERIES = pa.schema([("qblock", pa.int64()), ("qids", pa.binary()), ("width", pa.int64()), ("values", pa.binary())])
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _rows(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """All rows of a task, ordered by id; shorter vectors are filled with zeros."""
    ids, lists = [np.zeros(0, np.int64)], []
    for batch in batches:
        ids.append(batch.column(0).to_numpy(zero_copy_only=False))
        lists.append(batch.column(1))
    ids = np.concatenate(ids)
    lengths = np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in lists]) if lists else np.zeros(0, int)
    values = np.zeros((len(ids), int(lengths.max()) if len(lengths) else 0), dtype=np.int64)
    if values.size:
        flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in lists])
        values[np.arange(values.shape[1]) < lengths[:, None]] = flat
    order = np.argsort(ids, kind="stable")
    return ids[order], values[order]


def _index_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, values = _rows(batches)
    if len(ids):
        low, slices = bit_slices(values)
        yield pa.RecordBatch.from_pylist(
            [{"block": TaskContext.get().partitionId(), "ids": ids.tobytes(), "low": low, "shape": list(slices.shape), "slices": slices.tobytes()}],
            schema=_INDEX,
        )


def _query_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, values = _rows(batches)
    if len(ids):
        yield pa.RecordBatch.from_pylist(
            [{"qblock": TaskContext.get().partitionId(), "qids": ids.tobytes(), "width": values.shape[1], "values": values.tobytes()}], schema=_QUERIES
        )


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.to_pylist():
                ids = np.frombuffer(pair["ids"], np.int64)
                slices = np.frombuffer(pair["slices"], U).reshape(pair["shape"])
                queries = np.frombuffer(pair["qids"], np.int64)
                values = np.frombuffer(pair["values"], np.int64).reshape(len(queries), pair["width"])
                both = min(slices.shape[1], values.shape[1])
                slices, values = slices[:, :both], values[:, :both]
                full = np.zeros(slices.shape[2] * 64, dtype=np.uint8)
                full[: len(ids)] = 1
                out: tuple[list, list, list] = ([], [], [])
                for query_id, query in zip(queries.tolist(), values, strict=True):
                    own = slice(np.searchsorted(ids, query_id), np.searchsorted(ids, query_id, side="right"))
                    full[own] = 0
                    rows = np.packbits(full, bitorder="little").view(U)
                    full[own] = 1
                    constant, bitmaps = score_bitmaps(pair["low"], slices, query)
                    for row in top_rows(bitmaps, rows, k).tolist():
                        word, bit = divmod(row, 64)
                        out[0].append(query_id)
                        out[1].append(int(ids[row]))
                        out[2].append(constant + sum((int(m[word]) >> bit & 1) << t for t, m in enumerate(bitmaps)))
                yield pa.record_batch([pa.array(x, pa.int64()) for x in out], schema=_FOUND)

    return run


def exact_top_k(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", is_query=None, k: int = 5, scale: int = 256,
    block_rows: int = 16_384, block_queries: int = 256,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the highest integer inner product for every query.

    Components become ``floor(scale * x)``; candidates are all rows but those
    with the query's own id; ties go to the smaller id.  ``is_query`` picks the
    queries (default: ids divisible by 50).  A query with fewer candidates gets
    them all.

    Rows whose id or vector is null, or whose vector holds a null or a value
    that is not finite, take no part.  Nor do rows whose integer vector has a
    squared length over 2^62, as their scores may not fit in 64 bits; those of
    all other pairs do.  Vectors of different lengths are
    compared over the components both have.  A repeated row is a candidate each
    time; a repeated query is answered once for each of its different vectors
    and keeps k rows in all.  No rows or no queries give an empty result.
    Other columns are not read.
    """
    spark = vectors.sparkSession
    x = C("v").cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    squared = F.aggregate(x, F.lit(0.0), lambda s, e: s + F.pow(F.floor(e * scale).cast("double"), 2))
    rows = stored(
        vectors.select(C(id_col).cast("bigint").alias("id"), C(vector_col).alias("v")).filter(C("id").isNotNull() & C("v").isNotNull() & finite & (squared <= float(1 << 62)))
        .select("id", F.transform(x, lambda e: F.floor(e * scale).cast("bigint")).alias("values"))
    )
    queries = rows.filter(C("id") % 50 == 0 if is_query is None else is_query(C("id"))).distinct()
    n_rows, n_queries = rows.count(), queries.count()
    n_blocks, n_qblocks = max(1, math.ceil(n_rows / block_rows)), max(1, math.ceil(n_queries / block_queries))
    index = stored(rows.repartition(n_blocks).mapInArrow(_index_block, "block bigint, ids binary, low bigint, shape array<bigint>, slices binary"))
    asked = stored(queries.repartition(n_qblocks).mapInArrow(_query_block, "qblock bigint, qids binary, width bigint, values binary"))
    # Every block of the query set against every block of the index.
    pairs = index.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(n_qblocks - 1)).cast("array<bigint>"))).join(asked, "qblock")
    pairs = pairs.repartition(min(n_blocks * n_qblocks, 4 * partitions(spark)))
    found = pairs.select("ids", "low", "shape", "slices", "qids", "width", "values").mapInArrow(_searched(k), "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(C("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(C("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(generate_series(1, len(q.e)), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
