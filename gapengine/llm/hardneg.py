"""Hard negatives: for an anchor and one of its positives, the best rows of other labels within a window of scores.

Scores are inner products of integer vectors, exact.  They are computed in a
residue number system: components are taken modulo several small primes, each
matrix of residues is multiplied in float32, where every sum stays below 2^24
and is therefore exact, and the signed score is put together from its residues
by Chinese remaindering with balanced digits.  How many primes two blocks need
follows from the lengths of their longest vectors.

The anchors, a stated set, meet all rows block by block.  A first pass finds
each anchor's positives, whose scores set the windows; a second pass finds the
negatives inside them.  Two blocks yield only the best rows of each anchor, and
those are ranked over all blocks.  Few anchors (``BROADCAST_BYTES``, checked)
come to the rows by broadcast; more are copied to each block of rows, so the
rows themselves are shuffled once however many anchors there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from gapengine.llm.common import C, discard, partitions, stored

# Components multiplied at once: with balanced residues of primes up to 1021 a
# sum of 64 products is at most 64 * 510 ** 2 < 2 ** 24.
SLAB = 64
LARGEST_PRIME = 1021
# Scores a task holds at once.
TILE = 1 << 22
# Squared lengths up to this keep every score inside 64 bits.
LONGEST = float(1 << 62)
BLOCK_ROWS = 1 << 16
BLOCK_ANCHORS = 1 << 14
BROADCAST_BYTES = 1 << 23
_LEAST = np.iinfo(np.int64).min


def primes_for(bound: int) -> list[int]:
    """Enough primes, largest first, that all numbers from -bound to bound differ in their residues."""
    out, product, p = [], 1, LARGEST_PRIME
    while product < 2 * bound + 1:
        if all(p % q for q in range(3, math.isqrt(p) + 1, 2)):
            out.append(p)
            product *= p
        p -= 2
    return out


def _balanced(x: np.ndarray, p: int) -> np.ndarray:
    r = x % p
    r[r > p // 2] -= p
    return r


def residues(values: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    return [_balanced(values.astype(np.int64), p).astype(np.float32) for p in primes]


def _product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p, slab by slab, each slab exact in float32."""
    total = np.zeros((len(a), len(b)), dtype=np.int64)
    for at in range(0, a.shape[1], SLAB):
        total += (a[:, at : at + SLAB] @ b[:, at : at + SLAB].T).astype(np.int32)
    return _balanced(total, p)


def exact_scores(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Signed scores a @ b.T from the residues of both.

    Digit i of the mixed-radix form, whose radix is the product of the primes
    before it, follows from residue i and the digits before.  Balanced digits
    give signed numbers; sums are modulo 2^64, and every score fits in there.
    """
    digits: list[np.ndarray] = []
    for i, p in enumerate(primes):
        digit = _product(a[i], b[i], p)
        for q, earlier in zip(primes, digits):
            digit = _balanced((digit - earlier) * pow(q, -1, p), p)
        digits.append(digit)
    out, radix = np.zeros_like(digits[0]), 1
    for p, digit in zip(primes, digits):
        out += digit * np.uint64(radix % (1 << 64)).astype(np.int64)
        radix *= p
    return out


def _best(scores: np.ndarray, allowed: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of ``scores``, columns) of the k best allowed entries of each row; earlier columns win ties."""
    left = np.where(allowed, scores, _LEAST)
    every = np.arange(len(left))
    for _ in range(min(k, left.shape[1])):
        column = left.argmax(axis=1)
        there = left[every, column] != _LEAST
        if not there.any():
            return
        yield every[there], column[there]
        left[every, column] = _LEAST


# ------------------------------------------------------------------------ blocks

_BLOCK = {"no": pa.int64(), "n": pa.int64(), "width": pa.int64(), "kind": pa.string(), "longest": pa.int64(),
          "ids": pa.binary(), "labels": pa.binary(), "places": pa.binary(), "data": pa.binary(), "bounds": pa.binary()}


def _ddl(prefix: str) -> str:
    names = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{prefix}{name} {names[kind]}" for name, kind in _BLOCK.items())


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Lists as rows of numbers; shorter ones are filled with zeros."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), int(lengths.max()) if len(lengths) else 0), dtype=np.int64)
    if out.size:
        out[np.arange(out.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _packed(prefix: str):
    """All rows of a task (id, label, place, components, bounds), ordered by id, as matrices in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        ids, labels, places = (table.column(i).to_numpy() for i in range(3))
        order = np.lexsort((places, ids))
        matrix, bounds = (_matrix(table.column(i).chunk(0))[order] for i in (3, 4))
        most = int(np.abs(matrix).max()) if matrix.size else 0
        kind = next(k for k in ("int16", "int32", "int64") if most <= np.iinfo(k).max)
        row = {
            "no": TaskContext.get().partitionId(), "n": len(ids), "width": matrix.shape[1], "kind": kind,
            "longest": int((matrix * matrix).sum(axis=1).max()), "ids": ids[order].tobytes(), "labels": labels[order].tobytes(),
            "places": places[order].tobytes(), "data": matrix.astype(kind).tobytes(), "bounds": bounds.tobytes(),
        }
        schema = pa.schema([(f"{prefix}{name}", t) for name, t in _BLOCK.items()])
        yield pa.RecordBatch.from_pylist([{f"{prefix}{k}": v for k, v in row.items()}], schema=schema)

    return run


class _Block:
    def __init__(self, row: dict, prefix: str):
        get = {name: row[f"{prefix}{name}"] for name in _BLOCK}
        self.ids, self.labels, self.places = (np.frombuffer(get[k], np.int64) for k in ("ids", "labels", "places"))
        self.values = np.frombuffer(get["data"], get["kind"]).reshape(get["n"], get["width"])
        self.bounds = np.frombuffer(get["bounds"], np.int64).reshape(get["n"], -1)
        self.longest = get["longest"]


_FOUND = "place bigint, slot int, vec_id bigint, score bigint"
_FOUND_SCHEMA = pa.schema([("place", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

# From the scores of some anchors with a block of rows: slot numbers, and what is allowed in them.
Allowed = Callable[["_Block", slice, "_Block", np.ndarray], Iterator[tuple[int, np.ndarray]]]


def _positives(anchors: _Block, some: slice, rows: _Block, scores: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    yield 0, (anchors.labels[some, None] == rows.labels) & (anchors.ids[some, None] != rows.ids)


def _negatives(anchors: _Block, some: slice, rows: _Block, scores: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    other = (anchors.labels[some, None] != rows.labels) & (anchors.ids[some, None] != rows.ids)
    bounds = anchors.bounds[some]
    for slot in range(bounds.shape[1] // 2):
        yield slot, other & (scores >= bounds[:, 2 * slot, None]) & (scores <= bounds[:, 2 * slot + 1, None])


def _selected(allowed: Allowed, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                pair = batch.slice(at, 1).to_pylist()[0]
                rows, anchors = _Block(pair, ""), _Block(pair, "a_")
                primes = primes_for(math.isqrt(rows.longest * anchors.longest) + 1)
                both = min(rows.values.shape[1], anchors.values.shape[1])
                right = residues(rows.values[:, :both], primes)
                step = max(1, TILE // max(1, len(rows.ids)))
                for start in range(0, len(anchors.ids), step):
                    some = slice(start, start + step)
                    scores = exact_scores(residues(anchors.values[some, :both], primes), right, primes)
                    for slot, mask in allowed(anchors, some, rows, scores):
                        for a, column in _best(scores, mask, k):
                            yield pa.record_batch(
                                [anchors.places[some][a], np.full(len(a), slot, np.int32), rows.ids[column], scores[a, column]], schema=_FOUND_SCHEMA
                            )

    return run


def _blocks(rows: DataFrame, n: int, prefix: str) -> DataFrame:
    return stored(rows.repartition(n).mapInArrow(_packed(prefix), _ddl(prefix)))


def _search(index: DataFrame, n_blocks: int, anchors: DataFrame, n_anchors: int, anchor_bytes: int, allowed: Allowed, k: int) -> DataFrame:
    """(place, slot, rank, vec_id, score): the k best allowed rows of each anchor and slot over all blocks; stored."""
    n = max(1, math.ceil(n_anchors / BLOCK_ANCHORS))
    packed = _blocks(anchors, n, "a_")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)).cast("array<bigint>"))
    if anchor_bytes <= BROADCAST_BYTES:
        pairs = index.withColumn("a_no", every(n)).join(F.broadcast(packed), "a_no")  # at most BROADCAST_BYTES
    else:
        pairs = index.join(packed.withColumn("no", every(n_blocks)).hint("shuffle_merge"), "no")
    columns = [f"{prefix}{name}" for prefix in ("", "a_") for name in _BLOCK]
    found = pairs.select(*columns).mapInArrow(_selected(allowed, k), _FOUND)
    best = Window.partitionBy("place", "slot").orderBy(C("score").desc(), "vec_id")
    out = stored(found.withColumn("rank", F.row_number().over(best)).filter(C("rank") <= k))
    discard(packed)
    return out


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", is_anchor=None, positives: int = 5,
    negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), the best negatives of each pair.

    Components become ``floor(scale * x)``.  An anchor's positives are its best
    ``positives`` other rows of the same label; a pair's negatives are the best
    ``negatives`` rows of other labels whose score is between ``low`` and
    ``high`` per cent of the positive's.  Ties go to the smaller id.
    ``is_anchor`` picks the anchors (default: ids divisible by 50).

    Rows whose id, label or vector is null, or whose vector holds a null or a
    value that is not finite, take no part, nor do rows whose integer vector has
    a squared length over 2^62, as their scores may not fit in 64 bits.  Empty
    vectors score 0 with everything; vectors of different lengths are compared
    over the components both have.  A row is no candidate of an anchor with its
    own id.  A repeated row is a candidate each time; an anchor repeated with
    the same label and vector is asked once, with others each time.  A positive
    score below 0 has an empty window.  No rows, no anchors or one label only
    give an empty result.  Other columns are not read.
    """
    spark = vectors.sparkSession
    x = C("v").cast("array<double>")
    whole = lambda e: F.floor(e * scale)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    squared = F.aggregate(x, F.lit(0.0), lambda s, e: s + F.pow(F.floor(e * scale).cast("double"), F.lit(2.0)))
    rows = stored(
        vectors.select(C(id_col).cast("bigint").alias("id"), C(label_col).cast("bigint").alias("label"), C(vector_col).alias("v"))
        .filter(C("id").isNotNull() & C("label").isNotNull() & C("v").isNotNull() & finite & (squared <= LONGEST))
        .select("id", "label", F.transform(x, lambda e: whole(e).cast("bigint")).alias("values"))
    )
    chosen = rows.filter(C("id") % 50 == 0 if is_anchor is None else is_anchor(C("id"))).distinct()
    nothing = F.array().cast("array<bigint>")
    anchors = stored(chosen.withColumn("place", F.monotonically_increasing_id()))
    n_rows = rows.count()
    n_anchors, components = anchors.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("values")), F.lit(0))).first()
    size = 8 * (components + (3 + 2 * positives) * n_anchors)
    # As many blocks as keep all cores busy, each of a bounded size.
    n_blocks = max(1, math.ceil(n_rows / block_rows), min(partitions(spark), math.ceil(n_rows / 1024)))
    index = _blocks(rows.select("id", "label", F.lit(-1).cast("bigint").alias("place"), "values", nothing.alias("bounds")), n_blocks, "")
    asked = anchors.select("id", "label", "place", "values", nothing.alias("bounds"))
    near = _search(index, n_blocks, asked, n_anchors, size, _positives, positives)
    # A positive's window in whole scores; a slot without positive has an empty one.
    part = lambda percent: C("score").cast("decimal(20,0)") * F.lit(percent).cast("decimal(4,0)") / F.lit(100).cast("decimal(4,0)")
    windows = near.select("place", "rank", F.array(F.ceil(part(low)).cast("bigint"), F.floor(part(high)).cast("bigint")).alias("window"))
    # At most ``positives`` rows of one anchor.
    windows = windows.groupBy("place").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "window"))), lambda s: s["window"])).alias("given"))
    empty = F.array_repeat(F.array(F.lit(1), F.lit(0)).cast("array<bigint>"), positives)
    bounds = F.slice(F.concat("given", F.flatten(empty)), 1, 2 * positives)
    asked = stored(anchors.join(windows, "place").select("id", "label", "place", "values", bounds.alias("bounds")))
    far = _search(index, n_blocks, asked, n_anchors, size, _negatives, negatives)
    pairs = near.select("place", (C("rank") - 1).cast("int").alias("slot"), C("vec_id").alias("positive_id"), C("score").alias("positive_score"))
    negative = far.select("place", "slot", C("rank").cast("int").alias("rank"), C("vec_id").alias("negative_id"), C("score").alias("negative_score"))
    out = stored(
        negative.join(pairs, ["place", "slot"]).join(anchors.select("place", C("id").alias("anchor_id")), "place")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
    for used in (rows, anchors, index, near, asked, far):
        discard(used)
    return out


def relabelled(label: Column, id_: Column) -> Column:
    """Labels of the report: every seventh row carries the next of ten labels."""
    return F.when(id_ % 7 == 0, (label + 1) % 10).otherwise(label)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_sum(list_transform(generate_series(1, len(a.e)), lambda i: a.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
