"""A modified Kneser-Ney trigram model over 128 shapes of words: short words by hash, longer ones by length and kinds of characters, runs by length.

It sees what a model of words can't: decorated and repeated words, whichever
words they are.  It has ``SYMBOLS`` ** 3 numbers whatever the data, which is
the proven bound of its broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructType

from gapengine.llm.common import C, in_filter, stored
from gapengine.llm.wordhash import Words, buffers, chunks

U = np.uint64
SYMBOLS = 128
# Symbols 0: before and behind a text, then short words by hash, then shapes.
SHORT, SHAPES = 2, 96
# Words equal to so many right before them.
RUNS = ((1, 1), (2, 125), (4, 126), (8, 127))
SHORT_BYTES = 5
_KIND = np.zeros(256, dtype=np.int64)
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 1 << 20  # signs
_KIND[48:58] = 1  # digits
_CLOSING = np.zeros(256, dtype=bool)
_CLOSING[[ord(c) for c in ".,;:!?)\"'"]] = True


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the words of each text, end to end, and how many words each has."""
    words = Words(data, offsets)
    starts, ends = words.starts, words.ends.copy()
    # One mark that closes a word or sentence is no part of it.
    ends -= _CLOSING[data[ends - 1]] & (ends - 1 > starts)
    sums = np.concatenate([[0], np.cumsum(_KIND[data])])
    inside = sums[ends] - sums[starts]
    signs, digits, length = inside >> 20, inside & ((1 << 20) - 1), ends - starts
    out = SHAPES + np.minimum(length, 20) - 1  # letters only: by length
    out = np.where(digits > 0, SHAPES + 20 + np.minimum(length, 8) // 4, out)
    out = np.where(signs > 0, SHAPES + 23 + np.minimum(length, 12) // 4, out)
    out = np.where(signs == length, SHAPES + 27 + np.minimum(length, 2) - 1, out)
    short = (length <= SHORT_BYTES) & (inside == 0)
    closed = ends != words.ends
    names = words.hashes
    if closed.any():
        # The hash of a short word must not depend on the mark behind it.
        names = names.copy()
        at = np.flatnonzero(closed & short)
        names[at] = _bare(data, starts[at], ends[at])
    plain = np.flatnonzero(~closed & short)
    names[plain] = _bare(data, starts[plain], ends[plain])
    out = np.where(short, SHORT + (names % U(SHAPES - SHORT)).astype(np.int64), out)
    same = np.zeros(len(out), dtype=bool)
    same[1:] = words.hashes[1:] == words.hashes[:-1]
    same[words.bounds[:-1][words.counts > 0]] = False
    place = np.arange(len(out))
    run = place - np.maximum.accumulate(np.where(same, 0, place)) if len(out) else place
    for least, symbol in RUNS:
        out = np.where(run >= least, symbol, out)
    return out, words.counts


def _bare(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each short byte string, A-Z lower-cased."""
    out = (ends - starts).astype(U)
    for i in range(SHORT_BYTES):
        at = starts + i
        byte = np.where(at < ends, data[np.minimum(at, len(data) - 1)], 0).astype(U)
        byte = np.where((byte >= 65) & (byte <= 90), byte + U(32), byte)
        out = out * U(0x100000001B3) + byte
    return out ^ (out >> U(29))


def trigrams(symbol: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes of all texts: one for each word and one for the end, and the text of each code."""
    text = np.repeat(np.arange(len(counts)), counts + 3)
    heads = np.cumsum(counts + 3) - (counts + 3)
    padded = np.zeros(len(text), dtype=np.int64)
    place = np.arange(len(symbol)) + np.repeat(heads + 2 - (np.cumsum(counts) - counts), counts)
    padded[place] = symbol
    code = (padded[:-2] * SYMBOLS + padded[1:-1]) * SYMBOLS + padded[2:] if len(padded) > 2 else np.zeros(0, np.int64)
    inside = text[: len(code)] == text[2:] if len(code) else np.zeros(0, bool)
    return code[inside], text[: len(code)][inside]


def _coded(text_at: int, bitmap=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if bitmap is not None:
                batch = batch.filter(pa.array(in_filter(bitmap.value, batch.column(0))))
            data, offsets = buffers(batch.column(text_at))
            for a, b in chunks(offsets):
                symbol, counts = symbols(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lines = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends), pa.py_buffer(symbol.astype(np.uint8))])
                yield pa.record_batch([*batch.slice(a, b - a).columns[:text_at], lines], names=[*batch.schema.names[:text_at], "symbols"])

    return run


def coded(rows: DataFrame, bitmap=None) -> DataFrame:
    """The columns before the last, a text, and its words' symbols, one byte each.  ``bitmap``: only rows whose first column may be in it."""
    *kept, _ = rows.schema.fields
    return rows.mapInArrow(_coded(len(kept), bitmap), StructType(kept).add("symbols", BinaryType()))


def _lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = buffers(column)
    return data.astype(np.int64), np.diff(offsets)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, dtype=np.int64)
    for batch in batches:
        symbol, counts = _lines(batch.column(0))
        code, text = trigrams(symbol, counts)
        total += np.bincount(code[counts[text] > 0], minlength=len(total))
    seen = np.flatnonzero(total)
    yield pa.record_batch([pa.array(seen), pa.array(total[seen])], names=["code", "n"])


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of an order from the number of n-grams counted one to four times."""
    row = counts.agg(*[F.count(F.when(C("n") == i, 1)) for i in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (max(1, x) for x in row)
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), k) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def _order(counts: DataFrame, context: Column) -> tuple[DataFrame, DataFrame]:
    """(ngram, p): discounted shares; (context, weight): what each context leaves to the lower order."""
    d1, d2, d3 = _discounts(counts)
    discount = F.when(C("n") == 1, d1).when(C("n") == 2, d2).otherwise(d3)
    rows = counts.withColumn("context", context).withColumn("discount", discount)
    contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("discount").alias("left"))
    shares = rows.join(contexts, "context").select("ngram", ((C("n") - C("discount")) / C("total")).alias("p"))
    return shares, contexts.select("context", (C("left") / C("total")).alias("weight"))


def train(lines: DataFrame) -> np.ndarray:
    """Log probabilities of all trigrams, [first, second, third], from one column of symbols (see ``coded``)."""
    counts = stored(lines.mapInArrow(_counted, "code bigint, n bigint").groupBy(C("code").alias("ngram")).agg(F.sum("n").alias("n")))
    # Lower orders count in how many different contexts an n-gram occurs.
    pairs = stored(counts.groupBy((C("ngram") % SYMBOLS**2).alias("ngram")).agg(F.count(F.lit(1)).alias("n")))
    singles = pairs.groupBy((C("ngram") % SYMBOLS).alias("ngram")).agg(F.count(F.lit(1)).alias("n"))
    lower = np.full(SYMBOLS, 1 / SYMBOLS)
    for order, table in ((1, singles), (2, pairs), (3, counts)):
        shares, weights = _order(table, F.floor(C("ngram") / SYMBOLS).cast("bigint"))
        share, weight = np.zeros(SYMBOLS**order), np.ones(SYMBOLS ** (order - 1))
        # At most SYMBOLS ** 3 rows, whatever the corpus.
        found, left = shares.toArrow(), weights.toArrow()
        share[found["ngram"].to_numpy()] = found["p"].to_numpy()
        weight[left["context"].to_numpy()] = left["weight"].to_numpy()
        below = lower if order == 1 else np.tile(lower.reshape(-1, SYMBOLS), (SYMBOLS if order == 3 else 1, 1))
        lower = (share.reshape(-1, SYMBOLS) + weight[:, None] * below.reshape(-1, SYMBOLS)).reshape(-1)
    return np.log(lower).astype(np.float32)


def log_perplexity(logs: np.ndarray, symbol: np.ndarray, counts: np.ndarray) -> pa.Array:
    code, text = trigrams(symbol, counts)
    total = np.bincount(text, weights=logs[code].astype(np.float64), minlength=len(counts))
    return pa.array(np.round(-total / (counts + 1), 6), mask=counts == 0)
