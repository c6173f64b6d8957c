"""Interpolated modified Kneser-Ney trigrams over words, counted and looked up in shards.

Words are 64-bit hashes of their bytes, A-Z lower-cased, less one closing mark.
Texts are packed into chunks of about ``CHUNK_WORDS`` words.  Counting: each
chunk sends its distinct trigrams, in one compressed list for each shard of the
tables, where they are added up; continuation counts and context totals are
sums of those tables and go on to their own shards.  Scoring: each chunk asks
for its distinct n-grams once, again in one list for each shard, so a common
n-gram costs a shard one look-up for each chunk; the answers come back to the
chunk, which adds up the log probabilities of its texts.  Chunks are scored in
up to ``ROUNDS`` rounds, whose lists are deleted before the next one's are made.
Nothing but the discounts, totals and number of words passes through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gapengine.llm.common import C, discard, partitions, stored
from gapengine.llm.shapes import log_perplexity, symbols, train
from gapengine.llm.wordhash import Words, buffers, chunks, mix

U = np.uint64
# A chunk of 1 << 20 words takes a worker up to 240 MB while it is counted or scored.
CHUNK_WORDS = 1 << 19
# Words of all texts for each shard of the tables.
SHARD_WORDS = 1 << 21
# Rounds of summing pairs and of scoring, each of at least so many words; each reads the tables once, so there are never more.
ROUNDS = 8
ROUND_WORDS = 1 << 22
EDGE = U(0x2545F4914F6CDD1D)  # before and behind a text
_CLOSING = np.zeros(256, dtype=bool)
_CLOSING[[ord(c) for c in ".,;:!?)\"'"]] = True

PACKED = "chunk bigint, n_words bigint, ids array<bigint>, names array<bigint>, counts array<int>, words binary, symbols binary"
WORDS = "u8", "u4"
TRIGRAM, PAIR, PAIR_CONTEXT, WORD, WORD_CONTEXT, NUMBERS = range(6)
# Rows of a table, or with ``part`` of what is still to be added up, for one shard; ``numbers``: see ``_numbers``.
LISTS = "shard bigint, kind int, part boolean, packed binary, numbers array<bigint>"
# Names, values, the values as contexts and what contexts leave.
ENTRY = "u8", "f4", "f4", "f4"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as compressed bytes, all first bytes of an array's numbers before all second ones."""
    body = b"".join(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() for x in arrays)
    return np.array([len(x) for x in arrays], np.int64).tobytes() + (pa.compress(body, "zstd", asbytes=True) if body else b"")


def unpack(packed: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    sizes = [int(n) * np.dtype(k).itemsize for n, k in zip(np.frombuffer(packed, np.int64, len(kinds)), kinds, strict=True)]
    body = np.frombuffer(pa.decompress(packed[8 * len(kinds) :], sum(sizes), "zstd", asbytes=True) if sum(sizes) else b"", np.uint8)
    ends = np.cumsum(sizes)
    return [
        np.ascontiguousarray(body[end - size : end].reshape(np.dtype(k).itemsize, -1).T).view(k).reshape(-1) for size, end, k in zip(sizes, ends, kinds, strict=True)]


def _steps(ascending: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers, which take fewer bytes."""
    return np.diff(ascending, prepend=U(0))


def _places(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=U)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, end to end, and how many words each has."""
    words = Words(data, offsets)
    ends = words.ends - (_CLOSING[data[words.ends - 1]] & (words.ends - 1 > words.starts))
    return words.hashes_upto(ends), words.counts


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done, held, n_words = 0, [], 0

    def flush() -> pa.RecordBatch:
        ids, names = (pa.concat_arrays([x[i] for x in held]) for i in (0, 1))
        vocabulary, places, often = np.unique(np.concatenate([x[3] for x in held]), return_inverse=True, return_counts=True)
        # Frequent words get small numbers, which take fewer bytes.
        order = np.argsort(-often, kind="stable")
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(len(order))
        counts = pa.array(np.concatenate([x[2] for x in held]).astype(np.int32))
        whole = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), x) for x in (ids, names, counts)]
        chunk = TaskContext.get().partitionId() << 32 | done
        return pa.record_batch(
            [pa.array([chunk]), pa.array([n_words]), *whole, pa.array([pack(vocabulary[order], number[places])]),
             pa.array([pack(np.concatenate([x[4] for x in held]))])],
            names=["chunk", "n_words", "ids", "names", "counts", "words", "symbols"])

    for batch in batches:
        data, offsets = buffers(batch.column(2))
        for a, b in chunks(offsets):
            run = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            hashes, counts = word_hashes(*run)
            held.append((batch.column(0)[a:b], batch.column(1)[a:b], counts, hashes, symbols(*run)[0].astype(np.uint8)))
            n_words += len(hashes)
            if n_words >= CHUNK_WORDS:
                yield flush()
                done, held, n_words = done + 1, [], 0
    if held:
        yield flush()


def packed(rows: DataFrame) -> DataFrame:
    """Chunks of (id, name, text); stored, as their numbers must not change."""
    return stored(rows.mapInArrow(_packed, PACKED))


def triples(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First, second and third of every trigram, one for each word and one for the end of each text that has words, and its text."""
    full = np.flatnonzero(counts)
    n = counts[full].astype(np.int64)
    text = np.repeat(full, n + 3)
    line = np.full(len(text), EDGE, dtype=U)
    line[np.arange(len(hashes)) + np.repeat(2 + 3 * np.arange(len(full)), n)] = hashes
    inside = text[:-2] == text[2:]
    return line[:-2][inside], line[1:-1][inside], line[2:][inside], text[:-2][inside]


def key(*words: np.ndarray) -> np.ndarray:
    """A 64-bit name of an n-gram."""
    return reduce(lambda x, w: mix(x * U(0x9E3779B97F4A7C15) + w), words, np.full(len(words[0]), len(words), dtype=U))


def _hashes(row: dict) -> tuple[np.ndarray, np.ndarray]:
    vocabulary, places = unpack(row["words"], WORDS)
    return vocabulary[places], np.array(row["counts"], dtype=np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _heads(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def _lists(kind: int, part: bool, shard: np.ndarray, columns: list[np.ndarray], packed, by: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    """One row for each shard; its rows of ``columns``, in the order of ``by``, go through ``packed``."""
    order = np.lexsort((*by[::-1], shard))
    at = np.append(_heads(shard[order]), len(order))
    for a, b in zip(at[:-1], at[1:], strict=True):
        row = int(shard[order[a]]), kind, part, packed(*[x[order[a:b]] for x in columns]), None
        yield pa.record_batch([pa.array([x], t) for x, t in zip(row, LIST_TYPES, strict=True)], names=LIST_NAMES)


LIST_NAMES = ["shard", "kind", "part", "packed", "numbers"]
LIST_TYPES = [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.list_(pa.int64())]


def _gram_list(width: int):
    """(words of each n-gram ..., others ...) with every word once."""

    def run(*columns: np.ndarray) -> bytes:
        vocabulary, places = np.unique(np.concatenate(columns[:width]), return_inverse=True)
        return pack(_steps(vocabulary), places.astype(np.uint32), *[x.astype(np.int64) for x in columns[width:]])

    return run


def _name_list(names: np.ndarray, *columns: np.ndarray) -> bytes:
    """(names, ascending, others ...)."""
    return pack(_steps(names), *[x.astype(np.int64) for x in columns])


def _grams_of(packed: bytes, width: int, more: int) -> list[np.ndarray]:
    steps, places, *rest = unpack(packed, ("u8", "u4", *["i8"] * more))
    return [*_places(steps)[places].reshape(width, -1), *rest]


def _named_of(packed: bytes, more: int) -> list[np.ndarray]:
    steps, *rest = unpack(packed, ("u8", *["i8"] * more))
    return [_places(steps), *rest]


def _joined(rows: list[dict], width: int, more: int) -> list[np.ndarray]:
    """Columns of the lists of all rows, end to end."""
    each = [_grams_of(row["packed"], width, more) for row in rows]
    return [np.concatenate(x) for x in zip(*each, strict=True)] if each else [*[np.zeros(0, U)] * width, *[np.zeros(0, np.int64)] * more]


def _added(names: np.ndarray, first: list[np.ndarray], sums: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> tuple:
    """Rows of each name added up, by ascending names: names, ``first`` of each, ``sums``, smallest ``lo`` and largest ``hi``."""
    if not len(names):
        return names, first, sums, lo, hi
    order = np.argsort(names)
    heads = _heads(names[order])
    return (names[order[heads]], [x[order[heads]] for x in first], [np.add.reduceat(x[order], heads) for x in sums],
            np.minimum.reduceat(lo[order], heads), np.maximum.reduceat(hi[order], heads))


def _named(rows: list[dict], more: int) -> list[np.ndarray]:
    """The same of lists of names."""
    each = [_named_of(row["packed"], more) for row in rows]
    return [np.concatenate(x) for x in zip(*each, strict=True)] if each else [np.zeros(0, U), *[np.zeros(0, np.int64)] * more]


def _texts(lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    """Smallest and largest text as they are sent: of several texts it only counts that they are not one."""
    several = lo != hi
    return [np.where(several, 0, lo), several.astype(np.int64)]


def _shard(names: np.ndarray, n_shards: int) -> np.ndarray:
    return (names % U(n_shards)).astype(np.int64)


def _counted(n_shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            hashes, counts = _hashes(row)
            trusted = np.zeros(len(counts), dtype=bool)
            trusted[row["trusted"]] = True
            hashes = hashes[np.repeat(trusted, counts)]
            a, b, c, text = triples(hashes, np.where(trusted, counts, 0))
            ids = _ids(row)[text]
            names, (a, b, c), (n,), lo, hi = _added(key(a, b, c), [a, b, c], [np.ones(len(a), np.int64)], ids, ids)
            yield from _lists(TRIGRAM, True, _shard(names, n_shards), [a, b, c, n, *_texts(lo, hi)], _gram_list(3), (a, b))

    return run


def _signed(n: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Counts, negative where only one text has the n-gram."""
    return np.where(lo == hi, -n, n).astype(np.float32)


def _entries(kind: int, shard: int, names: np.ndarray, values: np.ndarray, contexts: tuple | None = None) -> pa.RecordBatch:
    """The final rows of a shard, by ascending names; ``contexts``: names, values and what they leave."""
    if contexts is None:
        columns = [values, np.zeros(len(names), np.float32), np.zeros(len(names), np.float32)]
    else:
        every = np.union1d(names, contexts[0])
        columns = [np.zeros(len(every), np.float32) for _ in range(3)]
        columns[0][np.searchsorted(every, names)] = values
        at = np.searchsorted(every, contexts[0])
        columns[1][at], columns[2][at] = contexts[1:]
        names = every
    row = shard, kind, False, pack(_steps(names), *columns), None
    return pa.record_batch([pa.array([x], t) for x, t in zip(row, LIST_TYPES, strict=True)], names=LIST_NAMES)


def _numbers(shard: int, n: np.ndarray) -> pa.RecordBatch:
    """How many n-grams were counted one to four times, the sum of counts, their number."""
    row = shard, NUMBERS, False, b"", [*[int((n == i).sum()) for i in (1, 2, 3, 4)], int(n.sum()), len(n)]
    return pa.record_batch([pa.array([x], t) for x, t in zip(row, LIST_TYPES, strict=True)], names=LIST_NAMES)


def _ones(n: np.ndarray) -> list[np.ndarray]:
    """What the discounts of a context add up: whether a count is one, two or more."""
    return [(n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64)]


def _table(parts: pa.Table) -> tuple[int, dict[int, list[dict]]]:
    rows = parts.to_pylist()
    return rows[0]["shard"], {k: [x for x in rows if x["kind"] == k] for k in range(NUMBERS)}


def _trigrams(n_shards: int):
    """Trigrams of a shard, and its part of the pairs and of their contexts."""

    def run(parts: pa.Table) -> pa.Table:
        shard, rows = _table(parts)
        a, b, c, n, lo, hi = _joined(rows[TRIGRAM], 3, 3)
        names, (a, b, c), (n,), lo, hi = _added(key(a, b, c), [a, b, c], [n], lo, lo + hi)
        out = [_entries(TRIGRAM, shard, names, _signed(n, lo, hi)), _numbers(shard, n)]
        # Lower orders count in how many different contexts an n-gram occurs.
        two, words, sums, low, high = _added(key(b, c), [b, c], [np.ones(len(n), np.int64)], lo, hi)
        out += _lists(PAIR, True, _shard(two, n_shards), [*words, *sums, *_texts(low, high)], _gram_list(2), tuple(words))
        two, _, sums, low, high = _added(key(a, b), [], [n, *_ones(n)], lo, hi)
        out += _lists(PAIR_CONTEXT, True, _shard(two, n_shards), [two, *sums, *_texts(low, high)], _name_list, (two,))
        return pa.Table.from_batches(out)

    return run


def _pairs(n_shards: int, discounts: tuple):
    """Pairs and contexts of a shard, and its part of the words and of their contexts."""

    def run(parts: pa.Table) -> pa.Table:
        shard, rows = _table(parts)
        names, n, *ones, lo, hi = _named(rows[PAIR_CONTEXT], 6)
        names, _, (n, *ones), lo, hi = _added(names, [], [n, *ones], lo, lo + hi)
        contexts = names, _signed(n, lo, hi), sum(d * x for d, x in zip(discounts, ones, strict=True)).astype(np.float32)
        b, c, n, lo, hi = _joined(rows[PAIR], 2, 3)
        names, (b, c), (n,), lo, hi = _added(key(b, c), [b, c], [n], lo, lo + hi)
        out = [_entries(PAIR, shard, names, _signed(n, lo, hi), contexts), _numbers(shard, n)]
        one, _, sums, low, high = _added(key(c), [], [np.ones(len(n), np.int64)], lo, hi)
        out += _lists(WORD, True, _shard(one, n_shards), [one, *sums, *_texts(low, high)], _name_list, (one,))
        one, _, sums, low, high = _added(key(b), [], [n, *_ones(n)], lo, hi)
        out += _lists(WORD_CONTEXT, True, _shard(one, n_shards), [one, *sums, *_texts(low, high)], _name_list, (one,))
        return pa.Table.from_batches(out)

    return run


def _words(discounts: tuple):
    """Words and contexts of a shard."""

    def run(parts: pa.Table) -> pa.Table:
        shard, rows = _table(parts)
        names, n, *ones, lo, hi = _named(rows[WORD_CONTEXT], 6)
        names, _, (n, *ones), lo, hi = _added(names, [], [n, *ones], lo, lo + hi)
        contexts = names, _signed(n, lo, hi), sum(d * x for d, x in zip(discounts, ones, strict=True)).astype(np.float32)
        names, n, lo, hi = _named(rows[WORD], 3)
        names, _, (n,), lo, hi = _added(names, [], [n], lo, lo + hi)
        return pa.Table.from_batches([_entries(WORD, shard, names, _signed(n, lo, hi), contexts), _numbers(shard, n)])

    return run


def half(ids: np.ndarray) -> np.ndarray:
    """0 or 1 for each id."""
    return (mix(ids.astype(np.int64).view(U)) & U(1)).astype(np.int64)


def _ids(row: dict) -> np.ndarray:
    return np.array([x or 0 for x in row["ids"]], dtype=np.int64)


def _lines(which: int):
    """Symbols of each trusted text of one half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ends, halves = np.concatenate([[0], np.cumsum(row["counts"])]), half(_ids(row))
            symbol = unpack(row["symbols"], ("u1",))[0].tobytes()
            yield pa.record_batch([pa.array([symbol[ends[i] : ends[i + 1]] for i in row["trusted"] if halves[i] == which], pa.binary())], names=["symbols"])

    return run


def _discounts(lists: DataFrame) -> tuple[tuple[float, float, float], list[int]]:
    """The three discounts of an order, and its numbers (see ``_numbers``) over all shards."""
    rows = lists.filter(C("kind") == NUMBERS).select(F.posexplode("numbers").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()  # six
    numbers = [0] * 6
    for row in rows:
        numbers[row["i"]] = row["x"]
    n1, n2, n3, n4 = (max(1, x) for x in numbers[:4])
    y = n1 / (n1 + 2 * n2)
    found = tuple(min(max(d, 0.05), k) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))
    return found, numbers


class Model:
    """Count tables of the trusted texts, for each shard and kind one list of names and values, and what the formula needs besides.

    A value is a count or a context's total, negative if the n-gram is only in
    one text; contexts also have what they leave to the lower order.
    """

    def __init__(self, chunked: DataFrame, ids: DataFrame):
        places = chunked.select("chunk", F.posexplode("ids").alias("place", "id")).join(ids, "id", "left_semi")
        trusted = places.groupBy("chunk").agg(F.collect_list("place").alias("trusted"))
        learned = chunked.drop("names").join(stored(trusted), "chunk")
        # Each half of the trusted texts is judged by the model of the other one.
        self.shapes = [train(learned.select("ids", "counts", "symbols", "trusted").mapInArrow(_lines(h), "symbols binary")) for h in (0, 1)]
        n_words = chunked.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
        self.rounds = min(ROUNDS, 1 + n_words // ROUND_WORDS)
        n = self.n_shards = max(partitions(chunked.sparkSession), math.ceil(n_words / SHARD_WORDS))
        counted = learned.select("ids", "counts", "words", "trusted").mapInArrow(_counted(n), LISTS)
        three = stored(counted.groupBy("shard").applyInArrow(_trigrams(n), LISTS))
        d3, _ = _discounts(three)
        parts = [three.filter(C("part") & (C("shard") % self.rounds == i)) for i in range(self.rounds)]
        pairs = [stored(x.groupBy("shard").applyInArrow(_pairs(n, d3), LISTS)) for x in parts]
        two = reduce(DataFrame.union, pairs)
        three = self._final(three)
        d2, _ = _discounts(two)
        one = stored(two.filter("part").groupBy("shard").applyInArrow(_words(d2), LISTS))
        two = self._final(two, pairs)
        d1, numbers = _discounts(one)
        self.discounts = [d3, d2, d1]
        self.total, self.n_words = numbers[4], numbers[5] + 1  # and one for all unknown words
        self.left = d1[0] * numbers[0] + d1[1] * numbers[1] + d1[2] * (numbers[5] - numbers[0] - numbers[1])
        self.entries = reduce(DataFrame.union, [three, two, self._final(one)])

    @staticmethod
    def _final(lists: DataFrame, tables: list[DataFrame] | None = None) -> DataFrame:
        """The final rows alone; what has been added up, ``tables`` or ``lists`` itself, is deleted."""
        out = stored(lists.filter(~C("part") & (C("kind") != NUMBERS)).select("shard", "kind", "packed"))
        for x in tables or [lists]:
            discard(x)
        return out


class _Grams:
    """Distinct n-grams of a chunk in the order of their shards, and where each is in its trigrams."""

    def __init__(self, row: dict, n_shards: int):
        self.hashes, self.counts = _hashes(row)
        a, b, c, self.text = triples(self.hashes, self.counts)
        three, first, self.event = np.unique(key(a, b, c), return_index=True, return_inverse=True)
        a, b, c = a[first], b[first], c[first]
        two, place = np.unique(np.concatenate([key(a, b), key(b, c)]), return_inverse=True)
        one, word = np.unique(np.concatenate([key(b), key(c)]), return_inverse=True)
        self.context, self.pair = place[: len(a)], place[len(a) :]
        self.middle, self.last = word[: len(a)], word[len(a) :]
        self.asked = []
        for names in (three, two, one):
            shard = (names % U(n_shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            self.asked.append((order, names[order], np.searchsorted(shard[order], np.arange(n_shards + 1))))


def _asks(n_shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            grams = _Grams(row, n_shards)
            lists = [pa.array([pack(_steps(names[at[s] : at[s + 1]])) for s in range(n_shards)]) for _, names, at in grams.asked]
            yield pa.record_batch([pa.array(np.arange(n_shards)), pa.array(np.full(n_shards, row["chunk"])), *lists], names=["shard", "chunk", "three", "two", "one"])

    return run


# The tables asked for each kind of n-gram, and how many of their values.
_ASKED = (("three", TRIGRAM, 1), ("two", PAIR, 3), ("one", WORD, 3))


def _answered(entries: pa.Table, asked: pa.Table) -> pa.Table:
    tables = {kind: [np.zeros(0, U), *[np.zeros(0, np.float32)] * 3] for _, kind, _ in _ASKED}
    for row in entries.to_pylist():
        steps, *values = unpack(row["packed"], ENTRY)
        tables[row["kind"]] = [_places(steps), *values]
    out = {name: [] for name, _, _ in _ASKED}
    for name, kind, width in _ASKED:
        have, *numbers = tables[kind]
        for x in asked[name]:
            want = _places(unpack(x.as_py(), ("u8",))[0])
            at = np.minimum(np.searchsorted(have, want), max(0, len(have) - 1))
            hit = have[at] == want if len(have) else np.zeros(len(want), bool)
            out[name].append(pack(*[np.where(hit, v[at], 0).astype(np.float32) if len(have) else np.zeros(len(want), np.float32) for v in numbers[:width]]))
    return pa.table({"chunk": asked["chunk"].combine_chunks(), "shard": asked["shard"].combine_chunks(), **{k: pa.array(v, pa.binary()) for k, v in out.items()}})


def probabilities(values: dict, grams, discounts, total: float, left: float, n_words: int, others: bool) -> np.ndarray:
    """Probability of each distinct trigram of a chunk; ``others``: as if n-grams that only one text has were unseen."""

    def seen(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.maximum(x, 0) if others else np.abs(x)

    def share(n: np.ndarray, order: int) -> np.ndarray:
        d = np.array([0, *discounts[order]])
        return n - d[np.minimum(n, 3).astype(np.int64)]

    def step(n, whole, rest, order, lower):
        some = whole > 0
        whole = np.where(some, whole, 1)
        return np.where(some, share(n, order) / whole + rest / whole * lower, lower)

    (pair, context, rest2), (word, middle, rest1) = values["two"], values["one"]
    p = np.full(len(grams.last), 1 / n_words)
    p = step(seen(word)[grams.last], np.full(len(p), float(total)), left, 2, p)
    p = step(seen(pair)[grams.pair], seen(middle)[grams.middle], rest1[grams.middle].astype(np.float64), 1, p)
    return step(seen(values["three"][0]), seen(context)[grams.context], rest2[grams.context].astype(np.float64), 0, p)


def _shape_scores(row: dict, counts: np.ndarray, models: list[np.ndarray]) -> dict:
    """Of each text by both halves' models: their mean, and that of the half without the text."""
    symbol = unpack(row["symbols"], ("u1",))[0].astype(np.int64)
    by = [log_perplexity(m, symbol, counts).to_numpy(zero_copy_only=False) for m in models]
    none = counts == 0
    return {"shape": pa.array((by[0] + by[1]) / 2, mask=none), "other_shape": pa.array(np.where(half(_ids(row)) == 0, by[1], by[0]), mask=none)}


def _judged(n_shards: int, settings: tuple, shapes):
    def run(chunked: pa.Table, answers: pa.Table) -> pa.Table:
        parts = []
        answers = answers.sort_by("shard")
        for row in _rows(chunked.to_batches()):
            grams, values = _Grams(row, n_shards), {}
            for (name, _, width), (order, _, _) in zip(_ASKED, grams.asked, strict=True):
                found = np.concatenate([np.stack(unpack(x, ("f4",) * width)) for x in answers[name].to_pylist()], axis=1)
                values[name] = np.empty_like(found)
                values[name][:, order] = found
            logs = []
            for others in (False, True):
                p = np.log(probabilities(values, grams, *settings, others))
                sums = np.bincount(grams.text, weights=p[grams.event], minlength=len(grams.counts))
                logs.append(pa.array(np.round(-sums / (grams.counts + 1), 6), mask=grams.counts == 0))
            parts.append(pa.table({
                "id": pa.array(row["ids"], pa.int64()), "name": pa.array(row["names"], pa.int64()), "n_words": pa.array(grams.counts), "plain": logs[0], "others": logs[1],
                **_shape_scores(row, grams.counts, shapes.value)}))
        return pa.concat_tables(parts)

    return run


SCORES = "id bigint, name bigint, n_words bigint, plain double, others double, shape double, other_shape double"


def word_scores(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, name, n_words, plain, others, shape, other_shape) of rows (id, name, text): log perplexities under the models of the texts of ``ids``.

    ``others`` is that without the n-grams only one trusted text holds: what the
    other texts say of a trusted text.  ``shape`` is the mean of the shape
    models of two halves of the trusted texts, ``other_shape`` that of the half
    a trusted text is not in.
    """
    chunked = packed(rows)
    model = Model(chunked, ids)
    shapes = rows.sparkSession.sparkContext.broadcast(model.shapes)
    judged = _judged(model.n_shards, (model.discounts, model.total, model.left, model.n_words), shapes)

    def scored(some: DataFrame) -> DataFrame:
        asked = some.select("chunk", "counts", "words").mapInArrow(_asks(model.n_shards), "shard bigint, chunk bigint, three binary, two binary, one binary")
        answers = model.entries.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(
            _answered, "chunk bigint, shard bigint, three binary, two binary, one binary")
        return some.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(judged, SCORES)

    turn = F.pmod(F.xxhash64("chunk"), F.lit(model.rounds))
    return reduce(DataFrame.union, [stored(scored(chunked.filter(turn == i))) for i in range(model.rounds)])
