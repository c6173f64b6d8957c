"""Words and hashed features of texts, counted in one pass over each text.

Splitting with patterns and counting one row per word and neighbour is most of
the work of an index.  Here the words of a slice of texts are found by looking
up code points and counted as numbers.  The results are those of
``explode_tokens``, ``doc_terms`` and ``raw_buckets``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gapengine import fixed
from gapengine.functions.text import MARK, token_letters

# Characters, and texts times buckets, handled at once: the arrays of a slice take some 60 bytes a character.
SLICE_CHARS = 1_000_000
SLICE_BUCKETS = 1_000_000

_LETTERS = np.frombuffer(token_letters(), dtype=np.uint8)
# 1 for the capitals, 2 for what a capital behind it starts a new word after.
_CASE = np.zeros(len(_LETTERS), dtype=np.uint8)
_CASE[65:91] = 1
_CASE[[*range(48, 58), *range(97, 123)]] = 2
_DOT, _LEAST_LETTER = ord("."), MARK + 1


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """TXT-2: the text and the word number of each token, in order, and the words."""
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.cumsum([len(t) + 1 for t in texts])
    points = np.minimum(points, len(_LETTERS) - 1)
    letters, case = _LETTERS[points], _CASE[points]
    turn = np.zeros(len(points), dtype=bool)
    turn[1:] = (case[1:] == 1) & (case[:-1] == 2)
    marks = letters == MARK
    if marks.any():
        ends = ends - np.cumsum(marks)[ends - 1]
        letters, turn = letters[~marks], turn[~marks]
    inside = letters >= _LEAST_LETTER
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | turn[1:]
    last[:-1] &= ~inside[1:] | turn[1:]
    # Dots at both ends go: a word reaches from the first to the last other letter of its run.
    solid = inside & (letters != _DOT)
    before, places = np.cumsum(solid), np.flatnonzero(solid)
    starts, stops = np.flatnonzero(first), np.flatnonzero(last)
    low, high = before[starts] - solid[starts], before[stops]
    some = high > low
    low, high = places[low[some]], places[high[some] - 1] + 1
    size = high - low
    whole = (size > 1) | ((letters[low] >= ord("0")) & (letters[low] <= ord("9")))
    low, high, size = low[whole], high[whole], size[whole]
    step = np.zeros(len(letters) + 1, dtype=np.int8)
    step[low] += 1
    step[high] -= 1
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    bytes_ = letters[np.cumsum(step[:-1], dtype=np.int8) > 0]
    coded = pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(bytes_)).dictionary_encode()
    words = coded.dictionary
    kept = ~pc.is_in(words, value_set=pa.array(fixed.STOPWORDS, pa.string())).to_numpy(zero_copy_only=False)
    number = coded.indices.to_numpy()
    at = kept[number]
    return np.searchsorted(ends, low[at], side="right"), number[at], words


def _counted(code: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and number of times of each different ``row * width + column``, by row."""
    different, n = np.unique(code, return_counts=True)
    return different // width, different % width, n


# The rounds of MD5: how far each turns and what it adds.
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_ADDED = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_ONE_BLOCK, _AT_ONCE = 55, 16_384


def _md5_heads(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First eight bytes of the MD5 of texts of at most ``_ONE_BLOCK`` bytes, as numbers: all texts go through the rounds together."""
    n, size = len(offsets) - 1, np.diff(offsets)
    block = np.zeros((n, 64), dtype=np.uint8)
    block.reshape(-1)[np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1] - 64 * np.arange(n), size)] = data[offsets[0] : offsets[-1]]
    block[np.arange(n), size] = 128
    word = np.ascontiguousarray(block.view("<u4").T)
    word[14] = 8 * size
    a, b, c, d = (np.full(n, x, dtype=np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    for i in range(64):
        if i < 16:
            f, at = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, at = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, at = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, at = c ^ (b | ~d), 7 * i % 16
        f += a
        f += _ADDED[i]
        f += word[at]
        turned = f << np.uint32(_TURNS[i])
        turned |= f >> np.uint32(32 - _TURNS[i])
        turned += b
        a, b, c, d = d, turned, b, c
    first, second = (x.byteswap().astype(np.uint64) for x in (a + np.uint32(0x67452301), b + np.uint32(0xEFCDAB89)))
    return (first << np.uint64(32)) | second


def _hashed(features: pa.StringArray, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """AGG-5: bucket and sign of each feature, as ``bucket_of`` and ``sign_of`` have them."""
    heads = np.zeros(len(features), dtype=np.uint64)
    size = pc.binary_length(features).to_numpy(zero_copy_only=False)
    for long in np.flatnonzero(size > _ONE_BLOCK):
        heads[long] = int.from_bytes(hashlib.md5(features[int(long)].as_py().encode()).digest()[:8], "big")
    short = np.flatnonzero(size <= _ONE_BLOCK)
    data = np.frombuffer(features.take(pa.array(short)).buffers()[2] or b"", dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum(size[short])]).astype(np.int64)
    for start in range(0, len(short), _AT_ONCE):
        heads[short[start : start + _AT_ONCE]] = _md5_heads(data, offsets[start : start + _AT_ONCE + 1])
    return ((heads >> np.uint64(4)) % np.uint64(dimensions)).astype(np.int64), np.where(heads & np.uint64(8), 1.0, -1.0)


def _borrowed(row: np.ndarray, number: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """AGG-4: (row, number) of the synonyms of a row's words that the row doesn't hold itself, and the words with them.

    ``row`` and ``number`` are in order."""
    place = {w: i for i, w in enumerate(words)}
    heads = {place[h]: [place.setdefault(s, len(place)) for s in related] for h, related in fixed.SYNONYMS.items() if h in place}
    at = np.flatnonzero(np.isin(number, list(heads)))
    width = len(place)
    asked = np.unique(np.array([int(r) * width + s for r, n in zip(row[at], number[at]) for s in heads[int(n)]], dtype=np.int64))
    own = np.append(row * width + number, -1)  # in order
    missing = asked[own[np.searchsorted(own[:-1], asked)] != asked]
    return missing // width, missing % width, list(place)


def _listed(row: np.ndarray, n_rows: int, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n_rows + 1)), pa.int32()), values)


def counted_slice(texts: list[list[str]], dimensions: int, only: pa.Array | None = None) -> list[pa.Array]:
    """AGG-1/AGG-4/AGG-5: number of words, words (of ``only``, if given), how often, buckets and raw sums of each row of texts."""
    n_rows = len(texts)
    owner = np.repeat(np.arange(n_rows), [len(t) for t in texts])
    text, number, words = words_of([t for row in texts for t in row])
    row = owner[text] if len(owner) else text
    if len(owner) != n_rows:  # texts of one key are read side by side
        place = np.arange(len(text)) - np.searchsorted(text, text)
        order = np.lexsort((place, row))
        row, number = row[order], number[order]
    at, word, n = _counted(row * max(1, len(words)) + number, max(1, len(words)))
    lent, synonym, names = _borrowed(at, word, words.to_pylist())
    near = row[1:] == row[:-1]
    coded = pa.array(number[:-1][near] * max(1, len(words)) + number[1:][near]).dictionary_encode()
    pairs, pair = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    beside, gram, n_grams = _counted(row[1:][near] * max(1, len(pairs)) + pair, max(1, len(pairs)))
    grams = pc.binary_join_element_wise(*[words.take(pa.array(x)) for x in np.divmod(pairs, max(1, len(words)))], "_")
    bucket, sign = _hashed(pa.concat_arrays([pa.array(names, pa.string()), grams]), dimensions)
    feature = np.concatenate([word, synonym, len(names) + gram])
    weight = np.concatenate([fixed.UNIGRAM_WEIGHT * n, np.full(len(lent), fixed.SYNONYM_WEIGHT), fixed.BIGRAM_WEIGHT * n_grams])
    place = np.concatenate([at, lent, beside]) * dimensions + bucket[feature]
    raw = np.bincount(place, weights=sign[feature] * np.where(weight > 1, 1.0 + np.log(np.maximum(weight, 1.0)), weight), minlength=n_rows * dimensions)
    touched = np.flatnonzero(np.bincount(place, minlength=n_rows * dimensions))
    length = pa.array(np.bincount(row, minlength=n_rows), pa.int64())
    if only is not None:
        named = pc.is_in(words, value_set=only).to_numpy(zero_copy_only=False)[word]
        at, word, n = at[named], word[named], n[named]
    return [
        length, _listed(at, n_rows, words.take(pa.array(word))), _listed(at, n_rows, pa.array(n, pa.int64())),
        _listed(touched // dimensions, n_rows, pa.array(touched % dimensions, pa.int32())), _listed(touched // dimensions, n_rows, pa.array(raw[touched], pa.float64())),
    ]


def _slices(texts: list[list[str]], most: int) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for at, row in enumerate(texts):
        more = sum(len(t) for t in row)
        if at > start and (size + more > SLICE_CHARS or at - start == most):
            yield start, at
            start, size = at, 0
        size += more
    if texts:
        yield start, len(texts)


def _counts(key: str, dimensions: int, only: pa.Array | None):
    most = max(1, SLICE_BUCKETS // dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Bytes that are no UTF-8 end a word, as they do in the JVM.
            texts = [[t.decode("utf-8", "replace") for t in row] for row in batch.column("texts").to_pylist()]
            for start, stop in _slices(texts, most):
                columns = counted_slice(texts[start:stop], dimensions, only)
                yield pa.record_batch([batch.column(key).slice(start, stop - start), *columns], [key, "doc_length", "terms", "tfs", "buckets", "raws"])

    return run


def counted_texts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", dimensions: int = fixed.VECTOR_DIMENSIONS, only: pa.Array | None = None
) -> DataFrame:
    """(key, doc_length, terms, tfs, buckets, raws), one row for each key: ``docs`` are spread by key already.

    With ``only``, the words that will be asked for, others aren't listed; all of them count for the length and the buckets."""
    rows = docs.groupBy(key).agg(F.collect_list(F.col(text).cast("binary")).alias("texts"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(_counts(key, dimensions, only), f"{key} {kind}, doc_length bigint, terms array<string>, tfs array<bigint>, buckets array<int>, raws array<double>")
