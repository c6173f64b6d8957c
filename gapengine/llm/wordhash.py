"""Words of whole text columns as 64-bit hashes, with array arithmetic on the Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
# Text bytes handled at once: arrays of eight times this size stay small beside a worker's memory.
CHUNK_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose results look random (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the multiplier and of its inverse, kept as far as they were needed."""

    up = _powers(MULTIPLIER, 1 << 10)
    down = _powers(_INVERSE, 1 << 10)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(MULTIPLIER, n), _powers(_INVERSE, n)
        return cls.up[:n], cls.down[:n]


def _byte_values(lower: bool) -> np.ndarray:
    b = np.arange(256, dtype=np.uint64)
    if lower:
        b[65:91] += np.uint64(32)
    return mix(b + np.uint64(0x5851F42D4C957F2D))


_VALUES = {lower: _byte_values(lower) for lower in (False, True)}
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (UTF-8 of a text) of all values and the n + 1 offsets into them; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``size`` bytes; a longer text is a run of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1)
        yield start, stop
        start = stop


class Words:
    """Words of a run of texts: byte ranges, 64-bit hashes, and how many each text has."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        n = len(data)
        solid = ~_SPACE[data]
        first = np.zeros(n + 1, dtype=bool)
        first[offsets] = True
        before = np.zeros(n, dtype=bool)
        before[1:] = solid[:-1]
        before &= ~first[:n]
        after = np.zeros(n, dtype=bool)
        after[:-1] = solid[1:]
        after &= ~first[1:]
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        up, down = _Powers.upto(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_VALUES[lower][data] * up[:n], out=total[1:])
        self._total, self._down = total, down
        self.hashes = self.hashes_upto(self.ends)
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)

    def hashes_upto(self, ends: np.ndarray) -> np.ndarray:
        """Hashes of the same words, each only up to its place in ``ends``."""
        return mix((self._total[ends] - self._total[self.starts]) * self._down[self.starts])
