"""Whole texts of Arrow batches as flat byte arrays, and hashes of their parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
ODD = 0xD6E8FEB86659FD93
_INVERSE = pow(ODD, -1, 1 << 64)
_LETTERS = np.random.RandomState(7).randint(1, 2**62, 256).astype(U)
_tables: dict[str, np.ndarray] = {}


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, one after another, and where each row begins and ends; nulls are empty."""
    if column.null_count:
        column = column.fill_null(pa.scalar("" if pa.types.is_string(column.type) else b"", column.type))
    if column.type in (pa.large_string(), pa.large_binary()):
        kind = np.int64
    else:
        kind = np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `limit` bytes: first row, row after the last, bytes, bounds.

    A row longer than `limit` comes alone.  Working memory follows the slice,
    not the batch.
    """
    data, bounds = flat(column)
    first, n = 0, len(bounds) - 1
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n; the table is kept and grows by doubling."""
    table = _tables.get(base)
    if table is None or len(table) < n:
        size = 1 << max(16, (n - 1).bit_length())
        table = np.ones(size, U)
        done = 1
        while done < size:
            table[done : 2 * done] = table[:done] * U(pow(base, done, 1 << 64))
            done *= 2
        _tables[base] = table
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Every input bit reaches every output bit."""
    x = x ^ (x >> U(32))
    x *= U(ODD)
    x ^= x >> U(29)
    x *= U(0x9E3779B97F4A7C15)
    x ^= x >> U(32)
    return x


LONG_WORD = 64


class Hashes:
    """Hashes of any byte ranges of one array, equal for equal bytes wherever they stand."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self._data = data
        self._back = powers(_INVERSE, n + 1)
        self._sums = np.zeros(n + 1, U)
        np.cumsum(_LETTERS[data] * powers(ODD, n), out=self._sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[begin]) * self._back[begin] + (end - begin).astype(U))

    def words(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of words.

        Sums of powers are the same for some pairs of long words, whatever the
        base (Thue and Morse's word and its complement), so beyond LONG_WORD bytes
        another hash takes their place.
        """
        names = self.of(begin, end)
        for i in np.flatnonzero(end - begin > LONG_WORD).tolist():
            names[i] = xxhash.xxh3_64_intdigest(self._data[begin[i] : end[i]].tobytes())
        return names

    def grams(self, size: int) -> np.ndarray:
        """Of every run of `size` bytes, unmixed in its low bits."""
        sums = self._sums
        x = (sums[size:] - sums[:-size]) * self._back[: len(sums) - size]
        x ^= x >> U(32)
        x *= U(0x9E3779B97F4A7C15)
        return x


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal runs of true that stay within one row."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.empty(len(inside), bool)
    begins[0] = inside[0]
    begins[1:] = inside[1:] & ~inside[:-1]
    ends = np.empty(len(inside), bool)
    ends[-1] = inside[-1]
    ends[:-1] = inside[:-1] & ~inside[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(inside))]
    cuts = cuts[inside[cuts] & inside[cuts - 1]]
    begins[cuts] = True
    ends[cuts - 1] = True
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
