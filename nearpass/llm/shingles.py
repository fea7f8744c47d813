"""Sets of word shingles of whole texts, as sorted 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from nearpass.llm.scan import ODD, U, Hashes, mix, runs, slices

SLICE_BYTES = 1 << 18

# ASCII letters are lower-cased; every byte but space and 0x09-0x0D belongs to a word.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.ones(256, bool)
WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def sets(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row of a run of rows, bounds of each row's set, and the sets: distinct hashes in ascending order.

    A text of fewer words than a shingle has its whole sequence as the only
    member; one without words has an empty set.
    """
    for begin, end, data, bounds in slices(column, SLICE_BYTES):
        lower = LOWER[data]
        first, last = runs(WORD[lower], bounds)
        word = Hashes(lower).words(first, last)
        row = np.searchsorted(bounds, first, side="right") - 1
        count = np.bincount(row, minlength=end - begin)
        ends = np.cumsum(count)
        value = np.zeros(max(len(word) - words + 1, 0), U)
        for k in range(words):
            value = value * U(ODD) + word[k : k + len(value)]
        inside = row[: len(value)] == row[words - 1 :] if len(value) else np.zeros(0, bool)
        value, owner = mix(value[inside]), row[: len(inside)][inside]
        short = np.flatnonzero((count > 0) & (count < words))
        if len(short):
            whole = np.zeros(len(short), U)
            for k in range(words - 1):
                here = count[short] > k
                at = (ends - count)[short][here] + k
                whole[here] = whole[here] * U(ODD) + word[at]
            value = np.concatenate([value, mix(whole ^ mix(count[short].astype(U)))])
            owner = np.concatenate([owner, short])
            order = np.argsort(owner, kind="stable")
            value, owner = value[order], owner[order]
        size = np.bincount(owner, minlength=end - begin)
        edge = np.concatenate([[0], np.cumsum(size)])
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            value[a:b].sort()
        if len(value):
            keep = np.ones(len(value), bool)
            keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
            value, owner = value[keep], owner[keep]
        yield begin, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=end - begin))]), value


def names(bounds: np.ndarray, value: np.ndarray) -> np.ndarray:
    """One hash for each set."""
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(value ^ U(ODD)))])
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(U))
