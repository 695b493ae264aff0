"""Words of whole Arrow columns as 64-bit hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are taken apart at once; a longer text is taken apart alone.
SLICE = 1 << 20
_RNG = np.random.Generator(np.random.Philox(20))
#: A random number for each byte value at each place in a word (places repeat after 64).
_TABLE = _RNG.integers(0, 1 << 64, (64, 256), np.uint64)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: Letters and digits of ASCII, the underscore, and every byte of other characters.
_WORD = np.array([c >= 128 or chr(c).isalnum() or c == 95 for c in range(256)])
#: All bytes but ASCII white space; and letters and digits of ASCII with every byte of other characters.
NO_SPACE = np.array([not (c == 32 or 9 <= c <= 13) for c in range(256)])
ALNUM = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])


class Words(NamedTuple):
    """The words of some texts, in order."""

    first: int  # the first text's row
    offsets: np.ndarray  # of the texts in `data`, one more than there are texts
    data: np.ndarray  # their bytes
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # words of text i: bounds[i] to bounds[i + 1]


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, bytes) of successive texts of a string column; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, "right")) - 1)
        yield a, offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
        a = b


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the capitals from U+00C0 to U+00DE in lower case."""
    out = _LOWER[data]
    latin = np.flatnonzero(data[:-1] == 0xC3) + 1
    latin = latin[(data[latin] >= 0x80) & (data[latin] <= 0x9E) & (data[latin] != 0x97)]
    out[latin] += 0x20
    return out


def ascii_lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z in lower case."""
    return _LOWER[data]


def words(column: pa.Array) -> Iterator[Words]:
    """Maximal runs of word characters in lower case, for successive rows of `column`."""
    return runs(column, _WORD, lowered)


def runs(column: pa.Array, member: np.ndarray, fold: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[Words]:
    """Maximal runs of the bytes that `member` (of 256 booleans) marks, for successive rows of `column`; hashes are of the folded bytes."""
    for first, offsets, data in slices(column):
        inside = member[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True  # a word ends with its text
        before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
        after = np.concatenate((inside[1:], [False])) & ~edge[1:]
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        if len(starts):
            low, sizes = (fold(data) if fold else data)[inside], ends - starts
            heads = np.cumsum(sizes) - sizes
            place = np.arange(len(low)) - np.repeat(heads, sizes)
            values = _TABLE[place & 63, low]
            if sizes.max() > 64:  # equal bytes 64 places apart count differently
                values *= (place >> 6).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C16) + np.uint64(1)
            hashes = np.add.reduceat(values, heads)
            hashes ^= hashes >> np.uint64(29)
        else:
            hashes = np.zeros(0, np.uint64)
        yield Words(first, offsets, data, hashes, starts, ends, np.searchsorted(starts, offsets))
