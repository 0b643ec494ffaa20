"""Vectorised words and word shingles over the UTF-8 buffers of Arrow columns.

All functions work on whole texts. A text is taken as its UTF-8 bytes, A-Z lower-cased; a byte table says which
bytes belong to words, so that both word definitions in use (everything but ASCII white space; ASCII letters, digits
and everything above ASCII) are exact on code points, because every separator is one ASCII byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 5
#: Texts are hashed in runs of about this many bytes; one longer text is a run of its own.
RUN_BYTES = 1 << 20

_U = np.uint64
_BASE, _STEP = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + _U(salt)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = _lower()
_VALUES = mix(LOWER.astype(np.uint64) + _U(1), 0x1234567)
#: Words are runs of bytes other than ASCII white space.
BLANK_WORDS = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Words are runs of ASCII letters, digits and all that is not ASCII.
PLAIN_WORDS = np.array([c >= 0x80 or chr(c).isalnum() for c in range(256)])

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, RUN_BYTES + 1)
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            np.cumprod(table, out=table)
            _powers[i] = table
    return _powers[0], _powers[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts); a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8), at


def runs(offsets: np.ndarray, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes in all."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of consecutive texts, and the number of words of each text."""
    low = int(offsets[0])
    data, at = data[low : int(offsets[-1])], offsets - low
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at) - 1, np.int64)
    inside = table[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    full = at[:-1] < at[1:]
    before[at[:-1][full]] = False
    after[at[1:][full] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after)
    power, inverse = _power_tables(len(data))
    values = _VALUES[data]
    values *= power[: len(data)]
    sums = np.cumsum(values)
    hashed = mix((sums[ends] - sums[starts] + values[starts]) * inverse[starts])
    return hashed, np.diff(np.searchsorted(starts, at))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles in order, and their number; a text of fewer words has one, of all its words."""
    step = [_U(pow(int(_STEP), k, 1 << 64)) for k in range(size)]
    first = np.concatenate(([0], np.cumsum(counts)))
    many = np.maximum(counts - size + 1, (counts > 0).astype(counts.dtype))
    out = np.zeros(len(words), dtype=np.uint64)
    if len(words) >= size:
        m = len(words) - size + 1
        for k in range(size):
            out[:m] += words[k : k + m] * step[k]
    for few in range(1, size):
        at = first[:-1][counts == few]
        if len(at):
            out[at] = sum(words[at + k] * step[k] for k in range(few)) + _U(few * 0x51ED27)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(words)) - first[:-1][text]
    return mix(out[place < many[text]], 0xABCDEF), many


def shingle_sets(column: pa.Array, table: np.ndarray, size: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """The index and the sorted distinct shingle hashes of each text."""
    data, offsets = utf8(column)
    for a, b in runs(offsets):
        hashed, many = shingle_hashes(*word_hashes(data, offsets[a : b + 1], table), size)
        at = np.concatenate(([0], np.cumsum(many)))
        for i in range(b - a):
            yield a + i, np.unique(hashed[at[i] : at[i + 1]])
