"""Texts as blocks of words with a dictionary each.

Counts of all words of a corpus don't fit in a task, but those of the words of one block do. A block's distinct words go
out to be counted or looked up, and what is found comes back to the block by its number: no dictionary of the corpus is
ever broadcast. Texts of any length: one that is longer than a block is cut between words, and each part holds some words
of its neighbours as context.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard

from . import shingles as S

#: Bytes of texts in a block.
SIZE = 1 << 22


class Block(NamedTuple):
    words: pa.Array  # distinct words, A-Z lower-cased
    codes: np.ndarray  # of each word in order, the index of its distinct word
    fresh: np.ndarray  # of each word, whether no context reaches it from before
    text: np.ndarray  # of each word, its text
    own: tuple[int, int]  # the words that aren't context of a neighbour
    texts: tuple[int, int]  # the texts
    ends: bool  # whether the texts end here; only a cut text doesn't


def word_bounds(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that lie at ``at`` in ``data``, which begins and ends with them."""
    held = inside[data]
    edge = np.flatnonzero(held[1:] != held[:-1]) + 1
    # a text's start parts words, too
    parts = at[(at > 0) & (at < len(data))]
    parts = parts[held[parts] & held[parts - 1]] if len(parts) else parts
    if len(held) and held[0]:
        edge = np.concatenate(([0], edge))
    if len(held) and held[-1]:
        edge = np.append(edge, len(held))
    if len(parts):
        edge = np.sort(np.concatenate((edge, np.repeat(np.unique(parts), 2))))
    return edge[::2], edge[1::2]


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct words and each word's index among them. The gaps between words are encoded along with them, and dropped."""
    if not len(starts):
        return pa.array([], pa.string()), np.zeros(0, np.int32)
    offsets = np.stack((starts, ends), axis=1).astype(np.int32).ravel()
    both = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    index = both.indices.to_numpy()[::2]
    used = np.zeros(len(both.dictionary), dtype=bool)
    used[index] = True
    return both.dictionary.filter(pa.array(used)).cast(pa.string()), (np.cumsum(used, dtype=np.int32) - 1)[index]


def _gap(data: np.ndarray, at: int, high: int, inside: np.ndarray) -> int:
    """The first place from ``at`` that no word holds."""
    while at < high:
        found = np.flatnonzero(~inside[data[at : min(at + 4096, high)]])
        if len(found):
            return at + int(found[0])
        at += 4096
    return high


def _context(data: np.ndarray, low: int, high: int, inside: np.ndarray, words: int, last: bool) -> int:
    """Where the ``last`` or first ``words`` words of ``data[low:high]`` begin or end."""
    span = 1024
    while True:
        a, b = (max(low, high - span), high) if last else (low, min(high, low + span))
        starts, ends = word_bounds(data[a:b], np.zeros(0, np.int64), inside)
        # the outermost word may go on beyond the part that is read
        if len(starts) > words:
            return a + int(starts[-words] if last else ends[words - 1])
        if (a, b) == (low, high):
            return low if last else high
        span *= 4


def _block(data: np.ndarray, at: np.ndarray, inside: np.ndarray, breaks: np.ndarray | None, own: tuple[int, int], first: int, ends: bool) -> Block:
    """``at`` and ``own`` are places in ``data``; ``first`` is the number of the first text."""
    data = S.LOWER[data]
    starts, stops = word_bounds(data, at, inside)
    words, codes = distinct_words(data, starts, stops)
    text = np.searchsorted(at, starts, "right") - 1
    piece = text if breaks is None else text + np.cumsum(breaks[data], dtype=np.int64)[starts]
    fresh = np.concatenate(([True], piece[1:] != piece[:-1])) if len(piece) else np.zeros(0, bool)
    held = tuple(int(x) for x in np.searchsorted(starts, own))
    return Block(words, codes, fresh, text + first, held, (first, first + len(at) - 1), ends)


def blocks(column: pa.Array, inside: np.ndarray, breaks: np.ndarray | None = None, context: int = 0, size: int = SIZE, before: int | None = None) -> Iterator[Block]:
    """All words of texts, in order, each in its own block once. ``inside`` and ``breaks`` are tables of bytes.

    Cut texts have ``context`` words of the next part, and ``before`` words (as many, if not given) of the part before.
    """
    before = context if before is None else before
    data, offsets = S.utf8(column)
    for a, b in S.runs(offsets, size):
        low, high = int(offsets[a]), int(offsets[b])
        if high - low <= 2 * size:
            yield _block(data[low:high], offsets[a : b + 1] - low, inside, breaks, (0, high - low), a, True)
            continue
        # one long text
        at = low
        while at < high:
            end = _gap(data, at + size, high, inside) if high - at > 2 * size else high
            left = _context(data, low, at, inside, before, True) if before else at
            right = _context(data, end, high, inside, context, False) if context else end
            yield _block(data[left:right], np.array([0, right - left]), inside, breaks, (at - left, end - left), a, end == high)
            at = end


def pack(x: np.ndarray) -> bytes:
    """Numbers below 2 ** 32, compressed by their first bytes, second bytes and so on."""
    return zstandard.ZstdCompressor(level=1).compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def word_hash(words: pa.Array) -> np.ndarray:
    """64 bits of each word that isn't empty."""
    data, offsets = S.utf8(words)
    return S.word_hashes(data, offsets, np.ones(256, dtype=bool))[0]
