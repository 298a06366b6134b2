"""Words of many texts at once: numpy over the bytes of an Arrow column.

A word is a run of ASCII letters and digits and of all bytes past ASCII, in lower case
(A-Z only).  Each has a 64-bit hash: a polynomial over its bytes, from prefix sums, mixed so
that all bits depend on all bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are spread out at once, unless a single text is longer.
CHUNK = 1 << 21

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that its powers can be undone
UNDO = np.uint64(pow(int(BASE), -1, 1 << 64))

_bytes = np.arange(256)
LOWER = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)
IN_WORD = (((LOWER >= 97) & (LOWER <= 122)) | ((_bytes >= 48) & (_bytes <= 57)) | (_bytes >= 128))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads differences over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each text begins and ends; NULL is empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0]:at[-1]], at - at[0]


def pieces(at: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes together."""
    first = 0
    while first < len(at) - 1:
        last = int(np.searchsorted(at, at[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(at) - 1)
        yield first, last
        first = last


def hashed_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, hashes of all words, where each row's words begin)`` per piece."""
    body, at = flat(column)
    powers = undo = np.ones(1, dtype=np.uint64)
    for first, last in pieces(at):
        text, cut = LOWER[body[at[first]:at[last]]], at[first:last + 1] - at[first]
        if len(text) >= len(powers):
            n = len(text) + 1
            powers = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, BASE, dtype=np.uint64)])
            undo = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, UNDO, dtype=np.uint64)])
        inside = np.concatenate([IN_WORD[text], [False]])
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = cut[:-1][cut[:-1] < len(text)]
        begins[edges] = inside[edges]
        ends = np.zeros(len(text) + 1, dtype=bool)
        ends[1:] = inside[:-1] & ~inside[1:]
        ends[edges] |= np.r_[False, inside[:-1]][edges]
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((text.astype(np.uint64) + np.uint64(1))
                                                         * powers[:len(text)])])
        yield first, mixed((sums[stops] - sums[starts]) * undo[starts]), np.searchsorted(starts, cut)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Rolling hash of every ``size`` words in a row."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        total += words[i:i + n] * np.uint64(pow(int(BASE), i, 1 << 64))
    return mixed(total)
