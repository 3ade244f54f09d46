"""Words and word shingles of UTF-8 texts as 64-bit hashes, in numpy over whole slices of texts.

Words are runs of bytes other than ASCII white space, with A-Z lower-cased. A word's hash is a polynomial over random
values of its bytes modulo 2^64, mixed at the end; a shingle's hash combines the hashes of its words. Two different
shingles of one text share a hash with a chance below n^2 / 2^65 for n shingles: below 10^-9 for 100,000 words.
"""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240601)
_VALUES = _rng.integers(1, 1 << 64, 256, np.uint64)
_VALUES[65:91] = _VALUES[97:123]  # A-Z as a-z
_PLACES = _rng.integers(1, 1 << 64, 64, np.uint64) | np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
#: Bytes that are hashed at a time: arrays of eight bytes for each of them stay small.
BLOCK = 1 << 20


def power_tables(n: int, known={}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006 - tables of the worker process
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    if 2 * BLOCK not in known:
        known[2 * BLOCK] = _powers(2 * BLOCK)
    return known[2 * BLOCK] if n <= 2 * BLOCK else _powers(n)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    tables = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        out = np.full(n, base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        tables.append(out)
    return tables[0], tables[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, text after text, and offsets of the texts' words."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    ink = ~_BLANK[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1] | edge[1:-1]
    last[:-1] &= ~ink[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):  # words of a block, the last of which may reach beyond it
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + BLOCK)))
        base = starts[low]
        part = raw[base:ends[high - 1]]
        powers, inverse = power_tables(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUES[part] * powers[: len(part)], out=sums[1:])
        begin, end = starts[low:high] - base, ends[low:high] - base
        hashes[low:high] = mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
        low = high
    return hashes, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle in its place, and offsets by text; a text of fewer words has one shingle, all its words."""
    counts = np.diff(offsets)
    full = np.zeros(len(words), np.uint64)
    for j in range(size):
        full[: max(0, len(words) - j)] += words[j:] * _PLACES[j]
    number = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out_at = np.zeros(len(number) + 1, np.int64)
    np.cumsum(number, out=out_at[1:])
    place = np.arange(out_at[-1]) + np.repeat(offsets[:-1] - out_at[:-1], number)
    values = full[place]
    for text in np.flatnonzero((counts > 0) & (counts < size)):
        a, b = offsets[text], offsets[text + 1]
        values[out_at[text]] = np.append(words[a:b] * _PLACES[: b - a], _PLACES[size + b - a]).sum(dtype=np.uint64)
    return mix(values), out_at


def plain_words(text: bytes) -> list[bytes]:
    """The words themselves: the same cut as in ``word_hashes``."""
    return text.lower().split()


def plain_shingles(text: bytes, size: int = SHINGLE) -> set[tuple[bytes, ...]]:
    words = plain_words(text)
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}
