"""Byte-pair merging of many words at once, in rounds over flat numpy arrays.

All words lie one after another in one array of symbols. A round looks up the rank of every adjacent pair, takes the
least rank of each word by a segmented minimum, merges all leftmost non-overlapping pairs of that rank at once, and
closes the gaps. Words without a pair of the table leave the array; the rounds end when none is left.

Merging all pairs of a rank at once equals merging them one after another as long as a merge cannot give a pair that
comes before the remaining ones. Where the table allows that (``serial`` symbols), a round merges the leftmost only; a
word with many such merges ahead (a long run of one sign) leaves the rounds and is merged from a heap of its pairs, so
that its time stays near its length.
"""

from __future__ import annotations

import heapq

import numpy as np

NONE = np.iinfo(np.int32).max
#: Serial merges of one rank in a word beyond which it is merged from a heap.
SERIAL = 32


class PairTable:
    """Rank and merged symbol of each pair of symbols; lower ranks merge first."""

    def __init__(self, left, right, rank, merged, symbols: int):
        left, right = np.asarray(left, np.int64), np.asarray(right, np.int64)
        self.symbols = symbols
        order = np.argsort(left * symbols + right)
        self.keys = (left * symbols + right)[order]
        self.rank = np.asarray(rank, np.int32)[order]
        self.merged = np.asarray(merged, np.int32)[order]
        made_at = np.full(symbols, -1, np.int64)  # latest rank that makes a symbol
        np.maximum.at(made_at, np.asarray(merged), np.asarray(rank))
        early = np.asarray(rank) <= np.maximum(made_at[left], made_at[right])
        self.serial = np.zeros(symbols, bool)
        for part in (left, right):
            late = early & (made_at[part] >= np.asarray(rank))
            self.serial[part[late]] = True

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE without entry) and place in the table of each pair."""
        if not len(self.keys):
            return np.full(len(left), NONE, np.int32), np.zeros(len(left), np.int64)
        key = left.astype(np.int64) * self.symbols + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE).astype(np.int32), at


def merge_by_heap(symbols: list[int], table: PairTable) -> list[int]:
    """Symbols that survive in one word, by the least rank and the leftmost place at every step."""
    known: dict[tuple[int, int], tuple[int, int]] = {}

    def pair(a: int, b: int) -> tuple[int, int]:
        if (a, b) not in known:
            rank, at = table.find(np.array([a]), np.array([b]))
            known[a, b] = (int(rank[0]), int(table.merged[at[0]]) if rank[0] != NONE else -1)
        return known[a, b]

    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r << 40) | i for i in range(n - 1) if (r := pair(symbols[i], symbols[i + 1])[0]) != NONE]
    heapq.heapify(heap)
    while heap:
        top = heapq.heappop(heap)
        rank, i = top >> 40, top & ((1 << 40) - 1)
        j = after[i]
        if symbols[i] < 0 or j >= n:
            continue
        now, merged = pair(symbols[i], symbols[j])
        if now != rank:
            continue
        symbols[i], symbols[j] = merged, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            r = pair(merged, symbols[k])[0]
            if r != NONE:
                heapq.heappush(heap, (r << 40) | i)
        h = before[i]
        if h >= 0:
            r = pair(symbols[h], merged)[0]
            if r != NONE:
                heapq.heappush(heap, (r << 40) | h)
    return [s for s in symbols if s >= 0]


def merge_words(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that survive, word after word, and their number per word."""
    count = len(lengths)
    word = np.repeat(np.arange(count, dtype=np.int32), lengths)
    sym = symbols.astype(np.int32)
    done_words, done_syms = [], []
    rank, place = np.full(len(sym), NONE, np.int32), np.zeros(len(sym), np.int64)
    if len(sym) > 1:
        rank[:-1], place[:-1] = table.find(sym[:-1], sym[1:])
        rank[:-1][word[:-1] != word[1:]] = NONE
    while len(sym):
        first = np.flatnonzero(np.diff(word, prepend=np.int32(-1)))
        least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(sym))))
        over = least == NONE
        done_words.append(word[over])
        done_syms.append(sym[over])
        at = np.flatnonzero((rank == least) & ~over)
        if not len(at):
            break
        fresh = np.ones(len(at), bool)
        fresh[1:] = at[1:] != at[:-1] + 1
        within = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        merged = table.merged[place[at]]
        keep = within % 2 == 0
        late = table.serial[merged]
        if late.any():
            many = np.flatnonzero(np.bincount(word[at[late]], minlength=1) > SERIAL)
            if len(many):
                for w in many.tolist():
                    a, b = np.searchsorted(word, [w, w + 1])
                    rest = np.array(merge_by_heap(sym[a:b].tolist(), table), np.int32)
                    done_words.append(np.full(len(rest), w, np.int32))
                    done_syms.append(rest)
                alive = ~(over | np.isin(word, many))
                sym, word, rank, place = sym[alive], word[alive], rank[alive], place[alive]
                continue
            leftmost = np.ones(len(at), bool)
            leftmost[1:] = word[at[1:]] != word[at[:-1]]
            keep &= leftmost | ~table.serial[merged]
        at, merged = at[keep], merged[keep]
        sym[at] = merged
        alive = ~over
        alive[at + 1] = False
        moved = np.cumsum(alive) - 1
        sym, word, rank, place = sym[alive], word[alive], rank[alive], place[alive]
        at = moved[at]
        touched = np.zeros(len(sym) + 1, bool)
        touched[at] = touched[at - 1] = True  # -1 is the spare last place
        if len(sym):
            rank[-1], touched[len(sym) - 1 :] = NONE, False
        again = np.flatnonzero(touched)
        found, where = table.find(sym[again], sym[again + 1])
        found[word[again] != word[again + 1]] = NONE
        rank[again], place[again] = found, where
    words = np.concatenate(done_words) if done_words else np.zeros(0, np.int32)
    out = np.concatenate(done_syms) if done_syms else np.zeros(0, np.int32)
    order = np.argsort(words, kind="stable")
    return out[order], np.bincount(words, minlength=count)
