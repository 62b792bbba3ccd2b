"""Sorted suffixes of many short sequences at once, by prefix doubling in numpy.

Sequences stand one after another in one array, each closed by a place with nothing ``left``. Two
suffixes that are equal up to the ends of their sequences are ordered by their places.
"""

from __future__ import annotations

import numpy as np


class Suffixes:
    """The order of all suffixes, and for each power of two whether stretches of that length are equal.

    ``key`` holds for each place a number that orders its first ``span`` symbols, those beyond the
    end of its sequence being least; ``left`` the symbols up to the end.
    """

    def __init__(self, key: np.ndarray, left: np.ndarray, span: int = 1):
        self.left, self.span = left, span
        order = np.argsort(key).astype(np.int32)
        ordered = key[order]
        new = np.ones(len(key), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(len(key), np.int32)
        first = np.flatnonzero(new).astype(np.int32)
        sizes = np.diff(first, append=len(key))
        rank[order] = np.repeat(first, sizes)
        #: (length, rank of the stretch of that length from each place), by length.
        self.levels = [(span, rank)]
        open_ = np.flatnonzero(np.repeat(sizes > 1, sizes))
        open_ = order[open_]
        length = span
        while True:
            open_ = open_[left[open_] >= length]
            if not len(open_):
                break
            rank = rank.copy()
            pair = rank[open_].astype(np.int64) << 32 | rank[open_ + length]
            turn = np.argsort(pair)
            pair, open_ = pair[turn], open_[turn]
            own = pair >> 32
            starts = np.ones(len(pair), bool)
            starts[1:] = pair[1:] != pair[:-1]
            first = np.flatnonzero(starts)
            opens = np.ones(len(pair), bool)
            opens[1:] = own[1:] != own[:-1]
            sizes = np.diff(first, append=len(pair))
            base = np.maximum.accumulate(np.where(opens, np.arange(len(pair)), 0))[first]
            rank[open_] = np.repeat(own[first] + first - base, sizes)
            length *= 2
            self.levels.append((length, rank))
            open_ = open_[np.repeat(sizes > 1, sizes)]
        self.order = np.argsort(rank, kind="stable").astype(np.int32)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at ``a`` and ``b`` have in common, up to a multiple of ``span``."""
        most = np.minimum(self.left[a], self.left[b])
        got = np.zeros(len(a), np.int32)
        for length, rank in reversed(self.levels):
            go = np.flatnonzero(got < most)
            x, y = a[go] + got[go], b[go] + got[go]
            got[go[rank[x] == rank[y]]] += length
        return np.minimum(got, most)

    def before(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Symbols before ``a`` that equal those before ``b``, at most ``most``; for a ``span`` of one."""
        got = np.zeros(len(a), np.int64)
        for length, rank in reversed(self.levels):
            go = np.flatnonzero(got + length <= most)
            back = got[go] + length
            got[go[rank[a[go] - back] == rank[b[go] - back]]] += length
        return got
