"""An enhanced suffix array in memory: ranks by prefix doubling, common prefixes, intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class EnhancedSuffixArray:
    """Suffixes of ``octets`` in order of their first ``depth`` bytes or more, with common prefixes.

    A suffix ends with its text: ``ends[i]`` is the end of the text that position i lies in.
    ``starts`` are the positions whose suffixes are listed. ``lcp[i]`` is the common prefix
    of the i-th and the one before it, exact up to ``depth`` and beyond.
    """

    def __init__(self, octets: np.ndarray, ends: np.ndarray, starts: np.ndarray, depth: int):
        n = len(octets)
        left = ends - np.arange(n)
        # Eight bytes from each position on as one number, zeros beyond the text's end.
        word = np.zeros(n, dtype=np.uint64)
        for back in range(8):
            inside = left > back
            word <<= np.uint64(8)
            word[inside] |= octets[np.flatnonzero(inside) + back]
        rank = np.unique(word, return_inverse=True)[1].astype(np.int64) + 1
        self._levels = [(1 << k, word >> np.uint64(64 - (8 << k))) for k in range(3)] + [(8, rank)]
        width = 8
        while width < int(left.max(initial=1)):
            second = np.zeros(n, dtype=np.int64)
            inside = np.flatnonzero(left > width)
            second[inside] = rank[inside + width]
            pair = rank * (int(second.max(initial=0)) + 1) + second
            rank = np.unique(pair, return_inverse=True)[1].astype(np.int64) + 1
            width *= 2
            self._levels.append((width, rank))
        order = np.lexsort((starts, rank[starts]))
        self.positions = starts[order]
        self.left = left[self.positions]
        self.lcp = np.zeros(len(starts), dtype=np.int64)
        if len(starts) > 1:
            self.lcp[1:] = self._common(self.positions[:-1], self.positions[1:], left)

    def _common(self, a: np.ndarray, b: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Common prefixes of suffixes, from the widest prefixes that were ranked to the narrowest."""
        most = np.minimum(left[a], left[b])
        done = np.zeros(len(a), dtype=np.int64)
        for width, rank in reversed(self._levels):
            at = np.flatnonzero(done + width <= most)
            at = at[rank[a[at] + done[at]] == rank[b[at] + done[at]]]
            done[at] += width
        return done

    def intervals(self, least: int) -> Iterator[tuple[int, int, int]]:
        """The common-prefix interval tree down to depth ``least``: (depth, first, last) of each node.

        A stack holds the intervals that are still open; each is given when it closes, so
        children come before their parents.
        """
        stack: list[tuple[int, int]] = []  # depth, first
        lcp = self.lcp
        for at in np.flatnonzero((lcp >= least) | np.r_[False, lcp[:-1] >= least]).tolist():
            here, first = int(lcp[at]) if lcp[at] >= least else 0, at - 1
            while stack and stack[-1][0] > here:
                depth, first = stack.pop()
                yield depth, first, at - 1
            if here and (not stack or stack[-1][0] < here):
                stack.append((here, first))
        while stack:
            depth, first = stack.pop()
            yield depth, first, len(lcp) - 1

    def maximal_repeats(self, least: int, before: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Length and all occurrences of each repeat that neither side can extend.

        ``before[p]`` is the byte before position p, or -1 where a text begins. A repeat whose
        occurrences all follow the same byte is part of a longer one and is passed over.
        """
        preceding = before[self.positions]
        differs = np.r_[0, np.cumsum((preceding[1:] != preceding[:-1]) | (preceding[1:] < 0))]
        for depth, first, last in self.intervals(least):
            if differs[last] > differs[first]:
                yield depth, self.positions[first : last + 1]
