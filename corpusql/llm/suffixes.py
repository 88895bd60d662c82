"""Difference-cover blockwise suffix sorting in numpy, for one bucket's text at a time.

A difference cover D of v holds, for any two positions i and j, a shift below v that brings both onto covered residues.
So suffixes that agree on v bytes are told apart by the ranks of two covered suffixes, which are computed beforehand
for the covered positions alone. Suffixes are then sorted one block at a time (a range of first eight bytes), which is
what bounds memory: a block needs its own positions and the cover's ranks, never an array for all suffixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

V, ROOT = 64, 8
#: Every difference below V is a multiple of ROOT minus a number below ROOT.
COVER = sorted({*range(ROOT), *range(0, V, ROOT)})
_COVERED = np.zeros(V, bool)
_COVERED[COVER] = True
#: SHIFT[a, b]: the least shift that brings residues a and b both onto the cover.
SHIFT = np.array([[next(d for d in range(V) if _COVERED[(a + d) % V] and _COVERED[(b + d) % V]) for b in range(V)] for a in range(V)], np.int64)


class Text:
    """Bytes with the big-endian word of eight at every position; zeros follow the end."""

    def __init__(self, data: np.ndarray, depth: int):
        self.n, self.depth = len(data), depth
        padded = np.zeros(len(data) + depth + 2 * V, np.uint8)
        padded[: len(data)] = data
        self.words = np.zeros(len(padded) - 8, np.uint64)
        for k in range(8):
            self.words <<= np.uint64(8)
            self.words |= padded[k : len(padded) - 8 + k]
        self._rank_cover()

    def _refine(self, at: np.ndarray, group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions sorted by (group, key), and group numbers of the finer groups in that order."""
        order = np.lexsort((key, group))
        group, key = group[order], key[order]
        new = np.append(True, (group[1:] != group[:-1]) | (key[1:] != key[:-1]))
        return at[order], np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))

    def _by_prefix(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions sorted by their first V bytes; equal ones share a group number (their first place)."""
        at, group = self._refine(at, np.zeros(len(at), np.int64), self.words[at])
        for k in range(8, V, 8):
            same = np.append(group[1:] == group[:-1], False)
            tied = np.flatnonzero(same | np.append(False, same[:-1]))
            if not len(tied):
                break
            own, finer = self._refine(at[tied], group[tied], self.words[at[tied] + k])
            at[tied], group[tied] = own, tied[finer]
        return at, group

    def _rank_cover(self) -> None:
        """Ranks of the covered suffixes, to ``depth`` bytes and V more: by V bytes, then doubling in steps of V."""
        every = np.arange(self.n, dtype=np.int64)
        at, group = self._by_prefix(every[_COVERED[every % V]])
        self.rank = np.zeros(self.n + self.depth + 2 * V, np.int32)
        self.rank[at] = group + 1
        reach = V
        while reach < self.depth + V:
            same = np.append(group[1:] == group[:-1], False)
            tied = np.flatnonzero(same | np.append(False, same[:-1]))
            if not len(tied):
                break
            ahead = np.minimum(at[tied] + reach, len(self.rank) - 1)
            own, finer = self._refine(at[tied], group[tied], self.rank[ahead])
            at[tied], group[tied] = own, tied[finer]
            self.rank[at[tied]] = group[tied] + 1
            reach *= 2

    def _compare(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Sign of the order of suffixes that agree on V bytes."""
        d = SHIFT[i % V, j % V]
        return np.sign(self.rank[i + d].astype(np.int64) - self.rank[j + d])

    def _resolve(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Sorts inside the groups of a prefix-sorted block: a three-way quicksort of all groups at once."""
        live = np.arange(len(at))
        rng = np.random.default_rng(7)
        while True:
            same = np.append(group[live][1:] == group[live][:-1], False) if len(live) else np.zeros(0, bool)
            live = live[same | np.append(False, same[:-1])] if len(live) else live
            if not len(live):
                return at
            g = group[live]
            first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            size = np.diff(np.append(first, len(g)))
            pivot = at[live[first + (rng.random(len(first)) * size).astype(np.int64)]]
            side = self._compare(at[live], np.repeat(pivot, size))
            order = np.lexsort((side, g))
            at[live], side, g = at[live][order], side[order], g[order]
            new = np.append(True, (g[1:] != g[:-1]) | (side[1:] != side[:-1]))
            group[live] = live[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
            live = live[side != 0]  # those equal to the pivot are in place

    def blocks(self, positions: np.ndarray, most: int = 200_000) -> Iterator[np.ndarray]:
        """The positions in suffix order, one block at a time; equal prefixes of ``depth`` bytes are in one block."""
        if not len(positions):
            return
        n = -(-len(positions) // most)
        first = self.words[positions]
        edges = np.quantile(first[:: max(1, len(first) // 10_000)].astype(np.float64), np.linspace(0, 1, n + 1)[1:-1]) if n > 1 else []
        block = np.searchsorted(np.asarray(edges, np.float64), first.astype(np.float64), "right")
        for k in range(n):
            at, group = self._by_prefix(positions[block == k])
            yield self._resolve(at, group)

    def agree(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffixes i and j agree on ``depth`` bytes (eight at least)."""
        live = np.arange(len(i))
        for k in (*range(0, self.depth - 7, 8), self.depth - 8):
            live = live[self.words[i[live] + k] == self.words[j[live] + k]]
        out = np.zeros(len(i), bool)
        out[live] = True
        return out


def repeated(data: np.ndarray, positions: np.ndarray, depth: int, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
    """Which of the positions start a string of ``depth`` bytes that starts at another of them too.

    low, high: of each position the least and the greatest owner; then a string counts only if two owners have it.
    """
    text = Text(data, depth)
    out = np.zeros(len(data), bool)
    if low is not None:
        least, most = np.zeros((2, len(data)), np.int64)
        least[positions], most[positions] = low, high
    for at in text.blocks(positions):
        if not len(at):
            continue
        same = text.agree(at[:-1], at[1:])
        if low is None:
            out[at[:-1][same]] = True
            out[at[1:][same]] = True
        else:
            first = np.flatnonzero(np.append(True, ~same))
            shared = np.minimum.reduceat(least[at], first) < np.maximum.reduceat(most[at], first)
            out[at[np.repeat(shared, np.diff(np.append(first, len(at))))]] = True
    return out[positions]
