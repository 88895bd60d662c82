"""Whole Arrow batches of text as numpy arrays: words, hashes of words and of any byte range, counts by document.

Everything works on UTF-8 bytes. Hashes of ranges come from one running sum of byte values times powers of an odd base
modulo 2**64, so the hash of any range costs one subtraction and one product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Every ASCII byte but letters and digits sets words apart; bytes of longer characters never do.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix finaliser)."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
_LOWER_VALUES = _VALUES.copy()
_LOWER_VALUES[65:91] = _VALUES[97:123]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


class Slice:
    """Some consecutive documents of a batch: their bytes end to end, and where each starts."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.n_docs = len(offsets) - 1
        self._fold: bool | None = None

    def by_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value for each byte, by document."""
        run = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=run[1:])
        return run[self.offsets[1:]] - run[self.offsets[:-1]]

    def sums(self, fold: bool) -> None:
        """Prepare ``hashes``; fold: A-Z count as a-z."""
        if fold is self._fold:
            return
        self._fold = fold
        n = len(self.data)
        up, self._down = powers(n + 1)
        self._run = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER_VALUES if fold else _VALUES)[self.data] * up[:n], out=self._run[1:])

    def forget_sums(self) -> None:
        """Free what ``sums`` made."""
        self._fold = None
        del self._run, self._down

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self._run[ends] - self._run[starts]) * self._down[starts]
        return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))

    def words(self, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and documents of all words, a word being a run of bytes that are not ``apart`` (white space)."""
        if not len(self.data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        inside = ~apart[self.data]
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        full = self.offsets[1:] > self.offsets[:-1]
        before[self.offsets[:-1][full]] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        after[self.offsets[1:][full] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1


class WordSlice(Slice):
    """The words of a slice in place of its bytes: ``data`` holds a 64-bit hash of each word, positions count words."""

    def __init__(self, s: Slice):
        starts, ends, docs = s.words()
        s.sums(fold=False)
        super().__init__(s.first, s.hashes(starts, ends), np.searchsorted(docs, np.arange(s.n_docs + 1)))

    def sums(self, fold: bool) -> None:
        n = len(self.data)
        up, self._down = powers(n + 1)
        self._run = np.zeros(n + 1, np.uint64)
        np.cumsum(self.data * up[:n], out=self._run[1:])


def slices(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[Slice]:
    """The column (null: empty) in slices of at most ``most_bytes``, or of one longer document."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1)
        yield Slice(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def windows(hashes: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k consecutive words of one document, and the index of each one's first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = (h ^ hashes[i : i + n]) * np.uint64(0x9FB21C651E98DF25) + np.uint64(i + 1)
        h ^= h >> np.uint64(29)
    first = np.flatnonzero(docs[:n] == docs[k - 1 : k - 1 + n])
    return mix(h[first]), first


def spans_union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open spans as maximal runs; spans that touch become one run."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return starts[at], reach[np.append(at[1:] - 1, len(starts) - 1)]
