"""Benchmark decontamination under edit distance: CGK embedding, bit-sampling LSH, exact verification.

Words are runs of letters and digits, A-Z as a-z. A document holds an item of n words when some passage of it is at most
floor(allowed * n) word edits (insert, delete, replace) from the item.

1. Windows as long as an item are laid where a short run of words agrees with the item. An item with at most k edits
   keeps some run of ceil((n - k) / (k + 1)) words unedited, so with runs no longer than that no passage is missed.
2. Windows and items are embedded by the CGK random walk: a pointer reads the word it stands on and moves on by a random
   bit that depends on step and word. Words that differ by few edits give outputs with few differing places.
3. Each of ``repeats`` walks is sampled at ``bits`` random places, ``tables`` times; a window that agrees with the item
   in all places of some sample is a candidate.
4. Candidates are verified by the exact edit distance between the item and the best passage in reach of the window.

The items go to the tasks in blocks of bounded size (BLOCK_BYTES of text; one pass over the documents for each block), so
a benchmark of any size works. There is no shuffle. Null texts, empty texts and items without words match nothing.
Repeated rows give repeated results; equal items are reported each under its item_id; of passages equally near, the
first is reported. ``drop_contaminated`` returns the input's columns, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.llm.common import table
from corpusql.llm.textops import PUNCTUATION, Slice, mix, slices, windows

#: Part of an item's words that may be edited. With 6 walks, 6 samples each of 3 places, a passage with a fifth of its
#: words edited is found with probability over 0.97; with half as many edits, practically always.
ALLOWED, REPEATS, TABLES, BITS = 0.2, 6, 6, 3
BLOCK_BYTES = 32 << 20
SEED = 20_011


def _tokens(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, docs = s.words(PUNCTUATION)
    s.sums(fold=True)
    return s.hashes(starts, ends), starts, ends, docs


class Items:
    """A block of benchmark items, ready to look documents up in."""

    def __init__(self, rows: list[tuple[int, str]], allowed: float = ALLOWED, repeats: int = REPEATS, tables: int = TABLES, bits: int = BITS):
        self.repeats, self.tables, self.bits = repeats, tables, bits
        words, ids = [], []
        for s in slices(pa.array([t for _, t in rows], pa.string())):
            h, _, _, docs = _tokens(s)
            words += [h[docs == d] for d in range(s.n_docs)]
        rows = [r[0] for r in rows]
        full = [i for i, w in enumerate(words) if len(w)]
        self.ids, self.words = [rows[i] for i in full], [words[i] for i in full]
        self.n = np.array([len(w) for w in self.words], np.int64)
        self.most = np.floor(self.n * allowed).astype(np.int64)
        seed = np.minimum(-(-(self.n - self.most) // (self.most + 1)), 4)
        #: seed length to (sorted hashes, item, place in the item)
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for g in sorted(set(seed.tolist())):
            found = [(windows(self.words[i], np.zeros(self.n[i], np.int64), g), i) for i in np.flatnonzero(seed == g)]
            keys = np.concatenate([k for (k, _), _ in found])
            item = np.concatenate([np.full(len(k), i) for (k, _), i in found])
            place = np.concatenate([at for (_, at), _ in found])
            order = np.argsort(keys, kind="stable")
            self.seeds[g] = keys[order], item[order], place[order]
        flat = np.concatenate(self.words) if self.words else np.zeros(0, np.uint64)
        begin = np.concatenate([[0], np.cumsum(self.n)])[:-1] if self.words else np.zeros(0, np.int64)
        self.sketches = self.embed(flat, begin, begin + self.n, self.n)

    def embed(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: np.ndarray) -> np.ndarray:
        """One number for each sequence words[start:end] and sample; the walk of an n-word sequence has 3n steps."""
        out = np.zeros((len(starts), self.repeats * self.tables), np.uint64)
        blank = np.uint64(0x5BD1E995)
        for r in range(self.repeats):
            for size in np.unique(n):
                rows = np.flatnonzero(n == size)
                rng = np.random.default_rng([SEED, r, int(size)])
                # Sampled from the first two thirds of the walk: it reads a sequence in about 2n steps.
                places = rng.integers(0, 2 * size, (self.tables, self.bits))
                salts = rng.integers(1, 1 << 63, int(2 * size), dtype=np.uint64)
                at, end = starts[rows].copy(), ends[rows]
                own = np.zeros((len(rows), self.tables), np.uint64)
                for j in range(int(places.max()) + 1):
                    inside = at < end
                    word = np.where(inside, words[np.minimum(at, len(words) - 1)], blank)
                    for t in np.flatnonzero((places == j).any(1)):
                        own[:, t] = mix(own[:, t] ^ word) + np.uint64(j + 1)
                    at += inside & ((mix(word ^ salts[j]) & np.uint64(1)) == 1)
                out[rows, r * self.tables : (r + 1) * self.tables] = own
        return out

    def candidates(self, words: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, item) of the windows that share a sample with their item."""
        begin = np.searchsorted(docs, docs, "left")  # each word's document's first word
        items, firsts = [], []
        for g, (keys, item, place) in self.seeds.items():
            found, at = windows(words, docs, g)
            if not len(found):
                continue
            low, high = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
            hit = np.flatnonzero(high > low)
            count = (high - low)[hit]
            which = np.repeat(low[hit], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            where = np.repeat(at[hit], count)
            items.append(item[which])
            firsts.append(np.maximum(where - place[which], begin[where]))
        if not items:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.column_stack([np.concatenate(firsts), np.concatenate(items)]), axis=0)
        first, item = pairs[:, 0], pairs[:, 1]
        keep = np.zeros(len(first), bool)
        end = np.searchsorted(docs, docs[first], "right")
        for a in range(0, len(first), 50_000):
            b = slice(a, a + 50_000)
            own = self.embed(words, first[b], np.minimum(first[b] + self.n[item[b]], end[b]), self.n[item[b]])
            keep[b] = (own == self.sketches[item[b]]).any(1)
        return first[keep], item[keep]

    def matches(self, words: np.ndarray, docs: np.ndarray) -> dict[int, dict[int, tuple[int, int, int]]]:
        """Document to item to (edits, first word, word after the last) of the nearest passage."""
        out: dict[int, dict[int, tuple[int, int, int]]] = {}
        for first, item in zip(*self.candidates(words, docs), strict=True):
            doc, most = int(docs[first]), int(self.most[item])
            known = out.get(doc, {}).get(int(item))
            if known and known[0] == 0:
                continue
            low = max(int(np.searchsorted(docs, doc, "left")), int(first) - most)
            high = min(int(np.searchsorted(docs, doc, "right")), int(first + self.n[item]) + most)
            edits, a, b = nearest_passage(self.words[item], words[low:high])
            if edits <= most and (not known or (edits, low + a) < known[:2]):
                out.setdefault(doc, {})[int(item)] = (edits, low + a, low + b)
        return out


def nearest_passage(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Fewest word edits between the item and any passage of the text, and the first such passage [a, b)."""
    m = len(text)
    scale = 1 << 20  # the cost in the high part, where the passage began in the low part
    now = np.arange(m + 1, dtype=np.int64)
    steps = np.arange(m + 1, dtype=np.int64) * scale
    for w in item:
        new = now + scale
        new[1:] = np.minimum(new[1:], now[:-1] + np.where(text == w, 0, scale))
        now = np.minimum.accumulate(new - steps) + steps
    end = int(np.argmin(now))
    return int(now[end] >> 20), int(now[end] & (scale - 1)), end


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about BLOCK_BYTES of text."""
    items = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield sorted((r[0], r[1]) for r in part.collect())


def contaminated(docs: DataFrame, items: DataFrame, allowed: float = ALLOWED) -> DataFrame:
    """doc_id, item_id, n_words of the item, edits, and the passage's start and end in code points; only for matches."""
    spark, out = docs.sparkSession, None
    schema = "doc_id bigint, item_id bigint, n_words bigint, edits bigint, start bigint, end bigint"
    for rows in _blocks(items):
        shared = spark.sparkContext.broadcast(Items(rows, allowed))

        def each(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                ids, found = batch.column(0), []
                for s in slices(batch.column(1)):
                    words, starts, ends, owner = _tokens(s)
                    for d, per in known.matches(words, owner).items():
                        lead = (s.data[s.offsets[d] : s.offsets[d + 1]] & 0xC0) != 0x80
                        at = np.concatenate([[0], np.cumsum(lead)])
                        for item, (edits, a, b) in sorted(per.items()):
                            span = (at[starts[a] - s.offsets[d]], at[ends[b - 1] - s.offsets[d]]) if b > a else (0, 0)
                            found.append((ids[s.first + d].as_py(), known.ids[item], int(known.n[item]), edits, int(span[0]), int(span[1])))
                if found:
                    names = ("doc_id", "item_id", "n_words", "edits", "start", "end")
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], list(names))

        part = docs.select("doc_id", "text").mapInArrow(each, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, items: DataFrame, allowed: float = ALLOWED) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    spark, names, schema = docs.sparkSession, docs.columns, docs.schema
    for rows in _blocks(items):
        shared = spark.sparkContext.broadcast(Items(rows, allowed))

        def each(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for s in slices(batch.column(names.index("text"))):
                    words, _, _, owner = _tokens(s)
                    keep[[s.first + d for d in shared.value.matches(words, owner)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(each, schema)
    return docs


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
