"""Quality rules on repetition inside a text, by a suffix array over its words.

Documents are independent, so there is no shuffle: each Arrow batch is cut into slices of about a megabyte, and one
suffix array over the words of a slice serves all its documents (the document is part of a word's first rank, so no
match crosses documents). Ranks double in length from round to round for the suffixes that are still tied; kept rank
levels give the longest common prefix of neighbours; prefixes of ``min_repeat`` words or more are the maximal repeated
substrings, whose spans are united.

Null and empty texts have no words and fail the base rule. Ties (equal rows) get equal results. Extra columns are
ignored by ``repetition_features``; ``keep_unrepetitive`` returns the input's columns and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.llm.common import table
from corpusql.llm.textops import Slice, slices, spans_union, windows

#: Words that a repeat must have to count as one; the largest part of a text's words that repeats may cover; the
#: longest repeat allowed, in words. Ordinary prose of a thousand words has next to no repeats of eight words.
MIN_REPEAT, MOST_COVERED, LONGEST_REPEAT = 8, 0.3, 120
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def suffix_repeats(first: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For every position the length of the longest repeat that starts there, within its document.

    first: any value for each word, equal for equal words. Suffixes end with their document.
    """
    n = len(first)
    if n < 2:
        return np.zeros(n, np.int64)
    last = np.flatnonzero(np.append(docs[1:] != docs[:-1], True))
    end = last[np.searchsorted(last, np.arange(n))] + 1
    order = np.lexsort((first, docs))
    same = (first[order][1:] == first[order][:-1]) & (docs[order][1:] == docs[order][:-1])
    head = np.maximum.accumulate(np.where(np.append(True, ~same), np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    levels, h = [rank.copy()], 1
    tied = order[np.append(False, same) | np.append(same, False)]
    while len(tied):
        ahead = tied + h
        inside = ahead < end[tied]
        second = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.lexsort((second, rank[tied]))
        tied, second, old = tied[by], second[by], rank[tied[by]]
        at = np.arange(len(tied))
        group = np.append(True, old[1:] != old[:-1])
        part = group | np.append(True, second[1:] != second[:-1])
        rank[tied] = old + np.maximum.accumulate(np.where(part, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        alone = part & np.append(part[1:], True)
        tied = tied[~alone]
        levels.append(rank.copy())
        h *= 2
    array = np.empty(n, np.int64)
    array[rank] = np.arange(n)
    left, right = array[:-1], array[1:]
    common = np.zeros(n - 1, np.int64)
    live = np.flatnonzero(levels[0][left] == levels[0][right])
    for k in range(len(levels) - 1, -1, -1):
        if not len(live):
            break
        i, j = left[live] + common[live], right[live] + common[live]
        fits = (i < end[left[live]]) & (j < end[right[live]])
        equal = fits & (levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)])
        common[live[equal]] += 1 << k
    longest = np.zeros(n, np.int64)
    longest[right] = common
    longest[left] = np.maximum(longest[left], common)
    return longest


def _features(s: Slice, min_repeat: int) -> dict[str, np.ndarray]:
    starts, ends, docs = s.words()
    out = {"n_words": np.bincount(docs, minlength=s.n_docs).astype(np.int64)}
    lead = (s.data & 0xC0) != 0x80
    run = np.zeros(len(s.data) + 1, np.int64)
    np.cumsum(lead, out=run[1:])
    out["word_chars"] = np.bincount(docs, run[ends] - run[starts], s.n_docs).astype(np.int64)
    out["n_symbols"] = s.by_doc(_SYMBOL[s.data])
    s.sums(fold=False)
    out["n_dup_lines"] = _dup_lines(s, starts)
    words = s.hashes(starts, ends)
    keys, at = windows(words, docs, 3)
    order = np.lexsort((keys, docs[at]))
    same = (keys[order][1:] == keys[order][:-1]) & (docs[at][order][1:] == docs[at][order][:-1])
    twice = at[order[(np.append(False, same) | np.append(same, False))[: len(order)]]]
    covered = np.zeros(len(words) + 3, bool)
    for k in range(3):
        covered[twice + k] = True
    out["n_repeat_words"] = np.bincount(docs[covered[: len(words)]], minlength=s.n_docs).astype(np.int64)
    longest = suffix_repeats(words, docs)
    found = np.flatnonzero(longest >= min_repeat)
    gap = docs[found]  # spans of neighbouring documents must not touch
    a, b = spans_union(found + gap, found + gap + longest[found])
    out["covered_words"] = np.zeros(s.n_docs, np.int64)
    np.add.at(out["covered_words"], gap[np.searchsorted(found + gap, a)], b - a)
    out["longest_repeat"] = np.zeros(s.n_docs, np.int64)
    np.maximum.at(out["longest_repeat"], docs[found], longest[found])
    return out


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _dup_lines(s: Slice, word_starts: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their document."""
    breaks = np.flatnonzero(s.data == 10)
    a = np.unique(np.concatenate([s.offsets[:-1], breaks + 1]))
    a = a[a < len(s.data)]
    b = np.searchsorted(breaks, a)
    docs = np.searchsorted(s.offsets, a, "right") - 1
    e = np.minimum(np.append(breaks, len(s.data))[b], s.offsets[docs + 1])
    has = np.searchsorted(word_starts, a) < np.searchsorted(word_starts, e)
    a, e, docs = a[has], e[has], docs[has]
    h = s.hashes(a, e)
    order = np.lexsort((h, docs))
    same = (h[order][1:] == h[order][:-1]) & (docs[order][1:] == docs[order][:-1])
    return np.bincount(docs[order][1:][same], minlength=s.n_docs).astype(np.int64)


def repetition_features(docs: DataFrame, min_repeat: int = MIN_REPEAT, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``docs`` and the FIELDS of each row's whole text, in one pass without a shuffle."""
    rows = docs.select(*keep, F.col("text").alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), *(f"{x} bigint" for x in FIELDS)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_features(s, min_repeat) for s in slices(batch.column(len(keep)))]
            if parts:
                made = [pa.array(np.concatenate([p[x] for p in parts])) for x in FIELDS]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], [*keep, *FIELDS])

    return rows.mapInArrow(each, schema)


def verdicts(features: DataFrame, most_covered: float = MOST_COVERED, longest_repeat: int = LONGEST_REPEAT) -> DataFrame:
    """Adds base_failed and kept."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    method = (F.col("covered_words") <= most_covered * F.col("n_words")) & (F.col("longest_repeat") <= longest_repeat)
    return features.withColumn("base_failed", base).withColumn("kept", ~base & method)


def keep_unrepetitive(docs: DataFrame, min_repeat: int = MIN_REPEAT, most_covered: float = MOST_COVERED, longest_repeat: int = LONGEST_REPEAT) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns, whatever these are called."""
    own = {c: f"_own{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*(F.col(f"`{c}`").alias(new) for c, new in own.items()), F.col("text"))
    judged = verdicts(repetition_features(renamed, min_repeat, tuple(own.values())), most_covered, longest_repeat)
    return judged.where("kept").select(*(F.col(new).alias(c) for c, new in own.items()))


def op3_quality_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verdicts(repetition_features(table(spark, sf_dir, "documents")))
    return out.select("doc_id", *FIELDS[:5], "base_failed", "kept", *FIELDS[5:])
