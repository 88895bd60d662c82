"""Full-text search: postings, BM25 and Boolean matching over a ``docs`` frame (id, space, type, title, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusql.functions.text import tokens

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def term_counts(docs: DataFrame, terms: list[str]) -> DataFrame:
    """id, length and a column for each term's count: one pass over the texts, nothing exploded."""
    # Explode keeps tokens and counts as columns of their own, so that a filter on counts does not split texts again.
    words = docs.select("id", "space", "type", "title", F.explode(F.array(F.struct(tokens(F.col("text")).alias("w")))).alias("_t"))
    counts = [F.size(_equal("_t.w", t)).cast("long").alias(f"tf_{i}") for i, t in enumerate(terms)]
    counted = words.select("id", "space", "type", "title", F.explode(F.array(F.struct(F.size("_t.w").cast("long").alias("length"), *counts))).alias("_c"))
    return counted.select("id", "space", "type", "title", "_c.*")


def _equal(column: str, term: str) -> Column:
    return F.filter(column, lambda w: w == term)


def bm25(docs: DataFrame, terms: list[str], require_all: bool = False, without: str | None = None) -> DataFrame:
    """id, space, type, title and score (rounded, higher is better) of the matching documents.

    require_all: every term must occur, else any. without: a term that must not occur.
    """
    names = [*terms, without] if without else terms
    counts = term_counts(docs, names)
    stats = counts.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *(F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(terms))))
    has = [F.col(f"tf_{i}") > 0 for i in range(len(terms))]
    match = has[0]
    for h in has[1:]:
        match = match & h if require_all else match | h
    if without:
        match = match & (F.col(f"tf_{len(terms)}") == 0)
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf_{i}"), F.col(f"df_{i}")
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    joined = counts.where(match).join(F.broadcast(stats))  # one row
    return joined.select("id", "space", "type", "title", F.round(score, 6).alias("score"))


def top(hits: DataFrame, k: int, offset: int = 0) -> DataFrame:
    return hits.orderBy(F.desc("score"), "id").offset(offset).limit(k)


def postings(docs: DataFrame) -> DataFrame:
    """term, id, tf and positions of every term."""
    words = docs.select("id", F.posexplode(tokens(F.col("text"))).alias("position", "term"))
    return words.groupBy("term", "id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"))


def phrase(docs: DataFrame, words: list[str]) -> DataFrame:
    """id and tf of documents in which the words (lower case, letters and digits) stand side by side in this order.

    One pass over each text: its tokens with one blank between, in which a look-ahead counts every place of the phrase.
    """
    if not words:
        raise ValueError("a phrase has one word at least")
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    found = docs.select("id", F.regexp_count(spaced, F.lit(rf"(?=\s{' '.join(words)}\s)")).cast("long").alias("tf"))
    return found.where("tf > 0")
