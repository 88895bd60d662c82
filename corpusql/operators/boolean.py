"""Boolean and phrase search over several text columns, with BM25 scores and snippets.

A query is words, "quoted phrases", AND, OR, NOT (in letters of either case) and brackets. Words that stand side by side are joined by AND, which then
binds tighter than the written operators; of these NOT binds tightest, then AND, then OR. NOT takes two sides: what
matches the left one and not the right one. Queries are parameters, so they are read on the driver; all work on texts is
column expressions.

A phrase counts in every column, its length statistics over all columns together. A phrase adds to a document's score
only where every expression around it matches.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusql.functions.text import folded, spaced_tokens
from corpusql.operators.lexical import K1, LEAST_IDF, B

_DASHES = dict.fromkeys(map(ord, "‐‑‒–—―"), "-")
_PIECES = re.compile(r'"((?:[^"]|"")*)"|([()])|([^\s()"]+)')
OPERATORS = ("AND", "OR", "NOT")


def _is_operator(piece: re.Match) -> bool:
    return piece[3] is not None and piece[3].upper() in OPERATORS


@dataclass(frozen=True)
class Node:
    """kind: 'phrase' (words), or an operator with two sides."""

    kind: str
    words: tuple[str, ...] = ()
    left: Node | None = None
    right: Node | None = None


def _signs(query: str) -> str:
    text = query.translate(_DASHES)
    for sign, word in ((r"&&?", "AND"), (r"\|\|?", "OR")):
        text = re.sub(sign, f" {word} ", text)
    return text


def normalized_query(query: str) -> str:
    """The query with signs spelled out and every word or phrase in quotation marks."""
    out = []
    for m in _PIECES.finditer(_signs(query)):
        if m[2] or _is_operator(m):
            out.append(m[0].upper())
        else:
            out.append('"' + (m[3] if m[3] else m[1].replace('""', '"')).replace('"', '""') + '"')
    return " ".join(out)


def phrase_words(phrase: str) -> tuple[str, ...]:
    """Words of a phrase as the texts' words are: lower case, without accents, runs of letters and digits."""
    bare = "".join(c for c in unicodedata.normalize("NFD", phrase.lower()) if not unicodedata.combining(c))
    return tuple(re.findall(r"[^\W_]+", bare))


class _Reader:
    def __init__(self, query: str):
        self.pieces = [m for m in _PIECES.finditer(_signs(query))]
        self.at = 0

    def _next(self) -> str | None:
        if self.at == len(self.pieces):
            return None
        m = self.pieces[self.at]
        return m[0].upper() if m[2] or _is_operator(m) else "phrase"

    def _take(self) -> re.Match:
        self.at += 1
        return self.pieces[self.at - 1]

    def read(self) -> Node:
        found = self._level(0)
        if self._next() is not None:
            raise ValueError(f"unexpected {self.pieces[self.at][0]!r} in the query")
        return found

    def _level(self, k: int) -> Node:
        """k: 0 for OR, 1 for AND, 2 for NOT, 3 for what stands side by side."""
        if k == 3:
            return self._side_by_side()
        word = ("OR", "AND", "NOT")[k]
        node = self._level(k + 1)
        while self._next() == word:
            self._take()
            node = Node(word, (), node, self._level(k + 1))
        return node

    def _side_by_side(self) -> Node:
        if self._next() == "(":
            self._take()
            node = self._level(0)
            if self._next() != ")":
                raise ValueError("a bracket is not closed")
            self._take()
            return node
        if self._next() != "phrase":
            raise ValueError("an operator or the end of the query stands where a word is due")
        node = None
        while self._next() == "phrase":
            m = self._take()
            one = Node("phrase", phrase_words(m[3] if m[3] else m[1]))
            node = one if node is None else Node("AND", (), node, one)
        return node


def parsed(query: str) -> Node:
    """The query's tree; ValueError where it is not well formed."""
    return _Reader(query).read()


def phrases(node: Node) -> list[tuple[str, ...]]:
    """The different phrases of a tree, in their order."""
    if node.kind == "phrase":
        return [node.words]
    return list(dict.fromkeys([*phrases(node.left), *phrases(node.right)]))


def _count(words: tuple[str, ...], texts: list[Column]) -> Column:
    """Places of a phrase in spaced tokens, all columns together; an empty phrase has none."""
    if not words:
        return F.lit(0)
    found = [F.regexp_count(t, F.lit(rf"(?=\s{' '.join(words)}\s)")) for t in texts]
    return sum(found[1:], found[0])


def _folded_tree(node: Node, count, score) -> tuple[Column, Column]:
    if node.kind == "phrase":
        has = count(node.words) > 0
        return has, F.when(has, score(node.words)).otherwise(0.0)
    (l, ls), (r, rs) = _folded_tree(node.left, count, score), _folded_tree(node.right, count, score)
    if node.kind == "AND":
        return l & r, F.when(l & r, ls + rs).otherwise(0.0)
    if node.kind == "OR":
        return l | r, F.when(l, ls).otherwise(0.0) + F.when(r, rs).otherwise(0.0)
    return l & ~r, F.when(l & ~r, ls).otherwise(0.0)


def search(docs: DataFrame, query: str, columns: tuple[str, ...] = ("id", "title", "text")) -> DataFrame:
    """The matching rows of ``docs`` with their score (higher is better). One pass tells the counts, a second the hits."""
    tree = parsed(query)
    every = phrases(tree)
    # Explode keeps texts and counts as columns of their own, so no phrase folds a text again and no filter counts again.
    made = [spaced_tokens(folded(F.coalesce(F.col(c).cast("string"), F.lit("")))).alias(f"c{i}") for i, c in enumerate(columns)]
    spaced = docs.select("*", F.explode(F.array(F.struct(*made))).alias("_t"))
    texts = [F.col(f"_t.c{i}") for i in range(len(columns))]
    length = [F.regexp_count(t, F.lit(r"\S+")) for t in texts]
    counts = [_count(w, texts).cast("long").alias(f"_tf{i}") for i, w in enumerate(every)]
    counted = spaced.select(*docs.columns, F.explode(F.array(F.struct(*counts, sum(length[1:], length[0]).cast("long").alias("_length")))).alias("_c")).select(*docs.columns, "_c.*")
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_length").alias("_mean"), *(F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(every))))
    name = {w: i for i, w in enumerate(every)}

    def score(words: tuple[str, ...]) -> Column:
        tf, df, n = F.col(f"_tf{name[words]}"), F.col(f"_df{name[words]}"), F.col("_n")
        idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_length") / F.col("_mean")))

    match, value = _folded_tree(tree, lambda w: F.col(f"_tf{name[w]}"), score)
    hits = counted.where(match).join(F.broadcast(stats))  # one row
    return hits.select(*docs.columns, F.round(value, 6).alias("score"))


def snippets(docs: DataFrame, column: str, words: list[str], size: int = 12, marks: tuple[str, str] = ("<b>", "</b>"), gap: str = "…") -> DataFrame:
    """``docs`` with snippet: the ``size`` tokens from the hit on that have the most hits (the first such), hits marked.

    Tokens are what blanks set apart; a token is a hit if its folded letters and digits are one of the words. Without a
    hit the snippet is the beginning. Explode keeps each array as a column of its own: written into a lambda, its
    expression would run once for each element.
    """
    tokens = F.filter(F.split(F.coalesce(column, F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda t: t != "")
    one = docs.select("*", F.explode(F.array(F.struct(tokens.alias("w")))).alias("_t"))
    wanted = F.transform("_t.w", lambda t: F.regexp_replace(folded(t), r"[^\p{L}\p{N}]+", "").isin(*words))
    two = one.select("*", F.explode(F.array(F.struct(wanted.alias("hit")))).alias("_h"))
    places = F.transform(F.filter(F.transform("_h.hit", lambda h, i: F.struct(h.alias("h"), i.alias("i"))), lambda x: x["h"]), lambda x: x["i"])
    three = two.select("*", F.explode(F.array(F.struct(places.alias("at")))).alias("_p"))
    near = F.transform("_p.at", lambda p, k: F.struct(F.size(F.filter(F.slice("_p.at", k + 1, F.lit(size)), lambda q: q < p + size)).alias("n"), (-p).alias("at")))
    four = three.select("*", F.explode(F.array(F.coalesce(-F.array_max(near)["at"], F.lit(0)))).alias("_s"))
    shown = F.zip_with(F.slice("_t.w", F.col("_s") + 1, F.lit(size)), F.slice("_h.hit", F.col("_s") + 1, F.lit(size)), lambda t, h: F.when(h, F.concat(F.lit(marks[0]), t, F.lit(marks[1]))).otherwise(t))
    text = F.concat(F.when(F.col("_s") > 0, F.lit(gap + " ")).otherwise(""), F.array_join(shown, " "), F.when(F.col("_s") + size < F.size("_t.w"), F.lit(" " + gap)).otherwise(""))
    return four.select(*docs.columns, text.alias("snippet"))
