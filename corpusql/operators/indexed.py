"""Search in a stored index: BM25, phrases, Boolean queries, English stems ranked by covers, and pages of results.

Nothing here reads a text but the snippets of one page. Of the postings only the buckets of a query's words are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusql.functions.stemming import STOP_WORDS, stemmed
from corpusql.jobs.index import TEXT, TITLE, Index
from corpusql.operators import boolean
from corpusql.operators.lexical import K1, LEAST_IDF, B

WEIGHT = 0.1  # of a word in a cover, where fields have no weights of their own


def _part(tf: Column, df: Column, n: Column, length: Column, mean: Column) -> Column:
    idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _none(index: Index, columns: str) -> DataFrame:
    return index.spark.createDataFrame([], columns)


def bm25(index: Index, terms: list[str], require_all: bool = False, without: str | None = None, field: int = TEXT, kind: str = "term") -> DataFrame:
    """id and score of the documents whose ``field`` holds any of the terms (all of them; not ``without``)."""
    names = [*terms, without] if without else terms
    found = index.postings(index.look_up(names, kind))
    if found is None:
        return _none(index, "id string, score double")
    count = lambda i: F.coalesce(F.sum(F.when(F.col("key") == names[i], F.col("tf"))), F.lit(0)).alias(f"tf_{i}")
    counts = found.where(F.col("field") == field).groupBy("id").agg(F.first("length").alias("length"), *map(count, range(len(names))))
    stats = counts.agg(*(F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(terms))))
    has = [F.col(f"tf_{i}") > 0 for i in range(len(terms))]
    match = has[0]
    for h in has[1:]:
        match = match & h if require_all else match | h
    if without:
        match = match & (F.col(f"tf_{len(terms)}") == 0)
    parts = [_part(F.col(f"tf_{i}"), F.col(f"df_{i}"), F.lit(index.n), F.col("length"), F.lit(index.means[field])) for i in range(len(terms))]
    hits = counts.where(match).join(F.broadcast(stats))  # one row
    return hits.select("id", F.round(sum(parts[1:], parts[0]), 6).alias("score"))


def with_headers(index: Index, hits: DataFrame) -> DataFrame:
    """``hits`` with space, type and title. A page of hits makes this a small join; all hits meet the headers by id."""
    return hits.join(index.docs(), "id")


def _phrase_places(words: tuple[str, ...], positions: dict[str, Column]) -> Column:
    """How often the words stand side by side in one field, from the positions of each."""
    if not words:
        return F.lit(0)
    back = lambda at, k: F.transform(at, lambda p: p - k)
    starts = positions[words[0]]
    for k, w in enumerate(words[1:], 1):
        starts = F.array_intersect(starts, back(positions[w], k))
    return F.size(starts)


def _phrase_counts(found: DataFrame, every: list[tuple[str, ...]]) -> DataFrame:
    """id, length and a column tf_i for each phrase: places in all fields together."""
    several = sorted({w for p in every if len(p) > 1 for w in p})
    name = {w: f"p_{i}" for i, w in enumerate(several)}
    at = [F.flatten(F.collect_list(F.when(F.col("key") == w, F.col("positions")))).alias(name[w]) for w in several]
    single = [(i, p[0]) for i, p in enumerate(every) if len(p) == 1]
    sums = [F.coalesce(F.sum(F.when(F.col("key") == w, F.col("tf"))), F.lit(0)).alias(f"s_{i}") for i, w in single]
    fields = found.groupBy("id", "field").agg(F.first("doc_length").alias("length"), *at, *sums)
    alone = {i for i, _ in single}
    places = [F.col(f"s_{i}") if i in alone else _phrase_places(p, {w: F.col(name[w]) for w in p}) for i, p in enumerate(every)]
    counted = fields.select("id", "length", *(x.cast("long").alias(f"tf_{i}") for i, x in enumerate(places)))
    return counted.groupBy("id").agg(F.first("length").alias("length"), *(F.sum(f"tf_{i}").alias(f"tf_{i}") for i in range(len(every))))


def phrase(index: Index, words: list[str], field: int = TEXT, kind: str = "term") -> DataFrame:
    """id and tf of the documents in whose ``field`` the words stand side by side."""
    found = index.postings(index.look_up(sorted(set(words)), kind))
    if found is None:
        return _none(index, "id string, tf long")
    counts = _phrase_counts(found.where(F.col("field") == field), [tuple(words)])
    return counts.where("tf_0 > 0").select("id", F.col("tf_0").alias("tf"))


def search(index: Index, query: str) -> DataFrame:
    """id and score of the documents that match a Boolean query over id, title and text (see ``boolean``)."""
    tree = boolean.parsed(query)
    every = boolean.phrases(tree)
    found = index.postings(index.look_up(sorted({w for p in every for w in p}), "folded"))
    if found is None:
        return _none(index, "id string, score double")
    counts = _phrase_counts(found, every)
    stats = counts.agg(*(F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(every))))
    name = {w: i for i, w in enumerate(every)}
    part = lambda w: _part(F.col(f"tf_{name[w]}"), F.col(f"df_{name[w]}"), F.lit(index.n), F.col("length"), F.lit(index.mean))
    match, value = boolean._folded_tree(tree, lambda w: F.col(f"tf_{name[w]}"), part)
    return counts.where(match).join(F.broadcast(stats)).select("id", F.round(value, 6).alias("score"))  # one row


def covers(occurrences: DataFrame, terms: int) -> DataFrame:
    """The minimal stretches that hold all of a query's terms: id, first, last (positions) and words (occurrences inside).

    occurrences: id, term (from 0 to ``terms`` - 1), position. At each occurrence the latest place of every term is known;
    the earliest of these begins the shortest stretch that ends here, and the stretch is minimal if that beginning is a later
    one than that of the occurrence before.
    """
    by = Window.partitionBy("id").orderBy("position")  # one document's words of the query
    until = by.rowsBetween(Window.unboundedPreceding, 0)
    numbered = occurrences.withColumn("_at", F.struct("position", F.row_number().over(by).alias("number")))
    latest = numbered.select("id", "position", "_at", *(F.max(F.when(F.col("term") == t, F.col("_at"))).over(until).alias(f"_t{t}") for t in range(terms)))
    names = [f"_t{t}" for t in range(terms)]
    whole = F.lit(True)
    for c in names:
        whole &= F.col(c).isNotNull()
    begin = F.when(whole, F.least(*names) if terms > 1 else F.col(names[0]))
    found = latest.select("id", "position", "_at", begin.alias("_begin"))
    before = F.lag("_begin").over(by)
    new = found.withColumn("_new", F.col("_begin").isNotNull() & (before.isNull() | (F.col("_begin.position") > before["position"]))).where("_new")
    return new.select("id", F.col("_begin.position").alias("first"), F.col("position").alias("last"), (F.col("_at.number") - F.col("_begin.number") + 1).alias("words"))


def cover_density(found: DataFrame, weight: float = WEIGHT) -> DataFrame:
    """id and score: each cover counts ``weight`` over one plus the other words inside it."""
    other = F.col("last") - F.col("first") + 1 - F.col("words")
    return found.groupBy("id").agg(F.round(F.sum(weight / (1 + other)), 6).alias("score"))


def query_stems(index: Index, query: str) -> list[str]:
    """The different stems of a query's words that are no stop words."""
    words = [w for w in re.findall(r"[^\W_]+", query.lower()) if w not in STOP_WORDS]
    if not words:
        return []
    rows = index.spark.createDataFrame([(w,) for w in words], "w string").select(stemmed(F.col("w")).alias("s")).collect()
    return list(dict.fromkeys(r.s for r in rows))


def stemmed_search(index: Index, query: str) -> DataFrame:
    """id and score of the documents whose title and text hold all stems of a query, ranked by cover density.

    Positions run through the title and on through the text. A query of stop words alone matches nothing.
    """
    stems = query_stems(index, query)
    forms = index.look_up(stems, "stem")
    if not stems or not all(forms.values()):
        return _none(index, "id string, score double")
    number = F.element_at(F.create_map(*(F.lit(x) for k, s in enumerate(stems) for x in (s, k))), F.col("key"))
    found = index.postings(forms).where(F.col("field").isin(TITLE, TEXT)).select("id", number.alias("term"), F.transform("positions", lambda p: p + F.col("base")).alias("positions"))
    every = found.groupBy("id").agg(F.collect_list(F.struct("term", "positions")).alias("t"), F.count_distinct("term").alias("n")).where(F.col("n") == len(stems))
    places = every.select("id", F.explode("t").alias("t")).select("id", "t.term", F.explode("t.positions").alias("position"))
    return cover_density(covers(places, len(stems)))


def result_page(index: Index, hits: DataFrame, texts: DataFrame, attachments: DataFrame, words: list[str], limit: int, offset: int = 0, space: str | None = None, kind: str | None = None) -> DataFrame:
    """One page of hits (id, score), best first: rank, id, space, type, title, attachments_count, snippet and score.

    Filters by space and type come before the page is cut; texts (id, text) and attachments (content_id) are read for the
    page's ids only.
    """
    known = with_headers(index, hits)
    if space is not None:
        known = known.where(F.col("space") == space)
    if kind is not None:
        known = known.where(F.col("type") == kind)
    page = known.orderBy(F.desc("score"), "id").offset(offset).limit(limit)
    page = page.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")) + F.lit(offset))  # at most ``limit`` rows
    ids = F.broadcast(page.select("id"))  # likewise
    counts = attachments.join(ids, attachments["content_id"] == F.col("id"), "left_semi").groupBy(F.col("content_id").alias("id")).agg(F.count("*").alias("n"))
    shown = boolean.snippets(texts.join(ids, "id", "left_semi").select("id", "text"), "text", words).select("id", "snippet")
    return page.join(counts, "id", "left").join(shown, "id", "left").select("rank", "id", "space", "type", "title", F.coalesce("n", F.lit(0)).alias("attachments_count"), "snippet", "score")
