"""How far the sources of a language differ: term frequencies by source, compared pair by pair and against the language.

Terms are counted by a token-start pointer sort. In each batch the documents are put in order of language and source, and
a pointer is built to every word's first byte in the Arrow buffer. The pointers are sorted by a multikey quicksort over
slices of eight bytes: all pointers by the first slice, then those whose words go on, within their run of equal ones, by the
next, until no run goes on. The sort is stable, so within a run of one term the pointers lie by group and by document:
run lengths are the counts by source, changes of the document inside them the document frequency. Only these sums leave
the task; Spark adds them up, before its shuffle and after.

Kept terms of a language are those in at least LEAST of its documents, a document being a row. p = 1 + floor(ONE * (count
+ 1) / (N + V)) for each group and kept term, N the group's count of kept terms, V their number. Divergence of p from q
is floor((p - q)**2 / q). Sums over pairs of sources are taken in shards of terms, as matrices of sources by terms, so no pair of
rows is formed; tiles of TILE sources bound a task's memory. All arithmetic is whole numbers: decimals where a count is
multiplied, 64 bits after (a pair's sum is at most about 2 * (ONE + V) * ONE).

Null text, language or source: as if empty. Documents without words still make their group occur. Rows that repeat count
each time. Ties are broken by item. Empty tables: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusql.llm.common import cut, shuffle_partitions, table
from corpusql.llm.textops import slices

LEAST, ONE, RANKS = 3, 1_000_000_000, 200
SLICE, SHARD, TILE, CELLS = 8 << 20, 200_000, 512, 2_000_000
SMALL = 8 << 20
_APART = np.array([not (0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80) for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def slice_keys(data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on, as numbers in the bytes' order; zero from the word's end on. ``data`` has eight bytes to spare."""
    wide = np.lib.stride_tricks.sliding_window_view(data, 8)[np.minimum(at, len(data) - 8)]
    keys = np.ascontiguousarray(wide).view(">u8").ravel().astype(np.uint64)
    short = np.clip(8 - (ends - at), 0, 8)
    some = np.flatnonzero(short)
    shift = (short[some] * 8).astype(np.uint64)
    keys[some] = np.where(short[some] == 8, np.uint64(0), (keys[some] >> np.minimum(shift, 56)) << np.minimum(shift, 56))
    return keys


def pointer_sort(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of words by their bytes, and whether a word differs from the one before it in that order."""
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    keys = slice_keys(data, starts, ends)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    open_ = np.arange(len(keys))  # places in the order whose run goes on
    depth = 0
    while len(open_):
        run = np.cumsum(new[open_])  # places of one run are neighbours here
        longer = (keys & np.uint64(0xFF)) != 0
        size = np.bincount(run)
        go = longer & (size[run] > 1)
        open_, run = open_[go], run[go]
        depth += 8
        which = order[open_]
        keys = slice_keys(data, starts[which] + depth, ends[which])
        inside = np.lexsort((keys, run))
        order[open_] = which[inside]
        keys = keys[inside]
        if len(open_):
            new[open_[1:]] |= (run[1:] == run[:-1]) & (keys[1:] != keys[:-1])
    return order, new


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t.take(pc.sort_indices(t, sort_keys=[("lang", "ascending"), ("source", "ascending")])).combine_chunks()
        if not t.num_rows:
            continue
        lang, source = (t.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
        lang, source = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (lang, source))
        group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        for s in slices(t.column("text"), SLICE):
            data = _LOWER[s.data]
            starts, ends, docs = s.words(_APART)
            if not len(starts):
                continue
            order, term = pointer_sort(data, starts, ends)
            doc = docs[order]
            changed = np.ones(len(doc), bool)
            changed[1:] = doc[1:] != doc[:-1]
            kind = group[s.first + doc]
            parted = term.copy()
            parted[1:] |= kind[1:] != kind[:-1]
            at = np.flatnonzero(parted)
            first = order[at]
            n = np.diff(np.append(at, len(order)))
            seen = np.add.reduceat((changed | parted).astype(np.int64), at)
            size = ends[first] - starts[first]
            stop = np.cumsum(size)
            chars = data[np.repeat(starts[first] - (stop - size), size) + np.arange(stop[-1])]
            words = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.concatenate([[0], stop])), pa.py_buffer(chars)])
            g = kind[at]
            columns = [lang.dictionary.take(pa.array(g // len(source.dictionary))), source.dictionary.take(pa.array(g % len(source.dictionary))), words, pa.array(n), pa.array(seen)]
            yield pa.RecordBatch.from_arrays([c.cast(pa.string()) if k < 3 else c for k, c in enumerate(columns)], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents) of docs (lang, source, text), no nulls."""
    parts = docs.select("lang", "source", "text").mapInArrow(_counted, _COUNTS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_counts(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, term, n, lang_n (over all sources) and first (one row a term) of the terms in at least ``least`` documents of their language."""
    one = Window.partitionBy("lang", "term")  # a row a source
    seen = counts.withColumns({"_df": F.sum("docs").over(one), "lang_n": F.sum("n").over(one), "first": F.col("source") == F.min("source").over(one)})
    return seen.where(F.col("_df") >= least).select("lang", "source", "term", "n", "lang_n", "first")


def frequency(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(ONE * (count + 1) / (total + terms)), exactly."""
    whole = F.lit(ONE).cast("decimal(10,0)") * (count + 1).cast("decimal(27,0)")
    return (F.lit(1) + F.call_function("div", whole, (total + terms).cast("decimal(38,0)"))).cast("long")


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, total (N of the group), lang_total, terms (V) and place (rank of the source in its language) of every group that occurs."""
    g = docs.select("lang", "source").distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("terms"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    known = g.join(own, ["lang", "source"], "left").join(whole, "lang", "left")
    by = Window.partitionBy("lang")
    return known.select("lang", "source", zero("total"), zero("lang_total"), zero("terms"), F.row_number().over(by.orderBy("source")).alias("place"), F.count("*").over(by).alias("sources"))


def with_groups(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``kept`` with its group's columns: by broadcast where the groups are small, else on salted keys."""
    size = groups.agg(F.sum(F.octet_length("lang") + F.octet_length("source") + 64)).first()[0] or 0
    if size <= SMALL:
        return kept.join(F.broadcast(groups), ["lang", "source"])  # at most SMALL bytes, as just summed
    salts = shuffle_partitions(kept.sparkSession)
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return kept.withColumn("_salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int")).join(salted, ["lang", "source", "_salt"]).drop("_salt")


def _pair_sums(key: tuple, counts: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Sums of divergences of the tile's sources from all sources, over one shard's terms."""
    groups = groups.sort_values("g_place")
    base, place = groups["g_p"].to_numpy(np.int64), groups["g_place"].to_numpy(np.int64)
    tile = np.flatnonzero((place - 1) // TILE == key[2])
    sums = np.zeros((len(tile), len(base)), np.int64)
    term, names = pd.factorize(counts["term"])
    row, p = counts["place"].to_numpy(np.int64) - 1, counts["p"].to_numpy(np.int64)
    width = max(1, CELLS // max(1, len(base)))
    by = np.argsort(term, kind="stable")
    cuts = np.searchsorted(term[by], np.arange(0, len(names) + width, width))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if a == b:
            continue
        columns = min(width, len(names) - k * width)
        q = np.repeat(base[:, None], columns, axis=1)
        q[row[by[a:b]], term[by[a:b]] - k * width] = p[by[a:b]]
        for i, t in enumerate(tile):
            apart = q[t] - q
            sums[i] += (apart * apart // q).sum(axis=1)
    source = groups["g_source"].to_numpy(object)
    out = pd.DataFrame({"lang": key[0], "source": np.repeat(source[tile], len(base)), "item": np.tile(source, len(tile)), "value": sums.ravel()})
    return out[np.repeat(tile, len(base)) != np.tile(np.arange(len(base)), len(tile))]


def pair_divergence(rows: DataFrame, groups: DataFrame, shards: int) -> DataFrame:
    """lang, source, item and value: each ordered pair of a language's sources, summed over its kept terms (rows: lang, term, place, sources, p)."""
    shard = F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard")
    each = lambda n: F.explode(F.sequence(F.lit(0), n))
    tiles = each(((F.col("sources") - 1) / TILE).cast("int")).alias("tile")
    left = rows.select("lang", "term", "place", "p", shard, tiles)
    empty = frequency(F.lit(0), F.col("total"), F.greatest(F.col("terms"), F.lit(1)))
    right = groups.select(*(F.col(c).alias(f"g_{c}") for c in ("lang", "source", "place")), empty.alias("g_p"), tiles, "terms")  # new names, as both sides come from the groups
    right = right.select("*", each(F.when(F.col("terms") > 0, shards - 1).otherwise(0)).alias("g_shard")).withColumnRenamed("tile", "g_tile").drop("terms")
    key = ["lang", "shard", "tile"]
    parts = left.groupBy(*key).cogroup(right.groupBy(*(f"g_{c}" for c in key))).applyInPandas(_pair_sums, "lang string, source string, item string, value bigint")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST, ranks: int = RANKS) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank of docs (lang, source, text)."""
    d = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = cut(kept_counts(term_counts(d), least))
    groups = cut(groups_of(d, kept))
    rows = with_groups(kept, groups)
    p, q = frequency(F.col("n"), F.col("total"), F.col("terms")), frequency(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    rows = rows.select("lang", "source", "term", "place", "sources", p.alias("p"), q.alias("q"))
    pairs = pair_divergence(rows, groups, max(1, -(-kept.count() // SHARD)))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = rows.where("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)  # cut in each task before the shuffle
    pairs = pairs.withColumn("rank", F.row_number().over(order))  # a row a source
    named = lambda part, x: x.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return named("pair", pairs).unionByName(named("term", terms))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


_P = "CAST(1 + ({one} * (CAST({n} AS HUGEINT) + 1)) // ({total} + {terms}) AS BIGINT)"
_FREQUENCY = lambda n, total, terms: _P.format(one=ONE, n=n, total=total, terms=terms)

OP12_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= {LEAST}),
v AS (SELECT lang, count(*) AS terms, sum(n) AS lang_total FROM k GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
g AS (SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) x),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_FREQUENCY('coalesce(c.n, 0)', 'g.total', 'v.terms')} AS p, {_FREQUENCY('k.n', 'v.lang_total', 'v.terms')} AS q
  FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM f WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= {RANKS}"""
