"""Keyed upserts, set differences and incremental gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusql.operators.ranks import ranked


def upsert(old: DataFrame, new: DataFrame, keys: list[str], replace: list[str], keep_known: list[str] = (), keep_first: list[str] = (), order: str | None = None) -> DataFrame:
    """``old`` with ``new`` merged in by key, as if the new rows were written one after the other.

    replace: the new value wins; keep_known: the new value wins unless null; keep_first: the old value wins. order: a column
    of ``new`` that tells which of several rows of a key was written last; it may be kept as a column too. Without it the
    greatest row by its values counts as the last. Of rows written one after the other, ``keep_known`` takes the last known
    value and ``keep_first`` the first row's.
    """
    columns = [c for c in [*replace, *keep_known, *keep_first] if c not in keys]
    at = F.col(order) if order else F.struct(*columns)
    last = lambda c: F.max(F.struct(at.alias("at"), F.col(c).alias("v")))["v"]
    first = lambda c: F.min(F.struct(at.alias("at"), F.col(c).alias("v")))["v"]
    known = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("v"))))["v"]
    kept = {c: last for c in replace} | {c: known if order else last for c in keep_known} | {c: first if order else last for c in keep_first}
    new = new.groupBy(*keys).agg(*(f(c).alias(c) for c, f in kept.items()))
    o = old.withColumn("_old", F.lit(True)).alias("o")
    n = new.withColumn("_new", F.lit(True)).alias("n")
    joined = o.join(n, keys, "full")
    is_new = F.col("_new").isNotNull()
    pick = {c: F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in replace}
    pick |= {c: F.coalesce(f"n.{c}", f"o.{c}") for c in keep_known}
    pick |= {c: F.when(F.col("_old").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")) for c in keep_first}
    return joined.select(*keys, *(v.alias(c) for c, v in pick.items()))


def missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` whose key ``right`` has not."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def unchanged(now: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    return now.join(cache.select(*keys).distinct(), keys, "left_semi")


def oldest_part(rows: DataFrame, age: str, key: str, percent: int = 5, bins: int = 4096) -> DataFrame:
    """The oldest ``percent`` of all rows, those of one age by key; rows without an age are younger than all others.

    The bins of ``age`` (a time) before the cut-off are taken whole, and of the bin that it falls in the first rows by rank,
    so only the counts of the bins reach the driver and no task holds a bin.
    """
    at = F.unix_micros(F.col(age).cast("timestamp"))
    n, low, high = rows.agg(F.count("*"), F.min(at), F.max(at)).first()
    wanted = n * percent // 100
    if not wanted:
        return rows.limit(0)
    if low is None:
        return _first_ranks(rows, [key], wanted)
    bin_ = F.coalesce(F.floor((at - low) / ((high - low) // bins + 1)).cast("int"), F.lit(bins))  # the last one: no age
    before = 0
    for b, size in sorted(tuple(r) for r in rows.groupBy(bin_.alias("b")).count().collect()):
        if before + size >= wanted:
            break
        before += size
    edge = _first_ranks(rows.where(bin_ == b), [age, key], wanted - before)
    return rows.where(bin_ < b).unionByName(edge)


def _first_ranks(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    return ranked(rows, order, rank="_rank").where(F.col("_rank") <= n).drop("_rank")


def invariants(docs: DataFrame, texts: DataFrame, attachments: DataFrame) -> DataFrame:
    """One row for all spaces together (space null) and one for each: docs, texts and attachments, those without a document, and ok.

    docs: id, space; texts: id; attachments: content_id. What has no document has no space, so it stands in the first row alone.
    """
    ids = docs.select("id", "space")
    t = texts.select("id", F.lit(1).alias("t")).join(ids, "id", "left")
    a = attachments.select(F.col("content_id").alias("id")).join(docs.select("id", "space", F.lit(1).alias("known")), "id", "left")
    t = t.join(docs.select("id", F.lit(1).alias("known")), "id", "left")
    parts = [
        ids.select("space", F.lit(1).alias("docs"), F.lit(0).alias("texts"), F.lit(0).alias("attachments"), F.lit(0).alias("orphan_texts"), F.lit(0).alias("orphan_attachments"), F.lit(True).alias("known")),
        t.select("space", F.lit(0), F.lit(1), F.lit(0), F.when(F.col("known").isNull(), 1).otherwise(0), F.lit(0), F.col("known").isNotNull()),
        a.select("space", F.lit(0), F.lit(0), F.lit(1), F.lit(0), F.when(F.col("known").isNull(), 1).otherwise(0), F.col("known").isNotNull()),
    ]
    every = parts[0].union(parts[1]).union(parts[2])
    names = ["docs", "texts", "attachments", "orphan_texts", "orphan_attachments"]
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names]
    rows = every.agg(*sums).select(F.lit(None).cast("string").alias("space"), *names).unionByName(every.where("known").groupBy(F.coalesce("space", F.lit("")).alias("space")).agg(*sums))
    return rows.withColumn("ok", (F.col("orphan_texts") == 0) & (F.col("orphan_attachments") == 0))
