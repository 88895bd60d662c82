"""Result pages by bytes, cursors, answers and their event streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checked_range(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}")
    return value


def byte_pages(items: DataFrame, per: str, order: str, size: str, budget: int = 90_000) -> DataFrame:
    """``items`` with page (from 0): each list's items fill pages in order up to ``budget`` bytes; a larger item is a page of its own.

    A list is one request's result, bounded by its top k, so a task holds one at a time.
    """
    checked_range("budget", budget, 1, 1 << 40)
    names, kinds = items.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        page, full, pages = 0, 0, []
        for n in frame[size]:
            if full and full + n > budget:
                page, full = page + 1, 0
            pages.append(page)
            full += n
        return frame[names].assign(page=pages)

    return items.groupBy(per).applyInPandas(fill, f"{kinds}, page bigint")


def first_page(items: DataFrame, per: str, order: str, size: str, budget: int = 90_000) -> DataFrame:
    """The first page of each list; nothing tells of further ones."""
    return byte_pages(items, per, order, size, budget).where("page = 0").drop("page")


def page_totals(paged: DataFrame, per: str, size: str) -> DataFrame:
    """Items and bytes of each page, and the number of the next page, null on the last."""
    totals = paged.groupBy(per, "page").agg(F.count("*").alias("items"), F.sum(size).alias("approx_bytes"))
    last = paged.groupBy(per).agg(F.max("page").alias("_last"))
    return totals.join(last, per).select(per, "page", "items", "approx_bytes", F.when(F.col("page") < F.col("_last"), F.col("page") + 1).alias("next"))


def cursor_page(rows: DataFrame, order: list[Column], cursor: int, limit: int) -> tuple[DataFrame, int | None]:
    """The rows after the cursor and the next cursor, None at the end."""
    checked_range("limit", limit, 1, 10_000)
    seen = rows.orderBy(*order).offset(cursor).limit(limit + 1)
    more = seen.count() > limit
    return rows.orderBy(*order).offset(cursor).limit(limit), cursor + limit if more else None


def page_after(rows: DataFrame, order: list[str], limit: int, after: tuple | None = None) -> tuple[DataFrame, tuple | None]:
    """The first ``limit`` rows by ``order`` (columns, ascending, nulls first) behind the key ``after``, and the key to go on from.

    The key is a filter, so a page deep in the list costs what the first one does: one scan that keeps ``limit`` rows a task.
    ``order`` must tell rows apart. The next key is None at the end.
    """
    checked_range("limit", limit, 1, 10_000)
    if after is not None:
        rows = rows.where(_behind(order, after))
    seen = rows.orderBy(*(F.asc_nulls_first(c) for c in order)).limit(limit + 1)
    keys = [tuple(r) for r in seen.select(*order).collect()]  # a page
    page = seen.limit(limit)
    return page, keys[limit - 1] if len(keys) > limit else None


def _behind(order: list[str], key: tuple) -> Column:
    """Whether a row lies behind the key: greater in the first column that differs."""
    out, same = F.lit(False), F.lit(True)
    for c, value in zip(order, key, strict=True):
        greater = F.col(c).isNotNull() if value is None else F.coalesce(F.col(c) > F.lit(value), F.lit(False))
        out = out | (same & greater)
        same = same & F.col(c).eqNullSafe(F.lit(value))
    return out


def answer_events(citations: DataFrame, answer: str, abstention: str = "INSUFFICIENT CONTEXT") -> DataFrame:
    """seq and event (JSON) of one answer: the preamble, each citation (rank, id, title, url, score), the final text."""
    found = citations.select((F.col("rank").cast("long")).alias("seq"), F.to_json(F.struct(F.lit("citation").alias("type"), "id", "title", "url", "score")).alias("event"))
    ends = citations.agg(F.count("*").alias("n")).select(F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("seq"), F.to_json(F.struct(F.lit("preamble").alias("type"))).alias("event")),
        F.struct((F.col("n") + 1).alias("seq"), F.to_json(F.struct(F.lit("final").alias("type"), F.when(F.col("n") > 0, answer).otherwise(abstention).alias("answer"))).alias("event")),
    )).alias("e")).select("e.seq", "e.event")
    return found.unionByName(ends)
