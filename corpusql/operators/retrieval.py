"""Vector top-k, score fusion, paging budgets and graph look-ups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusql.functions import vectors as V
from corpusql.operators.ranks import least_k, running


def vector_topk(chunks: DataFrame, query: Column | list[float], k: int, measure=V.cosine, where: Column | None = None, pool: int | None = None) -> DataFrame:
    """The k nearest of ``chunks`` (id, space, embedding). where: a filter; pool: cut to so many before it (compat)."""
    q = query if isinstance(query, Column) else F.array(*map(F.lit, query))
    scored = chunks.select("id", "space", F.round(measure(V.doubles(F.col("embedding")), q), 6).alias("score"))
    if pool:
        scored = scored.orderBy(F.desc("score"), "id").limit(pool)
    if where is not None:
        scored = scored.where(where)
    return scored.orderBy(F.desc("score"), "id").limit(k)


def minmax(hits: DataFrame, column: str) -> DataFrame:
    """``column`` scaled to 0..1 over a hit list (0 where all are equal); hit lists are top-k, so this is small."""
    w = Window.partitionBy(F.lit(1))
    low, high = F.min(column).over(w), F.max(column).over(w)
    return hits.withColumn(column, F.when(high > low, (F.col(column) - low) / (high - low)).otherwise(0.0))


def fuse(lexical: DataFrame, vector: DataFrame, k: int, alpha: float = 0.5) -> DataFrame:
    """Hits of either side (id, score) by alpha * lexical + (1 - alpha) * vector of the scaled scores; missing ones are 0."""
    both = lexical.select("id", F.col("score").alias("lex")).join(vector.select("id", F.col("score").alias("vec")), "id", "full")
    both = both.select("id", F.coalesce("lex", F.lit(0.0)).alias("lex"), F.coalesce("vec", F.lit(0.0)).alias("vec"))
    both = minmax(minmax(both, "lex"), "vec")
    return both.select("id", F.round(alpha * F.col("lex") + (1 - alpha) * F.col("vec"), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def budget_cut(rows: DataFrame, size: str, order: str, budget: int, per: list[str]) -> DataFrame:
    """The rows of each ``per`` group, by ``order``, as long as their sizes (null: 0) sum to at most the budget; with running.

    Rows whose group is null are a group, rows whose order is null come first. Running sums are taken over ranges of
    the order, so a group of any size and spread is never in one task.
    """
    return running(rows, size, [order], per).where(F.col("running") <= budget)


#: Numbers in one task's matrices: a block's vectors, and the scores of a few queries against it.
CELLS = 4_000_000


def block_topk(chunks: DataFrame, queries: DataFrame, k: int, block: int = 20_000, query_block: int = 20_000) -> DataFrame:
    """For each query (query_id, q) the k nearest of all chunks (id, embedding) by cosine: query_id, id, score, rank.

    Both sides are dealt into blocks of bounded size, of fewer rows where vectors are wide; each pair of blocks gives k rows
    a query, and these are ranked by query. A null vector is near nothing and has nothing near it; vectors of different width
    are not compared.
    """
    chunks, queries = chunks.where("embedding is not null"), queries.where("q is not null")
    rows, width = chunks.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    most = max(1, CELLS // max(1, width))
    blocks = max(1, -(-rows // min(block, most)))
    query_blocks = max(1, -(-queries.count() // min(query_block, most)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = chunks.select("id", F.col("embedding").alias("v"), F.size("embedding").alias("w"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"), each(query_blocks).alias("qb"))
    q = queries.select("query_id", F.col("q").alias("v"), F.size("q").alias("w"), F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int").alias("qb"), each(blocks).alias("b"))

    return near_blocks(c, q, ["b", "qb", "w"], k)


def near_blocks(rows: DataFrame, queries: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k nearest rows (id, v) by cosine of each query (query_id, v), of those that share its ``keys``: query_id, id, score, rank."""
    found = rows.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(nearest(k), "query_id bigint, id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def nearest(k: int, cells: int = CELLS):
    """A function of blocks: the k nearest of ``left`` (id, v) for each of ``right`` (query_id, v), so few queries at a time that their scores are at most ``cells``."""

    def unit(vectors: pd.Series) -> np.ndarray:
        m = np.array(vectors.tolist(), np.float64)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        left = left.sort_values("id")
        ids, units, asked, found = left["id"].to_numpy(), unit(left["v"]).T, right["query_id"].to_numpy(), []
        step = max(1, cells // len(ids))
        for at in range(0, len(asked), step):
            scores = np.round(unit(right["v"].iloc[at : at + step]) @ units, 6)
            far = np.where(np.isnan(scores), np.inf, -scores)
            # Up to the k-th score and all its ties, from which the least ids are taken.
            q, i = np.nonzero(far <= np.partition(far, k - 1, axis=1)[:, k - 1 : k]) if k < len(ids) else np.nonzero(np.ones(far.shape, bool))
            order = np.lexsort((i, far[q, i], q))
            q, i = q[order], i[order]
            kept = np.arange(len(q)) - np.searchsorted(q, q) < k
            q, i = q[kept], i[kept]
            found.append(pd.DataFrame({"query_id": asked[at + q], "id": ids[i], "score": scores[q, i]}))
        return pd.concat(found)

    return near


def neighbors(edges: DataFrame, node: int | str, limit: int) -> DataFrame:
    return edges.where(F.col("src") == node).orderBy("dst", "kind").limit(limit)


def fan_out_cap(edges: DataFrame, most: int = 32) -> DataFrame:
    """The first ``most`` distinct neighbours of each node."""
    return least_k(edges.select("src", "dst"), ["src"], "dst", most)
