"""Best-fit packing into bins of several permitted lengths at once.

Texts longer than the largest length are cut into pieces of that length. Pieces are dealt at random into blocks of
bounded size, each packed by itself: longest piece first, into the open bin that it leaves least room in; where none has
room, a bin opens at the length with the least expected cost per token (a fixed cost, a linear and a quadratic one, over
the tokens it can expect to hold). At the end every bin shrinks to the smallest permitted length that holds its contents.

Blocks follow the row count alone, so neither a hot source nor a repeated doc_id makes one large. A text without words
is a piece of no tokens and rides in any bin. Repeated rows are pieces of their own. A null doc_id is packed and stays null.
Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.llm.common import cut, table

#: Permitted sequence lengths; pieces in a block; a bin's fixed cost in tokens; the length at which attention costs as
#: much as everything else.
LENGTHS, BLOCK, FIXED, EVEN_AT = (512, 1024, 2048, 4096), 20_000, 64, 16_384


def best_fit(sizes: np.ndarray, lengths: tuple[int, ...], fixed: float = FIXED, even_at: float = EVEN_AT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset in it and the bin's final length, for each size."""
    lengths = tuple(sorted(lengths))
    cost = {c: fixed + c * (1 + c / even_at) for c in lengths}
    order = np.argsort(-sizes, kind="stable")
    rest = int(sizes.sum())
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    room: dict[int, list[int]] = {}  # free tokens to the bins that have so many
    free: list[int] = []  # the keys of room, sorted
    fill: list[int] = []
    for i in order:
        size = int(sizes[i])
        k = bisect_left(free, size)
        if k < len(free):
            left = free[k]
            b = room[left].pop()
            if not room[left]:
                del room[left], free[k]
        else:
            b, left = len(fill), min((c for c in lengths if c >= size), key=lambda c: cost[c] / max(1, min(c, rest)))
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        rest -= size
        left -= size
        if left not in room:
            room[left] = []
            insort(free, left)
        room[left].append(b)
    final = np.array(lengths)[np.searchsorted(lengths, np.array(fill, np.int64))] if fill else np.zeros(0, np.int64)
    return bins, offsets, final[bins]


def pack(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, block: int = BLOCK) -> DataFrame:
    """doc_id, piece, n_tokens, bin, start (in the bin) and length (of the bin), for every piece of every row."""
    most = max(lengths)
    words = F.coalesce(F.expr(r"regexp_count(text, '[^\\x20\\x09-\\x0D]+')"), F.lit(0)).cast("long")
    # In a pandas frame a null would turn a whole column of ids into floats, so nulls travel as a flag.
    sized = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("unnamed"), words.alias("_n"))
    whole = f"sequence(0, greatest(0, cast((_n - 1) div {most} as int)))"
    pieces = sized.select("doc_id", "unnamed", "_n", F.explode(F.expr(whole)).alias("piece"))
    pieces = cut(pieces.select("doc_id", "unnamed", F.col("piece").cast("long").alias("piece"), F.expr(f"least({most}, _n - piece * {most})").alias("n_tokens")))
    blocks = max(1, -(-pieces.count() // block))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_tokens", "unnamed", "doc_id", "piece"], ascending=[False, True, True, True])
        bins, offsets, final = best_fit(frame["n_tokens"].to_numpy(), lengths)
        return pd.DataFrame({"doc_id": frame["doc_id"], "unnamed": frame["unnamed"], "piece": frame["piece"], "n_tokens": frame["n_tokens"], "bin": (frame["block"].to_numpy() << 32) + bins, "start": offsets, "length": final})

    packed = dealt.groupBy("block").applyInPandas(each, "doc_id bigint, unnamed boolean, piece bigint, n_tokens bigint, bin bigint, start bigint, length bigint")
    return packed.select(F.when(~F.col("unnamed"), F.col("doc_id")).alias("doc_id"), "piece", "n_tokens", "bin", "start", "length")


def op7_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
