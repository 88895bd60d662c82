"""Gapless ranks and running sums over groups of any size: range partitions, and the sums of the partitions before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusql.session import cut

ROWS_IN_PART = 500_000


def ranked(rows: DataFrame, order: list[str], per: list[str] = (), rank: str = "rank", parts: int | None = None) -> DataFrame:
    """``rows`` with their rank from 1 by ``order`` (columns) within ``per``; nulls come first, null groups are groups.

    Rows are dealt into ranges of (per, order), numbered where they lie, and written down; a group's rank begins, in each
    range, at the number of its rows in the ranges before. No task holds a group.
    """
    keys = [*per, *order]
    parts = parts or max(1, -(-rows.count() // ROWS_IN_PART))
    placed = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    # Ids of a partition follow its order; its number is in the upper bits.
    placed = cut(placed.withColumns({"_part": F.shiftright("_place", 33), "_place": F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))}))
    firsts = placed.groupBy(*per, "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*per).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    shifts = firsts.select(*(F.col(c).alias(f"_g{k}") for k, c in enumerate(per)), F.col("_part").alias("_p"), (before - F.col("_first")).alias("_shift"))
    same = F.col("_part") == F.col("_p")
    for k, c in enumerate(per):
        same &= F.col(c).eqNullSafe(F.col(f"_g{k}"))
    return placed.join(shifts, same).select(*rows.columns, (F.col("_place") + F.col("_shift") + 1).alias(rank))


def running(rows: DataFrame, value: str, order: list[str], per: list[str] = (), total: str = "running", parts: int | None = None) -> DataFrame:
    """``rows`` with the sum of ``value`` (null: 0) from the first row of ``per`` by ``order`` up to this one, by the same steps."""
    keys = [*per, *order]
    parts = parts or max(1, -(-rows.count() // ROWS_IN_PART))
    placed = cut(rows.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()))
    amount = F.coalesce(value, F.lit(0))
    sums = placed.groupBy(*per, "_part").agg(F.sum(amount).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*per).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = sums.select(*(F.col(c).alias(f"_g{k}") for k, c in enumerate(per)), F.col("_part").alias("_p"), before.alias("_ahead"))
    within = F.sum(amount).over(Window.partitionBy(*per, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    same = F.col("_part") == F.col("_p")
    for k, c in enumerate(per):
        same &= F.col(c).eqNullSafe(F.col(f"_g{k}"))
    return placed.withColumn("_within", within).join(ahead, same).select(*rows.columns, (F.col("_ahead") + F.col("_within")).alias(total))


def least_k(rows: DataFrame, key: list[str], value: str, k: int) -> DataFrame:
    """Of each key the ``k`` least different values. Each task keeps k a key before the shuffle, so no group is ever gathered."""
    return first_k(rows.select(*key, value).distinct(), key, value, k)


def first_k(rows: DataFrame, key: list[str], value: str, k: int) -> DataFrame:
    """Of each key the first ``k`` rows by ``value``."""
    by = Window.partitionBy(*key).orderBy(value)
    return rows.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= k).drop("_r")


def dealt_join(rows: DataFrame, few: DataFrame, key: str, by: str, sizes: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """``rows`` joined with the few rows that ``few`` has for each key, in ``parts`` tasks where told.

    A key of over ROWS_IN_PART rows is dealt over several tasks by ``by``, and its few rows are sent to each of these. sizes:
    key and count, where the rows of each key are known.
    """
    sizes = rows.groupBy(key).count() if sizes is None else sizes
    many = sizes.where(F.col("count") > ROWS_IN_PART).select(key, F.ceil(F.col("count") / ROWS_IN_PART).cast("int").alias("_parts"))
    frequent = F.broadcast(many)  # at most all rows / ROWS_IN_PART
    left = rows.join(frequent, key, "left").select(*rows.columns, F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1))).cast("int").alias("_part"))
    right = few.join(frequent, key, "left").select(*few.columns, F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_part"))
    if parts:
        left, right = left.repartition(parts, key, "_part"), right.repartition(parts, key, "_part")
    return left.join(right, [key, "_part"]).drop("_part")
