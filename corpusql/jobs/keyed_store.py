"""A keyed table in a shared folder: writes are numbered deltas, reads take the last row of each key.

A write goes to a folder of its own number and replaces what is there, so a batch that is written again (a stream that
replays, a job that failed half way) leaves the table as it was after the first time. Nothing of the table is rewritten
by a write; ``compact`` folds the deltas into a base from time to time, and a base counts only once it is complete.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.operators.store import latest

GONE = "_gone"


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def write(rows: DataFrame, path: str, keys: list[str], batch: int, order: str | None = None) -> None:
    """Writes ``rows`` as batch ``batch``: of each key its last row by ``order`` (else its greatest)."""
    one = latest(rows.withColumn("_order", F.col(order) if order else F.struct(*(c for c in rows.columns if c not in keys))), keys, "_order").drop("_order")
    gone = one if GONE in rows.columns else one.withColumn(GONE, F.lit(False))
    gone.write.mode("overwrite").parquet(f"{path}/deltas/batch={batch}")


def delete(ids: DataFrame, path: str, keys: list[str], batch: int) -> None:
    """Writes that these keys are gone as batch ``batch``."""
    write(ids.select(*keys).distinct().withColumn(GONE, F.lit(True)), path, keys, batch)


def _last(rows: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    if order is None:
        return latest(rows, keys, "batch")
    return latest(rows.withColumn("_at", F.struct(order, "batch")), keys, "_at").drop("_at")


def read(spark: SparkSession, path: str, keys: list[str], order: str | None = None) -> DataFrame | None:
    """The table's rows, None where nothing has been written. order: a column that tells the last row of a key, where batches may come out of order."""
    rows = _layers(spark, path)
    if rows is None:
        return None
    now = _last(rows, keys, order)
    return now.where(~F.coalesce(F.col(GONE), F.lit(False))).drop("batch", GONE)


def _layers(spark: SparkSession, path: str) -> DataFrame | None:
    deltas, bases = _table(spark, f"{path}/deltas"), _table(spark, f"{path}/bases")
    if bases is None:
        return deltas
    until = bases.agg(F.max("batch")).first()[0]  # of its folders' names alone
    base = bases.where(F.col("batch") == F.lit(until))
    return base if deltas is None else base.unionByName(deltas.where(F.col("batch") > F.lit(until)), allowMissingColumns=True)


def compact(spark: SparkSession, path: str, keys: list[str], order: str | None = None) -> None:
    """Folds what is there into a base; the deltas stay until they are removed, and count no more."""
    rows = _layers(spark, path)
    if rows is None:
        return
    last = rows.agg(F.max("batch")).first()[0]
    kept = _last(rows, keys, order).where(~F.coalesce(F.col(GONE), F.lit(False))).drop("batch")
    kept.write.mode("overwrite").parquet(f"{path}/unfinished-{last}")
    # Under its name the base appears at once: a rename of a complete folder.
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    at, to = fs.Path(f"{path}/unfinished-{last}"), fs.Path(f"{path}/bases/batch={last}")
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(to.getParent())
    if system.exists(to):
        system.delete(to, True)
    if not system.rename(at, to):
        raise OSError(f"{to} could not be written")


def sink(path: str, keys: list[str], change: Callable[[DataFrame], DataFrame] = lambda rows: rows, order: str | None = None) -> Callable[[DataFrame, int], None]:
    """What a stream's foreachBatch calls: its batch, changed, is merged under its number."""
    return lambda rows, batch: write(change(rows), path, keys, batch, order)
