"""Counts of a running job without a second scan, its report, and the time that is left."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def observed(rows: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """``rows`` and what the job that writes them will count: rows and the aggregates given."""
    seen = Observation()
    return rows.observe(seen, F.count("*").alias("rows"), *(c.alias(n) for n, c in counts.items())), seen


def run(rows: DataFrame, write: Callable[[DataFrame], None], **counts: Column) -> dict:
    """Writes ``rows`` and tells rows, the aggregates given, seconds and rows a second, all from the one job."""
    watched, seen = observed(rows, **counts)
    began = time.monotonic()
    write(watched)
    seconds = time.monotonic() - began
    found = dict(seen.get)
    return found | {"seconds": round(seconds, 3), "rate": round(found["rows"] / seconds, 3) if seconds else 0.0}


def time_left(snapshots: DataFrame, total: int, seconds: int = 60) -> DataFrame:
    """rate (rows a second) over the last ``seconds`` of snapshots (at: timestamp, done: rows so far), what is left and how long that takes.

    Null where the window holds no growth.
    """
    at = F.unix_micros(F.col("at").cast("timestamp")) / 1e6
    end = snapshots.agg(F.max(at).alias("end"))
    window = snapshots.select(at.alias("s"), "done").join(F.broadcast(end)).where(F.col("s") >= F.col("end") - seconds)  # one row
    ends = window.agg(F.min_by("done", "s").alias("d0"), F.max_by("done", "s").alias("d1"), F.min("s").alias("s0"), F.max("s").alias("s1"))
    rate = F.when((F.col("d1") > F.col("d0")) & (F.col("s1") > F.col("s0")), (F.col("d1") - F.col("d0")) / (F.col("s1") - F.col("s0")))
    left = F.greatest(F.lit(total) - F.col("d1"), F.lit(0))
    return ends.select(F.col("d1").alias("done"), rate.alias("rate"), left.alias("left"), (left / rate).alias("seconds_left"))


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A run's report as one JSON object."""
    spark.createDataFrame([tuple(report.values())], list(report)).coalesce(1).write.mode("overwrite").json(path)
