"""Streams: watched folders that feed a store, rates over event time, and a stream's progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusql.jobs import keyed_store


def watch_folder(spark: SparkSession, folder: str, schema: str, each: Callable[[DataFrame, int], None], state: str, every: str | None = None, files: int | None = None) -> StreamingQuery:
    """Feeds new record files of a folder to ``each``. The checkpoint in ``state`` knows which files were seen.

    every: such as '300 seconds'; without it, what is there now is taken and the query ends. files: at most so many a batch.
    """
    source = spark.readStream.schema(schema)
    stream = (source.option("maxFilesPerTrigger", files) if files else source).json(folder)
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", state)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def watch_into_store(spark: SparkSession, folder: str, schema: str, path: str, keys: list[str], state: str, change: Callable[[DataFrame], DataFrame] = lambda rows: rows, order: str | None = None, **how) -> StreamingQuery:
    """Merges a watched folder's records into the keyed store at ``path``. A batch that a restart replays is merged once."""
    return watch_folder(spark, folder, schema, keyed_store.sink(path, keys, change, order), state, **how)


def event_rates(events: DataFrame, width: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Events and their summed value by window and type. In append mode the watermark closes windows and bounds the state."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def rates_until_now(spark: SparkSession, folder: str, pattern: str, schema, state: str, out: str, width: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """The rates of all events that a folder's files hold, by way of a stream that ends.

    Each batch's events are summed by window and appended; windows that a later batch adds to have several rows, which are
    added up when read, so no state is kept at all and no event is too late.
    """
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)

    def save(batch: DataFrame, number: int) -> None:
        event_rates(batch, width, late).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).groupBy("start", "event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


def closed_rates(spark: SparkSession, folder: str, schema: str, out: str, state: str, width: str = "60 seconds", late: str = "10 minutes") -> StreamingQuery:
    """Appends each window's rates once, when the watermark has passed it; events later than ``late`` are left out."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)
    return event_rates(stream, width, late).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()


def progress(query: StreamingQuery) -> list[dict]:
    """Rows, seconds and rows a second of a stream's last batches, as the engine has observed them."""
    found = []
    for p in query.recentProgress:
        rows, seconds = p["numInputRows"], p["batchDuration"] / 1000
        found.append({"batch": p["batchId"], "rows": rows, "seconds": seconds, "rate": rows / seconds if seconds else 0.0})
    return found
