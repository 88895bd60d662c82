"""Two files that belong together line by line, read in parts: lines numbered over all parts, and both cut to the shorter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusql.functions.text import parsed_vector


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """number (from 0) and value of the lines of a file, or of a folder's files in the order of their names.

    Each split of a file numbers its own lines; a split's first number is the sum of the splits before, of which there is a row each.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    splits = lines.groupBy("_f", "_b").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = splits.select("_f", "_b", (before - F.col("_first")).alias("_shift"))
    return lines.join(shifts, ["_f", "_b"]).select((F.col("_m") + F.col("_shift")).alias("number"), "value")


def aligned(vectors: DataFrame, meta: DataFrame) -> DataFrame:
    """number, vector and meta of the lines (number, value) that both sides have: what is longer is cut."""
    v = vectors.select("number", parsed_vector(F.col("value")).alias("vector"))
    return v.join(meta.select("number", F.col("value").alias("meta")), "number")


def alignment(vectors: DataFrame, meta: DataFrame, dim: int) -> DataFrame:
    """One row: vectors, meta_lines, kept, wrong_width and whether both sides had as many lines."""
    v = vectors.agg(F.count("*").alias("vectors"), F.count_if(F.coalesce(F.size(parsed_vector(F.col("value"))), F.lit(-1)) != dim).alias("wrong_width"))
    m = meta.agg(F.count("*").alias("meta_lines"))
    both = v.join(F.broadcast(m))  # one row each
    return both.select("vectors", "meta_lines", F.least("vectors", "meta_lines").alias("kept"), "wrong_width", (F.col("vectors") == F.col("meta_lines")).alias("aligned"))
