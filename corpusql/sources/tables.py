"""Canonical frames over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.functions.text import title_of
from corpusql.jobs import index
from corpusql.session import table


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, space, type, title, text."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("space"), F.col("lang").alias("type"), title_of(F.col("text")).alias("title"), "text")


def docs_index(spark: SparkSession, sf_dir: str) -> index.Index:
    """The stored full-text index of ``docs``, built once a session."""
    return index.of_table(spark, "docs", table(spark, sf_dir, "documents"), lambda: docs(spark, sf_dir))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, space, embedding."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("space"), "embedding")


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """content_id, relpath, size: the lines of orders as files of documents."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("content_id"), F.col("l_linenumber").alias("relpath"), F.col("l_quantity").alias("size"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, kind, weight."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("kind"), F.col("l_quantity").alias("weight"))
