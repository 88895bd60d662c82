"""Jobs that turn documents, attachments and table rows into stored chunks with vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusql.functions.text import char_windows, sanitize, truncate_marked
from corpusql.operators.store import appended, local_embedder, prepared


def body_chunks(docs: DataFrame, least_chars: int = 200) -> DataFrame:
    """Chunks of the documents (id, space, type, title, text) that are long enough."""
    cut = docs.where(F.length("text") >= least_chars).select("*", F.explode(char_windows(F.col("text"))).alias("c"))
    return cut.select("id", "space", "type", "title", F.concat(F.lit("/v1/fetch?ids="), "id").alias("url"), F.col("c.chunk_ix").cast("long").alias("chunk_ix"), F.col("c.chunk").alias("text"))


def attachment_chunks(texts: DataFrame, least_chars: int = 50) -> DataFrame:
    """Chunks of extracted attachments (content_id, relpath, space, text)."""
    docs = texts.select(F.concat_ws(":", F.lit("ATT"), "content_id", "relpath").alias("id"), "space", F.lit("attachment").alias("type"), F.element_at(F.split("relpath", "/"), -1).alias("title"), "relpath", truncate_marked(sanitize(F.col("text"), 1 << 30), 200_000).alias("text"))
    chunks = body_chunks(docs, least_chars)
    return chunks.withColumn("url", F.concat(F.lit("/attachments/"), F.split("id", ":", 3)[2]))


def embedded(chunks: DataFrame, dim: int = 64, embed=None) -> DataFrame:
    """Chunks with the vector of their text; equal texts are embedded once."""
    embed = embed or local_embedder(dim)
    hashed = chunks.withColumn("content_hash", F.sha2("text", 256))
    vectors = hashed.groupBy("content_hash").agg(F.first("text").alias("_text")).select("content_hash", embed(F.col("_text")).alias("embedding"))
    return hashed.join(vectors, "content_hash")


def stored(store: DataFrame | None, chunks: DataFrame, dim: int) -> DataFrame:
    """The store after these chunks: one row for each id and chunk."""
    new = prepared(chunks, dim)
    return new if store is None else appended(store, new)


def only_new(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """Chunks whose text the store has not embedded yet."""
    return chunks.withColumn("content_hash", F.sha2("text", 256)).join(store.select("content_hash").distinct(), "content_hash", "left_anti")


def document_vectors(docs: DataFrame, dim: int, embed=None) -> DataFrame:
    """id and one vector for title and body together."""
    embed = embed or local_embedder(dim)
    return docs.select("id", embed(F.concat_ws("\n", "title", "text")).alias("embedding"))


def gate(now: DataFrame, before: str | None) -> tuple[bool, Column]:
    """Whether a run is due: the fingerprint (one row) differs from the one before; and the new one."""
    new = now.first()["fingerprint"]
    return new != before, F.lit(new)
