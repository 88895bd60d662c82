"""Attachments into a chunk store: find the files, take known texts from a cache, extract the others, chunk, embed, merge.

A file's text is kept under the hash of its path, length and time, so a file is extracted once for each of its states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.functions.text import truncate_marked, utf8_or_latin
from corpusql.jobs import embed, keyed_store
from corpusql.operators import store
from corpusql.operators.code import extension
from corpusql.sources.documents import office_text
from corpusql.sources.files import below, contents, listing

MOST_CHARS = 200_000
# Extensions that are never read, those of office files, and those that are read as text.
DENIED = [".rpm", ".deb", ".msi", ".exe", ".dll", ".so", ".whl", ".jar", ".iso", ".img", ".tar", ".tgz", ".gz", ".xz", ".bz2", ".7z", ".zip", ".obj", ".a", ".lib"]
OFFICE = [".docx", ".pptx", ".xlsx"]
TEXT = [".txt", ".csv", ".md", ".log", ".cfg", ".ini", ".conf", ".json", ".xml", ".yaml", ".yml", ".py", ".sh", ".rb", ".php", ".js", ".ts", ".java", ".go", ".cpp", ".cc", ".c", ".h", ".hpp", ".sql", ".ps1", ".bat"]
#: They need programs outside Spark, so their text is empty.
OUTSIDE = [".pdf", ".png", ".jpg", ".jpeg", ".tiff", ".bmp", ".gif"]


def route(path: Column) -> Column:
    """How a file is read, by its extension: none, office, text, or look (text unless its first bytes hold a NUL)."""
    ext = extension(path)
    return F.when(ext.isin(*DENIED, *OUTSIDE), "none").when(ext.isin(*OFFICE), "office").when(ext.isin(*TEXT), "text").otherwise("look")


def cache_key(path: Column, length: Column, time: Column) -> Column:
    return F.sha2(F.concat_ws(":", path, length.cast("string"), F.unix_seconds(time.cast("timestamp")).cast("string")), 256)


def extracted(files: DataFrame) -> DataFrame:
    """path and text (cut and marked beyond MOST_CHARS) of files (path, content); unreadable ones have an empty text."""
    routed = files.withColumn("_route", route(F.col("path")))
    binary = F.contains(F.decode(F.substring(F.col("content"), 1, 1024), "ISO-8859-1"), F.lit("\0"))
    plain = F.when(F.col("_route") == "none", "").when((F.col("_route") == "look") & binary, "").otherwise(truncate_marked(utf8_or_latin(F.col("content")), MOST_CHARS))
    own = routed.where("_route <> 'office'").select("path", plain.alias("text"))
    return own.unionByName(office_text(routed.where("_route = 'office'"), MOST_CHARS).select("path", F.coalesce("text", F.lit("")).alias("text")))


def ingest(spark: SparkSession, root: str, attachments: DataFrame, path: str, dim: int, run: int, spaces: list[str] | None = None, least_chars: int = 50) -> dict[str, int]:
    """Brings attachments (content_id, space, relpath), files below ``root``, into the store at ``path`` as run ``run`` and returns its counts.

    Texts and chunks are written under the run's number, texts first, so a run that failed is repeated by running it again.
    """
    wanted = attachments.select("content_id", "space", "relpath").distinct()
    if spaces:
        wanted = wanted.where(F.col("space").isin(spaces))
    files = listing(spark, root).withColumn("relpath", below(root))
    found = wanted.join(files.withColumn("key", cache_key(F.col("relpath"), F.col("length"), F.col("modificationTime"))), "relpath")
    known = keyed_store.read(spark, f"{path}/texts", ["key"])
    new = found if known is None else found.join(known.select("key"), "key", "left_anti")
    todo = [r.path for r in new.select("path").distinct().collect()]  # names of files, as any scan's driver holds them
    if todo:
        texts = extracted(contents(spark, todo)).select(below(root).alias("relpath"), "text")
        made = new.select("key", "relpath").distinct().join(texts, "relpath")
        keyed_store.write(made.select("key", "relpath", "text"), f"{path}/texts", ["key"], run)
    known = keyed_store.read(spark, f"{path}/texts", ["key"])
    if known is None:
        return {"attachments": wanted.count(), "found": 0, "extracted": 0, "chunked": 0, "chunks": 0}
    now = found.join(known.select("key", "text"), "key")
    chunks = embed.attachment_chunks(now.select("content_id", "space", "relpath", "text"), least_chars)
    before = keyed_store.read(spark, f"{path}/chunks", ["id", "chunk_ix"])
    fresh = chunks.withColumn("content_hash", F.sha2("text", 256))
    if before is not None:  # what is there under its name with the same text is not embedded again
        fresh = fresh.join(before.select("id", "chunk_ix", "content_hash"), ["id", "chunk_ix", "content_hash"], "left_anti")
    keyed_store.write(store.prepared(embed.embedded(fresh, dim), dim), f"{path}/chunks", ["id", "chunk_ix"], run)
    kept = keyed_store.read(spark, f"{path}/chunks", ["id", "chunk_ix"])
    counts = wanted.join(found.select("content_id", "relpath", F.lit(1).alias("f")).distinct(), ["content_id", "relpath"], "left").agg(F.count("*").alias("attachments"), F.count("f").alias("found")).first()
    return {"attachments": counts.attachments, "found": counts.found, "extracted": len(todo), "chunked": kept.select("id").distinct().count(), "chunks": kept.count()}
