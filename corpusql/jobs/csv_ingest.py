"""CSV trees into a chunk store: list, leave out unchanged files, parse, embed, merge, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.jobs import keyed_store
from corpusql.operators import store
from corpusql.sources import csvtree


def ingest(spark: SparkSession, root: str, customer: str, path: str, dim: int, run: int, glob: str = "*", **options) -> dict[str, int]:
    """Brings the tables below ``root`` into the store at ``path`` as run ``run`` (a number that grows) and returns its report.

    Files that the cache (``path``/files) holds with the same length and time are left out. The chunks are written before
    the cache, both under the run's number, so a run that failed is repeated by running it again. The report's aligned tells
    whether every chunk of the store has a vector of the right width.
    """
    files = csvtree.tree(spark, root, glob)
    cache = keyed_store.read(spark, f"{path}/files", ["path"])
    new = csvtree.changed(files, cache)
    wanted = sorted(r.path for r in new.select("path").collect())
    rows = csvtree.rows(spark, wanted, **options)
    chunks = csvtree.documents(rows, customer)
    vectors = store.prepared(chunks.withColumn("embedding", store.local_embedder(dim)("text")), dim)
    if wanted:
        keyed_store.write(vectors, f"{path}/chunks", ["id", "chunk_ix"], run, order="row")
        counts = rows.groupBy("path").agg(F.count("*").alias("rows"))
        keyed_store.write(new.join(counts, "path", "left").select("path", "length", "modificationTime", F.coalesce("rows", F.lit(0)).alias("rows"), F.lit(run).alias("run")), f"{path}/files", ["path"], run)
    return report(spark, path, run, files.count(), dim)


def report(spark: SparkSession, path: str, run: int, listed: int, dim: int) -> dict[str, int]:
    known, kept = keyed_store.read(spark, f"{path}/files", ["path"]), keyed_store.read(spark, f"{path}/chunks", ["id", "chunk_ix"])
    if known is None or kept is None:
        return {"files_processed": 0, "files_skipped": listed, "rows": 0, "chunks": 0, "aligned": 1}
    mine = known.where(F.col("run") == run).agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    chunks, right = kept.agg(F.count("*"), F.count_if(F.size("embedding") == dim)).first()
    return {"files_processed": mine[0], "files_skipped": listed - mine[0], "rows": mine[1], "chunks": chunks, "aligned": int(chunks == right)}


def chunks(spark: SparkSession, path: str) -> DataFrame | None:
    return keyed_store.read(spark, f"{path}/chunks", ["id", "chunk_ix"])
