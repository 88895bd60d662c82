"""Vector tables: embedding, projection, keyed append, delete, an inverted-file index, caches and request files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from corpusql.functions import vectors as V


def local_embedder(dim: int):
    """A column function: a deterministic unit vector for each text, without meaning, for use offline."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[float]:
            seed = hashlib.blake2b((text or "").encode(), digest_size=32).digest()[:8]
            v = np.random.default_rng(int.from_bytes(seed, "big")).standard_normal(dim).astype(np.float32)
            length = float(np.linalg.norm(v))
            return (v / length if length > 0 else v).tolist()

        return texts.map(one)

    return embed


def projection_matrix(rows: int, cols: int, seed: int = 0) -> np.ndarray:
    """Gaussian, scaled by 1 / sqrt(rows); the same for the same arguments."""
    return np.random.default_rng(seed & 0xFFFFFFFF).standard_normal((rows, cols), dtype=np.float32) / np.float32(np.sqrt(rows))


def projected(rows: DataFrame, column: str, out: str, dim_in: int, dim_out: int, seed: int = 0, unit: bool = False) -> DataFrame:
    """``rows`` with the random projection of a vector column; vectors of ``dim_out`` pass, null and other lengths give null.

    unit: normalise before and after, as the backfill of missing projections does. The matrix is made on each worker
    from its seed.
    """
    matrix: list[np.ndarray] = []

    @F.pandas_udf(ArrayType(FloatType()))
    def project(vectors: pd.Series) -> pd.Series:
        if not matrix:
            matrix.append(projection_matrix(dim_out, dim_in, seed))

        def scaled(x: np.ndarray) -> np.ndarray:
            n = np.linalg.norm(x)
            return x / n if unit and n > 0 else x

        def one(v) -> list[float] | None:
            if v is None or len(v) not in (dim_in, dim_out):
                return None
            x = np.asarray(v, np.float32)
            return x.tolist() if len(v) == dim_out else scaled(matrix[0] @ scaled(x)).astype(np.float32).tolist()

        return vectors.map(one)

    return rows.withColumn(out, project(column))


def backfilled(rows: DataFrame, full: str, reduced: str, dim_in: int, dim_out: int, seed: int = 0) -> DataFrame:
    """``rows`` with ``reduced`` filled in where it is null and ``full`` is not."""
    made = projected(rows, full, "_made", dim_in, dim_out, seed, unit=True)
    return made.withColumn(reduced, F.coalesce(reduced, "_made")).drop("_made")


def prepared(chunks: DataFrame, dim: int) -> DataFrame:
    """Chunks as the store holds them: unit vectors of the right width only, a snippet in place of the text."""
    right = chunks.where(F.size("embedding") == dim)
    return right.withColumn("embedding", V.normalized(V.doubles(F.col("embedding")))).withColumn("snippet", F.when(F.length("text") > 0, F.substring("text", 1, 300))).drop("text")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key the row with the greatest ``order``: one aggregation, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_best"))
    return best.select(*keys, *(F.col(f"_best.{c}").alias(c) for c in rest))


def appended(store: DataFrame, new: DataFrame, keys: list[str] = ("id", "chunk_ix")) -> DataFrame:
    """``store`` and ``new`` with one row a key, the new one's."""
    both = store.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    return latest(both, list(keys), "_age").drop("_age")


def without_ids(store: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return store.join(ids.select(key).distinct(), key, "left_anti")


def inverted_file(chunks: DataFrame, lists: int = 100, seed: int = 1, sample: int = 100_000) -> tuple[DataFrame, np.ndarray]:
    """``chunks`` with the list of the nearest centre, and the centres, by k-means on at most about ``sample`` rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = chunks.count()
    vectors = chunks.select("*", array_to_vector(V.doubles(F.col("embedding"))).alias("features"))
    fitted = KMeans(k=max(2, min(lists, n)), seed=seed, maxIter=10).fit(vectors if n <= sample else vectors.sample(sample / n, seed))
    return fitted.transform(vectors).drop("features").withColumnRenamed("prediction", "list_id"), np.array(fitted.clusterCenters())


def probe(index: DataFrame, centres: np.ndarray, q: list[float], k: int, probes: int = 10) -> DataFrame:
    """The k nearest (by L2) among the rows of the lists whose centres are nearest to the query."""
    near = np.argsort(((centres - np.asarray(q)) ** 2).sum(axis=1), kind="stable")[:probes]
    hits = index.where(F.col("list_id").isin([int(x) for x in near]))
    score = V.l2_similarity(V.doubles(F.col("embedding")), F.array(*map(F.lit, q)))
    return hits.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def write_lists(chunks: DataFrame, path: str, lists: int = 100, seed: int = 1, sample: int = 100_000, rows_in_file: int = 500_000, k: int = 10, recall: float = 0.95, asked: int = 200) -> int:
    """Stores chunks (id, space, embedding) by the list of their nearest centre, a folder each, and the centres beside them.

    The centres are fitted on a bounded sample; every row is stored. A list of many rows is dealt over several tasks and
    files by id, so no list is one task's. Null vectors have no list. How many lists a query must read is measured: about
    ``asked`` rows are taken as queries, their ``k`` nearest of all rows found exactly, and the least number of probes that
    reaches ``recall`` of these is stored and returned.
    """
    found, centres = inverted_file(chunks.where("embedding is not null"), lists, seed, sample)
    sizes = found.groupBy("list_id").count()
    files = sizes.select("list_id", F.ceil(F.col("count") / rows_in_file).cast("int").alias("_files"))
    dealt = found.join(F.broadcast(files), "list_id").withColumn("_file", F.pmod(F.xxhash64("id"), F.col("_files")))  # a row a list
    dealt.repartition("list_id", "_file").drop("_files", "_file").write.partitionBy("list_id").parquet(f"{path}/lists")
    spark = chunks.sparkSession
    probes = _probes_needed(chunks, spark.read.parquet(f"{path}/lists"), centres, k, recall, asked)
    spark.createDataFrame([(n, [float(x) for x in c], probes) for n, c in enumerate(centres)], "list_id int, centre array<double>, probes int").coalesce(1).write.parquet(f"{path}/centres")
    return probes


def _probes_needed(chunks: DataFrame, index: DataFrame, centres: np.ndarray, k: int, recall: float, asked: int) -> int:
    """Of a bounded number of queries: at which place in the order of lists each of the k nearest lies, and the place that covers ``recall`` of them."""
    from corpusql.operators.retrieval import block_topk

    n = chunks.count()
    queries = chunks.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // asked))) == 0).limit(2 * asked).select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    near = block_topk(chunks, queries, k).join(index.select("id", "list_id"), "id").join(queries, "query_id").select("query_id", "q", "list_id").collect()  # at most 2 * asked * k
    if not near:
        return 1
    order = np.argsort(_far(np.array([r.q for r in near], np.float64), centres), axis=1, kind="stable")
    places = np.sort((order == np.array([r.list_id for r in near])[:, None]).argmax(axis=1))
    return int(places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)]) + 1


def _far(q: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (q * q).sum(axis=1)[:, None] - 2 * q @ centres.T + (centres * centres).sum(axis=1)[None, :]


def stored_lists(spark, path: str) -> tuple[DataFrame, np.ndarray, int]:
    """The stored rows with list_id, the centres (at most as many as there are lists) and the probes a query needs."""
    centres = spark.read.parquet(f"{path}/centres").orderBy("list_id").collect()
    return spark.read.parquet(f"{path}/lists"), np.array([r.centre for r in centres]), centres[0].probes


def probe_batch(spark, path: str, queries: DataFrame, k: int, probes: int | None = None, block: int = 20_000, query_block: int = 20_000) -> DataFrame:
    """For each query (query_id, q) the k nearest by cosine among the lists of its nearest centres: query_id, id, score, rank.

    Queries meet rows list by list; a large list is dealt into blocks, and so are the queries that probe it. The lists that no
    query probes are not read.
    """
    from corpusql.operators.retrieval import CELLS, near_blocks

    index, centres, needed = stored_lists(spark, path)
    probes = probes or needed

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        q = np.array(vectors.tolist(), np.float64)
        return pd.Series(list(np.argsort(_far(q, centres), axis=1, kind="stable")[:, :probes].astype(np.int32)))

    most = max(1, CELLS // max(1, centres.shape[1]))
    block, query_block = min(block, most), min(query_block, most)
    queries = queries.where("q is not null")
    query_blocks = F.lit(max(1, -(-queries.count() // query_block)))
    asked = queries.select("query_id", F.col("q").alias("v"), F.pmod(F.xxhash64("query_id"), query_blocks).cast("int").alias("qb")).select("*", F.explode(nearest("v")).alias("list_id"))
    wanted = [r.list_id for r in asked.select("list_id").distinct().collect()]  # at most the number of lists
    rows = index.where(F.col("list_id").isin(wanted)).select("id", F.col("embedding").alias("v"), "list_id")
    blocks = rows.groupBy("list_id").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    blocks = {r.list_id: r["_blocks"] for r in blocks.collect()}  # a row a list
    many = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in blocks.items() for x in pair)), F.col("list_id")), F.lit(1)) if blocks else F.lit(1)
    left = rows.withColumn("b", F.pmod(F.xxhash64("id"), many).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), (query_blocks - 1).cast("int"))))
    right = asked.withColumn("b", F.explode(F.sequence(F.lit(0), many - 1)))
    return near_blocks(left, right, ["list_id", "b", "qb"], k)


def request_lines(texts: DataFrame, model: str) -> DataFrame:
    """One embedding request (JSON) for each text and its bytes; custom_id is the text's hash."""
    h = F.sha2(F.coalesce("text", F.lit("")), 256)
    body = F.struct(F.lit(model).alias("model"), F.array("text").alias("input"))
    line = F.to_json(F.struct(h.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/embeddings").alias("url"), body.alias("body")))
    return texts.select(h.alias("custom_id"), line.alias("line")).withColumn("bytes", F.octet_length("line") + 1)


def response_vectors(lines: DataFrame) -> DataFrame:
    """custom_id and vector of a batch's answer lines (value); lines that are blank, broken or without data give no row."""
    kind = "custom_id string, response struct<body struct<data array<struct<embedding array<double>>>>>"
    got = lines.select(F.from_json("value", kind).alias("r"))
    return got.select("r.custom_id", F.get(F.col("r.response.body.data"), F.lit(0))["embedding"].alias("vector")).where("custom_id is not null and vector is not null")


def fingerprint(files: DataFrame, *columns: str) -> DataFrame:
    """One SHA-256 over all files: each file's own hash, dealt into 4096 bins whose sorted hashes are hashed, then these.

    A bin holds a 4096th of the files' hashes, so no task holds them all.
    """
    own = files.select(F.sha2(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256).alias("h"))
    bins = own.groupBy(F.substring("h", 1, 3).alias("bin")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("h"))
    return bins.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bin", "h"))), lambda x: x["h"]), "\n"), 256).alias("fingerprint"))


def run_counters(rows: DataFrame, **flags: Column) -> DataFrame:
    """One row with the number of rows that satisfy each condition."""
    return rows.agg(F.count("*").alias("rows"), *(F.count_if(c).alias(name) for name, c in flags.items()))


def split_on_failure(batch: list, send, least: float = 0.6) -> Iterator:
    """What ``send`` returns for a batch; a refused batch is halved, a refused single text cut to ``least`` of its length."""
    try:
        yield from send(batch)
    except ValueError:
        if len(batch) > 1:
            half = len(batch) // 2
            yield from split_on_failure(batch[:half], send, least)
            yield from split_on_failure(batch[half:], send, least)
        else:
            yield from send([batch[0][: max(1, int(len(batch[0]) * least))]])
