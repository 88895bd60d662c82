"""Registered queries: vector tables, answers, pages by bytes, upserts, counters and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusql.functions import vectors as V
from corpusql.jobs import embed
from corpusql.operators import merge, pages, retrieval, store
from corpusql.registry import query
from corpusql.session import shared_path, table
from corpusql.sources import tables
from corpusql.streaming import watch

_Q = "(SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"
_COS = f"round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_Q}), 6)"


def _query_vector(spark, sf_dir):
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]


@query("WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS score FROM embeddings, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT * FROM r WHERE rank <= 10")
def vector_block_topk(spark, sf_dir):
    c = tables.chunks(spark, sf_dir)
    return retrieval.block_topk(c, c.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q")), 10)


def _citations(spark, sf_dir, k: int):
    top = retrieval.vector_topk(tables.chunks(spark, sf_dir), _query_vector(spark, sf_dir), k)
    return top.select(F.row_number().over(retrieval.Window.orderBy(F.desc("score"), "id")).alias("rank"), "id", F.concat(F.lit("t"), F.col("space").cast("string")).alias("title"), F.concat(F.lit("/v1/fetch?ids="), F.col("id").cast("string")).alias("url"), "score")


@query(f"WITH t AS (SELECT vec_id AS id, label, {_COS} AS score FROM embeddings ORDER BY score DESC, id LIMIT 5), e AS (SELECT row_number() OVER (ORDER BY score DESC, id) AS seq, 'citation' AS type, id, score FROM t UNION ALL SELECT 0, 'preamble', NULL, NULL UNION ALL SELECT 6, 'final', NULL, NULL) SELECT seq, type, coalesce(id, -1) AS id, coalesce(score, 0) AS score FROM e")
def answer_stream(spark, sf_dir):
    events = pages.answer_events(_citations(spark, sf_dir, 5), "Answer built from retrieved evidence. See citations.")
    read = F.from_json("event", "type string, id bigint, score double")
    return events.select("seq", read.alias("e")).select("seq", "e.type", F.coalesce("e.id", F.lit(-1)).alias("id"), F.coalesce("e.score", F.lit(0.0)).alias("score"))


@query(f"WITH t AS (SELECT vec_id AS id, label, {_COS} AS score FROM embeddings WHERE label IN (1, 3) ORDER BY score DESC, id LIMIT 20), r AS (SELECT *, sum(12) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS run FROM t) SELECT id, score FROM r WHERE run <= 100")
def code_search_in_budget(spark, sf_dir):
    hits = retrieval.vector_topk(tables.chunks(spark, sf_dir), _query_vector(spark, sf_dir), 20, where=F.col("space").isin(1, 3))
    ranked = hits.withColumn("rank", F.row_number().over(retrieval.Window.orderBy(F.desc("score"), "id")).cast("long")).withColumn("bytes", F.lit(12).cast("long"))
    return retrieval.budget_cut(ranked, "bytes", "rank", 100, []).select("id", "score")


@query("WITH a AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings WHERE len(embedding) = 64), n AS (SELECT id, label, sqrt(list_dot_product(e, e)) AS n, e FROM a) SELECT id, CAST(0 AS BIGINT) AS chunk_ix, label + 1 AS space, round(CASE WHEN n > 0 THEN e[1] / n ELSE e[1] END, 6) AS first FROM n")
def vector_append(spark, sf_dir):
    c = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit(0).cast("long").alias("chunk_ix"), F.col("label").alias("space"), "embedding", F.lit("text").alias("text"))
    old = store.prepared(c, 64)
    new = store.prepared(c.withColumn("space", F.col("space") + 1), 64)
    return store.appended(old, new).select("id", "chunk_ix", "space", F.round(F.col("embedding")[0], 6).alias("first"))


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def vector_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return store.without_ids(tables.chunks(spark, sf_dir), gone).select("id")


@query(None)
def vector_projection(spark, sf_dir):
    """Every vector projected to 32 dimensions and the share of its length that is kept."""
    p = store.projected(tables.chunks(spark, sf_dir), "embedding", "reduced", 64, 32)
    return p.select("id", "reduced", F.round(V.norm(V.doubles(F.col("reduced"))) / V.norm(V.doubles(F.col("embedding"))), 4).alias("kept"))


@query("SELECT vec_id AS id, vec_id % 3 <> 0 AS was_there, CAST(32 AS BIGINT) AS width, round(1.0, 4) AS length FROM embeddings")
def vector_backfill(spark, sf_dir):
    c = tables.chunks(spark, sf_dir)
    there = F.when(F.col("id") % 3 != 0, V.normalized(F.slice(V.doubles(F.col("embedding")), 1, 32)).cast("array<float>"))
    filled = store.backfilled(c.withColumn("reduced", there).withColumn("was_there", there.isNotNull()), "embedding", "reduced", 64, 32)
    return filled.select("id", "was_there", F.size("reduced").cast("long").alias("width"), F.round(V.norm(V.doubles(F.col("reduced"))), 4).alias("length"))


@query(None)
def vector_index_probe(spark, sf_dir):
    """The 20 nearest by an inverted file of 16 lists, 6 of which are read."""
    index, centres = store.inverted_file(tables.chunks(spark, sf_dir), 16)
    return store.probe(index, centres, _query_vector(spark, sf_dir), 20, 6)


@query(None)
def embed_bodies(spark, sf_dir):
    """Every long enough document as stored chunks with vectors of the offline embedder."""
    d = tables.docs(spark, sf_dir)
    return embed.stored(None, embed.embedded(embed.body_chunks(d), 64), 64)


@query("WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents WHERE length(text) >= 200), c AS (SELECT id, unnest(range(0, CAST(ceil(length(text) / 2800) AS BIGINT))) AS i, text FROM d) SELECT id, CAST(i AS BIGINT) AS chunk_ix, '/v1/fetch?ids=' || id AS url, sha256(substr(text, i * 2800 + 1, 3200)) AS content_hash FROM c")
def body_chunk_hashes(spark, sf_dir):
    return embed.body_chunks(tables.docs(spark, sf_dir)).select("id", "chunk_ix", "url", F.sha2("text", 256).alias("content_hash"))


_ATT = "a AS (SELECT item_id, 'ATT:' || item_id || ':b/' || item_id || '.txt' AS id, trim(regexp_replace(replace(text, chr(0), ''), '[\\x01-\\x08\\x0B-\\x1F]', ' ', 'g'), ' ') AS text FROM benchmark)"


@query(f"WITH {_ATT}, c AS (SELECT *, unnest(range(0, CAST(ceil(length(text) / 2800) AS BIGINT))) AS i FROM a WHERE length(text) >= 50) SELECT id, CAST(i AS BIGINT) AS chunk_ix, '/attachments/b/' || item_id || '.txt' AS url, substr(text, i * 2800 + 1, 3200) AS text FROM c")
def attachment_chunks(spark, sf_dir):
    i = F.col("item_id").cast("string")
    b = table(spark, sf_dir, "benchmark").select(i.alias("content_id"), F.concat(F.lit("b/"), i, F.lit(".txt")).alias("relpath"), F.lit("BENCH").alias("space"), "text")
    return embed.attachment_chunks(b).select("id", "chunk_ix", "url", "text")


_TURNS = "t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, octet_length(encode(coalesce(text, ''))) + 40 AS bytes FROM conversations)"
_FILLED = f"WITH RECURSIVE {_TURNS}, p AS (SELECT conv_id, i, bytes, CAST(0 AS BIGINT) AS page, CAST(bytes AS BIGINT) AS fill FROM t WHERE i = 1 UNION ALL SELECT t.conv_id, t.i, t.bytes, CASE WHEN p.fill > 0 AND p.fill + t.bytes > 2000 THEN p.page + 1 ELSE p.page END, CAST(CASE WHEN p.fill > 0 AND p.fill + t.bytes > 2000 THEN t.bytes ELSE p.fill + t.bytes END AS BIGINT) FROM p JOIN t ON t.conv_id = p.conv_id AND t.i = p.i + 1)"


def _paged(spark, sf_dir):
    order = retrieval.Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = table(spark, sf_dir, "conversations").select("conv_id", F.row_number().over(order).cast("long").alias("i"), (F.octet_length(F.coalesce("text", F.lit(""))) + 40).cast("long").alias("bytes"))
    return pages.byte_pages(t, "conv_id", "i", "bytes", 2000)


@query(f"{_FILLED} SELECT conv_id, CAST(i AS BIGINT) AS i, page FROM p")
def byte_budget_pages(spark, sf_dir):
    return _paged(spark, sf_dir).select("conv_id", "i", "page")


@query(f"{_FILLED}, g AS (SELECT conv_id, page, count(*) AS items, CAST(sum(bytes) AS BIGINT) AS approx_bytes FROM p GROUP BY ALL) SELECT conv_id, page, items, approx_bytes, coalesce(lead(page) OVER (PARTITION BY conv_id ORDER BY page), -1) AS next FROM g")
def byte_page_totals(spark, sf_dir):
    return pages.page_totals(_paged(spark, sf_dir), "conv_id", "bytes").select("conv_id", "page", "items", F.col("approx_bytes").cast("long").alias("approx_bytes"), F.coalesce("next", F.lit(-1)).alias("next"))


@query("WITH r AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id, event_type, value FROM r WHERE r = 1")
def upsert_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.struct("ts", "event_id").alias("at"))
    return store.latest(e, ["user_id"], "at").select("user_id", "event_type", "value")


@query("WITH n AS (SELECT l_orderkey, l_linenumber, max(l_quantity + 1) AS size FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) SELECT l.l_orderkey AS content_id, l.l_linenumber AS relpath, coalesce(n.size, l.l_quantity) AS size, l.l_linestatus AS sha256, l.l_returnflag AS name FROM lineitem l LEFT JOIN n ON n.l_orderkey = l.l_orderkey AND n.l_linenumber = l.l_linenumber")
def upsert_attachments(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    keys = [F.col("l_orderkey").alias("content_id"), F.col("l_linenumber").alias("relpath")]
    old = li.select(*keys, F.col("l_quantity").alias("size"), F.col("l_linestatus").alias("sha256"), F.col("l_returnflag").alias("name"))
    new = li.where("l_returnflag = 'R'").select(*keys, (F.col("l_quantity") + 1).alias("size"), F.lit(None).cast("string").alias("sha256"), F.lit("new").alias("name"))
    return merge.upsert(old, new, ["content_id", "relpath"], ["size"], ["sha256"], ["name"])


@query("SELECT sha256(coalesce(text, '')) AS custom_id, count(*) AS n FROM documents GROUP BY 1")
def embedding_requests(spark, sf_dir):
    lines = store.request_lines(table(spark, sf_dir, "documents").select("text"), "m")
    read = lines.select(F.get_json_object("line", "$.custom_id").alias("custom_id"), F.get_json_object("line", "$.body.model").alias("model"))
    return read.where("model = 'm'").groupBy("custom_id").agg(F.count("*").alias("n"))


@query("SELECT CAST(vec_id AS VARCHAR) AS custom_id, round(CAST(embedding[1] AS DOUBLE), 5) AS first, CAST(len(embedding) AS BIGINT) AS width FROM embeddings")
def embedding_responses(spark, sf_dir):
    made = F.to_json(F.struct(F.col("vec_id").cast("string").alias("custom_id"), F.struct(F.struct(F.array(F.struct("embedding")).alias("data")).alias("body")).alias("response")))
    e = table(spark, sf_dir, "embeddings").select(F.explode(F.array(made, F.lit(""), F.lit("{broken"))).alias("value"))
    return store.response_vectors(e).select("custom_id", F.round(F.col("vector")[0], 5).alias("first"), F.size("vector").cast("long").alias("width"))


@query(
    "WITH h AS (SELECT sha256(concat_ws(':', page_id, coalesce(url, ''))) AS h FROM pages), b AS (SELECT substr(h, 1, 3) AS bin, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM h GROUP BY 1) "
    "SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS files, sha256(string_agg(h, chr(10) ORDER BY bin)) AS fingerprint FROM b"
)
def corpus_fingerprint(spark, sf_dir):
    return store.fingerprint(table(spark, sf_dir, "pages"), "page_id", "url")


@query("SELECT count(*) AS rows, count(*) FILTER (text IS NULL OR text = '') AS empty, count(*) FILTER (length(text) >= 200) AS chunked FROM documents")
def run_counters(spark, sf_dir):
    t = F.col("text")
    return store.run_counters(table(spark, sf_dir, "documents"), empty=t.isNull() | (t == ""), chunked=F.length(t) >= 200)


@query("SELECT time_bucket(INTERVAL 60 SECONDS, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_event_rates(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    lone = any(f.endswith("/events.parquet") for f in rows.inputFiles())  # a stream reads folders
    folder, pattern = (sf_dir, "events.parquet") if lone else (f"{sf_dir}/events.parquet", "*.parquet")
    out = watch.rates_until_now(spark, folder, pattern, rows.schema, shared_path(spark, "rates-state"), shared_path(spark, "rates"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("SELECT d.doc_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1 AND d.n_chars = length(d.text)")
def unchanged_of_whole_tables(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n_chars"))
    cache = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id")
    return merge.unchanged(d, cache, ["doc_id", "n_chars"]).select("doc_id")
