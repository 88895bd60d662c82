"""Registered queries: stored vector lists, deep pages, slices, CSV trees, streamed merges, budgets, aligned files, edges, code search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusql.functions import text as T
from corpusql.functions import vectors as V
from corpusql.jobs import keyed_store
from corpusql.operators import code, merge, pages, retrieval, store
from corpusql.registry import query
from corpusql.session import shared_path, table
from corpusql.sources import aligned, csvtree, documents, tables
from corpusql.streaming import budget, watch
from corpusql.workload_code import _LANG, _PATH, _files


def _list_hits(spark, sf_dir):
    c = tables.chunks(spark, sf_dir)
    path = shared_path(spark, "lists")
    store.write_lists(c, path, 16)
    q = c.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    return c, q, store.probe_batch(spark, path, q, 10)


@query(None)
def vector_list_topk(spark, sf_dir):
    """The ten nearest of every fiftieth vector out of stored lists, as many read as measured recall asks for."""
    return _list_hits(spark, sf_dir)[2]


@query("SELECT count(*) AS queries, count(*) * 10 AS wanted, true AS recall_reached FROM embeddings WHERE vec_id % 50 = 0")
def vector_list_recall(spark, sf_dir):
    """Hits of the stored lists against the exact ones: recall_reached is whether nine of ten are found."""
    c, q, hits = _list_hits(spark, sf_dir)
    exact = retrieval.block_topk(c, q, 10).select("query_id", "id")
    both = exact.join(hits.select("query_id", "id", F.lit(True).alias("hit")), ["query_id", "id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("wanted"), (F.count("hit") >= 0.9 * F.count("*")).alias("recall_reached"))


_DOCS = "docs AS (SELECT CAST(doc_id AS VARCHAR) AS id, substr(split_part(text, chr(10), 1), 1, 60) AS title FROM documents)"


@query(f"WITH {_DOCS} SELECT id, title FROM docs ORDER BY title, id LIMIT 25 OFFSET 150")
def deep_page(spark, sf_dir):
    """The seventh page of 25, each page begun behind the last key of the one before."""
    d, key = tables.docs(spark, sf_dir).select("id", "title"), None
    for _ in range(7):
        page, key = pages.page_after(d, ["title", "id"], 25, key)
    return page


@query("SELECT doc_id, left(s, list_max(list_filter(range(0, length(s) + 1), lambda k: octet_length(encode(left(s, k))) <= 333))) AS part FROM (SELECT doc_id, coalesce(substr(text, 51, 350), '') AS s FROM documents)")
def file_slice(spark, sf_dir):
    """Characters 50 to 400 of each text, cut to whole characters of 333 bytes."""
    return table(spark, sf_dir, "documents").select("doc_id", T.char_slice(F.coalesce("text", F.lit("")), 50, 400, 333).alias("part"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS row_key, 'id=' || p_partkey || '; name=' || p_name || '; type=' || p_type || '; size=' || p_size AS text, 'DB' AS space, 'db_row' AS type FROM part")
def csv_tree_rows(spark, sf_dir):
    """The parts written as a tree of tables, half of them with semicolons, and read again by what each file shows."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_size").alias("size"), (F.col("p_partkey") % 2).alias("half"))
    root = shared_path(spark, "csv")
    for half, sign in ((0, ","), (1, ";")):
        p.where(F.col("half") == half).drop("half").write.option("header", True).option("sep", sign).option("quoteAll", True).csv(f"{root}/half={half}")
    files = sorted(r.path for r in csvtree.tree(spark, root).select("path").collect())
    return csvtree.documents(csvtree.rows(spark, files), "lib").select("row_key", "text", "space", "type")


@query("WITH r AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id, event_type, round(value, 6) AS value FROM r WHERE r = 1")
def stream_store_merge(spark, sf_dir):
    """Events streamed into a keyed store file by file; then one batch replayed, which changes nothing."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id").alias("at"))
    folder, path, state = (shared_path(spark, n) for n in ("events", "store", "state"))
    e.repartition(4, "at").write.json(folder)
    schema = "user_id long, event_type string, value double, at struct<t:long,event_id:long>"
    watch.watch_into_store(spark, folder, schema, path, ["user_id"], state, order="at", files=1).awaitTermination()
    last = spark.read.parquet(f"{path}/deltas").where("batch = 0").drop("batch")
    keyed_store.write(last, path, ["user_id"], 0, order="at")
    return keyed_store.read(spark, path, ["user_id"], order="at").select("user_id", "event_type", F.round("value", 6).alias("value"))


@query(None)
def rate_budget(spark, sf_dir):
    """When each event would be sent if every type had a budget of 3 requests and 40 tokens a minute."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", F.length("props").alias("tokens"))
    return budget.admitted(e, "event_type", "ts", "event_id", "tokens", 3, 40).select("event_id", "event_type", "ts", "sent_at")


@query("WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS number, embedding FROM embeddings), m AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS number, doc_id FROM documents) SELECT v.number, CAST(m.doc_id AS VARCHAR) AS meta, round(CAST(v.embedding[1] AS DOUBLE), 5) AS first FROM v JOIN m USING (number)")
def aligned_lines(spark, sf_dir):
    """Vectors and ids as two sets of text files, numbered line by line and cut to the shorter."""
    v, m = shared_path(spark, "vectors"), shared_path(spark, "meta")
    table(spark, sf_dir, "embeddings").repartitionByRange(3, "vec_id").sortWithinPartitions("vec_id").select(F.to_json("embedding")).write.text(v)
    table(spark, sf_dir, "documents").repartitionByRange(2, "doc_id").sortWithinPartitions("doc_id").select(F.col("doc_id").cast("string")).write.text(m)
    both = aligned.aligned(aligned.numbered_lines(spark, v), aligned.numbered_lines(spark, m))
    return both.select("number", "meta", F.round(F.col("vector")[0].cast("double"), 5).alias("first"))


@query("SELECT (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM documents) AS meta_lines, least((SELECT count(*) FROM embeddings), (SELECT count(*) FROM documents)) AS kept, 0 AS wrong_width, (SELECT count(*) FROM embeddings) = (SELECT count(*) FROM documents) AS aligned")
def alignment_counts(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.to_json("embedding").alias("value"))
    return aligned.alignment(v, table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("value")), 64)


_STEMS = "n AS (SELECT p_partkey AS id, lower(split_part(p_name, ' ', 1)) AS stem FROM part)"


@query(
    f"WITH {_STEMS}, w AS (SELECT p_partkey AS src, unnest(list_distinct(string_split(lower(p_name), ' '))) AS stem FROM part), h AS (SELECT DISTINCT src, id AS dst FROM w JOIN n USING (stem)), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM h), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY id) AS r FROM n), c AS (SELECT * FROM k WHERE r <= 32) "
    "SELECT src, dst, 'stem-match' AS why FROM r WHERE r <= 32 AND src <> dst UNION ALL SELECT DISTINCT a.id, b.id, 'co-stem' FROM c a JOIN c b ON a.stem = b.stem AND a.id <> b.id"
)
def xref_build(spark, sf_dir):
    """Both kinds of edges in one build, written as lines of JSON and read again."""
    p = table(spark, sf_dir, "part")
    names = p.select(F.col("p_partkey").alias("id"), F.lower(F.split("p_name", " ")[0]).alias("stem"))
    nodes = p.select(F.col("p_partkey").alias("id"), F.split(F.lower("p_name"), " ").alias("words"))
    path = shared_path(spark, "edges")
    code.stem_edges(nodes, names).unionByName(code.co_stem_edges(names)).write.json(path)
    return spark.read.schema("src long, dst long, why string").json(path)


_Q = "(SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"


@query(
    f"WITH c AS (SELECT doc_id, {_PATH} AS path, text FROM documents), l AS (SELECT *, {_LANG} AS lang FROM c), "
    f"t AS (SELECT vec_id AS id, path, lang, substr(text, 1, 300) AS snippet, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_Q}), 6) AS score FROM embeddings JOIN l ON vec_id = doc_id WHERE lower(lang) IN ('python', 'sql') AND contains(path, 'src1') ORDER BY score DESC, id LIMIT 20), "
    "r AS (SELECT *, sum(octet_length(encode(concat_ws('|', id, path, lang, snippet)))) OVER (ORDER BY score DESC, id) AS run FROM t) SELECT id, path, lang, snippet, score, CAST(run AS BIGINT) AS running FROM r WHERE run <= 2000"
)
def code_search_filtered(spark, sf_dir):
    """Code by vector: languages in either case, a part of the path, and results as long as their bytes fit a budget."""
    meta = _files(spark, sf_dir).select(F.col("doc_id").alias("id"), "path", code.language_of(F.col("path")).alias("lang"), F.substring("text", 1, 300).alias("snippet"))
    wanted = meta.where(code.search_filter(["Python", "SQL"], "src1"))
    q = [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]
    near = tables.chunks(spark, sf_dir).join(wanted.select("id"), "id", "left_semi")
    hits = retrieval.vector_topk(near, q, 20, measure=V.cosine).select("id", "score")
    found = meta.join(F.broadcast(hits), "id")  # at most 20 rows
    ranked = found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    sized = ranked.withColumn("bytes", F.octet_length(F.concat_ws("|", F.col("id").cast("string"), "path", "lang", "snippet")).cast("long"))
    return retrieval.budget_cut(sized, "bytes", "rank", 2000, []).select("id", "path", "lang", "snippet", "score", "running")


@query(f"WITH c AS (SELECT doc_id, {_PATH} AS path, coalesce(text, '') AS text FROM documents), l AS (SELECT doc_id AS id, path, {_LANG} AS lang, length(text) AS n FROM c) SELECT id, path, lang FROM l WHERE lower(lang) IN ('text') AND contains(path, '/en/')")
def code_search_stream(spark, sf_dir):
    """The same filters without a budget, as lines of JSON, read again here."""
    meta = _files(spark, sf_dir).select(F.col("doc_id").alias("id"), "path", code.language_of(F.col("path")).alias("lang"))
    lines = meta.where(code.search_filter(["TEXT"], "/en/")).select(F.to_json(F.struct("id", "path", "lang")).alias("line"))
    return lines.select(F.from_json("line", "id long, path string, lang string").alias("r")).select("r.*")


@query(
    "WITH d AS (SELECT doc_id AS id, source AS space FROM documents), t AS (SELECT doc_id AS id FROM labels), a AS (SELECT l_orderkey AS id FROM lineitem), "
    "e AS (SELECT space, 1 AS docs, 0 AS texts, 0 AS attachments, 0 AS orphan_texts, 0 AS orphan_attachments, true AS known FROM d "
    "UNION ALL SELECT space, 0, 1, 0, CASE WHEN d.id IS NULL THEN 1 ELSE 0 END, 0, d.id IS NOT NULL FROM t LEFT JOIN d USING (id) "
    "UNION ALL SELECT space, 0, 0, 1, 0, CASE WHEN d.id IS NULL THEN 1 ELSE 0 END, d.id IS NOT NULL FROM a LEFT JOIN d USING (id)) "
    "SELECT *, orphan_texts = 0 AND orphan_attachments = 0 AS ok FROM (SELECT CASE WHEN grouping(space) = 1 THEN NULL ELSE space END AS space, CAST(sum(docs) AS BIGINT) AS docs, CAST(sum(texts) AS BIGINT) AS texts, CAST(sum(attachments) AS BIGINT) AS attachments, CAST(sum(orphan_texts) AS BIGINT) AS orphan_texts, CAST(sum(orphan_attachments) AS BIGINT) AS orphan_attachments, bool_and(known) AS known, grouping(space) AS g FROM e GROUP BY ROLLUP (space)) WHERE known OR g = 1"
)
def invariant_report(spark, sf_dir):
    """Documents, labels as their texts and lines of orders as their attachments, with what has no document, in all and by space."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("space"))
    rows = merge.invariants(d, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), tables.attachments(spark, sf_dir))
    return rows.withColumns({"known": F.when(F.col("space").isNull(), F.col("ok")).otherwise(True), "g": F.when(F.col("space").isNull(), 1).otherwise(0).cast("long")})


@query("SELECT l_orderkey AS item, count(*) AS n, list_sort(list(l_linenumber || ':' || l_partkey)) AS files FROM lineitem GROUP BY 1")
def attachments_by_item(spark, sf_dir):
    """Lines of orders as an index file's entries, grouped by their item."""
    li = table(spark, sf_dir, "lineitem")
    entry = F.concat_ws(":", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))
    return li.groupBy(F.col("l_orderkey").alias("item")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(entry)).alias("files"))


_WHOLE = "list_sort(list_distinct(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '{}'))))"
_KINDS = [_WHOLE.format("[A-Z0-9_]{3,}"), "list_sort(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_\\-.]+(?:/[A-Za-z0-9_\\-.]+)+')))", _WHOLE.format("[a-z]+[A-Za-z0-9]*[A-Z][A-Za-z0-9]*")]


@query(f"SELECT doc_id, list_concat(list_concat(i, p), c) AS tokens, len(i) > 0 AS has_identifier, len(p) > 0 AS has_path, len(c) > 0 AS has_camel FROM (SELECT doc_id, {_KINDS[0]} AS i, {_KINDS[1]} AS p, {_KINDS[2]} AS c FROM documents WHERE text IS NOT NULL)")
def query_analyser(spark, sf_dir):
    """Texts as queries: identifiers, paths and camelCase words."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", T.analysed(F.col("text")).alias("a")).select("doc_id", "a.*")


@query("SELECT url AS path, octet_length(encode(html)) AS length FROM pages ORDER BY length DESC, url LIMIT 50")
def largest_files(spark, sf_dir):
    return documents.largest(table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.octet_length("html").cast("long").alias("length")))


@query("SELECT conv_id, i FROM (SELECT conv_id, row_number() OVER w AS i, sum(octet_length(encode(coalesce(text, ''))) + 40) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS run FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)) WHERE run <= 2000 OR i = 1")
def first_pages(spark, sf_dir):
    """What a fetch of one page returns of each conversation: the first page, whatever follows."""
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = table(spark, sf_dir, "conversations").select("conv_id", F.row_number().over(by).cast("long").alias("i"), (F.octet_length(F.coalesce("text", F.lit(""))) + 40).cast("long").alias("bytes"))
    return pages.first_page(t, "conv_id", "i", "bytes", 2000).select("conv_id", "i")
