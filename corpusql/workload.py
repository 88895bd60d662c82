"""Registered queries of the library itself and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusql.functions import text as T
from corpusql.functions import vectors as V
from corpusql.operators import indexed, lexical, merge, retrieval
from corpusql.registry import REGISTRY, query
from corpusql.session import table
from corpusql.sources import tables


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}


_DOCS = "docs AS (SELECT CAST(doc_id AS VARCHAR) AS id, source AS space, lang AS type, substr(split_part(text, chr(10), 1), 1, 60) AS title, text FROM documents)"
_WORDS = "words AS (SELECT id, space, type, title, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS w FROM docs)"


def _bm25_sql(terms: list[str], match: str, rest: str, without: str | None = None) -> str:
    names = [*terms, without] if without else terms
    tf = ", ".join(f"len(list_filter(w, lambda t: t = '{t}')) AS tf_{i}" for i, t in enumerate(names))
    df = ", ".join(f"sum(CASE WHEN tf_{i} > 0 THEN 1 ELSE 0 END) AS df_{i}" for i in range(len(terms)))
    score = " + ".join(f"greatest(ln((n - df_{i} + 0.5) / (df_{i} + 0.5)), 1e-6) * tf_{i} * 2.2 / (tf_{i} + 1.2 * (0.25 + 0.75 * length / mean))" for i in range(len(terms)))
    return f"WITH {_DOCS}, {_WORDS}, c AS (SELECT id, space, type, title, len(w) AS length, {tf} FROM words), s AS (SELECT count(*) AS n, avg(length) AS mean, {df} FROM c), hits AS (SELECT id, space, type, title, round({score}, 6) AS score FROM c, s WHERE {match}) {rest}"


_TERMS = ["the", "thing", "idiot"]
_ANY = " OR ".join(f"tf_{i} > 0" for i in range(3))


@query(_bm25_sql(_TERMS, _ANY, "SELECT id, title, score FROM hits ORDER BY score DESC, id LIMIT 10"))
def search_bm25_top10(spark, sf_dir):
    index = tables.docs_index(spark, sf_dir)
    return indexed.with_headers(index, lexical.top(indexed.bm25(index, _TERMS), 10)).select("id", "title", "score")


@query(_bm25_sql(_TERMS, _ANY, "SELECT id, space, type, score FROM hits"))
def search_bm25_all(spark, sf_dir):
    index = tables.docs_index(spark, sf_dir)
    return indexed.with_headers(index, indexed.bm25(index, _TERMS)).select("id", "space", "type", "score")


@query(_bm25_sql(["the", "of"], "tf_0 > 0 AND tf_1 > 0", "SELECT id, score FROM hits WHERE space = 'src3'"))
def search_two_terms_and(spark, sf_dir):
    index = tables.docs_index(spark, sf_dir)
    return indexed.with_headers(index, indexed.bm25(index, ["the", "of"], require_all=True)).where("space = 'src3'").select("id", "score")


@query(_bm25_sql(["und", "que"], "(tf_0 > 0 OR tf_1 > 0) AND tf_2 = 0", "SELECT id, score FROM hits", "der"))
def search_or_not(spark, sf_dir):
    return indexed.bm25(tables.docs_index(spark, sf_dir), ["und", "que"], without="der")


@query(f"WITH {_DOCS}, {_WORDS}, p AS (SELECT id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS tf FROM words) SELECT id, tf FROM p WHERE tf > 0")
def search_phrase(spark, sf_dir):
    return indexed.phrase(tables.docs_index(spark, sf_dir), ["of", "the"])


@query(f"WITH {_DOCS}, {_WORDS}, x AS (SELECT id, unnest(w) AS term FROM words) SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM x GROUP BY term")
def postings_stats(spark, sf_dir):
    p = lexical.postings(tables.docs(spark, sf_dir))
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"WITH {_DOCS} SELECT id, title FROM docs ORDER BY lower(title), id LIMIT 50 OFFSET 50")
def list_page2(spark, sf_dir):
    return tables.docs(spark, sf_dir).select("id", "title").orderBy(F.lower("title"), "id").offset(50).limit(50)


@query(f"WITH {_DOCS} SELECT id, title, coalesce(text, '') AS text FROM docs WHERE id IN ('1', '5', '77', 'none')")
def fetch_by_ids(spark, sf_dir):
    return tables.docs(spark, sf_dir).where(F.col("id").isin("1", "5", "77", "none")).select("id", "title", F.coalesce("text", F.lit("")).alias("text"))


@query("SELECT (SELECT count(*) FROM documents) AS docs, (SELECT count(*) FROM lineitem) AS attachments")
def stats_counts(spark, sf_dir):
    n = tables.docs(spark, sf_dir).agg(F.count("*").alias("docs"))
    return n.join(F.broadcast(tables.attachments(spark, sf_dir).agg(F.count("*").alias("attachments"))))


@query("SELECT source AS space, count(*) AS count FROM documents GROUP BY 1")
def spaces_count(spark, sf_dir):
    return tables.docs(spark, sf_dir).groupBy("space").count()


@query("SELECT string_agg(source, ',' ORDER BY source) AS spaces FROM (SELECT DISTINCT source FROM documents WHERE source <> 'src0')")
def distinct_spaces_csv(spark, sf_dir):
    d = tables.docs(spark, sf_dir).where("space <> 'src0'").select("space").distinct()
    return d.agg(F.array_join(F.sort_array(F.collect_set("space")), ",").alias("spaces"))


@query("SELECT l_orderkey AS content_id, count(*) AS n, sum(l_quantity) AS size FROM lineitem GROUP BY 1")
def attachments_by_content(spark, sf_dir):
    return tables.attachments(spark, sf_dir).groupBy("content_id").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


@query("SELECT d.doc_id, coalesce(n, 0) AS attachments_count FROM documents d LEFT JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) a ON a.k = d.doc_id")
def attachment_counts_left(spark, sf_dir):
    n = tables.attachments(spark, sf_dir).groupBy(F.col("content_id").alias("doc_id")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "documents").select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("attachments_count"))


@query("SELECT o_orderstatus AS space, count(*) AS n, sum(l_quantity) AS size FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def attachments_by_space(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O")).select(F.col("o_orderkey").alias("content_id"), F.col("o_orderstatus").alias("space"))
    return tables.attachments(spark, sf_dir).join(o, "content_id").groupBy("space").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS body FROM pages")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("body"))


@query("SELECT doc_id, substr(trim(regexp_replace(replace(text, chr(0), ''), '[\\x01-\\x08\\x0B-\\x1F]', ' ', 'g'), ' '), 1, 12000) AS clean FROM documents")
def sanitize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.sanitize(F.col("text")).alias("clean"))


@query(f"WITH {_DOCS} SELECT id, substr(concat_ws(chr(10) || chr(10), nullif(trim(title, ' '), ''), nullif(trim(text, ' '), '')), 1, 12000) AS body FROM docs")
def combine_title_body(spark, sf_dir):
    return tables.docs(spark, sf_dir).select("id", T.combine(F.col("title"), F.col("text")).alias("body"))


@query("SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || chr(10) || chr(10) || '... [truncated]' || chr(10) ELSE text END AS body FROM documents")
def truncate_marker(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate_marked(F.col("text"), 2000).alias("body"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens, sha256(coalesce(text, '')) AS content_hash, substr(text, 1, 300) AS snippet FROM documents")
def hash_tokens_snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.approx_tokens(F.col("text")).alias("tokens"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), F.substring("text", 1, 300).alias("snippet"))


@query("SELECT p_partkey, concat_ws('; ', 'p_partkey=' || p_partkey, 'p_name=' || coalesce(p_name, ''), 'p_brand=' || coalesce(p_brand, ''), 'p_size=' || p_size) AS body, 'DB:part:' || p_partkey AS id FROM part")
def row_to_text(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", T.row_text(["p_partkey", "p_name", "p_brand", "p_size"]).alias("body"), F.concat(F.lit("DB:part:"), F.col("p_partkey").cast("string")).alias("id"))


@query("SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '[A-Z0-9_]{3,}'))) AS idents, len(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_.]+/[A-Za-z0-9_./]+'))) > 0 AS has_path FROM documents")
def query_analyzer_flags(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    found = lambda p: F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(0)))
    return d.select("doc_id", F.array_sort(found("[A-Z0-9_]{3,}")).alias("idents"), (F.size(found("[A-Za-z0-9_.]+/[A-Za-z0-9_./]+")) > 0).alias("has_path"))


@query("WITH d AS (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil(length(text) / 2800) AS BIGINT)))) AS i FROM documents) SELECT doc_id, CAST(i AS BIGINT) AS chunk_ix, substr(text, i * 2800 + 1, 3200) AS chunk FROM d")
def chunk_prose(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.char_windows(F.col("text"))).alias("c"))
    return d.select("doc_id", F.col("c.chunk_ix").cast("long").alias("chunk_ix"), "c.chunk")


@query("SELECT source AS space, count(*) AS docs, CAST(sum(ceil(length(text) / 2800)) AS BIGINT) AS chunks FROM documents WHERE length(text) >= 200 GROUP BY 1")
def chunk_counts_dry_run(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.length("text") >= 200)
    return d.groupBy(F.col("source").alias("space")).agg(F.count("*").alias("docs"), F.sum(F.ceil(F.length("text") / 2800)).cast("long").alias("chunks"))


@query("WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), w AS (SELECT doc_id, lines, unnest(range(0, len(lines), 14)) AS a FROM l) SELECT doc_id, CAST(a + 1 AS BIGINT) AS line_start, CAST(least(a + 18, len(lines)) AS BIGINT) AS line_end, array_to_string(lines[a + 1:a + 18], chr(10)) AS body FROM w")
def chunk_line_windows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    w = d.select("doc_id", "lines", F.explode(F.expr("sequence(0, size(lines) - 1, 14)")).alias("a"))
    return w.select("doc_id", (F.col("a") + 1).cast("long").alias("line_start"), F.least(F.col("a") + 18, F.size("lines")).cast("long").alias("line_end"), F.array_join(F.expr("slice(lines, a + 1, 18)"), "\n").alias("body"))


_Q = "(SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"
_COS = f"round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_Q}), 6)"


def _query_vector(spark, sf_dir):
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]


@query(f"SELECT vec_id AS id, {_COS} AS score FROM embeddings ORDER BY score DESC, id LIMIT 20")
def vector_cosine_topk(spark, sf_dir):
    return retrieval.vector_topk(tables.chunks(spark, sf_dir), _query_vector(spark, sf_dir), 20).select("id", "score")


@query(f"SELECT vec_id AS id, {_COS} AS score FROM embeddings WHERE label IN (1, 2) ORDER BY score DESC, id LIMIT 10")
def vector_cosine_filtered_strict(spark, sf_dir):
    return retrieval.vector_topk(tables.chunks(spark, sf_dir), _query_vector(spark, sf_dir), 10, where=F.col("space").isin(1, 2)).select("id", "score")


@query(f"WITH t AS (SELECT vec_id AS id, label, {_COS} AS score FROM embeddings ORDER BY score DESC, id LIMIT 50) SELECT id, score FROM t WHERE label IN (1, 2) ORDER BY score DESC, id LIMIT 10")
def vector_cosine_filtered_compat(spark, sf_dir):
    return retrieval.vector_topk(tables.chunks(spark, sf_dir), _query_vector(spark, sf_dir), 10, where=F.col("space").isin(1, 2), pool=50).select("id", "score")


@query(f"SELECT vec_id AS id, round(1 / (1 + list_distance(CAST(embedding AS DOUBLE[]), {_Q})), 6) AS score FROM embeddings")
def vector_l2_similarity(spark, sf_dir):
    q = F.array(*map(F.lit, _query_vector(spark, sf_dir)))
    return tables.chunks(spark, sf_dir).select("id", F.round(V.l2_similarity(V.doubles(F.col("embedding")), q), 6).alias("score"))


@query("WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS score FROM embeddings, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, score, rank FROM r WHERE rank <= 10")
def vector_batch_topk(spark, sf_dir):
    c = tables.chunks(spark, sf_dir)
    q = c.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    return retrieval.block_topk(c, q, 10)


@query("WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM v), m AS (SELECT id, v[1:16] AS c FROM v), k AS (SELECT id, c, sqrt(list_dot_product(c, c)) AS cn FROM m) SELECT n.id, round(CASE WHEN n.n > 0 THEN v[1] / n.n ELSE v[1] END, 6) AS unit_first, round(CASE WHEN cn > 0 THEN c[1] / cn ELSE c[1] END, 6) AS cut_first FROM n JOIN k ON n.id = k.id")
def vector_normalize_dim(spark, sf_dir):
    v = V.doubles(F.col("embedding"))
    return tables.chunks(spark, sf_dir).select("id", F.round(V.normalized(v)[0], 6).alias("unit_first"), F.round(V.with_dim(v, 16)[0], 6).alias("cut_first"))


@query(
    _bm25_sql(_TERMS, _ANY, "")
    + ", lx AS (SELECT CAST(id AS BIGINT) AS id, score FROM hits ORDER BY score DESC, hits.id LIMIT 20), "
    + f"vc AS (SELECT vec_id AS id, round(1 / (1 + list_distance(CAST(embedding AS DOUBLE[]), {_Q})), 6) AS score FROM embeddings ORDER BY score DESC, id LIMIT 20), "
    + "u AS (SELECT coalesce(lx.id, vc.id) AS id, coalesce(lx.score, 0) AS a, coalesce(vc.score, 0) AS b FROM lx FULL JOIN vc ON lx.id = vc.id), "
    + "m AS (SELECT id, a, b, min(a) OVER () AS a0, max(a) OVER () AS a1, min(b) OVER () AS b0, max(b) OVER () AS b1 FROM u) "
    + "SELECT id, round(0.5 * CASE WHEN a1 > a0 THEN (a - a0) / (a1 - a0) ELSE 0 END + 0.5 * CASE WHEN b1 > b0 THEN (b - b0) / (b1 - b0) ELSE 0 END, 6) AS score FROM m ORDER BY score DESC, id LIMIT 20"
)
def hybrid_fusion(spark, sf_dir):
    lex = lexical.top(indexed.bm25(tables.docs_index(spark, sf_dir), _TERMS), 20).select(F.col("id").cast("long").alias("id"), "score")
    vec = retrieval.vector_topk(tables.chunks(spark, sf_dir), _query_vector(spark, sf_dir), 20, measure=V.l2_similarity).select("id", "score")
    return retrieval.fuse(lex, vec, 20)


@query("WITH r AS (SELECT source, doc_id, length(text) AS n, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run FROM documents) SELECT source, doc_id, CAST(run AS BIGINT) AS running FROM r WHERE run <= 20000")
def byte_budget_cut(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.length("text").alias("n"))
    return retrieval.budget_cut(d, "n", "doc_id", 20_000, ["source"]).select("source", "doc_id", F.col("running").cast("long").alias("running"))


@query("SELECT doc_id, length(text) AS n FROM documents WHERE text ILIKE '%token%' OR regexp_matches(text, '[0-9]{3}-[0-9]{4}')")
def grep_lines(spark, sf_dir):
    hit = F.col("text").ilike("%token%") | F.col("text").rlike("[0-9]{3}-[0-9]{4}")
    return table(spark, sf_dir, "documents").where(hit).select("doc_id", F.length("text").cast("long").alias("n"))


@query("SELECT l_orderkey AS src, l_partkey AS dst, l_returnflag AS kind FROM lineitem WHERE l_orderkey = 7 ORDER BY dst, kind LIMIT 20")
def graph_neighbors(spark, sf_dir):
    return retrieval.neighbors(tables.edges(spark, sf_dir), 7, 20).select("src", "dst", "kind")


@query("WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem), r AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM e) SELECT src, dst FROM r WHERE r <= 32")
def xref_fan_out(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return retrieval.fan_out_cap(li)


@query("WITH s AS (SELECT p_partkey, lower(split_part(p_name, ' ', 1)) AS stem FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY p_partkey) AS r FROM s), c AS (SELECT * FROM r WHERE r <= 32) SELECT a.p_partkey AS src, b.p_partkey AS dst, a.stem FROM c a JOIN c b ON a.stem = b.stem AND a.p_partkey <> b.p_partkey")
def xref_co_stem(spark, sf_dir):
    s = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.split("p_name", " ")[0]).alias("stem"))
    c = s.withColumn("r", F.row_number().over(Window.partitionBy("stem").orderBy("p_partkey"))).where("r <= 32")
    a, b = c.select("stem", F.col("p_partkey").alias("src")), c.select("stem", F.col("p_partkey").alias("dst"))
    return a.join(b, "stem").where("src <> dst").select("src", "dst", "stem")


@query("WITH o AS (SELECT doc_id, 'label' AS source, 'xx' AS lang, CAST(quality AS BIGINT) AS n_chars FROM labels), n AS (SELECT doc_id, source, nullif(lang, 'en') AS lang, CAST(n_chars AS BIGINT) AS n_chars FROM documents) SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NOT NULL THEN n.source ELSE o.source END AS source, coalesce(n.lang, o.lang) AS lang, CASE WHEN o.doc_id IS NOT NULL THEN o.n_chars ELSE n.n_chars END AS n_chars FROM o FULL JOIN n ON o.doc_id = n.doc_id")
def upsert_merge_docs(spark, sf_dir):
    """All documents merged into rows that are there for the labelled ones."""
    old = table(spark, sf_dir, "labels").select("doc_id", F.lit("label").alias("source"), F.lit("xx").alias("lang"), F.col("quality").cast("long").alias("n_chars"))
    new = table(spark, sf_dir, "documents").select("doc_id", "source", F.nullif("lang", F.lit("en")).alias("lang"), F.col("n_chars").cast("long").alias("n_chars"))
    return merge.upsert(old, new, ["doc_id"], ["source"], ["lang"], ["n_chars"])


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_vectors_anti(spark, sf_dir):
    return merge.missing(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT 'docs' AS what, count(*) AS n FROM documents UNION ALL SELECT 'labelled', count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'unlabelled', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'orphan_labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def coverage_matrix(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    parts = {"docs": d, "labelled": d.join(lab.distinct(), "doc_id", "left_semi"), "unlabelled": merge.missing(d, lab, ["doc_id"]), "orphan_labels": merge.missing(lab, d, ["doc_id"])}
    rows = [p.agg(F.count("*").alias("n")).select(F.lit(k).alias("what"), "n") for k, p in parts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("SELECT count(*) AS vectors, count(embedding) AS with_vector, count(*) FILTER (len(embedding) = 64) AS right_dim FROM embeddings")
def vector_alignment(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").agg(F.count("*").alias("vectors"), F.count("embedding").alias("with_vector"), F.count_if(F.size("embedding") == 64).alias("right_dim"))


@query("WITH c AS (SELECT d.doc_id, d.n_chars + l.toxic AS n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id) SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM c WHERE d.doc_id = c.doc_id AND d.n_chars = c.n_chars)")
def incremental_unchanged(spark, sf_dir):
    """Documents against a cache of the labelled ones, in which the toxic ones have another size."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    cache = d.join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id").select("doc_id", (F.col("n_chars") + F.col("toxic")).alias("n_chars"))
    return merge.unchanged(d, cache, ["doc_id", "n_chars"]).select("doc_id")


@query("SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT (SELECT CAST(count(*) * 5 // 100 AS BIGINT) FROM events)")
def cache_evict_oldest(spark, sf_dir):
    return merge.oldest_part(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id")


@query("WITH c AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE text IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels)) SELECT doc_id, coalesce(sha256(text) IN (SELECT h FROM c), false) AS hit FROM documents")
def cache_hits_misses(spark, sf_dir):
    """Texts against a cache of the hashes of the labelled ones."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    cache = d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("h").distinct().withColumn("hit", F.lit(True))
    return d.join(cache, "h", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("hit"))


@query("SELECT time_bucket(INTERVAL 60 SECONDS, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def rate_window_60s(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.window("ts", "60 seconds").alias("w"), "event_type")
    return e.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("SELECT event_id, coalesce(nullif(json_extract_string(props, '$.id'), ''), nullif(json_extract_string(props, '$.k'), ''), 'none') AS key FROM events")
def workitem_field_coalesce(spark, sf_dir):
    field = lambda k: F.nullif(F.get_json_object("props", f"$.{k}"), F.lit(""))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(field("id"), field("k"), F.lit("none")).alias("key"))


@query("SELECT conv_id, count(*) AS turns, string_agg(role, ',' ORDER BY turn, role) AS roles, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1")
def answer_event_stream(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id")
    roles = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",")
    return c.agg(F.count("*").alias("turns"), roles.alias("roles"), F.sum(F.length("text")).cast("long").alias("chars"))


from corpusql import workload_code, workload_index, workload_jobs, workload_search, workload_store  # noqa: E402, F401  (they register their queries)
