"""Registered queries: documents as source files, their blocks, windows, chunks and edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusql.functions import text as T
from corpusql.operators import code
from corpusql.registry import query
from corpusql.session import table

# The given tables hold no source code: a line that begins with a capitalised word of two letters stands for a symbol.
_SYMBOL = r"^\s*([A-Z][a-z] )"
_EXT = "list_extract(['.py', '.sql', '.txt', '.exe', ''], CAST(doc_id % 5 AS INTEGER) + 1)"
_PATH = f"CASE WHEN doc_id % 7 = 0 THEN 'build/' ELSE '' END || source || '/' || lang || '/f' || doc_id || {_EXT}"


def _files(spark, sf_dir):
    """path and text: every document as a file."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    ext = F.element_at(F.array(*map(F.lit, [".py", ".sql", ".txt", ".exe", ""])), (i % 5).cast("int") + 1)
    path = F.concat(F.when(i % 7 == 0, "build/").otherwise(""), "source", F.lit("/"), "lang", F.lit("/f"), i.cast("string"), ext)
    return d.select("doc_id", path.alias("path"), F.coalesce("text", F.lit("")).alias("text"), F.length("text").alias("length"))


_LINES = f"f AS (SELECT doc_id, {_PATH} AS path, coalesce(text, '') AS text FROM documents), s AS (SELECT *, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS l0 FROM f), l AS (SELECT doc_id, path, CASE WHEN len(l0) > 0 AND l0[-1] = '' THEN l0[:-2] ELSE l0 END AS lines FROM s)"
_BLOCKS = (
    f"{_LINES}, m AS (SELECT *, list_filter(range(0, len(lines)), lambda i: regexp_matches(lines[i + 1], '^\\s*([A-Z][a-z] )')) AS st FROM l), "
    "b AS (SELECT doc_id, path, lines, unnest(CASE WHEN len(st) > 0 THEN list_transform(range(0, len(st)), lambda k: {'label': substr(trim(lines[st[k + 1] + 1], ' '), 1, 200), 'a': st[k + 1], 'b': coalesce(st[k + 2], len(lines))}) "
    "ELSE list_transform(range(0, CASE WHEN len(lines) = 0 THEN 0 ELSE greatest(1, CAST(ceil((len(lines) - 4) / 14) AS BIGINT)) END), lambda k: {'label': 'slice:' || (14 * k + 1) || '-' || least(14 * k + 18, len(lines)), 'a': 14 * k, 'b': least(14 * k + 18, len(lines))}) END) AS x FROM m), "
    "c AS (SELECT doc_id, path, lines, x.label AS label, x.a AS a, x.b AS b FROM b)"
)


@query(f"WITH {_BLOCKS} SELECT doc_id, label, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM c")
def code_symbol_blocks(spark, sf_dir):
    found = code.blocks(_files(spark, sf_dir).select("doc_id", "text"), _SYMBOL, 18, 4)
    return found.select("doc_id", "label", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))


_LANG = "CASE regexp_extract(path, '[^/](\\.[^./]+)$', 1) WHEN '.py' THEN 'python' WHEN '.sql' THEN 'sql' ELSE 'text' END"
_SIGN = f"CASE {_LANG} WHEN 'python' THEN '#' WHEN 'sql' THEN '--' ELSE '//' END"


@query(
    f"WITH {_BLOCKS}, w AS (SELECT path, {_LANG} AS lang, a + 1 AS line_start, b AS line_end, {_SIGN} || ' path: ' || path || chr(10) || {_SIGN} || ' lang: ' || {_LANG} || chr(10) || {_SIGN} || ' symbol: ' || label || chr(10) || {_SIGN} || ' lines: ' || (a + 1) || '-' || b || chr(10) || array_to_string(lines[a + 1:b], chr(10)) AS whole FROM c), "
    "n AS (SELECT *, unnest(range(0, greatest(1, CAST(ceil((length(whole) - 480) / 2720) AS BIGINT)))) AS k FROM w) "
    "SELECT 'CODE:lib:0123456789ab:' || path || ':' || line_start || '-' || line_end AS id, CAST(k AS BIGINT) AS slice_ix, lang, substr(whole, k * 2720 + 1, 3200) AS text, 'http://c/' || path || '#L' || line_start AS url FROM n WHERE trim(substr(whole, k * 2720 + 1, 3200), ' ') <> ''"
)
def code_chunks(spark, sf_dir):
    found = code.chunks(_files(spark, sf_dir), "lib", "0123456789abcdef", url="http://c/{path}#L{line_start}", symbol=_SYMBOL, width=18, overlap=4)
    return found.select("id", F.col("slice_ix").cast("long").alias("slice_ix"), "lang", "text", "url")


@query(f"WITH {_LINES}, w AS (SELECT doc_id, len(lines) AS n, unnest(range(0, CASE WHEN len(lines) = 0 THEN 0 ELSE greatest(1, CAST(ceil((len(lines) - 3) / 7) AS BIGINT)) END)) AS k FROM l) SELECT doc_id, CAST(7 * k AS BIGINT) AS a, CAST(least(7 * k + 10, n) AS BIGINT) AS b FROM w")
def line_windows_to_end(spark, sf_dir):
    b = code.blocks(_files(spark, sf_dir).select("doc_id", "text"), "^\\x00$", 10, 3)
    return b.select("doc_id", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))


@query("WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE text <> ''), w AS (SELECT *, unnest(range(0, greatest(1, CAST(ceil((length(text) - 400) / 3600) AS BIGINT)))) AS k FROM d) SELECT doc_id, CAST(k AS BIGINT) AS slice_ix, substr(text, k * 3600 + 1, 4000) AS slice FROM w")
def token_slices(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", "text")
    w = d.select("*", F.posexplode(T.windows_to_end(F.length("text"), 4000, 400)).alias("slice_ix", "w"))
    return w.select("doc_id", F.col("slice_ix").cast("long").alias("slice_ix"), F.substring(F.col("text"), F.col("w.a").cast("int") + 1, F.lit(4000)).alias("slice"))


@query(f"SELECT path, CAST(length AS BIGINT) AS length FROM (SELECT doc_id, {_PATH} AS path, length(text) AS length FROM documents) WHERE NOT list_contains(string_split(path, '/'), 'build') AND regexp_extract(path, '[^/](\\.[^./]+)$', 1) IN ('.py', '.sql', '.txt', '') AND length <= 3000000 AND regexp_matches(path, '^src1') AND NOT regexp_matches(path, '/fr/') AND len(string_split(path, '/')) <= 3")
def code_file_rules(spark, sf_dir):
    kept = code.wanted_files(_files(spark, sf_dir).select("path", "length"), "^src1", "/fr/", 3)
    return kept.select("path", F.col("length").cast("long").alias("length"))


_STEMS = "n AS (SELECT p_partkey AS id, lower(split_part(p_name, ' ', 1)) AS stem FROM part)"


@query(f"WITH {_STEMS} SELECT stem, list_sort(list(id)) AS ids FROM n GROUP BY 1")
def code_outline(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lower(F.split("p_name", " ")[0]).alias("stem"))
    return code.outline(p)


@query(f"WITH {_STEMS}, w AS (SELECT p_partkey AS src, unnest(list_distinct(string_split(lower(p_name), ' '))) AS stem FROM part), h AS (SELECT DISTINCT src, id AS dst FROM w JOIN n USING (stem)), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM h) SELECT src, dst, 'stem-match' AS why FROM r WHERE r <= 32 AND src <> dst")
def xref_stem_match(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    nodes = p.select(F.col("p_partkey").alias("id"), F.split(F.lower("p_name"), " ").alias("words"))
    return code.stem_edges(nodes, p.select(F.col("p_partkey").alias("id"), F.lower(F.split("p_name", " ")[0]).alias("stem")))


@query("WITH e AS (SELECT l_suppkey AS src, l_partkey AS dst, 'line' AS why FROM lineitem UNION SELECT s_suppkey, p_partkey, 'size' FROM supplier JOIN part ON p_size = s_nationkey) SELECT why, count(*) AS n, count(DISTINCT src) AS sources FROM e GROUP BY 1")
def edge_union(spark, sf_dir):
    """Both kinds of edges counted; those by size from the numbers on either side of each key, so no pair is formed."""
    a = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    line = a.agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources")).select(F.lit("line").alias("why"), "n", "sources")
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.countDistinct("s_suppkey").alias("s"))
    p = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("k")).agg(F.countDistinct("p_partkey").alias("p"))
    size = s.join(p, "k").agg(F.sum(F.col("s") * F.col("p")).alias("n"), F.sum("s").alias("sources")).where("n is not null")
    return line.unionByName(size.select(F.lit("size").alias("why"), "n", "sources")).where("n > 0")


@query("SELECT regexp_extract(lower(url), '(\\.[^./]+)$', 1) AS ext, count(*) AS files, CAST(sum(octet_length(encode(html))) AS BIGINT) AS bytes FROM pages GROUP BY 1")
def tree_audit(spark, sf_dir):
    from corpusql.sources.documents import audit

    return audit(table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.octet_length("html").alias("length")))


@query("SELECT '7001' AS k, count(*) AS n FROM pages WHERE url LIKE '%/%' UNION ALL SELECT '7002', count(*) FROM pages WHERE url LIKE '%/%'")
def attachments_of_nested_folders(spark, sf_dir):
    from corpusql.sources.files import tree_attachments

    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("s/a_7001/b_7002/c_12/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.length("html").alias("length"), "url")
    return tree_attachments(p.where("url like '%/%'")).groupBy(F.col("content_id").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT event_id, 'ADO:' || event_id AS id, lower(event_type) AS type, 'ADO Work Item ' || event_id AS title, props AS text FROM events")
def work_items_of_json(spark, sf_dir):
    from corpusql.sources.files import work_items

    e = table(spark, sf_dir, "events")
    made = F.to_json(F.struct(F.col("event_id").alias("id"), F.upper("event_type").alias("System.WorkItemType"), F.col("props").alias("description")))
    return work_items(e.select(made.alias("text"))).select(F.split("id", ":")[1].cast("long").alias("event_id"), "id", "type", "title", "text")


@query("SELECT event_id, 'ADO:' || event_id AS id, event_type AS type, event_type || ': x' AS title FROM events")
def work_items_of_lines(spark, sf_dir):
    from corpusql.sources.files import work_items

    e = table(spark, sf_dir, "events")
    lines = F.concat(F.lit("no pair\nworkItemId: "), F.col("event_id").cast("string"), F.lit("\nType: "), "event_type", F.lit("\nName: "), "event_type", F.lit(": x\n"))
    return work_items(e.select(lines.alias("text"))).select(F.split("id", ":")[1].cast("long").alias("event_id"), "id", "type", "title")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS work_item, 'd/' || l_partkey || '.bin' AS path, l_partkey || '.bin' AS name, CAST(l_linenumber AS BIGINT) AS size FROM lineitem")
def attachment_index_of_items(spark, sf_dir):
    from corpusql.sources.files import attachment_index

    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    li = li.repartition(max(1, li.count() // 100_000))  # parsing takes far longer than reading, and a file may be one task's
    nested = F.struct(F.struct(F.concat(F.lit("d/"), F.col("l_partkey").cast("string"), F.lit(".bin")).alias("localPath")).alias("artifact"), F.col("l_orderkey").alias("workItemId"), F.col("l_linenumber").alias("size"))
    return attachment_index(li.select(F.to_json(F.array(nested)).alias("text"))).select("work_item", "path", "name", "size")
