"""Registered queries: Boolean search, snippets, the stored index, listings and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusql.functions import text as T
from corpusql.operators import boolean, indexed, pages
from corpusql.registry import query
from corpusql.session import table
from corpusql.sources import tables

_DOCS = "docs AS (SELECT CAST(doc_id AS VARCHAR) AS id, source AS space, lang AS type, substr(split_part(text, chr(10), 1), 1, 60) AS title, coalesce(text, '') AS text FROM documents)"
_FOLD = "list_filter(regexp_split_to_array(strip_accents(lower({})), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def _tree_sql(tree: boolean.Node, name: dict) -> tuple[str, str]:
    if tree.kind == "phrase":
        i = name[tree.words]
        term = f"greatest(ln((n - df_{i} + 0.5) / (df_{i} + 0.5)), 1e-6) * tf_{i} * 2.2 / (tf_{i} + 1.2 * (0.25 + 0.75 * length / mean))"
        return f"(tf_{i} > 0)", f"CASE WHEN tf_{i} > 0 THEN {term} ELSE 0 END"
    (l, ls), (r, rs) = _tree_sql(tree.left, name), _tree_sql(tree.right, name)
    if tree.kind == "AND":
        return f"({l} AND {r})", f"CASE WHEN {l} AND {r} THEN ({ls}) + ({rs}) ELSE 0 END"
    if tree.kind == "OR":
        return f"({l} OR {r})", f"(CASE WHEN {l} THEN {ls} ELSE 0 END + CASE WHEN {r} THEN {rs} ELSE 0 END)"
    return f"({l} AND NOT {r})", f"CASE WHEN {l} AND NOT {r} THEN {ls} ELSE 0 END"


def _boolean_sql(text: str) -> str:
    tree = boolean.parsed(text)
    every = boolean.phrases(tree)

    def places(words: tuple[str, ...], w: str) -> str:
        test = " AND ".join(f"{w}[i + {j}] = '{x}'" for j, x in enumerate(words))
        return f"len(list_filter(range(1, len({w}) - {len(words) - 2}), lambda i: {test}))"

    tf = ", ".join(f"{places(x, 'wi')} + {places(x, 'wt')} + {places(x, 'wx')} AS tf_{k}" for k, x in enumerate(every))
    df = ", ".join(f"sum(CASE WHEN tf_{k} > 0 THEN 1 ELSE 0 END) AS df_{k}" for k in range(len(every)))
    match, score = _tree_sql(tree, {x: k for k, x in enumerate(every)})
    return (
        f"WITH {_DOCS}, w AS (SELECT id, space, {_FOLD.format('id')} AS wi, {_FOLD.format('title')} AS wt, {_FOLD.format('text')} AS wx FROM docs), "
        f"c AS (SELECT id, space, len(wi) + len(wt) + len(wx) AS length, {tf} FROM w), s AS (SELECT count(*) AS n, avg(length) AS mean, {df} FROM c) "
        f"SELECT id, space, round({score}, 6) AS score FROM c, s WHERE {match}"
    )


def _boolean(text: str):
    def run(spark, sf_dir):
        index = tables.docs_index(spark, sf_dir)
        return indexed.with_headers(index, indexed.search(index, text)).select("id", "space", "score")

    return run


_TREES = {
    "search_boolean_nested": '("of the" || thing) & ouais OR idiot NOT des',
    "search_boolean_phrase": '"of the" AND "and"',
    "search_boolean_folded": "señor OR über OR été OR que",
    "search_boolean_side_by_side": "der die OR la le NOT the",
}
for _name, _text in _TREES.items():
    _f = _boolean(_text)
    _f.__name__ = _name
    query(_boolean_sql(_text))(_f)

_WANTED = ["the", "der", "que"]


@query(
    "WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), "
    "h AS (SELECT doc_id, w, list_transform(w, lambda x: CASE WHEN regexp_replace(strip_accents(lower(x)), '[^\\p{L}\\p{N}]+', '', 'g') IN ('the', 'der', 'que') THEN 1 ELSE 0 END) AS h FROM t), "
    "p AS (SELECT doc_id, w, h, list_filter(range(0, len(w)), lambda i: h[i + 1] = 1) AS hits FROM h), "
    "b AS (SELECT doc_id, w, h, coalesce(-list_max(list_transform(range(0, len(hits)), lambda k: {'n': len(list_filter(hits[k + 1:k + 12], lambda q: q < hits[k + 1] + 12)), 'p': -hits[k + 1]})).p, 0) AS s FROM p), "
    "x AS (SELECT *, list_transform(range(s + 1, least(s + 12, len(w)) + 1), lambda i: CASE WHEN h[i] = 1 THEN '<b>' || w[i] || '</b>' ELSE w[i] END) AS shown FROM b) "
    "SELECT doc_id, CASE WHEN s > 0 THEN '… ' ELSE '' END || array_to_string(shown, ' ') || CASE WHEN s + 12 < len(w) THEN ' …' ELSE '' END AS snippet FROM x"
)
def search_snippets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    return boolean.snippets(d, "text", _WANTED).select("doc_id", "snippet")


@query(
    f"WITH {_DOCS}, w AS (SELECT id, {_FOLD.format('text')} AS w FROM docs), c AS (SELECT id, len(w) AS length, "
    + ", ".join(f"len(list_filter(w, lambda t: t = '{t}')) AS tf_{i}" for i, t in enumerate(_WANTED))
    + " FROM w), s AS (SELECT count(*) AS n, avg(length) AS mean, "
    + ", ".join(f"sum(CASE WHEN tf_{i} > 0 THEN 1 ELSE 0 END) AS df_{i}" for i in range(3))
    + " FROM c) SELECT id, round("
    + " + ".join(f"greatest(ln((n - df_{i} + 0.5) / (df_{i} + 0.5)), 1e-6) * tf_{i} * 2.2 / (tf_{i} + 1.2 * (0.25 + 0.75 * length / mean))" for i in range(3))
    + ", 6) AS score FROM c, s WHERE tf_0 + tf_1 + tf_2 > 0 ORDER BY score DESC, id LIMIT 20"
)
def search_stored_index(spark, sf_dir):
    hits = indexed.bm25(tables.docs_index(spark, sf_dir), _WANTED, kind="folded")
    return hits.orderBy(F.desc("score"), "id").limit(20)


@query(f"WITH {_DOCS}, x AS (SELECT id, unnest({_FOLD.format('text')}) AS term FROM docs) SELECT term, count(DISTINCT id) AS df FROM x GROUP BY term")
def folded_terms(spark, sf_dir):
    words = tables.docs(spark, sf_dir).select("id", F.explode(F.array_distinct(T.tokens(T.folded(F.col("text"))))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("df"))


@query(f"WITH {_DOCS}, a AS (SELECT CAST(l_orderkey AS VARCHAR) AS id, count(*) AS n FROM lineitem GROUP BY 1) SELECT docs.id, title, text, coalesce(n, 0) AS attachments_count FROM docs LEFT JOIN a ON a.id = docs.id ORDER BY lower(title), docs.id LIMIT 100")
def fetch_bodies_by_title(spark, sf_dir):
    n = tables.attachments(spark, sf_dir).groupBy(F.col("content_id").cast("string").alias("id")).agg(F.count("*").alias("n"))
    d = tables.docs(spark, sf_dir).select("id", "title", F.coalesce("text", F.lit("")).alias("text"))
    return d.join(n, "id", "left").select("id", "title", "text", F.coalesce("n", F.lit(0)).alias("attachments_count")).orderBy(F.lower("title"), "id").limit(100)


@query("SELECT l_orderkey AS content_id, string_agg(l_linenumber || '/' || flag, ',' ORDER BY l_linenumber, l_partkey, flag) AS files FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS flag FROM lineitem) GROUP BY 1")
def attachments_in_order(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_returnflag").alias("f"))
    names = F.transform(F.array_sort(F.collect_list("f")), lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit("/"), x["l_returnflag"]))
    return li.groupBy(F.col("l_orderkey").alias("content_id")).agg(F.array_join(names, ",").alias("files"))


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 20")
def sample_of_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").orderBy("doc_id").limit(20)


@query("SELECT doc_id AS id FROM documents UNION SELECT doc_id FROM labels")
def union_of_ids(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.select(F.col("doc_id").alias("id")).unionByName(lab.select(F.col("doc_id").alias("id"))).distinct()


@query("SELECT kind, count(*) AS n, CAST(sum(length(body)) AS BIGINT) AS chars FROM (SELECT 'document' AS kind, text AS body FROM documents UNION ALL SELECT 'page', html FROM pages UNION ALL SELECT 'turn', text FROM conversations) GROUP BY 1")
def bag_of_sources(spark, sf_dir):
    parts = [table(spark, sf_dir, t).select(F.lit(k).alias("kind"), F.col(c).alias("body")) for t, k, c in (("documents", "document", "text"), ("pages", "page", "html"), ("conversations", "turn", "text"))]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("body")).cast("long").alias("chars"))


@query(f"WITH {_DOCS} SELECT id, title FROM docs ORDER BY lower(title), id LIMIT 25 OFFSET 25")
def cursor_second_page(spark, sf_dir):
    d = tables.docs(spark, sf_dir).select("id", "title")
    return pages.cursor_page(d, [F.lower("title"), F.col("id")], 25, 25)[0]


_STRIPPED = "trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))"
_DECODED = _STRIPPED
for _entity, _sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _DECODED = f"replace({_DECODED}, '{_entity}', '{_sign}')"


@query(f"SELECT page_id, trim(regexp_replace({_DECODED}, '[ \\x{{a0}}]+', ' ', 'g')) AS body FROM pages")
def html_to_decoded_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_to_decoded_text(F.col("html"), few=True).alias("body"))


# Each entity once: the ampersand's own is put away while the others are decoded.
_EVERY = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
_EVERY = f"replace({_STRIPPED.replace('(html,', f'({_EVERY},', 1)}, '&amp;', chr(1))"
for _entity, _sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©")):
    _EVERY = f"replace({_EVERY}, '{_entity}', '{_sign}')"


@query(f"SELECT page_id, trim(regexp_replace(replace({_EVERY}, chr(1), '&'), '[ \\x{{a0}}]+', ' ', 'g')) AS body FROM pages")
def html_visible_text(spark, sf_dir):
    """Text of pages without comments, scripts and styles, every entity decoded."""
    return table(spark, sf_dir, "pages").select("page_id", T.html_to_decoded_text(F.col("html")).alias("body"))


_CLEAN = "substr(trim(regexp_replace(replace({}, chr(0), ''), '[\\x01-\\x08\\x0B-\\x1F]', ' ', 'g'), ' '), 1, 12000)"


@query(f"WITH {_DOCS}, c AS (SELECT id, title, text, {_CLEAN.format('title')} AS t, {_CLEAN.format('text')} AS b FROM docs) SELECT id, coalesce(nullif(substr(concat_ws(chr(10) || chr(10), nullif(trim(t, ' '), ''), nullif(trim(b, ' '), '')), 1, 12000), ''), nullif(title, ''), nullif(text, ''), '-') AS body FROM c")
def combine_or_dash(spark, sf_dir):
    d = tables.docs(spark, sf_dir).select("id", "title", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("id", T.combine_or_dash(F.col("title"), F.col("text")).alias("body"))


@query("SELECT p_partkey, coalesce(nullif(trim(p_brand), ''), 'row' || p_partkey) AS row_key, sha256(concat_ws(chr(1), p_partkey, p_name, p_brand)) AS h FROM part")
def row_keys(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    h = F.sha2(F.concat_ws("\x01", F.col("p_partkey").cast("string"), "p_name", "p_brand"), 256)
    return p.select("p_partkey", T.row_key(["id", "p_brand"], p.columns, F.col("p_partkey")).alias("row_key"), h.alias("h"))


@query(f"WITH {_DOCS}, s AS (SELECT id, list_sort(list_distinct(regexp_extract_all(lower(substr(title || ' ' || substr(text, 1, 300), 1, 2000)), '[a-z0-9_./-]+'))) AS words FROM docs) SELECT id, words FROM s")
def word_sets(spark, sf_dir):
    d = tables.docs(spark, sf_dir).select("id", "title", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("id", T.word_set(F.coalesce("title", F.lit("")), F.substring("text", 1, 300)).alias("words"))


_REL = "'attachments\\' || source || '/' || doc_id || '_a.txt'"


@query(
    f"WITH p AS (SELECT doc_id, 'ATT:' || doc_id || ':' || source || '/x:' || doc_id || '.txt' AS id, {_REL} AS rel FROM documents) "
    "SELECT doc_id, 'ADO/' || regexp_replace(regexp_replace(replace(rel, '\\', '/'), '^/+', ''), '^attachments/', '') AS public_path, split_part(replace(rel, '\\', '/'), '/', 1) AS space, "
    "'ADO' AS public_space, '/items/' || substr(regexp_replace(replace(rel, '\\', '/'), '^attachments/', ''), 1) AS absolute, substr(id, length('ATT:' || doc_id || ':') + 1) AS part, "
    "regexp_extract(doc_id || '_a.txt', '^(\\d+)_', 1) AS item, 'http://x/' || rel || '#' || doc_id AS url FROM p"
)
def path_functions(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    p = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("ATT:"), i, F.lit(":"), "source", F.lit("/x:"), i, F.lit(".txt")).alias("id"), F.concat(F.lit("attachments\\"), "source", F.lit("/"), i, F.lit("_a.txt")).alias("rel"))
    public = T.public_path(F.col("rel"))
    from corpusql.sources.files import item_of_file

    return p.select(
        "doc_id", public.alias("public_path"), T.space_of_path(F.replace("rel", F.lit("\\"), F.lit("/"))).alias("space"), T.space_of_path(public).alias("public_space"),
        T.absolute_path(public, "/items", "/data").alias("absolute"), T.id_part(F.col("id"), 2).alias("part"), item_of_file(F.concat(F.col("doc_id").cast("string"), F.lit("_a.txt"))).alias("item"),
        T.filled_url("http://x/{path}#{line}", path=F.col("rel"), line=F.col("doc_id")).alias("url"),
    )


@query("SELECT doc_id, octet_length(encode(text)) AS bytes, length(text) AS chars FROM documents WHERE octet_length(encode(text)) <> length(text)")
def wide_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.length("text").cast("long").alias("chars"))
    return d.where("bytes <> chars")
