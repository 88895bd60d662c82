"""Registered queries on stored indexes: stems, cover density, hybrid and symbol search, pages of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusql.functions import stemming
from corpusql.functions import text as T
from corpusql.functions import vectors as V
from corpusql.jobs import index as stored
from corpusql.operators import boolean, code, indexed, retrieval
from corpusql.operators.ranks import ROWS_IN_PART, dealt_join
from corpusql.registry import query
from corpusql.session import table
from corpusql.sources import tables
from corpusql.workload_code import _BLOCKS, _LANG, _SYMBOL, _files
from corpusql.workload_search import _boolean_sql

_SPLIT = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
_V, _C = "[aeiouy]", "[^aeiouy]"
_SHORT = f"((^{_V}{_C}$)|({_C}{_V}[^aeiouywxY]$))"


def _step_sql(name: str, source: str, rules: list[tuple[str, str]], region: dict[str, str], default: str) -> str:
    """One step as a join with its table of suffixes: of those that fit the longest, then its conditions."""
    before = {"ogi": "l$", "li": "[cdeghkmnrt]$", "ion": "[st]$"}
    values = ", ".join(f"('{s}', '{n}', '{before.get(s, '')}', {1 if region.get(s, default) == 'p1' else 2})" for s, n in rules)
    return (
        f"{name} AS (SELECT t.term, t.p1, t.p2, CASE WHEN r.s IS NULL THEN t.w WHEN length(t.w) - length(r.s) >= (CASE r.p WHEN 1 THEN t.p1 ELSE t.p2 END) AND regexp_matches(left(t.w, -length(r.s)), r.b) "
        f"THEN left(t.w, -length(r.s)) || r.n ELSE t.w END AS w FROM {source} t LEFT JOIN (VALUES {values}) r(s, n, b, p) ON suffix(t.w, r.s) QUALIFY row_number() OVER (PARTITION BY t.term ORDER BY length(r.s) DESC NULLS LAST) = 1)"
    )


def _stem_sql(source: str) -> str:
    """CTEs that end in stems (term, stem), for the different terms of ``source`` (term)."""
    rest = f"(^.*?{_V}{_C})"
    mend = f"CASE WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e' WHEN regexp_matches(b, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(b, -1) WHEN length(b) <= p1 AND regexp_matches(b, '{_SHORT}') THEN b || 'e' ELSE b END"
    part = "CASE WHEN regexp_matches(w, '(ingly|edly|ing|ed)$') AND NOT regexp_matches(w, 'eed(ly)?$') THEN regexp_replace(w, '(ingly|edly|ing|ed)$', '') END"
    whole = ", ".join(f"('{a}', '{b}')" for a, b in stemming.WHOLE.items())
    stay = ", ".join(f"'{x}'" for x in stemming.STAY)
    return ", ".join([
        f"s0 AS (SELECT term, regexp_replace(term, '(^|{_V})y', '\\1Y', 'g') AS w FROM (SELECT DISTINCT term FROM {source}))",
        f"s1 AS (SELECT term, w, CASE WHEN regexp_matches(w, '^(gener|commun|arsen)') THEN length(regexp_extract(w, '^(gener|commun|arsen)')) WHEN regexp_matches(w, '{rest}') THEN length(regexp_extract(w, '{rest}')) ELSE length(w) END AS p1 FROM s0)",
        f"s2 AS (SELECT term, w, p1, p1 + CASE WHEN regexp_matches(substr(w, p1 + 1), '{rest}') THEN length(regexp_extract(substr(w, p1 + 1), '{rest}')) ELSE length(w) - p1 END AS p2 FROM s1)",
        f"s3 AS (SELECT term, p1, p2, CASE WHEN suffix(w, 'sses') THEN left(w, -2) WHEN suffix(w, 'ied') OR suffix(w, 'ies') THEN CASE WHEN length(w) > 4 THEN left(w, -2) ELSE left(w, -1) END WHEN suffix(w, 'us') OR suffix(w, 'ss') THEN w WHEN regexp_matches(w, '{_V}.+s$') THEN left(w, -1) ELSE w END AS w FROM s2)",
        f"s4 AS (SELECT *, {part} AS b FROM s3)",
        f"s5 AS (SELECT term, p1, p2, w AS plural, CASE WHEN suffix(w, 'eedly') THEN CASE WHEN length(w) - 5 >= p1 THEN left(w, -3) ELSE w END WHEN suffix(w, 'eed') THEN CASE WHEN length(w) - 3 >= p1 THEN left(w, -1) ELSE w END WHEN b IS NOT NULL AND regexp_matches(b, '{_V}') THEN {mend} ELSE w END AS w FROM s4)",
        f"s6 AS (SELECT term, p1, p2, regexp_replace(w, '^(.+{_C})[yY]$', '\\1i') AS w FROM s5)",
        _step_sql("s7", "s6", stemming.SECOND, {}, "p1"),
        _step_sql("s8", "s7", stemming.THIRD, {"ative": "p2"}, "p1"),
        _step_sql("s9", "s8", [(s, "") for s in stemming.FOURTH], {}, "p2"),
        f"s10 AS (SELECT term, lower(CASE WHEN suffix(w, 'e') AND (length(w) > p2 OR (length(w) > p1 AND NOT regexp_matches(left(w, -1), '{_SHORT}'))) THEN left(w, -1) WHEN suffix(w, 'll') AND length(w) > p2 THEN left(w, -1) ELSE w END) AS w FROM s9)",
        f"stems AS (SELECT s0.term, CASE WHEN length(s0.term) <= 2 THEN s0.term WHEN x.b IS NOT NULL THEN x.b WHEN s5.plural IN ({stay}) THEN s5.plural ELSE s10.w END AS stem FROM s0 JOIN s5 ON s0.term = s5.term JOIN s10 ON s0.term = s10.term LEFT JOIN (VALUES {whole}) x(a, b) ON s0.term = x.a)",
    ])


def _stop_sql() -> str:
    return ", ".join(f"'{w}'" for w in stemming.STOP_WORDS)


def _cover_sql(text: str) -> str:
    """CTEs that end in ranked (id, score), over words (id, position, term)."""
    asked = "(" + ", ".join(f"('{w}')" for w in text.lower().split()) + ")"
    asked = f"SELECT a.w FROM (VALUES {asked[1:-1]}) a(w) WHERE a.w NOT IN ({_stop_sql()})"
    return ", ".join([
        f"every AS (SELECT term FROM words UNION {asked})",
        _stem_sql("every"),
        f"asked AS (SELECT DISTINCT stem FROM stems WHERE term IN ({asked}))",
        "hits AS (SELECT id, position, stem FROM words JOIN stems USING (term) WHERE stem IN (SELECT stem FROM asked))",
        "whole AS (SELECT id FROM hits GROUP BY id HAVING count(DISTINCT stem) = (SELECT count(*) FROM asked))",
        # The last place of each stem at or before each hit, by definition.
        "latest AS (SELECT e.id, e.position, h.stem, max(h.position) AS place FROM hits e JOIN hits h ON e.id = h.id AND h.position <= e.position WHERE e.id IN (SELECT id FROM whole) GROUP BY ALL)",
        "ends AS (SELECT id, position AS b, min(place) AS a FROM latest GROUP BY id, position HAVING count(*) = (SELECT count(*) FROM asked))",
        "least AS (SELECT id, a, min(b) AS b FROM ends GROUP BY id, a)",
        "inside AS (SELECT l.id, l.a, l.b, count(*) AS n FROM least l JOIN hits h ON h.id = l.id AND h.position BETWEEN l.a AND l.b GROUP BY ALL)",
        "ranked AS (SELECT id, round(sum(0.1 / (1 + (b - a + 1 - n))), 6) AS score FROM inside GROUP BY id)",
    ])


_DOCS = "docs AS (SELECT CAST(doc_id AS VARCHAR) AS id, source AS space, lang AS type, substr(split_part(text, chr(10), 1), 1, 60) AS title, coalesce(text, '') AS text FROM documents)"
_WORDS = f"tokens AS (SELECT id, list_concat({_SPLIT.format('title')}, {_SPLIT.format('text')}) AS w FROM docs), words AS (SELECT id, unnest(w) AS term, generate_subscripts(w, 1) AS position FROM tokens)"


@query(f"WITH {_DOCS}, words AS (SELECT unnest({_SPLIT.format('text')}) AS term FROM docs), {_stem_sql('words')} SELECT term, stem, term IN ({_stop_sql()}) AS stop FROM stems")
def stem_vocabulary(spark, sf_dir):
    words = tables.docs(spark, sf_dir).select(F.explode(T.tokens(F.col("text"))).alias("term")).distinct()
    return words.select("term", stemming.stemmed(F.col("term")).alias("stem"), stemming.is_stop_word(F.col("term")).alias("stop"))


@query(f"WITH {_DOCS}, {_WORDS}, {_stem_sql('words')} SELECT stem, count(*) AS occurrences, count(DISTINCT id) AS docs, CAST(sum(position) AS BIGINT) AS positions FROM words JOIN stems USING (term) WHERE term NOT IN ({_stop_sql()}) GROUP BY stem")
def stemmed_postings(spark, sf_dir):
    """Stems of titles and texts as the index holds them: terms by stem, their positions running through both."""
    i = tables.docs_index(spark, sf_dir)
    stems = i.vocabulary().where("kind = 'stem'")
    forms = stems.select(F.col("key").alias("stem"), "term")
    p = i.all_postings().where(F.col("field") > stored.ID)
    counted = p.groupBy("term").agg(F.sum("tf").alias("n"), F.sum(F.aggregate("positions", F.lit(0).cast("long"), lambda a, x: a + x + F.col("base") + 1)).alias("at"))
    by_stem = forms.join(stored.stop_words_out(counted, "term"), "term").groupBy("stem").agg(F.sum("n").alias("occurrences"), F.sum("at").alias("positions"))
    # A document counts once for a stem, in whatever forms and fields it holds it.
    pairs = stored.stop_words_out(p.select("id", "term"), "term")
    parts = (stems.agg(F.sum("fields")).first()[0] or 0) // ROWS_IN_PART + 1  # so a task's rows are bounded, and so is its memory
    named = dealt_join(pairs, forms, "term", "id", stems.select("term", F.col("fields").alias("count")), parts).select("stem", "id")
    docs = named.repartition(parts, "stem", "id").distinct().groupBy("stem").agg(F.count("id").alias("docs"))
    return by_stem.join(docs, "stem").select("stem", "occurrences", "docs", "positions")


@query(f"WITH {_DOCS}, {_WORDS}, {_cover_sql('the things of thers and thons')} SELECT ranked.id, title, space, score FROM ranked JOIN docs USING (id) ORDER BY score DESC, id LIMIT 100")
def search_stemmed(spark, sf_dir):
    i = tables.docs_index(spark, sf_dir)
    hits = indexed.stemmed_search(i, "the things of thers and thons").orderBy(F.desc("score"), "id").limit(100)
    return indexed.with_headers(i, hits).select("id", "title", "space", "score")


@query(f"WITH {_DOCS}, {_WORDS}, {_cover_sql('things')} SELECT id, score FROM ranked")
def search_stemmed_one_word(spark, sf_dir):
    return indexed.stemmed_search(tables.docs_index(spark, sf_dir), "things")


_Q = "(SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"


@query(
    f"WITH {_DOCS}, {_WORDS}, {_cover_sql('things')}, lx AS (SELECT CAST(id AS BIGINT) AS id, score FROM ranked ORDER BY score DESC, ranked.id LIMIT 20), "
    f"vc AS (SELECT vec_id AS id, round(1 / (1 + list_distance(CAST(embedding AS DOUBLE[]), {_Q})), 6) AS score FROM embeddings ORDER BY score DESC, id LIMIT 20), "
    "u AS (SELECT coalesce(lx.id, vc.id) AS id, coalesce(lx.score, 0) AS a, coalesce(vc.score, 0) AS b FROM lx FULL JOIN vc ON lx.id = vc.id), "
    "m AS (SELECT id, a, b, min(a) OVER () AS a0, max(a) OVER () AS a1, min(b) OVER () AS b0, max(b) OVER () AS b1 FROM u), "
    "f AS (SELECT id, round(0.5 * CASE WHEN a1 > a0 THEN (a - a0) / (a1 - a0) ELSE 0 END + 0.5 * CASE WHEN b1 > b0 THEN (b - b0) / (b1 - b0) ELSE 0 END, 6) AS score FROM m ORDER BY score DESC, id LIMIT 20) "
    "SELECT f.id, title, space, f.score FROM f LEFT JOIN docs ON docs.id = CAST(f.id AS VARCHAR)"
)
def hybrid_stemmed(spark, sf_dir):
    """Stems ranked by covers fused with the nearest vectors, headers joined to what is left."""
    i = tables.docs_index(spark, sf_dir)
    lex = indexed.stemmed_search(i, "things").orderBy(F.desc("score"), "id").limit(20).select(F.col("id").cast("long").alias("id"), "score")
    q = [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]
    vec = retrieval.vector_topk(tables.chunks(spark, sf_dir), q, 20, measure=V.l2_similarity).select("id", "score")
    fused = retrieval.fuse(lex, vec, 20).withColumn("key", F.col("id").cast("string"))
    return fused.join(i.docs().withColumnRenamed("id", "key"), "key", "left").select("id", "title", "space", "score")


_PAGE = '"of the" OR thing'


@query(
    f"WITH hits AS ({_boolean_sql(_PAGE)}), {_DOCS}, top AS (SELECT docs.id, docs.space, docs.type, docs.title, docs.text, score FROM hits JOIN docs USING (id) WHERE docs.type = 'en' ORDER BY score DESC, docs.id LIMIT 10 OFFSET 5), "
    "a AS (SELECT CAST(l_orderkey AS VARCHAR) AS id, count(*) AS n FROM lineitem GROUP BY 1), "
    "t AS (SELECT id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM top), "
    "h AS (SELECT id, w, list_transform(w, lambda x: CASE WHEN regexp_replace(strip_accents(lower(x)), '[^\\p{L}\\p{N}]+', '', 'g') IN ('of', 'the', 'thing') THEN 1 ELSE 0 END) AS h FROM t), "
    "p AS (SELECT id, w, h, list_filter(range(0, len(w)), lambda i: h[i + 1] = 1) AS hits FROM h), "
    "b AS (SELECT id, w, h, coalesce(-list_max(list_transform(range(0, len(hits)), lambda k: {'n': len(list_filter(hits[k + 1:k + 12], lambda q: q < hits[k + 1] + 12)), 'p': -hits[k + 1]})).p, 0) AS s FROM p), "
    "x AS (SELECT *, list_transform(range(s + 1, least(s + 12, len(w)) + 1), lambda i: CASE WHEN h[i] = 1 THEN '<b>' || w[i] || '</b>' ELSE w[i] END) AS shown FROM b) "
    "SELECT CAST(5 + row_number() OVER (ORDER BY score DESC, top.id) AS INTEGER) AS rank, top.id, space, type, title, coalesce(n, 0) AS attachments_count, "
    "CASE WHEN s > 0 THEN '… ' ELSE '' END || array_to_string(shown, ' ') || CASE WHEN s + 12 < len(w) THEN ' …' ELSE '' END AS snippet, score FROM top LEFT JOIN a ON a.id = top.id JOIN x ON x.id = top.id"
)
def search_page(spark, sf_dir):
    """A filtered page of a Boolean search with titles, attachment counts and snippets in one result."""
    i = tables.docs_index(spark, sf_dir)
    files = tables.attachments(spark, sf_dir).select(F.col("content_id").cast("string").alias("content_id"))
    words = sorted({w for p in boolean.phrases(boolean.parsed(_PAGE)) for w in p})
    return indexed.result_page(i, indexed.search(i, _PAGE), tables.docs(spark, sf_dir).select("id", "text"), files, words, 10, 5, kind="en")


_SYMBOLS = f"{_BLOCKS}, docs AS (SELECT path || ':' || a AS id, '' AS title, array_to_string(lines[a + 1:b], chr(10)) AS text, label, path, a, b FROM c)"


def _symbols(spark, sf_dir):
    """Symbol blocks of the documents as source files, each a document of an index of its own."""
    found = code.blocks(_files(spark, sf_dir).select("path", "text"), _SYMBOL, 18, 4)
    body = F.array_join(F.slice("lines", F.col("a") + 1, F.col("b") - F.col("a")), "\n")
    return found.select(F.concat_ws(":", "path", F.col("a").cast("string")).alias("id"), F.lit("CODE").alias("space"), F.lit("code").alias("type"), F.lit("").alias("title"), body.alias("text"), "path", code.language_of(F.col("path")).alias("lang"), F.col("label").alias("symbol"), (F.col("a") + 1).alias("start_line"), F.col("b").alias("end_line"))


@query(f"WITH {_SYMBOLS}, {_WORDS}, {_cover_sql('the things')} SELECT path, {_LANG} AS lang, label AS symbol, CAST(a + 1 AS INTEGER) AS start_line, CAST(b AS INTEGER) AS end_line, substr(text, 1, 400) AS snippet, score FROM ranked JOIN docs USING (id) ORDER BY score DESC, id LIMIT 20")
def code_symbol_search(spark, sf_dir):
    """Symbols by the stems of their contents, ranked by covers, with the first 400 characters."""
    i = stored.of_table(spark, "symbols", table(spark, sf_dir, "documents"), lambda: _symbols(spark, sf_dir))
    hits = indexed.stemmed_search(i, "the things").orderBy(F.desc("score"), "id").limit(20)
    found = _symbols(spark, sf_dir).join(F.broadcast(hits), "id")  # at most 20 rows
    return found.select("path", "lang", "symbol", "start_line", "end_line", F.substring("text", 1, 400).alias("snippet"), "score")
