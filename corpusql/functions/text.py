"""Scalar text functions as column expressions."""

from __future__ import annotations

import json
import unicodedata
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks, and the letters that remain without them.
_MARKED = [c for c in map(chr, range(0xC0, 0x250)) if len(unicodedata.normalize("NFD", c)) > 1]
_BARE = [unicodedata.normalize("NFD", c)[0] for c in _MARKED]
#: All named entities of HTML that end in a semicolon, as the standard library lists them.
_NAMED = json.dumps({name: value for name, value in html5.items() if name.endswith(";")})

#: Escapes of markup's own signs, the ampersand last.
_FEW = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}

TRUNCATION_MARK = "\n\n... [truncated]\n"


def html_to_text(html: Column) -> Column:
    """Visible text of markup: comments, scripts and styles go, tags become blanks, white space collapses."""
    bare = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    bare = F.regexp_replace(bare, r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def approx_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def sanitize(text: Column, most: int = 12_000) -> Column:
    """Control characters but line feed and tab become blanks (NUL goes), ends are trimmed, the rest is cut."""
    clean = F.regexp_replace(F.replace(text, F.lit("\0"), F.lit("")), r"[\x01-\x08\x0B-\x1F]", " ")
    return F.substring(F.trim(clean), 1, most)


def combine(title: Column, body: Column, most: int = 12_000) -> Column:
    """Title and body with a blank line between, either left out where it is blank."""
    parts = [F.when(F.trim(x) != "", F.trim(x)) for x in (title, body)]
    return F.substring(F.concat_ws("\n\n", *parts), 1, most)


def truncate_marked(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(TRUNCATION_MARK))).otherwise(text)


def title_of(text: Column) -> Column:
    """A title for a text without one: the first sixty characters of its first line."""
    return F.substring(F.split(text, "\n")[0], 1, 60)


def row_text(columns: list[str], most: int = 4000) -> Column:
    """A table row as 'name=value; name=value'."""
    joined = F.concat_ws("; ", *(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns))
    return F.when(F.length(joined) > most, F.concat(F.substring(joined, 1, most), F.lit(" …"))).otherwise(joined)


def char_windows(text: Column, size: int = 3200, step: int = 2800) -> Column:
    """array<struct<chunk_ix, chunk>>: windows of ``size`` characters every ``step``; one at least."""
    last = F.greatest(F.lit(0), F.ceil(F.length(text) / step).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("chunk_ix"), F.substring(text, i * step + 1, F.lit(size)).alias("chunk")))


def folded(text: Column) -> Column:
    """Lower case without the marks of Latin letters."""
    return F.translate(F.lower(text), "".join(_MARKED), "".join(_BARE))


def spaced_tokens(text: Column) -> Column:
    """Runs of letters and digits with one blank before, between and after."""
    return F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def _code_point(digits: Column, base: int) -> Column:
    """The sign of a number; nothing where there is none of that number."""
    value = F.conv(digits, base, 10).cast("long")
    tail = lambda shift: F.shiftright(value, shift).bitwiseAND(F.lit(63)) + 0x80
    byte = lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")
    coded = (
        F.when(value < 0x80, byte(value))
        .when(value < 0x800, F.concat(byte(F.shiftright(value, 6) + 0xC0), byte(tail(0))))
        .when(value < 0x10000, F.concat(byte(F.shiftright(value, 12) + 0xE0), byte(tail(6)), byte(tail(0))))
        .otherwise(F.concat(byte(F.shiftright(value, 18) + 0xF0), byte(tail(12)), byte(tail(6)), byte(tail(0))))
    )
    right = (value > 0) & (value < 0x110000) & ~value.between(0xD800, 0xDFFF)
    return F.when(right, F.decode(F.unhex(coded), "UTF-8")).otherwise(F.lit("\ufffd"))


def decoded_few(text: Column) -> Column:
    """Escapes of markup's own signs, and the blank that does not break, as characters."""
    for entity, sign in _FEW.items():
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def decoded(text: Column) -> Column:
    """Entities, named and numbered, as the characters that they stand for, each once; what is none stays.

    The text is split where an entity ends, so every part holds one at most, at its end.
    """
    names = F.from_json(F.lit(_NAMED), "map<string,string>")  # a constant

    def one(part: Column) -> Column:
        entity = F.regexp_extract(part, r"&(#[0-9]{1,7};|#[xX][0-9a-fA-F]{1,6};|[A-Za-z][A-Za-z0-9]*;)$", 1)
        number = F.when(F.lower(F.substring(entity, 2, 1)) == "x", _code_point(F.regexp_extract(entity, "([0-9a-fA-F]+);$", 1), 16)).otherwise(_code_point(F.regexp_extract(entity, "([0-9]+);$", 1), 10))
        sign = F.when(F.startswith(entity, F.lit("#")), number).otherwise(F.try_element_at(names, entity))
        return F.when((entity == "") | sign.isNull(), part).otherwise(F.concat(F.substring(part, F.lit(1), F.length(part) - F.length(entity) - 1), sign))

    whole = F.array_join(F.transform(F.split(text, r"(?<=;)"), one), "")
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def html_to_decoded_text(html: Column, few: bool = False) -> Column:
    """Visible text with its entities as signs. few: only those that every markup writer escapes."""
    signs = decoded_few if few else decoded
    return F.trim(F.regexp_replace(signs(html_to_text(html)), "[ \u00a0]+", " "))


def combine_or_dash(title: Column, body: Column, most: int = 12_000) -> Column:
    """The sanitised combination of both; the raw body, the raw title or a dash where nothing is left."""
    filled = lambda c: F.when(F.length(c) > 0, c)
    return F.coalesce(filled(combine(sanitize(title, most), sanitize(body, most), most)), filled(title), filled(body), F.lit("-"))


def row_key(columns: list[str], present: list[str], number: Column) -> Column:
    """The first of ``columns`` that a row has and fills, else 'row' and its number."""
    return F.coalesce(*(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in columns if c in present), F.concat(F.lit("row"), number.cast("string")))


def word_set(title: Column, snippet: Column, most: int = 2000) -> Column:
    """Different lower-cased words (letters, digits and _./-) of title and snippet, sorted."""
    text = F.substring(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit(""))), 1, most)
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_./-]+"), F.lit(0))))


def public_path(path: Column) -> Column:
    """A work item's file as it is served: forward slashes, below ADO/."""
    bare = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+", "")
    return F.concat(F.lit("ADO/"), F.regexp_replace(bare, "^attachments/", ""))


def space_of_path(path: Column) -> Column:
    """ADO for work items' files, else the first part of the path, else ATTACH."""
    return F.when(path.startswith("ADO/"), F.lit("ADO")).otherwise(F.coalesce(F.nullif(F.trim(F.split(path, "/")[0]), F.lit("")), F.lit("ATTACH")))


def absolute_path(path: Column, items_root: str, data_root: str) -> Column:
    return F.when(path.startswith("ADO/"), F.concat(F.lit(items_root.rstrip("/") + "/"), F.substring(path, 5, 1 << 30))).otherwise(F.concat(F.lit(data_root.rstrip("/") + "/"), path))


def id_part(ident: Column, k: int, most: int = 3) -> Column:
    """Part k (from 0) of an id such as ATT:<document>:<path>, split at most into ``most``."""
    return F.get(F.split(ident, ":", most), F.lit(k))


def filled_url(template: str, **parts: Column) -> Column:
    """A URL template with {names} replaced by columns."""
    out = F.lit(template)
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def utf8_or_latin(content: Column) -> Column:
    """A file's text: UTF-8 where it is valid, else Latin-1."""
    return F.when(F.expr("true") & F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def windows_to_end(size: Column, width: int, overlap: int) -> Column:
    """array<struct<a, b>>: windows of ``width`` every width - overlap, the last one ending at ``size``; none where it is 0."""
    step = max(1, width - overlap)
    count = F.greatest(F.lit(1), F.ceil((size - (width - step)) / step)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * step)
    return F.when(size > 0, F.transform(F.arrays_zip(starts.alias("a"), F.array_repeat(size, count).alias("n")), lambda x: F.struct(x["a"].alias("a"), F.least(x["a"] + width, x["n"]).alias("b")))).otherwise(F.array().cast("array<struct<a:int,b:int>>"))


def cut_to_bytes(text: Column, most: int) -> Column:
    """The longest beginning of a text that has at most ``most`` UTF-8 bytes; no character is split."""
    raw = F.encode(text, "UTF-8")
    inside = lambda at: F.conv(F.hex(F.substring(raw, at + 1, 1)), 16, 10).cast("int").bitwiseAND(F.lit(0xC0)) == 0x80  # noqa: E731  byte ``at`` (from 0) goes on with a character
    end = F.lit(max(0, most - 3))
    for at in range(max(0, most - 2), most + 1):
        end = F.when(inside(at), end).otherwise(F.lit(at))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(raw, F.lit(1), end), "UTF-8"))


def char_slice(text: Column, start: int, end: int | None, most_bytes: int) -> Column:
    """Characters from ``start`` up to ``end`` (the text's end), cut to whole characters of at most ``most_bytes``."""
    if start < 0 or (end is not None and end < start):
        raise ValueError("a slice goes forward from 0 on")
    return cut_to_bytes(F.substring(text, start + 1, (1 << 30) if end is None else end - start), most_bytes)


def safe_path(path: Column) -> Column:
    """A path below a root with forward slashes; null where it leads out of the root or is absolute."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    kept = F.filter(parts, lambda x: (x != "") & (x != "."))
    out = F.startswith(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/")) | F.array_contains(kept, "..") | path.rlike("^[A-Za-z]:") | F.contains(path, F.lit("\0"))
    return F.when(~out, F.array_join(kept, "/"))


def parsed_vector(text: Column) -> Column:
    """A vector written as a JSON array; null where it is none."""
    return F.from_json(text, "array<float>")


def analysed(query: Column) -> Column:
    """struct<tokens, has_identifier, has_path, has_camel> of a query: its capital identifiers, paths and camelCase words, each sorted."""
    kept = lambda x: F.array_sort(F.array_distinct(x))
    words = F.regexp_extract_all(query, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))  # letters of any script bound a word
    whole = lambda p: kept(F.filter(words, lambda w: w.rlike(p)))
    kinds = [whole("^[A-Z0-9_]{3,}$"), kept(F.regexp_extract_all(query, F.lit(r"[A-Za-z0-9_\-.]+(?:/[A-Za-z0-9_\-.]+)+"), F.lit(0))), whole("^[a-z]+[A-Za-z0-9]*[A-Z][A-Za-z0-9]*$")]
    has = [(F.size(k) > 0).alias(n) for k, n in zip(kinds, ("has_identifier", "has_path", "has_camel"), strict=True)]
    return F.struct(F.concat(*kinds).alias("tokens"), *has)
