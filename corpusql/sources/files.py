"""Scans of exported trees: record files, storage pages, attachments, work items, tables, source code."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.functions.text import html_to_decoded_text, utf8_or_latin
from corpusql.operators.code import wanted_files

_RECORD = "id string, title string, containerTitle string, body struct<storage struct<value string>>"
# The keys under which work items and attachments carry their fields.
ID_KEYS = ["id", "workItemId", "work_item_id", "ID"]
TITLE_KEYS = ["title", "System.Title", "fields.System.Title", "name", "Name"]
TYPE_KEYS = ["System.WorkItemType", "fields.System.WorkItemType", "type", "Type"]
TEXT_KEYS = ["System.Description", "fields.System.Description", "description", "Description"]
PATH_KEYS = ["path", "relpath", "relativePath", "localPath", "fullPath", "filePath", "attachmentPath"]
NAME_KEYS = ["name", "fileName", "filename"]
NESTS = ["file", "attachment", "artifact"]


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def records(spark: SparkSession, paths: str | list[str], schema: str = _RECORD) -> DataFrame:
    """One row for each line that is a JSON object, with file; blank and broken lines give none."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"))
    read = lines.where(F.trim("value") != "").select(F.from_json("value", schema + ", _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("r"), "file")
    return read.where("r is not null and r._broken is null").select("r.*", "file").drop("_broken")


def storage_pages(spark: SparkSession, root: str) -> DataFrame:
    """id and html of page_storage files: the first run of three digits or more in a file's name; of two files the later name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/*/page_storage")
    named = files.select(F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"(\d{3,})", 1).alias("id"), "path", utf8_or_latin(F.col("content")).alias("html"))
    return named.where("id <> ''").groupBy("id").agg(F.max_by("html", "path").alias("html"))


def space_documents(spark: SparkSession, root: str, storage: DataFrame | None = None) -> DataFrame:
    """id, space, type, title, text of pages, blog posts and comments below ``root``/<space>/.

    Pages and posts need an id and a title; a comment without a title takes its container's, else 'Comment <id>'. The
    text is the storage page's, else the record's own body.
    """
    found = None
    for name, kind in (("page", "page"), ("blogpost", "blogpost"), ("page_comments", "comment")):
        try:
            r = records(spark, f"{root}/*/{name}.ndjson")
        except Exception as e:  # a tree without this kind of file
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        title = _filled(F.col("title"))
        if kind == "comment":
            title = F.coalesce(title, _filled(F.col("containerTitle")), F.concat(F.lit("Comment "), F.trim("id")))
        one = r.select(F.trim("id").alias("id"), F.element_at(F.split("file", "/"), -2).alias("space"), F.lit(kind).alias("type"), title.alias("title"), F.col("body.storage.value").alias("own"))
        one = one.where("id <> '' and title is not null")
        found = one if found is None else found.unionByName(one)
    if found is None:
        raise FileNotFoundError(f"no record files below {root}")
    if storage is None:
        return found.select("id", "space", "type", "title", F.coalesce(html_to_decoded_text(F.col("own")), F.lit("")).alias("text"))
    text = F.coalesce(_filled(html_to_decoded_text(F.col("html"))), html_to_decoded_text(F.col("own")), F.lit(""))
    return found.join(storage, "id", "left").select("id", "space", "type", "title", text.alias("text"))


def tree_attachments(files: DataFrame, path: str = "path", size: str = "length") -> DataFrame:
    """content_id, name, relpath, size: a folder that ends in _<three digits or more> owns every file below it."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    owners = F.array_distinct(F.filter(F.transform(folders, lambda x: F.regexp_extract(x, r"_(\d{3,})$", 1)), lambda x: x != ""))
    return files.select(F.explode(owners).alias("content_id"), F.element_at(parts, -1).alias("name"), F.col(path).alias("relpath"), F.col(size).alias("size"))


def _first(fields: Column, keys: list[str]) -> Column:
    return F.coalesce(*(_filled(F.try_element_at(fields, F.lit(k))) for k in keys))


def work_items(texts: DataFrame, space: str = "ADO") -> DataFrame:
    """Documents of work items' files (text): a JSON object, else lines 'key: value'; those without an id give none."""
    pairs = F.filter(F.split("text", r"\r?\n"), lambda x: F.contains(x, F.lit(":")))
    entries = F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))
    last = F.map_from_entries(F.transform(F.array_distinct(F.transform(entries, lambda e: e["key"])), lambda k: F.struct(k.alias("key"), F.lit("").alias("value"))))
    lines = F.aggregate(entries, last, lambda m, e: F.map_zip_with(m, F.map_from_arrays(F.array(e["key"]), F.array(e["value"])), lambda k, a, b: F.coalesce(b, a)))
    read = texts.select(F.coalesce(F.from_json("text", "map<string,string>"), lines).alias("f"))
    wid = _first(F.col("f"), ID_KEYS)
    return read.where(wid.isNotNull()).select(
        F.concat(F.lit(f"{space}:"), wid).alias("id"), F.lit(space).alias("space"), F.coalesce(F.lower(_first(F.col("f"), TYPE_KEYS)), F.lit("ado")).alias("type"),
        F.coalesce(_first(F.col("f"), TITLE_KEYS), F.concat(F.lit("ADO Work Item "), wid)).alias("title"), F.coalesce(_first(F.col("f"), TEXT_KEYS), F.lit("")).alias("text"),
    )


def _begins(json: Column, sign: str) -> Column:
    return json.rlike(rf"^[\s\uFEFF]*\{sign}")


def _parsed(json: Column) -> Column:
    """The fields of an object; what does not begin as one is null without a parse, whose failure costs more than one that succeeds."""
    return F.when(_begins(json, "{"), F.from_json(json, "map<string,string>"))


def _first_of(fields: Column, keys: list[str]) -> Column:
    """As ``_first``, for a stored column of fields: one small loop over the keys, where dozens of look-ups written out make a method too large to be compiled."""
    found = F.transform(F.array(*map(F.lit, keys)), lambda k: _filled(F.try_element_at(fields, k)))
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))


def attachment_fields(rows: DataFrame, json: str) -> DataFrame:
    """``rows`` with path, name, size and sha256 of an attachment's JSON, its own fields before those of a nested object.

    Explode keeps the parsed object as a column of its own, so each object is parsed once and not once a field.
    """
    own = rows.select("*", F.explode(F.array(F.struct(_parsed(F.col(json)).alias("own")))).alias("_o"))
    nested = [_parsed(F.try_element_at("_o.own", F.lit(n))).alias(n) for n in NESTS]
    maps = own.select("*", F.explode(F.array(F.struct(*nested))).alias("_n"))
    places = [F.col("_o.own"), *(F.col(f"_n.{n}") for n in NESTS)]
    size = F.coalesce(F.try_element_at("_o.own", F.lit("size")).cast("long"), F.lit(0).cast("long"))
    return maps.select(
        *rows.columns, F.coalesce(*(_first_of(m, PATH_KEYS) for m in places)).alias("path"), F.coalesce(*(_first_of(m, NAME_KEYS) for m in places)).alias("name"),
        size.alias("size"), _first_of(F.col("_o.own"), ["sha256", "sha"]).alias("sha256"), F.coalesce(*(F.try_element_at("_o.own", F.lit(k)) for k in ("workItemId", "id", "work_item_id"))).alias("_wid"),
    )


def attachment_index(texts: DataFrame) -> DataFrame:
    """work_item, name, path, size, sha256 of index files (text): an object {item: [path or object]} or a list of objects.

    An outer explode, as a plain one's check for empty input would parse each text three times; its null items have no path.
    """
    by_item = texts.where(_begins(F.col("text"), "{")).select(F.explode_outer(F.from_json("text", "map<string,string>")).alias("wid", "files"))
    of_map = by_item.select(F.trim("wid").alias("wid"), F.explode_outer(F.from_json("files", "array<string>")).alias("item"))
    of_list = texts.where(_begins(F.col("text"), "[")).select(F.lit(None).cast("string").alias("wid"), F.explode_outer(F.from_json("text", "array<string>")).alias("item"))
    both = of_map.unionByName(of_list).withColumn("plain", ~F.startswith(F.trim("item"), F.lit("{")))
    read = attachment_fields(both, "item")
    out = read.select(F.coalesce("wid", "_wid").alias("work_item"), F.when(F.col("plain"), F.col("item")).otherwise(F.col("path")).alias("path"), "name", "size", "sha256")
    return out.where("work_item is not null and path is not null").withColumn("name", F.coalesce("name", F.element_at(F.split("path", "/"), -1)))


def item_of_file(name: Column) -> Column:
    """The work item that a file's name begins with, null for none."""
    return F.nullif(F.regexp_extract(name, r"^(\d+)_", 1), F.lit(""))


def csv_rows(spark: SparkSession, path: str, table: str, separator: str = ",", most_columns: int = 80, most_chars: int = 4000) -> DataFrame:
    """The rows of CSV files of one table as documents: id, title, text 'name=value; ...', row_key; all values are strings.

    Rows without a key are numbered within their file. See ``csvtree`` for trees of files and for separators told by the files.
    """
    from corpusql.sources import csvtree

    rows = csvtree.rows(spark, csvtree.paths_of(spark, path), delimiter=separator).withColumn("table", F.lit(table))
    text, key = csvtree.row_text_of(most_columns, most_chars), csvtree.row_key_of()
    return rows.select(F.concat(F.lit(f"DB:{table}:"), key).alias("id"), F.concat(F.lit(f"{table}:"), key).alias("title"), text.alias("text"), key.alias("row_key"))


def listing(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """path, length and modificationTime of every file below ``root``; no contents are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (files.option("pathGlobFilter", glob) if glob else files).load(root).select("path", "length", "modificationTime")


def contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, length and content of these files. The driver holds their names, as it does for any scan of files."""
    if not paths:
        return spark.createDataFrame([], "path string, length long, content binary")
    return spark.read.format("binaryFile").load([p.replace("\\", "\\\\") if "\\" in p else p for p in paths]).select("path", "length", "content")


def below(root: str) -> Column:
    """The part of a file's path behind ``root``, whatever scheme the path has been given."""
    bare = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", root).rstrip("/") + "/"
    return F.substring_index(F.col("path"), bare, -1)


def code_files(spark: SparkSession, root: str, **rules) -> DataFrame:
    """path (below ``root``), length and text of the wanted source files: all are listed, the wanted ones alone are read."""
    listed = listing(spark, root).select(F.col("path").alias("at"), "length").withColumn("path", F.col("at")).withColumn("path", below(root))
    wanted = [r["at"] for r in wanted_files(listed, **rules).select("at").collect()]
    return contents(spark, wanted).select(below(root).alias("path"), "length", utf8_or_latin(F.col("content")).alias("text"))


def git_revision(root: str) -> tuple[str, str | None]:
    """The name of a checked-out tree and the commit that its HEAD stands at (None where that can't be told); read on the driver."""
    at = Path(root)
    try:
        head = (at / ".git" / "HEAD").read_text(encoding="utf-8").strip()
        if not head.startswith("ref:"):
            return at.name, head or None
        ref = head.partition(" ")[2].strip()
        own = at / ".git" / ref
        if own.exists():
            return at.name, own.read_text(encoding="utf-8").strip()
        packed = (at / ".git" / "packed-refs").read_text(encoding="utf-8").splitlines()
        return at.name, next((line.split(" ")[0] for line in packed if line.endswith(" " + ref)), None)
    except OSError:
        return at.name, None
