"""Text of office documents, one row for each file, by the standard library inside Arrow batches."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusql.functions.text import TRUNCATION_MARK

MOST_ROWS, MOST_CHARS = 5000, 200_000


def _tags(node, name: str):
    return (x for x in node.iter() if x.tag.rsplit("}", 1)[-1] == name)


def _joined(node, name: str) -> str:
    return "".join(x.text or "" for x in _tags(node, name))


def docx_text(z: zipfile.ZipFile) -> str:
    """Paragraphs outside tables, then tables row by row."""
    body = next(_tags(ElementTree.fromstring(z.read("word/document.xml")), "body"))
    lines = [_joined(p, "t") for p in body if p.tag.endswith("}p")]
    for row in _tags(body, "tr"):
        lines.append("\t".join(_joined(c, "t").strip() for c in row if c.tag.endswith("}tc")))
    return "\n".join(lines)


def pptx_text(z: zipfile.ZipFile) -> str:
    number = lambda name: int(re.search(r"(\d+)\.xml$", name)[1])
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number)
    lines = []
    for k, name in enumerate(slides, 1):
        lines.append(f"--- SLIDE {k} ---")
        for shape in _tags(ElementTree.fromstring(z.read(name)), "txBody"):
            text = "\n".join(_joined(p, "t") for p in _tags(shape, "p"))
            lines += [text] if text else []
    return "\n".join(lines)


def xlsx_text(z: zipfile.ZipFile, most_rows: int = MOST_ROWS) -> str:
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = [_joined(x, "t") for x in _tags(ElementTree.fromstring(z.read("xl/sharedStrings.xml")), "si")]
    links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    lines, rows = [], 0
    for sheet in _tags(ElementTree.fromstring(z.read("xl/workbook.xml")), "sheet"):
        lines.append(f"--- SHEET {sheet.get('name')} ---")
        target = links[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))].lstrip("/")
        for row in _tags(ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")), "row"):
            cells = []
            for c in _tags(row, "c"):
                value = _joined(c, "v") or _joined(c, "t")
                cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
            if any(cells):
                lines.append("\t".join(cells))
                rows += 1
                if rows >= most_rows:
                    return "\n".join(lines)
    return "\n".join(lines)


_READERS = {"docx": docx_text, "pptx": pptx_text, "xlsx": xlsx_text}


def office_text(files: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """path, text and error of files (path, content) by their extension; unreadable ones have an empty text and an error."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                        text = _READERS[path.rsplit(".", 1)[-1].lower()](z)
                    rows.append((path, text if len(text) <= most_chars else text[:most_chars] + TRUNCATION_MARK, None))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, StopIteration, ValueError, IndexError) as e:
                    rows.append((path, "", type(e).__name__))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["path", "text", "error"])

    return files.where(F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).isin(*_READERS)).select("path", "content").mapInArrow(each, "path string, text string, error string")


def office_members(files: DataFrame) -> DataFrame:
    """path, member and content of what office files hold, media left out."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content or b""))
                except zipfile.BadZipFile:
                    continue
                names = [n for n in z.namelist() if "/media/" not in n and not n.endswith("/")]
                for name in names:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name]), pa.array([z.read(name)], pa.binary())], ["path", "member", "content"])

    return files.where(F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).isin(*_READERS)).select("path", "content").mapInArrow(each, "path string, member string, content binary")


def audit(listing: DataFrame) -> DataFrame:
    """Files and bytes by extension of a listing (path, length)."""
    return listing.groupBy(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("ext")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def largest(listing: DataFrame, most: int = 50) -> DataFrame:
    """The largest files of a listing (path, length)."""
    return listing.select("path", "length").orderBy(F.desc("length"), "path").limit(most)


def unwanted(listing: DataFrame) -> DataFrame:
    """path and why of files that a code corpus should not hold: resource forks, and what lies in folders of tools or of builds."""
    folder = lambda names: F.arrays_overlap(F.transform(F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))), F.lower), F.array(*map(F.lit, names)))
    why = F.when(F.element_at(F.split("path", "/"), -1).startswith("._"), "fork").when(folder([".git", ".hg", ".svn", ".idea", ".vscode"]), "tool").when(folder(["build", "bin", "obj", "out", "target", "dist", ".vs"]), "build")
    return listing.select("path", why.alias("why")).where("why is not null")
