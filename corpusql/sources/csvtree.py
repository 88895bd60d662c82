"""Trees of CSV files: each file's own separator and quotes, rows numbered within their file, unchanged files left out.

A file is parsed in one task, as quoted line ends make it one sequence; rows leave the task as they are read. A file's
bytes are held once (Spark's binary reader takes files of up to 2 GB); larger exports must be split.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.operators.merge import missing
from corpusql.sources.files import contents, listing

ROWS = "path string, row long, names array<string>, fields array<string>"
# The columns that may hold a row's key, in their order.
KEYS = ["id", "ID", "Id", "pk", "PK", "key", "KEY", "Key"]
BATCH = 5000


def paths_of(spark: SparkSession, root: str) -> list[str]:
    return sorted(r.path for r in listing(spark, root).select("path").collect())


def tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, length and modificationTime of the CSV files (their suffix in letters of either case) that match the glob."""
    return listing(spark, root, glob).where(F.lower("path").endswith(".csv"))


def changed(files: DataFrame, cache: DataFrame | None) -> DataFrame:
    """The files whose path, length and time the cache of earlier runs does not hold."""
    return files if cache is None else missing(files, cache, ["path", "length", "modificationTime"])


def reader_of(text: str, sniff: int = 200_000, dialect: str | None = None, delimiter: str | None = None) -> Iterator[list[str]]:
    """A file's rows by a named dialect or a given delimiter, else by what a sample shows, else by commas."""
    if dialect in csv.list_dialects():
        return csv.reader(io.StringIO(text, newline=""), dialect)
    if delimiter:
        return csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)
    try:
        return csv.reader(io.StringIO(text, newline=""), csv.Sniffer().sniff(text[:sniff]))
    except csv.Error:
        return csv.reader(io.StringIO(text, newline=""))


def rows(spark: SparkSession, paths: list[str], most_rows: int | None = None, sniff: int = 200_000, dialect: str | None = None, delimiter: str | None = None) -> DataFrame:
    """path, row (from 1 in each file), names and fields of the files' rows; the first row with a field names the columns.

    Names are trimmed; a row's missing fields are empty, its further ones stand under an empty name; blank rows are none.
    Bytes that are not UTF-8 are left out.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                lines = reader_of(content.as_buffer().to_pybytes().decode("utf-8", "ignore"), sniff, dialect, delimiter)
                names, n, out = None, 0, ([], [], [], [])
                for line in lines:
                    if not line:
                        continue
                    if names is None:
                        names = [x.strip() for x in line]
                        continue
                    if most_rows is not None and n >= most_rows:
                        break
                    n += 1
                    more = [str(line[len(names) :])] if len(line) > len(names) else []
                    for column, value in zip(out, (path.as_py(), n, names + [""] * len(more), line[: len(names)] + [""] * (len(names) - len(line)) + more), strict=True):
                        column.append(value)
                    if len(out[0]) == BATCH:
                        yield _batch(out)
                        out = ([], [], [], [])
                yield _batch(out)

    return contents(spark, paths).select("path", "content").mapInArrow(parse, ROWS)


def _batch(columns: tuple) -> pa.RecordBatch:
    texts = pa.list_(pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), texts, texts), strict=True)], ["path", "row", "names", "fields"])


def row_key_of(prefix: str = "row") -> Column:
    """The first filled key column of a row, else its number."""
    at = [F.array_position("names", k).cast("int") for k in KEYS]
    value = [F.when(p > 0, F.nullif(F.trim(F.element_at("fields", F.greatest(p, F.lit(1)))), F.lit(""))) for p in at]
    return F.coalesce(*value, F.concat(F.lit(prefix), F.col("row").cast("string")))


def row_text_of(most_columns: int = 80, most_chars: int = 4000) -> Column:
    """'name=value; name=value' of a row."""
    joined = F.array_join(F.slice(F.zip_with("names", "fields", lambda n, v: F.concat(n, F.lit("="), F.coalesce(v, F.lit("")))), 1, most_columns), "; ")
    return F.when(F.length(joined) > most_chars, F.concat(F.substring(joined, 1, most_chars), F.lit(" …"))).otherwise(joined)


def documents(found: DataFrame, customer: str, most_columns: int = 80, most_chars: int = 4000) -> DataFrame:
    """Rows of tables as chunks: all in space DB, the table being the file's name without its suffix."""
    table = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    keyed = found.select("*", table.alias("table"), row_key_of().alias("row_key"))
    place = F.concat(F.lit(f"{customer}/"), "table", F.lit("#"), "row_key")
    return keyed.select(
        F.concat(F.lit(f"DB:{customer}:"), "table", F.lit(":"), "row_key").alias("id"), F.lit("DB").alias("space"), F.lit("db_row").alias("type"), place.alias("title"), F.concat(F.lit("/v1/fetch?ids="), place).alias("url"),
        F.lit(0).cast("long").alias("chunk_ix"), row_text_of(most_columns, most_chars).alias("text"), F.lit(customer).alias("customer"), "table", "row_key", "path", "row",
    )
