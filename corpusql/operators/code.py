"""Source files as chunks: language, symbol blocks, line windows, headers and slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusql.functions.text import filled_url, windows_to_end
from corpusql.operators.ranks import dealt_join, first_k, least_k

# Languages by extension, folders that are left out, extensions that are taken.
LANGUAGES = {
    ".py": "python", ".go": "go", ".js": "javascript", ".ts": "typescript", ".tsx": "typescript", ".jsx": "javascript",
    ".java": "java", ".kt": "kotlin", ".scala": "scala", ".cs": "csharp", ".cpp": "cpp", ".cxx": "cpp", ".cc": "cpp", ".c": "c",
    ".h": "c", ".hpp": "cpp", ".rs": "rust", ".rb": "ruby", ".php": "php", ".m": "objc", ".mm": "objc++", ".swift": "swift",
    ".sql": "sql", ".sh": "bash", ".bash": "bash", ".zsh": "zsh",
}
DENIED = [
    ".git", "node_modules", "dist", "build", "out", "target", "venv", ".venv", "__pycache__", ".idea", ".vscode", ".hg", ".svn", ".DS_Store", "coverage",
    ".pytest_cache", "bin", "obj", ".mypy_cache", ".ruff_cache", ".tox", ".cache", ".gradle", ".nuget", "Pods", ".next", ".scannerwork", ".terraform",
]
TAKEN = [
    ".py", ".go", ".js", ".ts", ".tsx", ".jsx", ".java", ".kt", ".scala", ".cs", ".cpp", ".cxx", ".cc", ".c", ".h", ".hpp", ".rs", ".rb", ".php", ".m", ".mm",
    ".swift", ".proto", ".thrift", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".sql", ".sh", ".bash", ".zsh", ".ps1", ".gradle", ".sbt", ".cmake",
    ".pl", ".lua", ".md", ".rst", ".txt",
]
SYMBOL = r"(?i)^\s*(def |func |class |struct |interface |enum |module |namespace )(\w+)"


def extension(path: Column) -> Column:
    """The last dot and what follows it in a path's base name, lower-cased; empty for none and for a leading dot alone."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"[^/](\.[^./]+)$", 1))


def language_of(path: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, extension(path)), F.lit("text"))


def comment_sign(language: Column) -> Column:
    return F.when(language.isin("python", "bash", "zsh"), "#").when(language == "sql", "--").otherwise("//")


def wanted_files(files: DataFrame, allow: str | None = None, deny: str | None = None, depth: int = 0, most: int = 3_145_728) -> DataFrame:
    """Files (path, length) of a tree: no denied folder, a taken extension or none, of bounded size, by path rules."""
    parts, ext = F.split("path", "/"), extension(F.col("path"))
    rule = ~F.arrays_overlap(parts, F.array(*map(F.lit, DENIED))) & (ext.isin(*TAKEN) | (ext == "")) & (F.col("length") <= most)
    if allow:
        rule &= F.col("path").rlike(allow)
    if deny:
        rule &= ~F.col("path").rlike(deny)
    if depth > 0:
        rule &= F.size(parts) <= depth
    return files.where(rule)


def search_filter(languages: list[str] | None = None, part: str | None = None) -> Column:
    """Rows (path, lang) of the languages, in letters of either case, whose path holds ``part`` as it is written."""
    rule = F.lit(True)
    if languages:
        rule &= F.lower("lang").isin([x.strip().lower() for x in languages if x.strip()])
    return rule & F.contains("path", F.lit(part)) if part else rule


def blocks(files: DataFrame, symbol: str = SYMBOL, width: int = 180, overlap: int = 40) -> DataFrame:
    """The columns of ``files`` and lines, label, a, b: from each symbol's line to the next one's, else windows of lines.

    What stands before the first symbol is left out. No array is named inside another one's lambda, so each text is
    split once.
    """
    lined = files.withColumn("lines", F.filter(F.split("text", r"\r\n|\n|\r"), lambda x: x.isNotNull()))
    lined = lined.withColumn("lines", F.when((F.size("lines") > 0) & (F.element_at("lines", -1) == ""), F.slice("lines", 1, F.size("lines") - 1)).otherwise(F.col("lines")))
    starts = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("a"), x.alias("line"))), lambda x: x["line"].rlike(symbol))
    lined = lined.select("*", F.explode(F.array(F.struct(starts.alias("starts"), F.size("lines").alias("n")))).alias("s"))
    nexts = F.concat(F.transform(F.slice("s.starts", F.lit(2), F.greatest(F.lit(0), F.size("s.starts") - 1)), lambda x: x["a"]), F.array("s.n"))
    named = F.zip_with("s.starts", nexts, lambda x, b: F.struct(F.substring(F.trim(x["line"]), 1, 200).alias("label"), x["a"].alias("a"), b.alias("b")))
    plain = F.transform(windows_to_end(F.col("s.n"), width, overlap), lambda x: F.struct(F.concat(F.lit("slice:"), (x["a"] + 1).cast("string"), F.lit("-"), x["b"].cast("string")).alias("label"), x["a"].cast("int").alias("a"), x["b"].cast("int").alias("b")))
    found = lined.select("*", F.explode(F.when(F.size("s.starts") > 0, named).otherwise(plain)).alias("x"))
    return found.select(*files.columns, "lines", "x.label", "x.a", "x.b")


def chunks(files: DataFrame, repo: str = "", commit: str = "", target_tokens: int = 800, overlap_tokens: int = 120, url: str | None = None, **rules) -> DataFrame:
    """Files (path, text) as chunks: blocks under a header of four comment lines, sliced to about ``target_tokens`` tokens."""
    language = language_of(F.col("path"))
    found = blocks(files.select("path", "text", language.alias("lang")), **rules)
    sign = comment_sign(F.col("lang"))
    header = [F.concat(sign, F.lit(" path: "), "path"), F.concat(sign, F.lit(" lang: "), "lang"), F.concat(sign, F.lit(" symbol: "), "label"), F.concat(sign, F.lit(" lines: "), (F.col("a") + 1).cast("string"), F.lit("-"), F.col("b").cast("string"))]
    whole = found.select("path", "lang", F.col("label").alias("symbol"), (F.col("a") + 1).alias("line_start"), F.col("b").alias("line_end"), F.concat_ws("\n", *header, F.array_join(F.slice("lines", F.col("a") + 1, F.col("b") - F.col("a")), "\n")).alias("whole"))
    cuts = whole.select("*", F.posexplode(windows_to_end(F.length("whole"), 4 * target_tokens, 4 * overlap_tokens)).alias("slice_ix", "w"))
    text = F.substring(F.col("whole"), F.col("w.a").cast("int") + 1, (F.col("w.b") - F.col("w.a")).cast("int"))
    parts = [F.lit(x) for x in ("CODE", repo, commit[:12]) if x]
    lines = F.concat(F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"))
    link = filled_url(url, path=F.col("path"), line_start=F.col("line_start"), line_end=F.col("line_end")) if url else F.lit(None).cast("string")
    out = cuts.select(F.concat_ws(":", *parts, F.col("path"), lines).alias("id"), F.lit(f"CODE:{repo}" if repo else "CODE").alias("space"), F.element_at(F.split("path", "/"), -1).alias("title"), "path", "lang", "symbol", "line_start", "line_end", "slice_ix", text.alias("text"), link.alias("url"))
    return out.where(F.trim("text") != "")


def stem_edges(nodes: DataFrame, code: DataFrame, most: int = 32) -> DataFrame:
    """Edges (src, dst, why) from nodes (id, words: array) to the code nodes (id, stem) that a word names, at most ``most`` each.

    A node's least ``most`` neighbours are among the least of each of its stems (one more, as itself is left out), so
    every stem is cut to these, kept as one array, before words meet it: a word gives one row, however many nodes share a
    stem. A word of very many nodes is dealt over several tasks.
    """
    few = least_k(code.select("stem", F.col("id").alias("dst")), ["stem"], "dst", most + 1).groupBy("stem").agg(F.collect_list("dst").alias("dsts"))
    words = nodes.select(F.col("id").alias("src"), F.explode(F.array_distinct("words")).alias("stem"))
    near = dealt_join(words, few, "stem", "src").groupBy("src").agg(F.flatten(F.collect_list("dsts")).alias("dsts"))
    hits = first_k(near.select("src", F.explode(F.array_distinct("dsts")).alias("dst")), ["src"], "dst", most)
    return hits.where("src <> dst").select("src", "dst", F.lit("stem-match").alias("why"))


def co_stem_edges(code: DataFrame, most: int = 32) -> DataFrame:
    """Edges (src, dst, why) between the least ``most`` code nodes (id, stem) of each stem, both ways: at most most**2 a stem."""
    few = least_k(code, ["stem"], "id", most)
    a, b = few.select("stem", F.col("id").alias("src")), few.select("stem", F.col("id").alias("dst"))
    return a.join(b, "stem").where("src <> dst").select("src", "dst", F.lit("co-stem").alias("why")).distinct()


def outline(code: DataFrame) -> DataFrame:
    """Stem and the sorted ids of its code nodes (id, stem)."""
    return code.groupBy("stem").agg(F.array_sort(F.collect_list("id")).alias("ids"))
