"""A stored full-text index with positions, written once and read by the words of a query.

Below its path:

* ``docs``: id, space, type, title and each field's length and different terms, with the positions of each;
* ``postings``, a folder for each bucket of terms: term, id, field, tf, positions, the field's and the document's
  length, and the field's place behind the title, sorted by term;
* ``vocabulary``: for every way to look a term up (as it is written, without marks, by its English stem) the key, the
  term, its bucket, documents' fields and occurrences, sorted by key;
* ``stats``: one row with documents, mean lengths and buckets.

Texts are tokenised once, and each field's tokens are grouped where they are read, so one row for each term of a field moves
and nothing is aggregated behind the shuffle. The number of buckets and of tasks follows the tokens: a bucket holds about
TOKENS_IN_BUCKET, and where there are more than MOST_BUCKETS times that, a bucket's rows are dealt over several tasks by id.
The vocabulary is counted first: a term that alone has more than TOKENS_IN_BUCKET occurrences is dealt over as many tasks
as it would fill, so a frequent term is not one task's. A look-up reads the keys' rows of the vocabulary and the buckets
that these name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.functions.stemming import is_stop_word, stemmed
from corpusql.functions.text import folded, tokens
from corpusql.session import cut, shared_path

FIELDS = ("id", "title", "text")
ID, TITLE, TEXT = range(3)
TOKENS_IN_BUCKET, MOST_BUCKETS = 500_000, 4096
#: Told when reading, as an empty table has no files to tell them.
POSTINGS = "term string, id string, field int, tf int, positions array<int>, length int, base int, doc_length int, bucket int"
VOCABULARY = "kind string, key string, term string, bucket int, fields long, occurrences long"


@dataclass(frozen=True)
class Index:
    """A stored index: its path, the documents' number and the mean lengths by field and over all fields."""

    spark: SparkSession
    path: str
    n: int
    means: tuple[float, ...]
    mean: float

    def docs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/docs").select("id", "space", "type", "title")

    def all_postings(self) -> DataFrame:
        return self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")

    def vocabulary(self) -> DataFrame:
        return self.spark.read.schema(VOCABULARY).parquet(f"{self.path}/vocabulary")

    def look_up(self, keys: list[str], kind: str) -> dict[str, list[tuple[str, int]]]:
        """Terms and buckets of each key. kind: 'term', 'folded' or 'stem'. As many rows as the words of a query have forms."""
        rows = self.vocabulary().where((F.col("kind") == kind) & F.col("key").isin(keys)) if keys else None
        found: dict[str, list[tuple[str, int]]] = {k: [] for k in keys}
        for r in rows.select("key", "term", "bucket").collect() if keys else []:
            found[r.key].append((r.term, r.bucket))
        return found

    def postings(self, found: dict[str, list[tuple[str, int]]]) -> DataFrame | None:
        """The postings of the terms looked up, each with its key; None where there is no term."""
        terms = {t: k for k, pairs in found.items() for t, _ in pairs}
        if not terms:
            return None
        rows = self.all_postings().where(F.col("bucket").isin(sorted({b for pairs in found.values() for _, b in pairs})) & F.col("term").isin(sorted(terms)))
        return rows.withColumn("key", F.element_at(F.create_map(*(F.lit(x) for pair in terms.items() for x in pair)), F.col("term")))


def _firsts(places: str) -> Column:
    """Where each term begins among places (term, position) that are sorted."""
    at = F.transform(places, lambda x, i: F.struct(x["term"].alias("term"), i.alias("i")))
    return F.transform(F.filter(at, lambda x: (x["i"] == 0) | (x["term"] != F.get(F.col(places), x["i"] - 1)["term"])), lambda x: x["i"])


def _groups(places: str, firsts: str) -> Column:
    """Each term of sorted places with its positions."""

    def group(a: Column, k: Column) -> Column:
        n = F.coalesce(F.get(F.col(firsts), k + 1), F.size(places)) - a
        return F.struct(F.get(F.col(places), a)["term"].alias("term"), F.transform(F.slice(places, a + 1, n), lambda x: x["position"]).alias("positions"))

    return F.transform(firsts, group)


def build(docs: DataFrame, path: str) -> Index:
    """Writes the index of docs (id, space, type, title, text)."""
    spark = docs.sparkSession
    made = [tokens(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in FIELDS]
    # Explode keeps the sorted tokens as columns of their own, so that their groups do not split and sort the text again.
    places = [F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("term"), i.alias("position")))).alias(f"s{k}") for k, w in enumerate(made)]
    split = docs.select(F.col("id").cast("string").alias("id"), "space", "type", "title", F.explode(F.array(F.struct(*places))).alias("_t")).select("id", "space", "type", "title", "_t.*")
    first = split.select("*", F.explode(F.array(F.struct(*(_firsts(f"s{k}").alias(f"a{k}") for k in range(3))))).alias("_a")).select(*split.columns, "_a.*")
    first.select("id", "space", "type", "title", *(_groups(f"s{k}", f"a{k}").alias(f"g{k}") for k in range(3)), *(F.size(f"s{k}").alias(f"n{k}") for k in range(3))).write.parquet(f"{path}/docs")
    stored = spark.read.parquet(f"{path}/docs")
    every = F.col("n0") + F.col("n1") + F.col("n2")
    total, n, mean, *means = stored.agg(F.coalesce(F.sum(every), F.lit(0)), F.count("*"), F.avg(every), *(F.avg(f"n{k}") for k in range(3))).first()
    buckets = max(1, min(MOST_BUCKETS, total // TOKENS_IN_BUCKET))
    deal = max(1, total // (buckets * 4 * TOKENS_IN_BUCKET))
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")

    terms = stored.select(F.explode(F.concat(*(F.transform(f"g{k}", lambda g: F.struct(g["term"].alias("term"), F.size(g["positions"]).alias("tf"))) for k in range(3)))).alias("t"))
    known = terms.groupBy("t.term").agg(F.count("*").alias("fields"), F.sum("t.tf").alias("occurrences")).select("*", bucket)
    keys = F.array(*(F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in (("term", F.col("term")), ("folded", folded(F.col("term"))), ("stem", stemmed(F.col("term"))))))
    # Stemmed once a term: the range partitions' sample and the sort would each do it again.
    listed = cut(known.select(F.explode(keys).alias("k"), "term", "bucket", "fields", "occurrences").select("k.kind", "k.key", "term", "bucket", "fields", "occurrences"))
    listed.repartitionByRange(max(1, buckets // 8), "kind", "key").sortWithinPartitions("kind", "key").write.parquet(f"{path}/vocabulary")

    # At most total / TOKENS_IN_BUCKET terms.
    frequent = listed.where((F.col("kind") == "term") & (F.col("occurrences") > TOKENS_IN_BUCKET)).select("term", F.ceil(F.col("occurrences") / TOKENS_IN_BUCKET).cast("int").alias("parts"))
    extra = frequent.agg(F.coalesce(F.sum("parts"), F.lit(0))).first()[0]
    fields = F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.col(f"n{k}").alias("length"), (F.col("n1") if k == TEXT else F.lit(0)).alias("base"), F.col(f"g{k}").alias("g")) for k in range(3)))).alias("f")
    words = stored.select("id", every.alias("doc_length"), fields).select("id", "doc_length", "f.field", "f.length", "f.base", F.explode("f.g").alias("g"))
    rows = words.select(F.col("g.term").alias("term"), "id", "field", F.size("g.positions").alias("tf"), F.col("g.positions").alias("positions"), "length", "base", "doc_length")
    part = F.pmod(F.xxhash64("id"), F.greatest(F.lit(deal), F.coalesce("parts", F.lit(1))))
    dealt = rows.join(F.broadcast(frequent), "term", "left").select(*rows.columns, bucket, part.alias("part")).repartition(buckets * deal + extra, "bucket", "part").drop("part")
    dealt.sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(f"{path}/postings")

    mean, means = mean or 0.0, [m or 0.0 for m in means]
    spark.createDataFrame([(n, mean, means, buckets)], "n long, mean double, means array<double>, buckets long").coalesce(1).write.parquet(f"{path}/stats")
    return Index(spark, path, n, tuple(means), mean)


def opened(spark: SparkSession, path: str) -> Index:
    """An index that ``build`` has written."""
    s = spark.read.parquet(f"{path}/stats").first()
    return Index(spark, path, s.n, tuple(s.means), s.mean)


_BUILT: dict[tuple, Index] = {}


def _is_there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def of_table(spark: SparkSession, name: str, source: DataFrame, docs: Callable[[], DataFrame]) -> Index:
    """The index of ``docs``, which come from the files of ``source``: built where this session has none of these files."""
    files = source.select(F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("h"))
    key = (spark.sparkContext.applicationId, name, *map(str, files.agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)"))).first()))
    if key not in _BUILT or not _is_there(spark, f"{_BUILT[key].path}/stats/_SUCCESS"):
        path = shared_path(spark, f"index-{name}")
        _BUILT[key] = build(docs(), path)
    return _BUILT[key]


def stop_words_out(frame: DataFrame, column: str) -> DataFrame:
    return frame.where(~is_stop_word(F.col(column)))
