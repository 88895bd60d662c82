"""Removal of every byte covered by a 400-byte string that occurs elsewhere, in this document or in any other.

1. Anchors. Of every 400-byte string, the 128-byte substring with the least hash is its anchor; equal strings have equal
   anchors at equal places. One anchor serves a run of neighbouring starts, so a text has about one for 137 bytes. Only
   anchors that two different texts hold, or one text twice, can matter.
2. Contexts. Such an anchor with the bytes its starts reach, 537 on average, is a context. Equal contexts are counted
   once, before any shuffle; a context met twice is repeated whole.
3. Suffix buckets. Contexts are dealt by anchor into buckets of bounded size; each bucket's suffixes are sorted by
   difference cover, block by block (see suffixes), and neighbours that agree on 400 bytes are repeated. An anchor in
   more than HOT different contexts would overfill a bucket, so a longer core takes its place: its strings are parted by
   how far they begin before it, into PARTS parts, each of these again and so on, and the bytes that all strings of a part
   have in common name the bucket. Pieces of contexts that are equal are one piece. The last parts have one start each, whose core is
   the whole string.
4. Verdicts go back from contexts to texts, and each text's spans are united.

Texts are keyed by two 64-bit hashes, and equal texts are handled once: of two or more, every byte is covered.

Passages of PASSAGE words go through the same four steps at once, a text being the sequence of its words' hashes (64 bit
for anchors, 32 bit for each word of a context):
a string of PASSAGE words counts if another document has it. They cost no byte; n_passage_words reports the words that
they cover, for passages of many short words that have fewer than 400 bytes.

Null and empty texts: no bytes, nothing removed. Repeated rows are copies of each other. Extra columns are ignored; a
null doc_id is carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.llm.common import shared_path, shuffle_partitions, table
from corpusql.llm.suffixes import repeated
from corpusql.llm.textops import Slice, WordSlice, slices, spans_union

DEPTH, GRAM = 400, 128
#: Words of a passage that repeats across documents, and of its anchor; no word has less than a byte and a blank.
PASSAGE, PASSAGE_GRAM = 51, 8
#: Bytes of one position, by kind: bytes of a text (0), words' hashes (1).
UNIT = (1, 4)
#: Tasks over which the contexts of one anchor are dealt while they are counted.
SALTS = 8
#: From so many rows of one context in a task on, further ones are dealt over SURPLUS tasks where verdicts return.
LOCAL_MET, SURPLUS = 32, 32
#: Into so many parts the strings of a frequent anchor, or of a longer core, are parted.
PARTS = 8
#: Different contexts of one anchor that a bucket takes; bytes of contexts in a bucket.
HOT, BUCKET_BYTES = 4096, 2 << 20
_LOW = np.uint64((1 << 24) - 1)


def anchors(s: Slice, depth: int = DEPTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(document, hash, first start, last start, own place) of each anchor of a slice, all positions in the slice."""
    n, width = len(s.data), depth - gram + 1
    empty = np.zeros(0, np.int64)
    if n < depth:
        return empty, np.zeros(0, np.uint64), empty, empty, empty
    s.sums(fold=False)
    at, chosen = [], []
    ends = np.repeat(s.offsets[1:], np.diff(s.offsets))
    for a in range(0, n - depth + 1, 1 << 18):
        b = min(n - depth + 1, a + (1 << 18))  # starts a..b-1, grams a..b+width-2
        g = np.arange(a, b + width - 1)
        key = (s.hashes(g, g + gram) & ~_LOW) | (g - a).astype(np.uint64)
        fill = -len(key) % width
        rows = np.concatenate([key, np.full(fill, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        low = np.minimum(behind[: b - a], ahead[width - 1 : width - 1 + b - a])
        starts = np.arange(a, b)
        fits = starts + depth <= ends[a:b]
        at.append(starts[fits])
        chosen.append((low[fits] & _LOW).astype(np.int64) + a)
    at, chosen = np.concatenate(at), np.concatenate(chosen)
    if not len(at):
        return empty, np.zeros(0, np.uint64), empty, empty, empty
    doc = np.searchsorted(s.offsets, at, "right") - 1
    new = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])))
    last = np.append(new[1:], len(at)) - 1
    where = chosen[new]
    return doc[new], s.hashes(where, where + gram), at[new], at[last], where


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text")).select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "text")


def _both(s: Slice, depth: int, gram: int) -> Iterator[tuple[int, int, Slice, tuple]]:
    """(kind, string length, slice, anchors) of the bytes of a slice and of its words; hashes of the kinds differ."""
    yield 0, depth, s, anchors(s, depth, gram)
    words = WordSlice(s)
    doc, h, *places = anchors(words, PASSAGE, PASSAGE_GRAM)
    yield 1, PASSAGE, words, (doc, h ^ np.uint64(0x5851F42D4C957F2D), *places)


def _long_enough(texts: DataFrame, depth: int) -> DataFrame:
    return texts.where(F.octet_length("text") >= min(depth, 2 * PASSAGE - 1))


def _anchor_rows(texts: DataFrame, depth: int, gram: int) -> DataFrame:
    """(h, salt, k1, k2, twice): the anchors of every text, each once.

    twice: its bytes have it again, or another text of the task has it, so it matters whatever other tasks hold. A task
    sends such an anchor once under salt 0, for the others to meet it, and its further rows under salts of their texts.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        sent = np.zeros(0, np.uint64)
        for batch in batches:
            k1, k2 = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            fresh = np.zeros(len(k1), bool)
            for i, key in enumerate(zip(k1.tolist(), k2.tolist(), strict=True)):
                if key not in seen:
                    seen.add(key)
                    fresh[i] = True
            for s in slices(batch.column(2)):
                for kind, _, _, (doc, h, *_) in _both(s, depth, gram):
                    own = fresh[s.first + doc]
                    doc, h = doc[own], h[own]
                    order = np.lexsort((h, doc))
                    doc, h = doc[order], h[order]
                    if not len(h):
                        continue
                    new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
                    twice = (np.diff(np.append(new, len(h))) > 1) & (kind == 0)
                    d, h = s.first + doc[new], h[new]
                    found, at, which, texts_of = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                    told = np.isin(found, sent)
                    met = (texts_of > 1) | told
                    surplus = met[which]
                    surplus[at[~told]] = False
                    salt = np.where(surplus, 1 + (k1[d] & 0x3FFFFFFF), 0).astype(np.int32)
                    sent = np.concatenate([sent, found[met & ~told]])
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(salt), pa.array(k1[d]), pa.array(k2[d]), pa.array(twice | met[which])], ["h", "salt", "k1", "k2", "twice"])

    return _long_enough(texts, depth).select("k1", "k2", "text").mapInArrow(each, "h bigint, salt int, k1 bigint, k2 bigint, twice boolean")


def _once(texts: DataFrame, depth: int) -> DataFrame:
    """(k1, k2, text), a text at most once from each task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keep = []
            for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keep.append(key not in seen)
                seen.add(key)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return _long_enough(texts, depth).select("k1", "k2", "text").mapInArrow(each, "k1 bigint, k2 bigint, text string")


def _name(kind: int, data: bytes) -> tuple[bytes, int, int]:
    """The name of a context or piece, and as two whole numbers."""
    name = hashlib.blake2b(data, digest_size=16, person=bytes([kind])).digest()
    return name, int.from_bytes(name[:8], "little", signed=True), int.from_bytes(name[8:], "little", signed=True)


def _contexts(held: DataFrame, depth: int, gram: int) -> DataFrame:
    """A row for each context of each text; the bytes only once for equal contexts of a task, salt 0 for the first of them.

    lead: the anchor's place in the context, in positions.
    """
    schema = "kind int, k1 bigint, k2 bigint, h bigint, c1 bigint, c2 bigint, start bigint, starts int, lead int, salt int, bytes binary"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            k1, k2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            wanted = batch.column(3)
            for s in slices(batch.column(2)):
                rows = []
                for kind, length, own, (doc, h, low, high, where) in _both(s, depth, gram):
                    for d in range(s.n_docs):
                        a, b = np.searchsorted(doc, [d, d + 1])
                        want = wanted[s.first + d].values.to_numpy().view(np.uint64)
                        for i in a + np.flatnonzero(np.isin(h[a:b], want)):
                            data = own.data[low[i] : high[i] + length].astype(np.uint32 if kind else np.uint8).tobytes()
                            name, c1, c2 = _name(kind, data)
                            before = seen.get(name, 0)
                            seen[name] = before + 1
                            salt = 0 if before < LOCAL_MET else 1 + k1[s.first + d] % SURPLUS
                            rows.append((kind, k1[s.first + d], k2[s.first + d], int(h[i].view(np.int64)), c1, c2, int(low[i] - own.offsets[d]), int(high[i] - low[i]) + 1, int(where[i] - low[i]), salt, None if before else data))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = [pa.int32(), *[pa.int64()] * 6, *[pa.int32()] * 3, pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["kind", "k1", "k2", "h", "c1", "c2", "start", "starts", "lead", "salt", "bytes"])

    return held.mapInArrow(each, schema)


def _sorted_bucket(depth: int):
    """Of one bucket's different contexts of one kind, the runs of starts that are repeated: (c1, c2, runs of first and last)."""

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["c1", "c2"])
        lengths = frame["starts"].to_numpy(np.int64)
        data = np.frombuffer(b"".join(frame["bytes"]), np.uint8)
        begin = np.concatenate([[0], np.cumsum([len(x) for x in frame["bytes"]])])[:-1]
        owner = np.repeat(np.arange(len(frame)), lengths)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        if frame["kind"].iloc[0]:
            hit = repeated(data, begin[owner] + within * UNIT[1], PASSAGE * UNIT[1], frame["low"].to_numpy()[owner], frame["high"].to_numpy()[owner])
        else:
            hit = repeated(data, begin[owner] + within, depth)
        owner, within = owner[hit], within[hit]
        if not len(owner):
            return pd.DataFrame({"c1": [], "c2": [], "runs": []}, dtype=object)
        new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (within[1:] != within[:-1] + 1)))
        last = np.append(new[1:], len(owner)) - 1
        runs = pd.DataFrame({"o": owner[new], "a": within[new], "b": within[last]})
        made = runs.groupby("o")[["a", "b"]].apply(lambda g: g.to_numpy().ravel().tolist())
        return pd.DataFrame({"c1": frame["c1"].to_numpy()[made.index], "c2": frame["c2"].to_numpy()[made.index], "runs": made.to_numpy()})

    return each


def _pieces(hot: DataFrame, size: tuple[int, int], depth: int) -> DataFrame:
    """Contexts of hot anchors by parts: starts that lie q * size to (q + 1) * size - 1 before the anchor are one piece.

    h names anchor, part and core, so equal strings of one anchor have one h. p1, p2 and at: the context that a piece is
    of, and its first start there. The bytes come once for equal pieces of a task.
    """
    schema = "kind int, p1 bigint, p2 bigint, at bigint, h bigint, c1 bigint, c2 bigint, starts int, lead int, low bigint, high bigint, bytes binary"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            for kind, h, p1, p2, starts, lead, low, high, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                unit, length, wide = UNIT[kind], PASSAGE if kind else depth, size[kind]
                for q in range((lead - starts + 1) // wide, lead // wide + 1):
                    first, last = max(0, lead - q * wide - wide + 1), min(starts - 1, lead - q * wide)
                    core = data[(lead - q * wide) * unit : (lead - q * wide - wide + 1 + length) * unit]
                    own = data[first * unit : (last + length) * unit]
                    key = hashlib.blake2b(core, digest_size=8, key=f"{h} {q} {wide}".encode()).digest()
                    name, c1, c2 = _name(kind, own)
                    fresh = name not in seen
                    seen.add(name)
                    rows.append((kind, p1, p2, first, int.from_bytes(key, "little", signed=True), c1, c2, last - first + 1, lead - first, low, high, own if fresh else None))
            if rows:
                kinds = [pa.int32(), *[pa.int64()] * 6, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                names = ["kind", "p1", "p2", "at", "h", "c1", "c2", "starts", "lead", "low", "high", "bytes"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return hot.select("kind", "h", "c1", "c2", "starts", "lead", "low", "high", "bytes").mapInArrow(each, schema)


def _verdicts(contexts: DataFrame, depth: int, gram: int, hot: int, bucket_bytes: int, level: int = 0) -> DataFrame:
    """(c1, c2, runs): which starts of each context are repeated, as first and last of runs. A context may have several rows."""
    spark = contexts.sparkSession
    # Different contexts, how often each was met and by which texts, and how many its anchor has.
    names = contexts.groupBy("kind", "h", "c1", "c2").agg(F.count("*").alias("met"), F.max("starts").alias("starts"), F.min("low").alias("low"), F.max("high").alias("high"))
    many = names.groupBy("h").agg(F.count("*").alias("different")).where("different > 1")
    many = many.withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
    salted = names.withColumn("salt", F.pmod("c1", F.lit(SALTS)).cast("int")).join(many, ["h", "salt"]).select("h", "c1", "c2", "low", "high", "different")
    met = F.when(F.col("kind") == 0, F.col("met") > 1).otherwise(F.col("low") < F.col("high"))
    whole = names.where(met).select("c1", "c2", F.array(F.lit(0).cast("long"), (F.col("starts") - 1).cast("long")).alias("runs"))
    held = contexts.where("bytes is not null")
    per_anchor = held.groupBy("h").agg(F.sum(F.octet_length("bytes")).alias("size"), F.count("*").alias("n"))
    size, most = per_anchor.agg(F.sum("size"), F.max("n")).first()
    buckets = max(shuffle_partitions(spark), -(-(size or 0) // bucket_bytes))
    widths = depth - gram + 1, PASSAGE - PASSAGE_GRAM + 1
    deeper = (most or 0) > hot and PARTS**level < max(widths)  # else pieces have one start, and a core is the string
    if deeper:
        path = shared_path(spark, "suffix-frequent")
        per_anchor.where(F.col("n") > hot).select("h").write.parquet(path)
        frequent = spark.read.parquet(path)
        held = held.join(frequent, "h", "left_anti")
    open_ = held.select("kind", "h", "c1", "c2", "starts", "bytes").join(salted, ["h", "c1", "c2"])
    cold = open_.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)))
    verdicts = whole.unionByName(cold.groupBy("bucket", "kind").applyInPandas(_sorted_bucket(depth), "c1 bigint, c2 bigint, runs array<bigint>"))
    if deeper:
        path = shared_path(spark, "suffix-pieces")
        of_frequent = contexts.join(frequent, "h", "left_semi").groupBy("kind", "h", "c1", "c2").agg(
            F.max("starts").alias("starts"), F.max("lead").alias("lead"), F.min("low").alias("low"), F.max("high").alias("high"), F.first("bytes", ignorenulls=True).alias("bytes")
        )
        _pieces(of_frequent, tuple(-(-w // PARTS ** (level + 1)) for w in widths), depth).write.parquet(path)
        pieces = spark.read.parquet(path)
        found = _verdicts(pieces, depth, gram, hot, bucket_bytes, level + 1)
        back = pieces.select("c1", "c2", "p1", "p2", "at").join(found, ["c1", "c2"])
        verdicts = verdicts.unionByName(back.select(F.col("p1").alias("c1"), F.col("p2").alias("c2"), F.expr("transform(runs, x -> x + at)").alias("runs")))
    return verdicts


def _spans(found: pa.ListArray, depth: int) -> tuple[np.ndarray, ...]:
    """(row, kind, start, end) of the repeated strings of a batch of texts, from the lists of what was found in each."""
    each = found.flatten()
    kind, start, runs = (each.field(k) for k in range(3))
    edges = runs.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
    owner = np.repeat(np.arange(len(each)), runs.value_lengths().to_numpy(zero_copy_only=False) // 2)
    row = np.repeat(np.arange(len(found)), found.value_lengths().to_numpy(zero_copy_only=False))[owner]
    kind, start = kind.to_numpy(zero_copy_only=False)[owner], start.to_numpy(zero_copy_only=False)[owner]
    return row, kind, start + edges[:, 0], start + edges[:, 1] + np.where(kind == 0, depth, PASSAGE)


def _removed(depth: int):
    """Of each text, what its repeated starts remove."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            row, kind, start, end = _spans(batch.column(3), depth)
            order = np.lexsort((kind, row))
            start, end = start[order], end[order]
            cuts = np.searchsorted((row * 2 + kind)[order], np.arange(2 * batch.num_rows + 1))
            keys = (batch.column(k).to_pylist() for k in range(2))
            for i, (k1, k2, text) in enumerate(zip(*keys, batch.column(2), strict=True)):
                data = text.as_py().encode()
                x, y, z = cuts[2 * i : 2 * i + 3]
                (a, b), (c, d) = spans_union(start[x:y], end[x:y]), spans_union(start[y:z], end[y:z])
                digest, at = hashlib.sha256(), 0
                for i, j in zip(a.tolist(), b.tolist(), strict=True):
                    digest.update(data[at:i])
                    at = j
                digest.update(data[at:])
                rows.append((k1, k2, int((b - a).sum()), len(a), digest.hexdigest(), int((d - c).sum())))
            if rows:
                kinds = [pa.int64()] * 4 + [pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["k1", "k2", "n_removed", "n_spans", "kept_sha256", "n_passage_words"])

    return each


def dedup(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_passage_words for each row of ``docs``. depth: a multiple of eight."""
    if depth % 8 or not 0 < gram <= depth:
        raise ValueError("depth must be a multiple of eight, and gram at most depth")
    spark = docs.sparkSession
    texts = _texts(docs)
    # Read twice, moved once: both readings ask for the same rows and columns, so Spark makes the exchange once.
    rows = _anchor_rows(texts, depth, gram).where("h is not null and k1 is not null and k2 is not null").repartition(F.col("h"), F.col("salt"))
    texts_of = rows.groupBy("h", "salt").agg(*(f(k).alias(f.__name__ + k) for f in (F.min, F.max) for k in ("k1", "k2")), F.max("twice").alias("twice"))
    shared = texts_of.where("mink1 < maxk1 or mink2 < maxk2 or twice").select("h", "salt")
    wanted = rows.join(shared, ["h", "salt"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("h", "twice")).alias("hs")).select("k1", "k2", F.col("hs.h").alias("hs"))
    path = shared_path(spark, "suffix-texts")
    _once(texts, depth).join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).write.parquet(path)
    held = spark.read.parquet(path)
    path = shared_path(spark, "suffix-contexts")
    _contexts(held.select("k1", "k2", "text", "hs"), depth, gram).write.parquet(path)
    contexts = spark.read.parquet(path)

    verdicts = _verdicts(contexts.withColumn("low", F.col("k1")).withColumn("high", F.col("k1")), depth, gram, hot, bucket_bytes)
    often = contexts.where("salt > 0").select("c1", "c2", F.lit(SURPLUS).alias("copies")).distinct()
    verdicts = verdicts.join(often, ["c1", "c2"], "left").withColumn("salt", F.explode(F.expr("sequence(0, coalesce(copies, 0))"))).drop("copies")
    per = contexts.select("kind", "k1", "k2", "c1", "c2", "start", "salt").join(verdicts, ["c1", "c2", "salt"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("kind", "start", "runs")).alias("found"))
    results = held.select("k1", "k2", "text").join(per, ["k1", "k2"]).mapInArrow(_removed(depth), "k1 bigint, k2 bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passage_words bigint")

    n_words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    narrow = texts.select("doc_id", "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes"), n_words.alias("n_words"), F.sha2("text", 256).alias("sha"))
    copies = narrow.groupBy("k1", "k2").agg(F.count("*").alias("copies")).where("copies > 1")
    out = narrow.join(copies, ["k1", "k2"], "left").join(results, ["k1", "k2"], "left")
    copied = F.col("copies").isNotNull() & (F.col("n_bytes") >= depth)
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(F.col("copies").isNotNull() & (F.col("n_words") >= PASSAGE), F.col("n_words")).otherwise(F.coalesce("n_passage_words", F.lit(0))).alias("n_passage_words"),
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
