"""N-gram Jaccard join by size-aware keys: fixed-size subsets for small sets, posting lists for large ones.

A document's set holds the hashes (64 bit) of its distinct three-word shingles. Two sets of sizes a and b with Jaccard
similarity t or more share at least ceil(t / (1 + t) * (a + b)) elements.

* Light sets (at most ``boundary`` elements): every set lists all its subsets of exactly that many elements, once for
  each size a partner may have; two linked sets list a common subset.
* Heavy sets: the elements are dealt by hash into P groups, and inverted lists are kept of whole groups (their number
  and everything in them), not of single elements. Two linked sets differ in at most k elements, so in at most k groups;
  in one order of all groups the least common one is then among the first k + 1 of both, and only those have lists. The
  order is by the number of elements in a group that are not hot, most first. P comes from a geometric grid over the k
  that partners of a set may have, so a set has lists for one P or two.
* Hot elements make at least one in 2**18 of all occurrences. Their number is bounded by 2**18, so they are broadcast.
* The boundary is where the expected cost of keys is least, from the histogram of set sizes.

Equal sets are one class before anything else. Classes that share a key hang together with the least class of that key
(a star, never all pairs); the components of these stars are candidate clusters, which hold every link whole. A cluster
is verified exactly, all against all, as one product of 0/1 matrices over the elements that occur twice in it. Clusters
over ``tile`` classes are cut into pairs of tiles, which go to different tasks and return a spanning forest of their
links; a second run of components joins these. No candidate is dropped and no partner capped.

Null or empty texts have no set: n_shingles 0, linked with nothing, a component each. Repeated rows are equal sets and
so linked. A null doc_id is not linked: it has no component. Extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.llm.common import components, cut, shuffle_partitions, table
from corpusql.llm.textops import Slice, mix, slices, windows

#: A cluster over TILE classes or TILE_ELEMENTS elements is verified tile by tile.
TILE, TILE_ELEMENTS = 2048, 4_000_000
#: Elements of one batch; a batch's counts from LOCAL_HOT on add up to those of hot elements.
BATCH, LOCAL_HOT = 2_000_000, 8
#: The numbers of groups are FIRST_GROUPS * GRID ** i; a set has at least SPREAD as many groups as it lists.
GRID, SPREAD = 1.5, 1.1
#: Elements of the texts that one task verifies.
VERIFIED = 4_000_000
#: Tasks over which the rows of one class are dealt.
SALTS = 8
#: The most hot elements; at one in so many of all occurrences an element is hot.
HOT = 1 << 18
#: Rows (28 bytes each) up to which the members of clusters are broadcast; beyond it the texts are shuffled to them.
MOST_BROADCAST = 1_000_000
#: Edges of one part of which a spanning forest is kept.
EDGES = 250_000
#: Sizes up to here may be light: beyond it, subsets of a set outnumber any posting lists.
MOST_LIGHT = 24


def _ratio(percent: int, a: int, b: int) -> int:
    """The least number of common elements with which sets of sizes a and b are linked."""
    return -(-percent * (a + b) // (100 + percent))


def _on_grid(least: float) -> int:
    return math.ceil(GRID ** math.ceil(math.log(least, GRID) - 1e-9))


def linked(percent: int, a, b, common):
    return 100 * common >= percent * (a + b - common)


class Keys:
    """Keys of a set for one threshold and boundary, and what they cost."""

    def __init__(self, percent: int, boundary: int):
        self.percent, self.boundary = percent, boundary
        self._plans: dict[int, list] = {}
        self._groups: dict[int, list] = {}

    def partners(self, n: int) -> range:
        return range(-(-self.percent * n // 100), 100 * n // self.percent + 1)

    def subsets(self, n: int) -> list[tuple[int, int]]:
        """(tag of the two sizes, number of elements left out) for each size of a light partner."""
        if n not in self._plans:
            plan = []
            for m in self.partners(n):
                c = _ratio(self.percent, n, m)
                if m <= self.boundary and c <= min(n, m):
                    plan.append((min(n, m) * 1_000_003 + max(n, m), n - c))
            self._plans[n] = plan
        return self._plans[n]

    def groups(self, n: int) -> list[tuple[int, int]]:
        """(P, how many groups a set of n elements lists) for each number of groups P that a partner's size asks for."""
        if n not in self._groups:
            plan: dict[int, int] = {}
            for m in self.partners(n):
                listed = n + m - 2 * _ratio(self.percent, n, m) + 1
                if listed > 0:
                    of = _on_grid(SPREAD * listed)
                    plan[of] = max(plan.get(of, 0), listed)
            self._groups[n] = sorted(plan.items())
        return self._groups[n]

    def is_heavy(self, n):
        """Whether a set of n elements may have a partner over the boundary, or is one itself."""
        return n * 100 > self.percent * self.boundary

    def light_cost(self, n: int) -> int:
        return sum(math.comb(n, left) for _, left in self.subsets(n))

    def heavy_cost(self, n: int) -> int:
        return sum(listed for _, listed in self.groups(n))

    def light(self, elements: np.ndarray) -> np.ndarray:
        """The keys of all listed subsets of one light set (distinct uint64)."""
        values = mix(elements ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        total, out = values.sum(dtype=np.uint64), [np.zeros(0, np.uint64)]
        for tag, left in self.subsets(len(elements)):
            sums = np.array([sum(map(int, c)) & 0xFFFFFFFFFFFFFFFF for c in combinations(values, left)], np.uint64) if left else np.zeros(1, np.uint64)
            out.append(mix((total - sums) ^ mix(np.array([tag], np.uint64))))
        return np.concatenate(out)


class HotElements:
    """The hot elements by hash, with their counts."""

    def __init__(self, names: np.ndarray, counts: np.ndarray):
        order = np.argsort(names)
        self.names, self.counts = names[order], counts[order]

    def count(self, elements: np.ndarray) -> np.ndarray:
        """Of each element its count, 0 where it is not hot."""
        if not len(self.names):
            return np.zeros(len(elements), np.int64)
        at = np.minimum(np.searchsorted(self.names, elements), len(self.names) - 1)
        return np.where(self.names[at] == elements, self.counts[at], 0)


def boundary_by_cost(percent: int, histogram: dict[int, int]) -> int:
    """The boundary with the fewest keys in all, given how many sets have each size."""
    every = Keys(percent, MOST_LIGHT)
    best, least, saved = 0, 0, 0
    for n in range(1, MOST_LIGHT + 1):
        saved += histogram.get(n, 0) * (every.light_cost(n) - every.heavy_cost(n))
        if saved <= least:
            best, least = n, saved
    return best


def shingle_sets(s: Slice, k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all documents of a slice, by document, and where each document's begin."""
    starts, ends, docs = s.words()
    s.sums(fold=True)
    words = s.hashes(starts, ends)
    n = np.bincount(docs, minlength=s.n_docs)
    begin = np.concatenate([[0], np.cumsum(n)])
    keys, at = windows(words, docs, k)
    short = np.flatnonzero((n > 0) & (n < k))
    whole = []
    for d in short:
        h = np.uint64(n[d])
        for w in words[begin[d] : begin[d + 1]]:
            h = mix(np.array([h ^ w], np.uint64))[0]
        whole.append(h)
    keys = np.concatenate([keys, np.array(whole, np.uint64)])
    owner = np.concatenate([docs[at], short])
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))[: len(keys)]
    keys, owner = keys[new], owner[new]
    return keys, np.searchsorted(owner, np.arange(s.n_docs + 1))


def _digests(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, size of the set and two sums that name the set; also rows of size null, d1 an element and d2 its count in a batch."""
    names = ["doc_id", "n_shingles", "d1", "d2"]

    def often(held: list[np.ndarray]) -> pa.RecordBatch:
        found, count = np.unique(np.concatenate(held), return_counts=True)
        found, count = found[count >= LOCAL_HOT], count[count >= LOCAL_HOT]
        none = pa.nulls(len(found), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(found.view(np.int64)), pa.array(count)], names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            n, one, two = [], [], []
            for s in slices(batch.column(1)):
                keys, at = shingle_sets(s, k)
                n.append(np.diff(at))
                held.append(keys)
                size += len(keys)
                if size >= BATCH:
                    yield often(held)
                    held, size = [], 0
                for salt, out in ((0x1234567, one), (0x89ABCDEF, two)):
                    run = np.zeros(len(keys) + 1, np.uint64)
                    np.cumsum(mix(keys ^ np.uint64(salt)), out=run[1:])
                    out.append((run[at[1:]] - run[at[:-1]]).view(np.int64))
            if n:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n)), pa.array(np.concatenate(one)), pa.array(np.concatenate(two))], names)
        if size:
            yield often(held)

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint")


def _own_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Ids and sets, in batches of BATCH elements or little more; within a task equal sets come once, under any of their rows."""
    seen: set[bytes] = set()
    ids, sets, size = [], [], 0
    for batch in batches:
        names = batch.column(0).to_pylist()
        for s in slices(batch.column(1)):
            found, at = shingle_sets(s, k)
            for d in np.flatnonzero(np.diff(at) > 0):
                own = found[at[d] : at[d + 1]]
                name = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                if names[s.first + d] is None or name in seen:
                    continue
                seen.add(name)
                ids.append(names[s.first + d])
                sets.append(own)
                size += len(own)
            if size >= BATCH:
                yield ids, sets
                ids, sets, size = [], [], 0
    if ids:
        yield ids, sets


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for each range, one after another."""
    return np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)


def group_keys(sets: list[np.ndarray], keys: Keys, hot: HotElements) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the groups that heavy sets (sorted, distinct) list, and which set each is of."""
    rows = [(i, of, listed) for i, x in enumerate(sets) for of, listed in keys.groups(len(x))]
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    which, of, listed = np.array(rows, np.int64).T
    length = np.array([len(x) for x in sets])
    every, first = np.concatenate(sets), np.cumsum(length) - length
    plain = hot.count(every) == 0
    size = length[which]
    take, row = _ranges(first[which], size), np.repeat(np.arange(len(which)), size)
    element = every[take]
    base = np.cumsum(of) - of
    # A group is a range of hashes, so sorted elements come group by group.
    place = base[row] + (((element >> np.uint64(32)) * of[row].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    total = int(of.sum())
    new = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    held = np.zeros(total, np.uint64)
    held[place[new]] = np.add.reduceat(mix(element ^ np.uint64(0x4F1BBCDCBFA53E0A)), new)
    unusual = np.bincount(place[plain[take]], minlength=total)
    owner = np.repeat(np.arange(len(which)), of)
    number = (np.arange(total) - base[owner]).astype(np.uint64) | (of[owner].astype(np.uint64) << np.uint64(32))
    name = mix(held ^ mix(number))
    order = np.lexsort((name, -unusual, owner))
    kept = order[np.arange(total) - base[owner] < listed[owner]]
    return name[kept], which[owner[kept]]


def _all_keys(docs: DataFrame, k: int, keys: Keys, hot) -> DataFrame:
    """(key, doc_id): of light sets the subsets, of heavy ones the groups."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: HotElements = hot.value
        for ids, sets in _own_sets(batches, k):
            names = np.array(ids, np.int64)
            size = np.array([len(x) for x in sets])
            chosen = np.flatnonzero(keys.is_heavy(size))
            found, owner = group_keys([sets[i] for i in chosen], keys, table)
            out = [(found, names[chosen][owner])]
            for i in np.flatnonzero(size <= keys.boundary):
                own = keys.light(sets[i])
                out.append((own, np.full(len(own), names[i])))
            found, owner = (np.concatenate(x) for x in zip(*out, strict=True))
            for a in range(0, len(found), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(found[a : a + (1 << 18)].view(np.int64)), pa.array(owner[a : a + (1 << 18)])], ["key", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(each, "key bigint, doc_id bigint")


def _products(sets: list[np.ndarray], rows: int, most: int = 8_000_000) -> Iterator[np.ndarray]:
    """0/1 matrices of the sets (rows) over elements that occur twice or more, a few columns at a time."""
    lengths = [len(x) for x in sets]
    values, owner = np.concatenate(sets), np.repeat(np.arange(rows), lengths)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.append(True, values[1:] != values[:-1])
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1
    owner, column = owner[often], column[often]
    if not len(owner):
        return
    column = np.cumsum(np.append(True, column[1:] != column[:-1])) - 1
    width = max(1, most // rows)
    for low in range(0, int(column[-1]) + 1, width):
        a, b = np.searchsorted(column, [low, low + width])
        m = np.zeros((rows, min(width, int(column[-1]) + 1 - low)), np.float32)
        m[owner[a:b], column[a:b] - low] = 1
        yield m


def links_within(sets: list[np.ndarray], percent: int, split: int | None = None) -> np.ndarray:
    """Which pairs are linked, as a boolean matrix; with split, only of the first ``split`` sets with the others."""
    rows, left = len(sets), slice(0, split)
    right = slice(split or 0, None)
    size = np.array([len(x) for x in sets], np.float64)
    common = np.zeros((len(size[left]), len(size[right])), np.float32)
    for m in _products(sets, rows):
        common += m[left] @ m[right].T
    return linked(percent, size[left][:, None], size[right][None, :], common.astype(np.float64))


def _labels(near: np.ndarray) -> np.ndarray:
    """Of each row of a symmetric matrix of links the least row that it hangs together with."""
    label = np.arange(len(near))
    while True:
        least = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1, initial=len(near)))
        np.minimum.at(least, label, least)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _fewer_edges(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components: a spanning forest of each part. A set has no more edges than keys, so parts by b have no hot one."""
    edges = cut(edges)
    parts = max(4, edges.count() // EDGES)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        for batch in batches:
            kept = []
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = parent.setdefault(a, a), parent.setdefault(b, b)
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                while parent[y] != y:
                    parent[y] = y = parent[parent[y]]
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    kept.append((a, b))
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*kept, strict=True)], ["a", "b"])

    return edges.repartition(parts, "b").mapInArrow(each, "a bigint, b bigint")


def jaccard_join(docs: DataFrame, percent: int = 90, k: int = 3, tile: int = TILE, tile_elements: int = TILE_ELEMENTS) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (documents linked with this one) for each row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = cut(_digests(docs, k))
    digests = found.where("n_shingles is not null")
    total = digests.agg(F.sum("n_shingles")).first()[0] or 0
    hot_rows = found.where("n_shingles is null").groupBy("d1").agg(F.sum("d2").alias("n")).where(F.col("n") * HOT >= total).collect()  # at most HOT
    hot = spark.sparkContext.broadcast(HotElements(np.array([r[0] for r in hot_rows], np.int64).view(np.uint64), np.array([r[1] for r in hot_rows], np.int64)))
    named = digests.where("n_shingles > 0 and doc_id is not null")
    classes = named.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    small = classes.where(F.col("n_shingles") <= MOST_LIGHT).groupBy("n_shingles").count().collect()
    keys = Keys(percent, boundary_by_cost(percent, {r[0]: r[1] for r in small}))
    met = classes.where("copies > 1").withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
    salted = named.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    of_doc = salted.join(met, ["n_shingles", "d1", "d2", "salt"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"), "n_shingles")
    of_doc = cut(of_doc)
    parts = max(shuffle_partitions(spark), 16)
    # Read twice, moved once: both readings ask for the same rows and columns, so Spark makes the exchange once.
    listed = _all_keys(docs, k, keys, hot).where("key is not null and doc_id is not null").repartition(F.col("key"))
    stars = listed.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key", "low")
    edges = listed.join(stars, "key").where("doc_id <> low").select(F.col("low").alias("a"), F.col("doc_id").alias("b"))
    edges = _fewer_edges(edges)
    to_class = of_doc.select("doc_id", "class_id").where("doc_id <> class_id").distinct()
    for side in ("a", "b"):
        edges = edges.join(to_class.withColumnRenamed("doc_id", side), side, "left").withColumn(side, F.coalesce("class_id", side)).drop("class_id")
    clusters = components(edges).withColumnRenamed("node", "class_id").withColumnRenamed("component", "cluster")
    info = of_doc.where("doc_id = class_id").select("class_id", "copies", "n_shingles").distinct()
    members = clusters.join(info, "class_id")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("elements"))
    sizes = sizes.withColumn("tiles", F.greatest(F.ceil(F.col("m") / tile), F.ceil(F.col("elements") / tile_elements)).cast("int"))
    members = cut(members.join(sizes.select("cluster", "tiles"), "cluster"))
    wanted = members.withColumnRenamed("class_id", "doc_id").drop("n_shingles")
    count, elements = members.agg(F.count("*"), F.sum("n_shingles")).first()
    if count <= MOST_BROADCAST:  # then only the members' texts move
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, "doc_id").dropDuplicates(["doc_id"])
    texts = texts.withColumn("tile", F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int"))
    lone = texts.where("tiles = 1").withColumn("task", F.pmod(F.xxhash64("cluster"), F.lit(max(parts, 4 * -(-(elements or 0) // VERIFIED)))))
    exact = lone.groupBy("task").applyInPandas(_verify(percent, k), "class_id bigint, component bigint, links bigint")
    pairs = F.explode(F.expr("transform(sequence(0, tiles - 1), x -> struct(least(x, tile) as i, greatest(x, tile) as j))"))
    tiled = texts.where("tiles > 1").withColumn("p", pairs).select("*", "p.i", "p.j").drop("p")
    tiled = cut(tiled.groupBy("cluster", "i", "j").applyInPandas(_verify_tiles(percent, k), "class_id bigint, other bigint, links bigint"))
    if tiled.limit(1).count():
        joined = components(tiled.where("other is not null").select(F.col("class_id").alias("a"), F.col("other").alias("b")))
        links = tiled.groupBy("class_id").agg(F.sum("links").alias("links"))
        far = links.join(joined.withColumnRenamed("node", "class_id"), "class_id", "left").select("class_id", F.coalesce("component", "class_id").alias("component"), "links")
        exact = exact.unionByName(far)
    out = of_doc.join(exact, "class_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    rest = digests.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(rest)


def _sets(frame: pd.DataFrame, k: int) -> list[np.ndarray]:
    out = []
    for s in slices(pa.array(frame["text"], pa.string())):
        keys, at = shingle_sets(s, k)
        out += [keys[at[d] : at[d + 1]].copy() for d in range(s.n_docs)]
    return out


def _verify(percent: int, k: int):
    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, g in frame.sort_values(["cluster", "doc_id"]).groupby("cluster", sort=False):
            ids, copies = g["doc_id"].to_numpy(), g["copies"].to_numpy()
            near = links_within(_sets(g, k), percent)
            np.fill_diagonal(near, False)
            rows.append(pd.DataFrame({"class_id": ids, "component": ids[_labels(near)], "links": near @ copies}))
        return pd.concat(rows) if rows else pd.DataFrame({"class_id": [], "component": [], "links": []})

    return verify


def _verify_tiles(percent: int, k: int):
    """Links between tile i and tile j of a cluster: edges that span their components, and each class's number of linked documents."""

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
        frame = frame.sort_values(["tile", "doc_id"])
        ids, copies = frame["doc_id"].to_numpy(), frame["copies"].to_numpy()
        sets = _sets(frame, k)
        if i == j:
            near = links_within(sets, percent)
            np.fill_diagonal(near, False)
            label, links = _labels(near), near @ copies
        else:
            split = int((frame["tile"] == i).sum())
            if not 0 < split < len(ids):
                return pd.DataFrame({"class_id": [], "other": [], "links": []})
            near = links_within(sets, percent, split)
            both = np.zeros((len(ids), len(ids)), bool)
            both[:split, split:], both[split:, :split] = near, near.T
            label = _labels(both)
            links = np.concatenate([near @ copies[split:], copies[:split] @ near])
        hung = np.flatnonzero(label != np.arange(len(ids)))
        counts = pd.DataFrame({"class_id": ids, "other": None, "links": links})
        return pd.concat([counts, pd.DataFrame({"class_id": ids[hung], "other": ids[label[hung]], "links": 0})]).astype({"other": "Int64"})

    return verify


def keep_first_of_group(docs: DataFrame, percent: int = 90, k: int = 3) -> DataFrame:
    """The rows of ``docs``, of each component only the document with the smallest doc_id."""
    joined = jaccard_join(docs, percent, k)
    gone = joined.where("component_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
