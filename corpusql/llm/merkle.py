"""A Merkle manifest of a table: a tree for each language over its documents, one over the languages, and proofs.

Nodes carry the interval of leaf ranks that they cover. Leaves are ranked within their group by a range partitioning and
offsets of its parts, so no group is ever one task's. The tree is built upwards in strides of ``span`` levels: members of a
stride are bucketed by the interval of the block that holds them (2**span members at most), and a block's nodes are hashed
together. Proofs come downwards: members meet the nodes of their block by containment of intervals, which attaches all
their ancestors; what a parent's interval covers besides the node's own is its sibling. The path of a block's highest
node was found in the stride before, so it is put behind. Proofs are as long as the tree is high; they move only once, out of
the last stride.

H is the lower-case hex SHA-256 of its inputs end to end. A run of two consecutive nodes becomes their H, a last single
one the H of itself; a group of one leaf has that leaf as its root. A path entry is a sign and a sibling's digest: L
left of the node, R right of it, a dash alone where the run has no other.

Null fields: a dash. A null language is a group of its own and comes first. Null doc_ids come first; rows that share a
doc_id are ordered by their leaf, equal rows are interchangeable and each has a rank. Empty tables: no rows, no root. Long
texts are hashed inside the JVM. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusql.llm.common import cut, table

SPAN, ROWS = 10, 100_000
_NODES = "grp string, total bigint, level int, lo bigint, hi bigint, digest string"


def field(value: Column) -> Column:
    """A field as it enters a leaf: its UTF-8 bytes' number, a colon and its value, or a dash."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def ranked(rows: DataFrame, order: list[str], n_rows: int) -> DataFrame:
    """``rows`` (grp and more) with lo = hi, the rank from 0 within grp by ``order``, and total, the group's size; written down."""
    keys = ["grp", *order, "_tie"]
    tied = rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    dealt = tied.repartitionByRange(max(1, -(-n_rows // ROWS)), *keys).sortWithinPartitions(*keys)
    placed = cut(dealt.withColumn("_place", F.monotonically_increasing_id()).drop("_tie").withColumns({"_part": F.shiftright("_place", 33), "_place": F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))}))
    firsts = placed.groupBy("grp", "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    one = Window.partitionBy("grp")  # a row a partition
    before = F.coalesce(F.sum("_n").over(one.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = firsts.select("grp", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(one).alias("total"))
    lo = F.col("_place") + F.col("_shift")
    return placed.join(firsts, ["grp", "_part"]).select(*rows.columns, "total", lo.alias("lo"), lo.alias("hi"))


def _height(total: int) -> int:
    return (int(total) - 1).bit_length()


def _block_of(stride: int, span: int, lo: str = "lo") -> Column:
    return F.shiftright(lo, span * (stride + 1)).alias("block")


def _nodes_of(stride: int, span: int):
    """Hashes a block of members up to the block's highest level, or to the group's root."""

    def build(key: tuple, members: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("lo")
        total, base = int(members["total"].iloc[0]), span * stride
        lo, hi, digest = members["lo"].tolist(), members["hi"].tolist(), members["digest"].tolist()
        rows = [pd.DataFrame({"level": base, "lo": lo, "hi": hi, "digest": digest})]
        for level in range(base, min(base + span, _height(total))):
            heads = range(0, len(lo), 2)
            digest = [hashlib.sha256("".join(digest[i : i + 2]).encode()).hexdigest() for i in heads]
            lo, hi = [lo[i] for i in heads], [hi[min(i + 1, len(hi) - 1)] for i in heads]
            rows.append(pd.DataFrame({"level": level + 1, "lo": lo, "hi": hi, "digest": digest}))
        return pd.concat(rows).assign(grp=key[0], total=total)[["grp", "total", "level", "lo", "hi", "digest"]]

    return build


def strides(leaves: DataFrame, highest: int, span: int = SPAN) -> list[DataFrame]:
    """The nodes (grp, total, level, lo, hi, digest) of each stride, lowest first, over leaves (grp, total, lo, hi, digest) of trees of at most ``highest`` levels."""
    found, members = [], leaves.select("grp", "total", "lo", "hi", "digest")
    for s in range(max(1, -(-highest // span))):
        made = members.groupBy("grp", _block_of(s, span)).applyInPandas(_nodes_of(s, span), _NODES)
        found.append(cut(made))
        top = span * (s + 1)
        members = found[-1].where((F.col("level") == top) & (F.col("total") > F.lit(1 << top))).drop("level")
    return found


def roots(found: list[DataFrame], span: int = SPAN) -> DataFrame:
    """grp, total and digest of each tree's root."""
    out = None
    for s, nodes in enumerate(found):
        mine = nodes.where((F.col("level") == F.ceil(F.log2("total")).cast("int")) & (F.col("total") <= F.lit(1 << span * (s + 1))))
        mine = mine.where(F.col("total") > F.lit(1 << span * s)) if s else mine
        out = mine if out is None else out.unionByName(mine)
    return out.select("grp", "total", "digest")


def _paths_of(stride: int, span: int, names: list[str]):
    """Members of a block against its nodes: ancestors by containment, siblings by the difference of intervals."""

    def attach(key: tuple, members: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        if members.empty:
            return pd.DataFrame({n: pd.Series(dtype=object) for n in [*names, "path", "subroot", "root"]})
        nodes = nodes.rename(columns=lambda c: c.removeprefix("n_"))
        lo, paths = members["lo"].to_numpy(), [[] for _ in range(len(members))]
        levels = {level: (g["lo"].to_numpy(), g["hi"].to_numpy(), g["digest"].tolist()) for level, g in nodes.sort_values(["level", "lo"]).groupby("level")}
        top = max(levels)
        for level in range(span * stride, top):
            at, to, digests = levels[level]
            up, up_to, _ = levels[level + 1]
            own = np.searchsorted(at, lo, "right") - 1
            over = np.searchsorted(up, lo, "right") - 1
            if (to[own] < lo).any() or (up_to[over] < lo).any():
                raise RuntimeError("a node is missing")
            left, right = at[own] > up[over], to[own] < up_to[over]
            for path, k, before, after in zip(paths, own.tolist(), left.tolist(), right.tolist(), strict=True):
                path.append("L" + digests[k - 1] if before else "R" + digests[k + 1] if after else "-")
        above = nodes[nodes["level"] == top].iloc[0]
        rest = list(above["path"]) if above["path"] is not None else []
        return members[names].assign(path=[p + rest for p in paths], subroot=above["subroot"], root=above["root"])

    return attach


def proofs(leaves: DataFrame, found: list[DataFrame], above: DataFrame, span: int = SPAN) -> DataFrame:
    """``leaves`` with path, subroot and root. above: path, subroot and root of each group's root (grp, total)."""
    top = F.ceil(F.log2("total")).cast("int")
    known = above.select("grp", top.alias("level"), F.lit(0).cast("long").alias("lo"), "path", "subroot", "root")
    for s in reversed(range(len(found))):
        members = leaves if s == 0 else found[s].where(F.col("level") == span * s)
        nodes = found[s].join(known, ["grp", "level", "lo"], "left")
        nodes = nodes.select(*(F.col(c).alias(f"n_{c}") for c in nodes.columns))  # new names, as members can come from the same table
        kind = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in members.schema)}, path array<string>, subroot string, root string"
        pairs = members.groupBy("grp", _block_of(s, span)).cogroup(nodes.groupBy("n_grp", _block_of(s, span, "n_lo")))
        made = pairs.applyInPandas(_paths_of(s, span, members.columns), kind)
        if s == 0:
            return made
        known = cut(made.select("grp", "level", "lo", "path", "subroot", "root").unionByName(known))
    raise ValueError("no strides")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(
        path,
        leaf,
        lambda node, entry: F.sha2(F.when(F.substring(entry, 1, 1) == "L", F.concat(F.substring(entry, 2, 64), node)).when(F.substring(entry, 1, 1) == "R", F.concat(node, F.substring(entry, 2, 64))).otherwise(node).cast("binary"), 256),
    )


def siblings_hash(path: Column) -> Column:
    """H of a path's siblings."""
    return F.sha2(F.array_join(F.transform(path, lambda entry: F.substring(entry, 2, 64)), "").cast("binary"), 256)


def manifest(rows: DataFrame, group: str, order: list[str], span: int = SPAN) -> DataFrame:
    """``rows`` (with leaf) with subroot (of its ``group``), root and path, the siblings from the leaf to the root."""
    grp = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group)))  # null first
    leaves = rows.select(*rows.columns, grp.alias("grp"), F.col("leaf").alias("digest"))
    leaves = cut(ranked(leaves, [*order, "leaf"], rows.count()))
    most = leaves.agg(F.max("total")).first()[0] or 0
    nodes = strides(leaves, _height(max(1, most)), span)
    tops = cut(roots(nodes, span))
    n_tops = tops.count()
    highest = ranked(tops.select(F.lit("all").alias("grp"), F.col("grp").alias("member"), F.col("total").alias("leaves"), "digest"), ["member"], n_tops)
    highest = cut(highest)
    upper = strides(highest, _height(max(1, n_tops)), span)
    end = roots(upper, span).select("grp", "total", F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    above = proofs(highest, upper, end, span)
    above = cut(above.select(F.col("member").alias("grp"), F.col("leaves").alias("total"), "path", F.col("digest").alias("subroot"), "root"))
    return proofs(leaves, nodes, above, span).select(*rows.columns, "path", "subroot", "root")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    fields = ("source", "lang")
    leaf = leaf_of(F.col("doc_id"), *map(F.col, fields), F.col("n_chars"), F.col("text"))
    changed = leaf_of(F.col("doc_id"), *map(F.col, fields), F.col("n_chars") + 1, F.col("text"))
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    rows = d.select("doc_id", "lang", leaf.alias("leaf"), F.when(tampered, changed).alias("presented"))
    proved = manifest(rows, "lang", ["doc_id"])
    proved = proved.withColumn("folded_root", folded(F.coalesce("presented", "leaf"), F.col("path")))
    return proved.select("doc_id", "leaf", "subroot", "root", siblings_hash(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _leaf_sql(n_chars: str) -> str:
    part = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
    return f"sha256({' || '.join(part.format(x) for x in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


_CRC32 = (
    "xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), "
    "lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
)


def _levels_sql(name: str, source: str) -> str:
    """All levels (k, level, nodes) of the trees whose leaves ``source`` (k, nodes: list) has."""
    return (
        f"{name} AS (SELECT k, 0 AS level, nodes FROM {source} UNION ALL SELECT k, level + 1, list_transform(range(1, len(nodes) + 1, 2), "
        f"lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], ''))) FROM {name} WHERE len(nodes) > 1)"
    )


_ENTRY = "CASE WHEN nodes[xor(r >> level, 1) + 1] IS NULL THEN '-' WHEN (r >> level) & 1 = 1 THEN 'L' || nodes[xor(r >> level, 1) + 1] ELSE 'R' || nodes[xor(r >> level, 1) + 1] END"

OP11_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS k, {_leaf_sql('n_chars')} AS leaf,
  CASE WHEN doc_id IS NOT NULL AND {_CRC32} % 7 = 0 THEN {_leaf_sql('(n_chars + 1)')} END AS presented FROM documents),
t AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM d),
first AS (SELECT k, list(leaf ORDER BY r) AS nodes FROM t GROUP BY k),
{_levels_sql('lower_levels', 'first')},
tops AS (SELECT k, nodes[1] AS subroot, row_number() OVER (ORDER BY k) - 1 AS r FROM lower_levels WHERE len(nodes) = 1),
second AS (SELECT 0 AS k, list(subroot ORDER BY r) AS nodes FROM tops),
{_levels_sql('upper_levels', 'second')},
root AS (SELECT nodes[1] AS root FROM upper_levels WHERE len(nodes) = 1),
top_path AS (SELECT t.k, list({_ENTRY} ORDER BY level) AS path FROM tops t, upper_levels u WHERE len(u.nodes) > 1 GROUP BY t.k),
leaf_path AS (SELECT t.k, t.r, list({_ENTRY} ORDER BY level) AS path FROM t JOIN lower_levels l ON t.k = l.k AND len(l.nodes) > 1 GROUP BY t.k, t.r),
p AS (SELECT t.doc_id, t.leaf, coalesce(t.presented, t.leaf) AS shown, tops.subroot, root.root, list_concat(coalesce(a.path, []), coalesce(b.path, [])) AS path
  FROM t JOIN tops ON t.k = tops.k CROSS JOIN root LEFT JOIN leaf_path a ON t.k = a.k AND t.r = a.r LEFT JOIN top_path b ON t.k = b.k),
f AS (SELECT *, list_reduce(list_concat([shown], path), lambda n, e: CASE e[1] WHEN 'L' THEN sha256(e[2:] || n) WHEN 'R' THEN sha256(n || e[2:]) ELSE sha256(n) END) AS folded_root FROM p)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda e: e[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f"""
