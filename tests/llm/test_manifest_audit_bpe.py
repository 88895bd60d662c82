"""Operators 11 to 13 against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusql.llm import bpe, divergence, merkle, workload
from corpusql.llm.textops import slices
from tests.test_workload import SF, TABLES, rows

tokenizers = pytest.importorskip("tokenizers")
vocabularies = pytest.importorskip("public_tokenizers")
KIND = "doc_id long, text string, lang string, source string, n_chars long, root string, rank string"


def h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_source_divergence"])
def test_query_matches_duckdb(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(workload.queries()[name](spark, SF).toPandas()) == rows(duck.sql(workload.oracle_sql()[name]).df())


# Merkle manifest ------------------------------------------------------------------------------------------------------


def tree(leaves):
    """All levels of a tree, and the path of each leaf."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h(*now[i : i + 2]) for i in range(0, len(now), 2)])
    paths = []
    for r in range(len(leaves)):
        path = []
        for now in levels[:-1]:
            other = r ^ 1
            path.append("-" if other >= len(now) else ("L" if r & 1 else "R") + now[other])
            r //= 2
        paths.append(path)
    return levels[-1][0], paths


def fold(node, path):
    for e in path:
        node = h(e[1:], node) if e[0] == "L" else h(node, e[1:]) if e[0] == "R" else h(node)
    return node


@pytest.mark.parametrize("span", [1, 3, 10])
def test_manifest(spark, span):
    rng = random.Random(span)
    data = [(rng.choice([None, "a", "b", "b", "b", "é", "one" if k == 3 else "b"]), None if k % 40 == 7 else k % 60, h(str(k % 55))) for k in range(150)]
    df = spark.createDataFrame([(*r, 1, 2) for r in data], "lang string, doc_id long, leaf string, path int, total int").repartition(3)
    got = sorted((r.lang or "", r.doc_id if r.doc_id is not None else -1, r.leaf, r.subroot, r.root, tuple(r.path)) for r in merkle.manifest(df.drop("path", "total"), "lang", ["doc_id"], span).collect())
    groups = {}
    for lang, i, leaf in data:
        groups.setdefault((lang is not None, (lang or "").encode()), []).append((i if i is not None else -1, leaf))
    trees = {g: tree([leaf for _, leaf in sorted(x)]) for g, x in sorted(groups.items())}
    root, tops = tree([t[0] for t in trees.values()])
    want = []
    for (g, (subroot, paths)), top in zip(trees.items(), tops, strict=True):
        for (i, leaf), path in zip(sorted(groups[g]), paths, strict=True):
            want.append((g[1].decode(), i, leaf, subroot, root, tuple(path + top)))
            assert fold(leaf, path + top) == root
    assert got == sorted(want)


def test_manifest_of_one_leaf_and_of_none(spark):
    one = spark.createDataFrame([(None, 1, "ab")], "lang string, doc_id long, leaf string")
    assert [(r.subroot, r.root, r.path) for r in merkle.manifest(one, "lang", ["doc_id"]).collect()] == [("ab", "ab", [])]
    assert merkle.manifest(one.limit(0), "lang", ["doc_id"]).collect() == []


def test_leaf_folding_and_tampering(spark, tmp_path):
    data = [(1, "täxt", "en", None, 4, "x", "y"), (2, None, None, "s", None, "x", "y"), (None, "", "en", "s", 0, "x", "y"), (2, None, None, "s", None, "x", "y")]
    data += [(k, "w" * 30_000 if k == 50 else f"t{k}", "de", "s", k, "x", "y") for k in range(10, 60)]
    spark.createDataFrame(data, KIND).write.parquet(f"{tmp_path}/documents.parquet")
    got = workload.queries()["op11_merkle_manifest"](spark, str(tmp_path)).collect()
    assert len(got) == len(data) and len({r.root for r in got}) == 1
    f = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaves = sorted(h(f(i), f(s), f(lang), f(n), f(t)) for i, t, lang, s, n, *_ in data)
    assert sorted(r.leaf for r in got) == leaves
    import zlib

    for r in got:
        n = next(d[4] for d in data if d[0] == r.doc_id)
        assert r.verified == (r.doc_id is None or n is None or zlib.crc32(str(r.doc_id).encode()) % 7 != 0)
    assert any(not r.verified for r in got)


# Source divergence ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_pointer_sort(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abé", k=rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 40]))).encode() for _ in range(3000)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    sizes = np.array([len(w) for w in words])
    starts = np.cumsum(sizes + 1) - sizes - 1
    order, new = divergence.pointer_sort(data, starts, starts + sizes)
    want = sorted(range(len(words)), key=lambda i: words[i])
    assert order.tolist() == want
    assert new.tolist() == [k == 0 or words[want[k]] != words[want[k - 1]] for k in range(len(want))]
    assert [len(x) for x in divergence.pointer_sort(data[:0], starts[:0], starts[:0])] == [0, 0]


def test_audit(spark, tmp_path):
    rng = random.Random(5)
    vocab = ["The", "THE", "the", "über", "Über", "internationalisation", "internationalise", "a1b", "x_y", "日本", "z" * 300]
    data = [(k, " ".join(rng.choices(vocab, weights=range(1, 12), k=rng.randint(0, 50))), rng.choice(["en", "en", None, "de"]), rng.choice(["s1", "s1", "s1", "s2", "ß", None]), 0, "x", "y") for k in range(80)]
    data += [(900, None, "fr", "s1", 0, "x", "y"), (901, "12 34 _", "fr", "s2", 0, "x", "y"), (902, "only", "it", "s9", 0, "x", "y")] + data[:5]
    frame = spark.createDataFrame(data, KIND).repartition(4)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = rows(duck.sql(divergence.OP12_SQL).df())
    assert rows(divergence.audit(frame).toPandas()) == want
    assert rows(workload.queries()["op12_source_divergence"](spark, str(tmp_path)).toPandas()) == want
    assert any(r[0] == "s2" and r[1] == "fr" for r in want[1])  # a pair of groups without terms
    assert divergence.audit(frame.limit(0)).collect() == []


def test_large_counts_stay_exact(spark):
    n, total, terms = 10**12 + 7, 3 * 10**15, 10**6
    got = spark.range(1).select(divergence.frequency(F.lit(n), F.lit(total), F.lit(terms)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 1) // (total + terms)


def test_pairs_over_several_shards_and_tiles(spark, monkeypatch):
    counts = [("en", f"s{s % 5}", f"t{t}", 1 + s * t % 7) for s in range(5) for t in range(40) if (s + t) % 3]
    kept = divergence.kept_counts(spark.createDataFrame([(*c, 3) for c in counts], "lang string, source string, term string, n long, docs long"))
    groups = divergence.groups_of(spark.createDataFrame([("en", f"s{s}") for s in range(5)], "lang string, source string"), kept)
    g = divergence.with_groups(kept, groups)
    monkeypatch.setattr(divergence, "SMALL", 0)
    salted = divergence.with_groups(kept, groups)
    assert sorted(map(tuple, g.collect())) == sorted(map(tuple, salted.select(*g.columns).collect()))
    made = g.select("lang", "term", "place", "sources", divergence.frequency(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    one, many = ({tuple(r) for r in divergence.pair_divergence(made, groups, shards).collect()} for shards in (1, 7))
    assert one == many and len(one) == 20


# BPE ------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def path():
    return vocabularies.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def codec(path):
    return bpe.Codec(open(path, encoding="utf-8").read())


@pytest.fixture(scope="module")
def library(path):
    return tokenizers.Tokenizer.from_file(path)


def hard_texts():
    rng = random.Random(1)
    parts = ["'", "s", "t", "re", "ve", " ", "  ", "\n", "\t", " ", "é", "1", "²", "!", "''", "ll", "d", "m", "x", "<|endoftext|>", "<|", "　", "日本", "🙂", "A", "\x1c", "\x85", "|>", "'S", "\r\n", "́", "\x00", "\U00013460", "Ᲊ"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x3000), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    texts += ["".join(rng.choices("abcd", k=rng.randint(1, 300))) for _ in range(300)]
    return [*texts, "a" * 20_000, "ab" * 9000, " " * 9000, "x" + " " * 3000 + "y", "\n" * 500, "", None, "same", "same"]


def test_encoding_equals_the_library(codec, library):
    texts = hard_texts()
    got = []
    for s in slices(pa.array(texts), 1 << 16):
        ids, counts = codec.encode_slice(s)
        got += np.split(ids, np.cumsum(counts)[:-1])
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [g.tolist() for g in got] == want
    assert [codec.decode_ids(g).decode("utf-8", "replace") for g in got] == library.decode_batch(want, skip_special_tokens=False)


def test_decoding_of_any_ids(codec, library):
    rng = random.Random(2)
    for _ in range(300):
        ids = [rng.randrange(50_257) for _ in range(rng.randint(0, 30))]
        assert codec.decode_ids(np.array(ids, np.uint32)).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)
    assert codec.decode_ids(np.array([70_000], np.uint32)) == b""


def merged(codec, piece):
    """Merging by rank, the definition."""
    parts = [codec.ids[bytes([b])] for b in piece]
    while True:
        best = min(((codec.rank.get(p, 1 << 60), k) for k, p in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 60, 0))
        if best[0] == 1 << 60:
            return parts
        k = best[1]
        parts[k : k + 2] = [codec.ids[codec.pieces[parts[k]] + codec.pieces[parts[k + 1]]]]


def test_backtracking_equals_merging(codec):
    rng = random.Random(3)
    for _ in range(1500):
        piece = bytes(rng.choices(b"abcdeinrst\xc3\xa9 ", k=rng.randint(1, 25)))
        assert codec.encode_piece(piece) == merged(codec, piece), piece
    ids = rng.sample(sorted(codec.usable), 300)
    for a, b in zip(ids, ids[1:], strict=False):
        assert codec.fits(a, b) == (merged(codec, codec.pieces[a] + codec.pieces[b]) == [a, b])


def test_character_classes_are_the_library_s(codec):
    split = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    rng = random.Random(4)
    for c in [*range(0x3400), *(c for c in (rng.randrange(0x3400, 0x110000) for _ in range(20_000)) if not 0xD800 <= c < 0xE000)]:
        one = [len(split(x + chr(c))) == 1 for x in "a1!"]
        want = bpe.LETTER if one[0] else bpe.NUMBER if one[1] else bpe.OTHER if one[2] else bpe.SPACE
        assert codec.classes[c] == want, hex(c)


def test_round_trip_on_frames(spark, path, library):
    texts = hard_texts()[-400:]
    frame = spark.createDataFrame([(k, t, "clash", k) for k, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens long").repartition(3)
    vocabulary = bpe.read_vocabulary(spark, path)
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(frame, vocabulary), vocabulary).collect()}
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(got[k].ids), "<u4").tolist() == ids and got[k].n_tokens == len(ids) and got[k].decoded == (t or "")
    assert bpe.encode(frame.limit(0), vocabulary).collect() == []
    assert bpe.decode(spark.createDataFrame([(None,)], "ids binary"), vocabulary).first().decoded is None


def test_op13(spark, library):
    texts = {i: t or "" for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()}
    got = {r.doc_id: tuple(r) for r in workload.queries()["op13_bpe_round_trip"](spark, SF).collect()}
    want = {}
    for i, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), h(library.decode(ids, skip_special_tokens=False)))
    assert got == want
