"""Rows that were lost, crashes and wrong values of earlier code, each as a small case; whole-table steps on hot groups."""

import datetime as dt
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusql.functions import text as T
from corpusql.operators import code, merge, ranks, retrieval
from corpusql.sources import files

ROOT = Path(__file__).resolve().parents[1]


def test_oldest_part_counts_rows_without_an_age(spark):
    at = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(k, at + dt.timedelta(seconds=k // 2) if k < 45 else None) for k in range(1000)], "id long, ts timestamp")
    got = sorted(r.id for r in merge.oldest_part(rows, "ts", "id").collect())
    assert got == list(range(50))
    same = spark.createDataFrame([(k, at) for k in range(400)], "id long, ts timestamp")
    assert sorted(r.id for r in merge.oldest_part(same, "ts", "id", 10).collect()) == list(range(40))
    assert merge.oldest_part(rows.where("ts is null"), "ts", "id").count() == 47
    assert merge.oldest_part(rows.limit(0), "ts", "id").count() == 0


def test_budget_cut_keeps_null_groups(spark):
    rows = spark.createDataFrame([(None, 1, 5), (None, 2, 5), (None, 3, 5), ("a", 1, 20), ("b", 1, None), ("b", None, 3)], "g string, o long, n long")
    got = sorted((r.g or "", r.o or 0, r.running) for r in retrieval.budget_cut(rows, "n", "o", 10, ["g"]).collect())
    assert got == [("", 1, 5), ("", 2, 10), ("b", 0, 3), ("b", 1, 3)]


@pytest.mark.parametrize("parts", [1, 5])
def test_ranks_and_running_sums(spark, parts):
    rng = random.Random(parts)
    data = [(rng.choice([None, "hot", "hot", "hot", "b"]), k, rng.randrange(9)) for k in range(300)]
    rows = spark.createDataFrame(data, "g string, o long, n long").repartition(3)
    got = {r.o: (r["rank"], r.running) for r in ranks.ranked(ranks.running(rows, "n", ["o"], ["g"], parts=parts), ["o"], ["g"], parts=parts).collect()}
    for g in (None, "hot", "b"):
        total = 0
        for place, (_, o, n) in enumerate((d for d in data if d[0] == g), 1):
            total += n
            assert got[o] == (place, total)


def test_block_topk_with_null_and_short_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 1.0])], "id long, embedding array<float>")
    queries = rows.select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    got = {(r.query_id, r.id): r.score for r in retrieval.block_topk(rows, queries, 3).collect()}
    assert got == {(1, 1): 1.0, (1, 4): 0.0, (4, 4): 1.0, (4, 1): 0.0, (3, 3): 1.0}


def test_csv_rows_are_numbered_in_their_file(spark, tmp_path):
    (tmp_path / "b.csv").write_text("v\nb1\nb2\n")
    (tmp_path / "a.csv").write_text("v\na1\na2\n")
    got = {(r.id, r.text) for r in files.csv_rows(spark, str(tmp_path), "t").collect()}
    assert got == {("DB:t:row1", "v=a1"), ("DB:t:row2", "v=a2"), ("DB:t:row1", "v=b1"), ("DB:t:row2", "v=b2")}


def test_code_files_below_a_root_with_signs(spark, tmp_path):
    root = tmp_path / "codex+y (1)"
    (root / "build").mkdir(parents=True)
    (root / "a.py").write_text("x = 1\n")
    (root / "build" / "b.py").write_text("y = 1\n")
    assert [(r.path, r.text) for r in files.code_files(spark, str(root)).collect()] == [("a.py", "x = 1\n")]


def test_size_bound_of_source_files(spark):
    sizes = spark.createDataFrame([("a.py", 3_000_001), ("b.py", 3_145_728), ("c.py", 3_145_729)], "path string, length long")
    assert {r.path for r in code.wanted_files(sizes).collect()} == {"a.py", "b.py"}


def test_entities_and_comments(spark):
    cases = {
        "caf&eacute; &#8217;s &#x27;q&#x27; &hellip; &amp;lt; &nbsp;x": "café ’s 'q' … &lt; x",
        "a<!-- x > y <b> -->b": "a b",
        "&#0; &#xD800; &#1114112; &unknown; & &; &#; x;": "\ufffd \ufffd \ufffd &unknown; & &; &#; x;",
        "&#128512;&#x1F600;&AMP;": "😀😀&",
        "": "",
    }
    got = spark.createDataFrame([(k,) for k in cases], "h string").select("h", T.html_to_decoded_text(F.col("h")).alias("t")).collect()
    assert {r.h: r.t for r in got} == cases


def test_upsert_by_a_given_order(spark):
    old = spark.createDataFrame([(1, "x", "k", 1)], "id int, r string, c string, f int")
    new = spark.createDataFrame([(1, "z", "m", 9, 1), (1, "a", None, 8, 2), (2, "b", "q", 5, 2), (2, "y", None, 6, 3)], "id int, r string, c string, f int, at int")
    got = sorted(map(tuple, merge.upsert(old, new, ["id"], ["r"], ["c"], ["f"], order="at").collect()))
    assert got == [(1, "a", "m", 1), (2, "y", "q", 5)]


def test_stem_edges_form_no_pairs_of_a_hot_stem(spark):
    n = 3000
    node = spark.range(n).select(F.col("id"), F.array(F.lit("hot"), F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("words"))
    names = spark.range(n).select("id", F.lit("hot").alias("stem"))
    edges = code.stem_edges(node, names, 32)
    got = {}
    for r in edges.collect():
        got.setdefault(r.src, []).append(r.dst)
    assert all(sorted(x) == [d for d in range(32) if d != src] for src, x in got.items()) and len(got) == n
    assert "WindowGroupLimit" in edges._jdf.queryExecution().executedPlan().toString()
    assert code.co_stem_edges(names, 4).count() == 12


def test_byte_cuts_and_paths(spark):
    texts = ["héllo", "日本語", "🙂🙂", "plain", "", None]
    for most in range(0, 10):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.cut_to_bytes(F.col("t"), most).alias("c")).collect()
        for r in rows:
            want = None if r.t is None else max((r.t[:k] for k in range(len(r.t) + 1) if len(r.t[:k].encode()) <= most), key=len)
            assert r.c == want
    paths = {"a/b.py": "a/b.py", "./a//b": "a/b", "../x": None, "a/../../x": None, "/etc": None, "a\\..\\b": None, "C:/x": None, "..a/b": "..a/b"}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", T.safe_path(F.col("p")).alias("s")).collect()
    assert {r.p: r.s for r in got} == paths


def test_the_entry_survives_a_folder_left_empty(tmp_path):
    """The library and its entry, copied without the training-data operators but with their empty folder."""
    code_ = (
        "import shutil, os, sys\n"
        f"shutil.copytree({str(ROOT / 'corpusql')!r}, 'corpusql', ignore=shutil.ignore_patterns('llm'))\n"
        f"shutil.copy({str(ROOT / '__spark_entry__.py')!r}, '.')\n"
        "os.makedirs('corpusql/llm/__pycache__')\n"
        "sys.path.insert(0, os.getcwd())\n"
        "import __spark_entry__ as e\n"
        "n = len(e.queries()); assert n > 100 and not any(k.startswith('op1_') for k in e.queries()), n\n"
        "assert 'pipeline' not in e.queries() and e.oracle_sql()\n"
        "open('corpus_pipeline.py', 'w').write('from corpusql.llm.common import table')\n"
        "assert 'pipeline' not in e.queries()\n"
    )
    done = subprocess.run([sys.executable, "-c", code_], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin"})
    assert done.returncode == 0, done.stderr


def test_no_folder_is_made_up_on_a_cluster(spark, monkeypatch):
    from corpusql import session

    class Far:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://x"})

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(Far)


def test_scores_of_a_block_are_bounded():
    import tracemalloc

    import numpy as np
    import pandas as pd

    from corpusql.operators import retrieval

    rng = np.random.default_rng(1)
    v = rng.integers(-2, 3, (5000, 4)).astype(float)  # many ties
    v[7] = 0
    left = pd.DataFrame({"id": np.arange(5000)[::-1], "v": list(v)})
    right = pd.DataFrame({"query_id": np.arange(400), "v": list(v[:400])})
    tracemalloc.start()
    got = retrieval.nearest(10, cells=100_000)(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8e6  # all scores are 16 MB, and were copied three times
    n = np.linalg.norm(v, axis=1, keepdims=True)
    u = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
    scores = np.round(u[:400] @ u.T, 6)
    want = [(q, i, s) for q in range(400) for s, i in sorted((-x, 4999 - k) for k, x in enumerate(scores[q]))[:10]]
    assert [(q, i) for q, i, _ in want] == list(zip(got["query_id"], got["id"], strict=True))


def test_stem_edges_deal_a_hot_word(spark, monkeypatch):
    from corpusql.operators import ranks

    monkeypatch.setattr(ranks, "ROWS_IN_PART", 100)
    nodes = spark.range(1000).select("id", F.array(F.lit("hot"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))).alias("words"))
    names = spark.range(50).select("id", F.when(F.col("id") % 2 == 0, "hot").otherwise("s1").alias("stem"))
    got = {}
    for r in code.stem_edges(nodes, names, 8).collect():
        got.setdefault(r.src, []).append(r.dst)
    for k in range(1000):
        near = [i for i in range(50) if i % 2 == 0 or k % 3 == 1][:8]
        assert sorted(got[k]) == [i for i in near if i != k]
    words = spark.range(1000).select(F.lit("hot").alias("stem"), F.col("id").alias("src"))
    joined = ranks.dealt_join(words, names.limit(1), "stem", "src", parts=40)
    assert joined.count() == 1000 and joined.groupBy(F.spark_partition_id()).count().count() > 3


def test_index_files_are_parsed_once(spark):
    from corpusql.sources import files

    texts = spark.createDataFrame([('[{"id": 1, "path": "a"}]',), (' {"2": ["b", null]}',), ("plain",), ("",), (None,)], "text string")
    found = files.attachment_index(texts)
    assert {(r.work_item, r.path) for r in found.collect()} == {("1", "a"), ("2", "b")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "from_json" in line]
