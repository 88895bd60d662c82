"""Edge cases of the library's operators."""

from pyspark.sql import functions as F

from corpusql.functions import text as T
from corpusql.functions import vectors as V
from corpusql.operators import merge, retrieval


def test_text_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a\x00b\rc\n")], "id long, t string")
    out = {r.id: r for r in df.select("id", T.sanitize(F.col("t")).alias("s"), T.combine(F.lit(" "), F.col("t")).alias("c"), F.size(T.char_windows(F.col("t"))).alias("n")).collect()}
    assert out[1].s is None and out[2].s == "" and out[3].s == "ab c\n"
    assert out[1].c == "" and out[2].n == 1


def test_zero_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    got = df.select(V.normalized(F.col("v")).alias("u"), V.cosine(F.col("v"), F.array(F.lit(1.0), F.lit(0.0))).alias("c")).collect()
    assert got[0].u == [0.0, 0.0] and got[0].c == 0.0
    assert got[1].u == [0.6, 0.8] and abs(got[1].c - 0.6) < 1e-12


def test_fusion_scales_over_the_union(spark):
    lex = spark.createDataFrame([("a", 4.0), ("b", 2.0)], "id string, score double")
    vec = spark.createDataFrame([("b", 1.0), ("c", 0.5)], "id string, score double")
    got = [(r.id, r.score) for r in retrieval.fuse(lex, vec, 3).collect()]
    assert got == [("b", 0.75), ("a", 0.5), ("c", 0.25)]


def test_upsert_rules(spark):
    old = spark.createDataFrame([(1, "x", "k", 1), (2, "y", "l", 2)], "id int, r string, c string, f int")
    new = spark.createDataFrame([(2, "z", None, 9), (3, "w", "m", 3)], "id int, r string, c string, f int")
    got = sorted(map(tuple, merge.upsert(old, new, ["id"], ["r"], ["c"], ["f"]).collect()))
    assert got == [(1, "x", "k", 1), (2, "z", "l", 2), (3, "w", "m", 3)]
