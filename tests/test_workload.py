"""Every registered query against its DuckDB twin, on the smallest tables."""

import duckdb
import pytest

from corpusql import workload
from corpusql.operators import boolean, lexical

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame):
    clean = lambda x: tuple(x) if hasattr(x, "__len__") and not isinstance(x, str) else None if x is None or x != x else x
    names = sorted(frame.columns)
    return names, sorted((tuple(map(clean, r)) for r in frame[names].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(workload.oracle_sql()))
def test_matches_duckdb(spark, duck, name):
    got = workload.queries()[name](spark, SF).toPandas()
    want = duck.sql(workload.oracle_sql()[name]).df()
    assert rows(got) == rows(want)


def test_queries_without_a_twin(spark):
    """What SQL cannot express: projections, an approximate index, the offline embedder."""
    assert workload.queries().keys() - workload.oracle_sql().keys() == {"vector_projection", "vector_index_probe", "embed_bodies", "vector_list_topk", "rate_budget"}
    assert workload.queries()["vector_index_probe"](spark, SF).count() == 20
    assert {len(r.reduced) for r in workload.queries()["vector_projection"](spark, SF).collect()} == {32}
    chunks = workload.queries()["embed_bodies"](spark, SF)
    assert chunks.count() == chunks.select("id", "chunk_ix").distinct().count() > 0


def test_phrase_on_long_texts(spark):
    d = spark.createDataFrame([("1", "Of the " * 20_000), ("2", "of of the"), ("3", None)], "id string, text string")
    assert {r.id: r.tf for r in lexical.phrase(d, ["of", "the"]).collect()} == {"1": 20_000, "2": 1}
    assert {r.id: r.tf for r in lexical.phrase(d, ["of", "of"]).collect()} == {"2": 1}
    assert boolean.snippets(d, "text", ["the"]).count() == 3
