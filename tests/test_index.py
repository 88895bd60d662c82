"""The stemmer, the stored index and the searches on it: published examples, hand-worked covers, brute force on random texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusql.functions import stemming
from corpusql.jobs import index
from corpusql.operators import boolean, indexed, lexical

EXAMPLES = """consignment consign consistency consist consolatory consolatori consoled consol conspiracy conspiraci constables constabl knackeries knackeri kneaded knead
knives knive knightly knight knitting knit generously generous communication communic arsenal arsenal relational relat happily happili running run hoping hope hopping hop
agreed agre feed feed bled bled ties tie cries cri gas gas gaps gap kiwis kiwi dying die sky sky inning inning proceed proceed news news by by say say cry cri fizzed fizz falling fall
valency valenc vietnamization vietnam operator oper feudalism feudal hopefulness hope callousness callous sensibility sensibl triplicate triplic formalize formal electrical electr
goodness good allowance allow inference infer replacement replac adjustment adjust dependent depend adoption adopt homologous homolog bowdlerize bowdler rate rate cease ceas
roll roll youth youth boyish boyish sayyid sayyid early earli luxuriated luxuri exceed exceed as as i i yy yy""".split()


def test_stems(spark):
    pairs = list(zip(EXAMPLES[::2], EXAMPLES[1::2], strict=True))
    got = spark.createDataFrame([*pairs, (None, None), ("", "")], "w string, s string").select("w", "s", stemming.stemmed(F.col("w")).alias("g")).collect()
    assert [(r.w, r.g) for r in got] == [(r.w, r.s) for r in got]


TEXTS = {
    "1": ("On rats", "The cat sat. The rats, the RAT of rating"),
    "2": ("Ünïcode", "rat cat rat"),
    "3": (None, None),
    "4": ("", ""),
    "5": ("Cats", "and dogs " * 300 + "rats"),
    "6": ("x", "rat " + "y " * 40 + "cat"),
    "7": ("the the", "of the of the"),
}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows = [(i, "s" + str(int(i) % 2), "t", title, text) for i, (title, text) in TEXTS.items()]
    docs = spark.createDataFrame(rows, "id string, space string, type string, title string, text string").repartition(3)
    path = str(tmp_path_factory.mktemp("index")) + "/i"
    index.build(docs, path)
    return docs, index.opened(spark, path)


def scores(frame):
    return {r.id: r.score for r in frame.collect()}


def test_covers_by_hand(spark):
    # a at 1 and 5, b at 3 and 9: the stretches 1-3, 3-5 and 5-9 are minimal.
    occurrences = spark.createDataFrame([("d", 0, 1), ("d", 1, 3), ("d", 0, 5), ("d", 1, 9), ("e", 0, 2)], "id string, term int, position int")
    found = sorted((r.first, r.last, r.words) for r in indexed.covers(occurrences, 2).collect())
    assert found == [(1, 3, 2), (3, 5, 2), (5, 9, 2)]
    assert scores(indexed.cover_density(indexed.covers(occurrences, 2))) == {"d": round(0.1 * (1 / 2 + 1 / 2 + 1 / 4), 6)}
    one = indexed.covers(occurrences.where("term = 0"), 1)
    assert scores(indexed.cover_density(one)) == {"d": 0.2, "e": 0.1}


@pytest.mark.parametrize("terms", [2, 3])
def test_covers_against_all_stretches(spark, terms):
    rng = random.Random(terms)
    places = {f"d{k}": {p: rng.randrange(terms) for p in rng.sample(range(40), rng.randint(0, 16))} for k in range(25)}
    got = {(r.id, r.first, r.last, r.words) for r in indexed.covers(spark.createDataFrame([(i, t, p) for i, x in places.items() for p, t in x.items()], "id string, term int, position int"), terms).collect()}
    want = set()
    for i, x in places.items():
        full = [(a, b) for a in x for b in x if a <= b and len({t for p, t in x.items() if a <= p <= b}) == terms]
        want |= {(i, a, b, sum(a <= p <= b for p in x)) for a, b in full if not any((c, d) != (a, b) and a <= c and d <= b for c, d in full)}
    assert got == want


def test_stemmed_search(made):
    docs, i = made
    # Of 1's positions, title first: on 0, rats 1, the 2, cat 3, sat 4, the 5, rats 6, the 7, rat 8, of 9, rating 10 (its stem is rate).
    got = scores(indexed.stemmed_search(i, "cats and rats"))
    assert got["1"] == round(0.1 / 2 + 0.1 / 3, 6) and got["2"] == 0.2
    assert got["6"] == round(0.1 / 41, 6) and got["5"] == round(0.1 / 601, 6)
    assert set(got) == {"1", "2", "5", "6"}
    assert scores(indexed.stemmed_search(i, "rat")) == {"1": 0.3, "2": 0.2, "5": 0.1, "6": 0.1}
    assert indexed.stemmed_search(i, "the of and").count() == indexed.stemmed_search(i, "rat zebra").count() == indexed.stemmed_search(i, "").count() == 0


@pytest.mark.parametrize("text", ["rat", '"the of"', 'cat and rat', 'cat Or dogs not "x rat"', '"of the" OR unicode', '"the the" or "of the of"', "nothing", 'rats AND (cat OR "and dogs")'])
def test_boolean_equals_the_scan(made, text):
    docs, i = made
    assert scores(indexed.search(i, text)) == scores(boolean.search(docs, text))


def test_bm25_and_phrase_equal_the_scan(made):
    docs, i = made
    for terms, more in ((["rat", "cat"], {}), (["rat", "cat"], {"require_all": True}), (["the"], {"without": "sat"}), (["none"], {})):
        assert scores(indexed.bm25(i, terms, **more)) == scores(lexical.bm25(docs.fillna("", "text"), terms, **more))
    for words in (["the", "of"], ["of", "the"], ["and", "dogs", "and"], ["the", "the"], ["nothing"]):
        assert {r.id: r.tf for r in indexed.phrase(i, words).collect()} == {r.id: r.tf for r in lexical.phrase(docs, words).collect()}


def test_page(spark, made):
    docs, i = made
    files = spark.createDataFrame([("1", "a"), ("1", "b"), ("9", "c")], "content_id string, name string")
    hits = indexed.search(i, "rat OR cat")
    page = indexed.result_page(i, hits, docs.select("id", "text"), files, ["rat", "cat"], 2).orderBy("rank").collect()
    every = indexed.with_headers(i, hits).orderBy(F.desc("score"), "id").collect()
    assert [(r["rank"], r.id, r.title) for r in page] == [(k + 1, r.id, r.title) for k, r in enumerate(every[:2])]
    assert all(r.attachments_count == (2 if r.id == "1" else 0) and "<b>" in r.snippet for r in page)
    only = indexed.result_page(i, hits, docs.select("id", "text"), files, ["rat"], 10, 0, space="s1").collect()
    assert {r.id for r in only} == {r.id for r in every if r.space == "s1"}


def test_operators_in_any_case_and_quoted():
    assert boolean.parsed("a and b Or c not d") == boolean.parsed("a AND b OR c NOT d")
    assert boolean.phrases(boolean.parsed('"and" or nota')) == [("and",), ("nota",)]
    assert boolean.normalized_query('x and "or" & y') == '"x" AND "or" AND "y"'


def test_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "id string, space string, type string, title string, text string")
    i = index.build(docs, f"{tmp_path}/i")
    assert i.n == 0 and indexed.bm25(i, ["a"]).count() == indexed.search(i, "a OR b").count() == indexed.stemmed_search(i, "cats").count() == 0


def test_a_look_up_reads_its_buckets_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "TOKENS_IN_BUCKET", 50)
    rng = random.Random(1)
    docs = spark.createDataFrame([(str(k), "s", "t", "", " ".join(f"w{rng.randrange(60)}" for _ in range(40))) for k in range(30)], "id string, space string, type string, title string, text string")
    i = index.build(docs, f"{tmp_path}/i")
    found = i.look_up(["w1"], "term")
    plan = i.postings(found)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    assert scores(indexed.bm25(i, ["w1", "w2"])) == scores(lexical.bm25(docs, ["w1", "w2"]))
    assert spark.read.parquet(f"{i.path}/postings").select("bucket").distinct().count() > 5


def test_an_index_is_built_once_and_again_where_it_is_gone(spark, tmp_path):
    import shutil

    rows = spark.createDataFrame([("1", "s", "t", "", "a b")], "id string, space string, type string, title string, text string")
    rows.write.parquet(f"{tmp_path}/docs")
    source = spark.read.parquet(f"{tmp_path}/docs")
    calls = []
    made = lambda: calls.append(1) or spark.read.parquet(f"{tmp_path}/docs")
    first = index.of_table(spark, "x", source, made)
    assert index.of_table(spark, "x", source, made) is first and len(calls) == 1
    shutil.rmtree(first.path.removeprefix("file:"))
    assert scores(indexed.bm25(index.of_table(spark, "x", source, made), ["a"])) and len(calls) == 2
    rows.unionByName(rows).write.mode("overwrite").parquet(f"{tmp_path}/docs")
    assert index.of_table(spark, "x", spark.read.parquet(f"{tmp_path}/docs"), made).n == 2


def test_a_frequent_term_is_dealt_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "TOKENS_IN_BUCKET", 100)
    texts = [(str(k), "s", "t", "", "the " * 40 + f"w{k}") for k in range(30)]
    docs = spark.createDataFrame(texts, "id string, space string, type string, title string, text string")
    i = index.build(docs, f"{tmp_path}/i")
    rows = i.all_postings().select("term", "id", "positions", F.input_file_name().alias("file")).where("term = 'the'").collect()
    assert len(rows) == 30 and all(r.positions == list(range(40)) for r in rows)
    assert len({r.file for r in rows}) > 1
    assert scores(indexed.bm25(i, ["the", "w3"])) == scores(lexical.bm25(docs, ["the", "w3"]))


def test_stemmed_postings_with_frequent_terms(spark, monkeypatch):
    from corpusql import workload_index
    from corpusql.operators import ranks

    want = {tuple(r) for r in workload_index.stemmed_postings(spark, "/root/testdata/sf0.001").collect()}
    for module in (ranks, workload_index):
        monkeypatch.setattr(module, "ROWS_IN_PART", 50)
    assert {tuple(r) for r in workload_index.stemmed_postings(spark, "/root/testdata/sf0.001").collect()} == want
