"""Scans of exported trees, office files, pages by bytes, stores and streams, on small fixtures."""

import gzip
import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusql.functions import text as T
from corpusql.jobs import embed
from corpusql.operators import boolean, code, pages, store
from corpusql.sources import documents, files
from corpusql.streaming import watch


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_space_documents(spark, tmp_path):
    body = {"storage": {"value": "<p>own &amp; text</p>"}}
    put(tmp_path / "S/page.ndjson", "\n".join([json.dumps({"id": 1234, "title": " One ", "body": body}), "", "{broken", json.dumps({"id": "77", "body": body}), json.dumps({"id": "555", "title": "Two"})]))
    put(tmp_path / "S/page_comments.ndjson", "\n".join([json.dumps({"id": "9", "containerTitle": "Box"}), json.dumps({"id": "10"})]))
    put(tmp_path / "S/page_storage/a/p_555.html", "<script>no</script><b>kept</b>")
    put(tmp_path / "S/page_storage/b/p_555.html", "<i>later</i>")
    found = files.space_documents(spark, str(tmp_path), files.storage_pages(spark, str(tmp_path)))
    got = {tuple(r) for r in found.collect()}
    assert got == {("1234", "S", "page", "One", "own & text"), ("555", "S", "page", "Two", "later"), ("9", "S", "comment", "Box", ""), ("10", "S", "comment", "Comment 10", "")}


def test_tree_attachments(spark):
    d = spark.createDataFrame([("S/x_123/a.txt", 1), ("S/x_123/y_4567/b.txt", 2), ("S/x_12/c.txt", 3)], "path string, length long")
    got = sorted(tuple(r) for r in files.tree_attachments(d).select("content_id", "relpath").collect())
    assert got == [("123", "S/x_123/a.txt"), ("123", "S/x_123/y_4567/b.txt"), ("4567", "S/x_123/y_4567/b.txt")]


def test_work_items(spark, tmp_path):
    put(tmp_path / "1.json", json.dumps({"id": 123, "System.Title": "T", "System.WorkItemType": "Bug", "System.Description": "D"}))
    put(tmp_path / "2.txt", "ID: 7\nTitle: a: b\nName: n\nbare line\n")
    put(tmp_path / "3.json.gz", gzip.compress(json.dumps({"title": "no id"}).encode()))
    texts = spark.read.text(str(tmp_path), wholetext=True).select(F.col("value").alias("text"))
    got = {tuple(r) for r in files.work_items(texts).collect()}
    assert got == {("ADO:123", "ADO", "bug", "T", "D"), ("ADO:7", "ADO", "ado", "n", "")}


def test_attachment_index(spark):
    one = json.dumps({"475": ["attachments/475_x.txt", {"file": {"localPath": "a/y.bin", "name": "Y"}, "size": 3}], "476": "none"})
    two = json.dumps([{"workItemId": 5, "path": "p/z.txt", "sha": "s"}, {"id": 6}])
    got = {tuple(r) for r in files.attachment_index(spark.createDataFrame([(one,), (two,), ("{bad",), (None,)], "text string")).collect()}
    assert got == {("475", "attachments/475_x.txt", "475_x.txt", 0, None), ("475", "a/y.bin", "Y", 3, None), ("5", "p/z.txt", "z.txt", 0, "s")}


def test_csv_rows(spark, tmp_path):
    put(tmp_path / "t.csv", "key ;v\nk1;one\n;two\nk3;\n")
    got = {(r.id, r.text) for r in files.csv_rows(spark, str(tmp_path / "t.csv"), "t", ";").collect()}
    assert got == {("DB:t:k1", "key=k1; v=one"), ("DB:t:row2", "key=; v=two"), ("DB:t:k3", "key=k3; v=")}


def test_code_files_and_blocks(spark, tmp_path):
    put(tmp_path / "src/a.py", "import x\n\ndef f():\n  pass\nclass G:\n  y\n")
    put(tmp_path / "node_modules/b.py", "def no(): pass\n")
    put(tmp_path / "Makefile", "\n".join(str(k) for k in range(200)))
    put(tmp_path / "c.exe", "no")
    found = files.code_files(spark, str(tmp_path))
    assert {r.path for r in found.collect()} == {"src/a.py", "Makefile"}
    got = sorted((r.path, r.symbol, r.line_start, r.line_end, r.text.split("\n")[0]) for r in code.chunks(found, "r").collect())
    assert got == [("Makefile", "slice:1-180", 1, 180, "// path: Makefile"), ("Makefile", "slice:141-200", 141, 200, "// path: Makefile"), ("src/a.py", "class G:", 5, 6, "# path: src/a.py"), ("src/a.py", "def f():", 3, 4, "# path: src/a.py")]


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


def test_office_text(spark):
    docx = zipped(**{"word__document.xml": '<d xmlns:w="u"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc><w:tc><w:p><w:t>b</w:t></w:p></w:tc></w:tr></w:tbl></w:body></d>'})
    pptx = zipped(**{"ppt__slides__slide2.xml": "<s><txBody><p><t>two</t></p></txBody></s>", "ppt__slides__slide1.xml": "<s><txBody><p><t>one</t></p></txBody></s>"})
    xlsx = zipped(**{"xl__workbook.xml": '<w xmlns:r="u"><sheets><sheet name="S" r:id="r1"/></sheets></w>', "xl___rels__workbook.xml.rels": '<x><y Id="r1" Target="worksheets/s1.xml"/></x>', "xl__sharedStrings.xml": "<s><si><t>hi</t></si></s>", "xl__worksheets__s1.xml": '<s><row><c t="s"><v>0</v></c><c><v>5</v></c></row><row><c/></row></s>'})
    d = spark.createDataFrame([("a.docx", docx), ("b.pptx", pptx), ("c.XLSX", xlsx), ("d.docx", b"no zip"), ("e.pdf", b"x"), ("f.xlsx", None)], "path string, content binary")
    got = {r.path: (r.text, r.error is None) for r in documents.office_text(d).collect()}
    assert got == {"a.docx": ("one\na\tb", True), "b.pptx": ("--- SLIDE 1 ---\none\n--- SLIDE 2 ---\ntwo", True), "c.XLSX": ("--- SHEET S ---\nhi\t5", True), "d.docx": ("", False), "f.xlsx": ("", False)}
    assert {r.member for r in documents.office_members(d.where("path = 'b.pptx'")).collect()} == {"ppt/slides/slide1.xml", "ppt/slides/slide2.xml"}


def test_text_of_bytes(spark):
    d = spark.createDataFrame([("é".encode(),), (b"\xe9",)], "content binary")
    assert [r.t for r in d.select(T.utf8_or_latin(F.col("content")).alias("t")).collect()] == ["é", "é"]


def test_byte_pages(spark):
    rows = [("r", i, 1011) for i in range(100)] + [("s", 0, 99), ("s", 1, 20_000), ("s", 2, 5)]
    paged = pages.byte_pages(spark.createDataFrame(rows, "req string, i int, bytes long"), "req", "i", "bytes", 10_000)
    got = {(r.req, r.page): (r["items"], r.approx_bytes, r.next) for r in pages.page_totals(paged, "req", "bytes").collect()}
    assert len(got) == 15 and all(v[1] <= 10_000 for k, v in got.items() if k[0] == "r")
    assert got["s", 0] == (1, 99, 1) and got["s", 1] == (1, 20_000, 2) and got["s", 2] == (1, 5, None)
    with pytest.raises(ValueError):
        pages.byte_pages(paged, "req", "i", "bytes", 0)


def test_cursor_ends(spark):
    d = spark.range(5)
    first, after = pages.cursor_page(d, [F.col("id")], 0, 3)
    assert after == 3 and pages.cursor_page(d, [F.col("id")], 3, 3)[1] is None and first.count() == 3


def test_boolean_queries():
    assert boolean.normalized_query("a–b && (c | NOT)") == '"a-b" AND ( "c" OR NOT )'
    assert boolean.phrase_words("Café_Nr. 2") == ("cafe", "nr", "2")
    t = boolean.parsed("a b OR c NOT d")
    assert (t.kind, t.left.kind, t.right.kind) == ("OR", "AND", "NOT")
    for bad in ("a (b OR c)", "NOT a", "a AND", "(a", ""):
        with pytest.raises(ValueError):
            boolean.parsed(bad)


def test_store(spark):
    c = spark.createDataFrame([("a", 0, [3.0, 4.0], "x"), ("b", 0, [0.0, 0.0], ""), ("c", 0, [1.0], "short")], "id string, chunk_ix long, embedding array<float>, text string")
    held = store.prepared(c, 2)
    assert {(r.id, tuple(r.embedding), r.snippet) for r in held.collect()} == {("a", (0.6, 0.8), "x"), ("b", (0.0, 0.0), None)} or held.count() == 2
    again = store.appended(held, store.prepared(c.where("id = 'a'").withColumn("text", F.lit("new")), 2))
    assert {(r.id, r.snippet) for r in again.collect()} == {("a", "new"), ("b", None)}
    assert [r.id for r in store.without_ids(again, spark.createDataFrame([("a",), ("a",)], "id string")).collect()] == ["b"]


def test_projection_is_stable_and_passes_right_widths(spark):
    v = [float(k) for k in range(8)]
    d = spark.createDataFrame([(1, v), (2, [1.0, 2.0]), (3, None), (4, [1.0])], "id int, v array<float>")
    got = {r.id: r.p for r in store.projected(d, "v", "p", 8, 2, 5).collect()}
    assert np.allclose(got[1], store.projection_matrix(2, 8, 5) @ np.array(v, np.float32), rtol=1e-5)
    assert got[2] == [1.0, 2.0] and got[3] is None and got[4] is None


def test_inverted_file_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((8, 16))
    v = centres[rng.integers(0, 8, 600)] + 0.1 * rng.standard_normal((600, 16))
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<float>").cache()
    index, found = store.inverted_file(d, 8)
    hits = 0
    for q in range(0, 600, 50):
        want = set(np.argsort(((v - v[q]) ** 2).sum(1), kind="stable")[:10].tolist())
        hits += len(want & {r.id for r in store.probe(index, found, v[q].tolist(), 10, 3).collect()})
    assert hits >= 0.9 * 120


def test_local_embedder(spark):
    d = spark.createDataFrame([("t",), ("t",), (None,), ("",)], "text string").select(store.local_embedder(8)(F.col("text")).alias("v")).collect()
    assert d[0].v == d[1].v and d[2].v == d[3].v and abs(sum(x * x for x in d[0].v) - 1) < 1e-5


def test_embedding_jobs(spark):
    docs = spark.createDataFrame([("1", "s", "page", "t", "w " * 2000), ("2", "s", "page", "t", "short")], "id string, space string, type string, title string, text string")
    chunks = embed.body_chunks(docs)
    held = embed.stored(None, embed.embedded(chunks, 8), 8)
    assert sorted((r.id, r.chunk_ix) for r in held.collect()) == [("1", 0), ("1", 1)]
    assert embed.only_new(chunks, held).count() == 0
    assert embed.document_vectors(docs, 8).count() == 2
    due, mark = embed.gate(store.fingerprint(docs, "id", "text"), None)
    assert due and not embed.gate(store.fingerprint(docs.repartition(3), "id", "text"), store.fingerprint(docs, "id", "text").first()["fingerprint"])[0]


def test_refused_batches_are_split():
    def send(batch):
        if len(batch) > 2 or any(len(x) > 5 for x in batch):
            raise ValueError
        return batch

    assert list(store.split_on_failure(["a", "b", "c", "abcdefgh"], send)) == ["a", "b", "c", "abcd"]


def test_watched_folder_takes_each_file_once(spark, tmp_path):
    seen = []
    each = lambda batch, n: seen.extend(r.id for r in batch.collect())
    put(tmp_path / "in/a.json", '{"id": "1"}\n')
    watch.watch_folder(spark, str(tmp_path / "in"), "id string", each, str(tmp_path / "state")).awaitTermination()
    put(tmp_path / "in/b.json", '{"id": "2"}\n')
    watch.watch_folder(spark, str(tmp_path / "in"), "id string", each, str(tmp_path / "state")).awaitTermination()
    assert seen == ["1", "2"]
