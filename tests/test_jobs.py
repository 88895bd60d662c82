"""Stored jobs: CSV trees, the keyed store and streams into it, stages, budgets, progress, aligned files, vector lists, deep pages."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from corpusql.jobs import csv_ingest, keyed_store, progress, stages
from corpusql.operators import pages, retrieval, store
from corpusql.sources import aligned, csvtree, files
from corpusql.streaming import budget, watch


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_csv_dialects_and_long_rows(spark, tmp_path):
    put(tmp_path / "a" / "one.csv", "id;name\n7;x\n;y\n\n8;z\n")
    put(tmp_path / "a" / "r.csv", "id,name\n9\n8,z,more,and\n")
    put(tmp_path / "two.CSV", 'v\tpk\n"line\nend"\tk1\nb\t\n')
    put(tmp_path / "three.csv", "x\n")
    put(tmp_path / "no.txt", "id\n1\n")
    found = [r.path for r in csvtree.tree(spark, str(tmp_path)).collect()]
    assert len(found) == 4
    got = {(r.id, r.text, r.row) for r in csvtree.documents(csvtree.rows(spark, sorted(found)), "c").collect()}
    assert got == {
        ("DB:c:one:7", "id=7; name=x", 1), ("DB:c:one:row2", "id=; name=y", 2), ("DB:c:one:8", "id=8; name=z", 3), ("DB:c:r:9", "id=9; name=", 1), ("DB:c:r:8", "id=8; name=z; =['more', 'and']", 2),
        ("DB:c:two:k1", "v=line\nend; pk=k1", 1), ("DB:c:two:row2", "v=b; pk=", 2),
    }
    assert csvtree.rows(spark, sorted(found), most_rows=1).count() == 3
    assert csvtree.rows(spark, []).count() == 0
    named = csvtree.rows(spark, [f for f in found if f.endswith("one.csv")], dialect="excel").first()
    assert named.names == ["id;name"]


def test_csv_ingest_leaves_unchanged_files_out(spark, tmp_path):
    root, path = tmp_path / "in", str(tmp_path / "store")
    put(root / "a.csv", "id,v\n1,x\n2,y\n2,z\n")
    put(root / "b.csv", "id;v\n1;x\n")
    first = csv_ingest.ingest(spark, str(root), "c", path, 8, 1)
    assert first == {"files_processed": 2, "files_skipped": 0, "rows": 4, "chunks": 3, "aligned": 1}
    assert csv_ingest.ingest(spark, str(root), "c", path, 8, 2) == {"files_processed": 0, "files_skipped": 2, "rows": 0, "chunks": 3, "aligned": 1}
    put(root / "b.csv", "id;v\n1;changed\n5;new\n")
    assert csv_ingest.ingest(spark, str(root), "c", path, 8, 3)["files_processed"] == 1
    got = {r.id: r.snippet for r in csv_ingest.chunks(spark, path).collect()}
    assert got == {"DB:c:a:1": "id=1; v=x", "DB:c:a:2": "id=2; v=z", "DB:c:b:1": "id=1; v=changed", "DB:c:b:5": "id=5; v=new"}
    assert csv_ingest.ingest(spark, str(tmp_path / "in"), "c", str(tmp_path / "empty"), 8, 1, glob="*.none") == {"files_processed": 0, "files_skipped": 0, "rows": 0, "chunks": 0, "aligned": 1}


def rows_of(frame):
    return sorted(map(tuple, frame.collect()))


def test_keyed_store(spark, tmp_path):
    path = str(tmp_path / "s")
    make = lambda *r: spark.createDataFrame(list(r), "id long, v string")
    read = lambda: rows_of(keyed_store.read(spark, path, ["id"]).select("id", "v"))
    assert keyed_store.read(spark, path, ["id"]) is None
    keyed_store.compact(spark, path, ["id"])
    keyed_store.write(make((1, "a"), (2, "b"), (None, "n")), path, ["id"], 0)
    keyed_store.write(make((2, "c"), (3, "d"), (3, "e")), path, ["id"], 1)
    want = sorted([(1, "a"), (2, "c"), (3, "e"), (None, "n")], key=repr)
    assert sorted(map(tuple, keyed_store.read(spark, path, ["id"]).select("id", "v").collect()), key=repr) == want
    keyed_store.delete(make((None, "")), path, ["id"], 2)
    keyed_store.write(make((2, "c"), (3, "d"), (3, "e")), path, ["id"], 1)  # replayed
    assert read() == [(1, "a"), (2, "c"), (3, "e")]
    keyed_store.compact(spark, path, ["id"])
    assert read() == [(1, "a"), (2, "c"), (3, "e")]
    keyed_store.write(make((1, "z"), (9, "q")), path, ["id"], 3)
    assert read() == [(1, "z"), (2, "c"), (3, "e"), (9, "q")]
    keyed_store.compact(spark, path, ["id"])
    assert read() == [(1, "z"), (2, "c"), (3, "e"), (9, "q")]


def test_a_replayed_batch_leaves_the_store_equal(spark, tmp_path):
    folder, path, state = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "state")
    put(folder / "1.json", '{"id": 1, "v": "a", "n": 1}\n{"id": 2, "v": "b", "n": 1}\n')
    run = lambda: watch.watch_into_store(spark, str(folder), "id long, v string, n long", path, ["id"], state, lambda d: d.where("v <> 'skip'"), order="n")
    q = run()
    q.awaitTermination()
    assert [p["rows"] for p in watch.progress(q) if p["rows"]] == [2]
    put(folder / "2.json", '{"id": 2, "v": "c", "n": 2}\n{"id": 3, "v": "skip", "n": 2}\n{"id": 2, "v": "d", "n": 3}\n')
    run().awaitTermination()
    once = rows_of(keyed_store.read(spark, path, ["id"]).select("id", "v"))
    assert once == [(1, "a"), (2, "d")]
    # The commit of the last batch is lost, as after a failure: the batch comes again under its number.
    commits = sorted((tmp_path / "state" / "commits").glob("[0-9]*"))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink()
    run().awaitTermination()
    assert rows_of(keyed_store.read(spark, path, ["id"]).select("id", "v")) == once


def test_closed_rates_are_appended_once(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    for k, seconds in enumerate(([0, 10, 70], [75, 2000], [2010], [5, 4000])):
        put(tmp_path / "in" / f"{k}.json", "".join(json.dumps({"ts": str(base + dt.timedelta(seconds=s)), "event_type": "x", "value": 1.0}) + "\n" for s in seconds))
        os.utime(tmp_path / "in" / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # read in this order
    out = str(tmp_path / "out")
    for _ in range(2):
        watch.closed_rates(spark, str(tmp_path / "in"), "ts timestamp, event_type string, value double", out, str(tmp_path / "state")).awaitTermination()
    got = {int((r.start - base).total_seconds()): r.n for r in spark.read.parquet(out).collect()}
    assert got[0] == 2 and got[60] == 2 and set(got) <= {0, 60, 1980}  # the event at 5 came too late, the last window is open


def test_stages_run_again_only_where_their_input_has_changed(spark, tmp_path):
    done = []

    def stage(name, source, fail=()):
        def work(s):
            if name in fail:
                raise RuntimeError(name)
            done.append(name)
            put(tmp_path / f"{name}.out" / "x", name + str(len(done)))

        return stages.Stage(name, lambda s: files.listing(s, str(tmp_path / source)), work)

    put(tmp_path / "raw" / "f", "1")
    put(tmp_path / "first.out" / "old", "")
    with pytest.raises(RuntimeError):
        stages.run_stages(spark, [stage("first", "raw"), stage("second", "first.out", fail=["second"])], str(tmp_path / "state"), 1)
    two = [stage("first", "raw"), stage("second", "first.out")]
    assert stages.run_stages(spark, two, str(tmp_path / "state"), 2) == {"first": "unchanged", "second": "done"}
    assert stages.run_stages(spark, two, str(tmp_path / "state"), 3) == {"first": "unchanged", "second": "unchanged"}
    assert done == ["first", "second"]
    put(tmp_path / "raw" / "g", "2")
    assert stages.run_stages(spark, two, str(tmp_path / "state"), 4) == {"first": "done", "second": "done"}


def test_backfill(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(5)], "id long, text string")
    path, keys = str(tmp_path / "s"), ["id"]
    make = lambda d: d.select("id", F.upper("text").alias("v"))
    assert stages.backfill(docs.limit(0), docs.where("id < 3"), keys, make, path, 1) == 3
    assert stages.backfill(keyed_store.read(spark, path, keys), docs, keys, make, path, 2) == 2
    assert stages.backfill(keyed_store.read(spark, path, keys), docs, keys, make, path, 3) == 0
    assert rows_of(keyed_store.read(spark, path, keys)) == [(k, f"T{k}") for k in range(5)]


def brute(items, requests, tokens, width):
    """Each request is sent at the first of all times at which both limits hold, found by trying them."""
    sent = []
    for at, n in items:
        times = sorted({max(at, sent[-1][0] if sent else at), *(t + width for t, _ in sent)})
        for t in (x for x in times if x >= at and (not sent or x >= sent[-1][0])):
            window = [m for s, m in sent if s > t - width]
            if len(window) < requests and (sum(window) + n <= tokens or not window):
                sent.append((t, n))
                break
    return [t for t, _ in sent]


@pytest.mark.parametrize("seed", range(3))
def test_budget_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    data, want = [], {}
    for key in ("a", "b", None):
        times = sorted(rng.sample(range(400), 60))
        sizes = [rng.choice([1, 2, 5, 30]) for _ in times]
        want |= {(key, t): s for t, s in zip(times, brute(list(zip(times, sizes, strict=True)), 3, 12, 20), strict=True)}
        data += [(key, start + dt.timedelta(seconds=t), t, n) for t, n in zip(times, sizes, strict=True)]
    rng.shuffle(data)
    rows = spark.createDataFrame(data, "k string, at timestamp, o long, n long")
    got = {(r.k, r.o): r.s for r in budget.admitted(rows, "k", "at", "o", "n", 3, 12, 20).withColumn("s", (F.unix_micros("sent_at") / 1_000_000 - int(start.timestamp())).cast("long")).collect()}
    assert got == want


def test_budget_of_a_stream(spark, tmp_path):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rng = random.Random(1)
    times = sorted(rng.sample(range(300), 60))
    sizes = [rng.choice([1, 2, 5]) for _ in times]
    for part in range(3):
        lines = [json.dumps({"k": "a", "at": (start + dt.timedelta(seconds=t)).isoformat(), "o": t, "n": n}) for t, n in list(zip(times, sizes, strict=True))[part * 20 : part * 20 + 20]]
        put(tmp_path / "in" / f"{part}.json", "\n".join(lines))
        os.utime(tmp_path / "in" / f"{part}.json", (1_700_000_000 + part, 1_700_000_000 + part))
    stream = spark.readStream.schema("k string, at timestamp, o long, n long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    sent = budget.admitted_stream(stream, "k", "at", "o", "n", 3, 12, 20)
    out = str(tmp_path / "out")
    sent.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {r.order: r.s for r in spark.read.parquet(out).select("order", (F.unix_micros("sent_at") / 1_000_000 - int(start.timestamp())).cast("long").alias("s")).collect()}
    assert got == dict(zip(times, brute(list(zip(times, sizes, strict=True)), 3, 12, 20), strict=True))


def test_progress_without_a_second_scan(spark, tmp_path):
    out = str(tmp_path / "out")
    report = progress.run(spark.range(1000).repartition(4), lambda d: d.write.parquet(out), even=F.count_if(F.col("id") % 2 == 0))
    assert report["rows"] == 1000 and report["even"] == 500 and report["rate"] > 0
    at = dt.datetime(2024, 1, 1)
    snapshots = spark.createDataFrame([(at + dt.timedelta(seconds=s), d) for s, d in ((0, 0), (50, 100), (100, 300))], "at timestamp, done long")
    assert tuple(progress.time_left(snapshots, 700).first()) == (300, 4.0, 400, 100.0)
    assert progress.time_left(snapshots.where("done = 0"), 700).first().rate is None
    progress.write_report(spark, report, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().rows == 1000


def test_aligned_files_heal(spark, tmp_path):
    put(tmp_path / "v" / "a.txt", "[1.0, 2.0]\n[3.0, 4.0]\n")
    put(tmp_path / "v" / "b.txt", "[5.0]\nbroken\n[7.0, 8.0]\n")
    put(tmp_path / "m.txt", "m0\nm1\nm2\nm3\n")
    v, m = aligned.numbered_lines(spark, str(tmp_path / "v")), aligned.numbered_lines(spark, str(tmp_path / "m.txt"))
    got = [(r.number, r.vector, r.meta) for r in aligned.aligned(v, m).orderBy("number").collect()]
    assert got == [(0, [1.0, 2.0], "m0"), (1, [3.0, 4.0], "m1"), (2, [5.0], "m2"), (3, None, "m3")]
    assert aligned.alignment(v, m, 2).first().asDict() == {"vectors": 5, "meta_lines": 4, "kept": 4, "wrong_width": 2, "aligned": False}


def test_lines_are_numbered_over_the_parts_of_a_file(spark, tmp_path):
    put(tmp_path / "x" / "a.txt", "".join(f"line {k}\n" for k in range(5000)))
    put(tmp_path / "x" / "b.txt", "".join(f"line {k}\n" for k in range(5000, 9000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        lines = aligned.numbered_lines(spark, str(tmp_path / "x"))
        assert lines.where(F.col("value") != F.concat(F.lit("line "), F.col("number").cast("string"))).count() == 0 and lines.count() == 9000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_stored_lists_reach_their_recall_and_read_less(spark, tmp_path):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(12)]
    data = [(k, 0, [c + rng.gauss(0, 0.3) for c in centres[k % 12]]) for k in range(1500)] + [(2000, 0, None)]
    chunks = spark.createDataFrame(data, "id long, space int, embedding array<float>")
    path = str(tmp_path / "lists")
    probes = store.write_lists(chunks, path, 12, rows_in_file=100)
    assert 1 <= probes < 12
    queries = chunks.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    exact = {(r.query_id, r.id) for r in retrieval.block_topk(chunks, queries, 10).collect()}
    got = {(r.query_id, r.id) for r in store.probe_batch(spark, path, queries, 10, block=50).collect()}
    assert len(exact & got) >= 0.9 * len(exact)
    one = store.probe_batch(spark, path, queries.where("query_id = 50"), 10, probes=1)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list_id" in plan and one.count() == 10
    assert store.probe_batch(spark, path, queries.limit(0), 10).count() == 0


def test_walking_pages_gives_every_row_once(spark):
    rows = spark.createDataFrame([(None if k % 9 == 0 else f"t{k % 5}", k) for k in range(60)], "t string, id long").repartition(3)
    seen, key, first = [], None, True
    while first or key is not None:
        page, key = pages.page_after(rows, ["t", "id"], 7, key)
        seen += [tuple(r) for r in page.collect()]
        first = False
    assert seen == sorted(seen, key=lambda r: (r[0] is not None, r[0] or "", r[1])) and len(seen) == 60 == len(set(seen))
    page, key = pages.page_after(rows, ["t", "id"], 60)
    assert page.count() == 60 and key is None
    plan = pages.page_after(rows, ["t", "id"], 7, ("t3", 30))[0]._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Filter" in plan and "offset" not in plan.lower()


def test_attachment_ingest(spark, tmp_path):
    import zipfile

    from corpusql.jobs import attachment_ingest

    root, path = tmp_path / "att", str(tmp_path / "store")
    put(root / "S" / "a.txt", "plain words " * 400)
    put(root / "S" / "short.txt", "too short")
    put(root / "S" / "b.exe", "never read " * 50)
    put(root / "T" / "odd.bin", "x" * 100 + "\0" + "y" * 100)
    put(root / "T" / "odd.dat", "readable " * 20)
    with zipfile.ZipFile(root / "T" / "d.docx", "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>' + f"<w:p><w:r><w:t>{'office words ' * 20}</w:t></w:r></w:p>" + "</w:body></w:document>")
    put(root / "T" / "broken.docx", "no archive at all " * 10)
    rows = [(str(k), n.split("/")[0], n) for k, n in enumerate(["S/a.txt", "S/short.txt", "S/b.exe", "T/odd.bin", "T/odd.dat", "T/d.docx", "T/broken.docx", "T/gone.txt"])]
    attachments = spark.createDataFrame(rows, "content_id string, space string, relpath string")
    first = attachment_ingest.ingest(spark, str(root), attachments, path, 8, 1)
    assert first == {"attachments": 8, "found": 7, "extracted": 7, "chunked": 3, "chunks": 4}
    kept = keyed_store.read(spark, f"{path}/chunks", ["id", "chunk_ix"])
    assert {(r.id, r.chunk_ix) for r in kept.collect()} == {("ATT:0:S/a.txt", 0), ("ATT:0:S/a.txt", 1), ("ATT:4:T/odd.dat", 0), ("ATT:5:T/d.docx", 0)}
    assert {r.url for r in kept.collect()} >= {"/attachments/S/a.txt", "/attachments/T/d.docx"}
    assert attachment_ingest.ingest(spark, str(root), attachments, path, 8, 2)["extracted"] == 0
    put(root / "T" / "odd.dat", "other words " * 20)
    assert attachment_ingest.ingest(spark, str(root), attachments, path, 8, 3, spaces=["T"])["extracted"] == 1
    assert keyed_store.read(spark, f"{path}/chunks", ["id", "chunk_ix"]).where("id = 'ATT:4:T/odd.dat' and snippet like 'other%'").count() == 1


def test_invariants(spark):
    from corpusql.operators import merge

    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id long, space string")
    got = {r.space: tuple(r)[1:] for r in merge.invariants(docs, docs.where("id < 3"), spark.createDataFrame([(1,), (1,), (9,)], "content_id long")).collect()}
    assert got == {None: (3, 2, 3, 0, 1, False), "a": (2, 2, 2, 0, 0, True), "": (1, 0, 0, 0, 0, True)}


def test_git_revision(tmp_path):
    assert files.git_revision(str(tmp_path / "none")) == ("none", None)
    put(tmp_path / "r" / ".git" / "HEAD", "ref: refs/heads/main\n")
    put(tmp_path / "r" / ".git" / "packed-refs", "# pack\nabc123 refs/heads/main\n")
    assert files.git_revision(str(tmp_path / "r")) == ("r", "abc123")
    put(tmp_path / "r" / ".git" / "refs" / "heads" / "main", "def456\n")
    assert files.git_revision(str(tmp_path / "r")) == ("r", "def456")


def test_unwanted_files(spark):
    from corpusql.sources import documents

    names = ["a/._x", "a/.git/config", "a/Build/x.o", "a/b.py", "build"]
    got = {r.path: r.why for r in documents.unwanted(spark.createDataFrame([(n, 1) for n in names], "path string, length long")).collect()}
    assert got == {"a/._x": "fork", "a/.git/config": "tool", "a/Build/x.o": "build"}
