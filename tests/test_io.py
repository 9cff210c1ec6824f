import os

import pytest
from pyspark.sql import functions as F

from spanlake.hooks import EmbedderNotReady, embedder
from spanlake.operators import lexical as lx
from spanlake.operators import repair
from spanlake.sources import embeddings as emb, tables, transcripts
from spanlake.streaming import jobs

RECORDS = [("a.txt", 0, "héllo\tworld", [1.0, 2.0, 3.0]), ("a.txt", 150, "", [0.5, -1.0, 0.0]), ("b.txt", 0, "x", [0.0, 0.0, 1.0])]
SCHEMA = "source_file string, start_token int, text string, vec array<float>"


def test_fembed_round_trip_and_errors(spark, tmp_path):
    out = str(tmp_path / "out")
    emb.write_fembed(spark.createDataFrame(RECORDS, SCHEMA).repartition(2), out)
    assert sorted(tuple(r) for r in emb.read_fembed(spark, out).collect()) == sorted(RECORDS)
    for name, data in (("magic", b"NOPE" + bytes(12)), ("version", emb.HEADER.pack(emb.MAGIC, 2, 3, 1)), ("short", emb.HEADER.pack(emb.MAGIC, 1, 3, 1))):
        p = tmp_path / f"{name}.fembed"
        p.write_bytes(data)
        with pytest.raises(ValueError):
            list(emb.iter_records(str(p)))


def test_tsv_and_conversion(spark, tmp_path):
    head = "file_name\tstart_token\tembedding\ttext\n"
    (tmp_path / "one.embed").write_text(head + "a.txt\t0\t1.0, 2.5\thello\nshort\trow\na.txt\t150\t3,4\tmore\na.txt\t300\t1,2,3\tother dims\n")
    rows = emb.read_embed_tsv(spark, str(tmp_path / "*.embed")).orderBy("line").collect()
    assert [(r.start_token, r.vec, r.text) for r in rows] == [(0, [1.0, 2.5], "hello"), (150, [3.0, 4.0], "more"), (300, [1.0, 2.0, 3.0], "other dims")]
    got = emb.convert_tsv_to_fembed(spark, str(tmp_path), str(tmp_path / "bin")).collect()
    assert [(r.file, r.n, r.skipped) for r in got] == [("one.fembed", 2, 1)]
    chunks, counts = emb.import_embeddings_dir(spark, str(tmp_path / "bin"))
    assert chunks.count() == 2 and counts.collect()[0].imported == 2
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.embed").write_text("wrong\theader\there\tx\na\t0\t1\tt\n")
    with pytest.raises(Exception, match="header"):
        emb.read_embed_tsv(spark, str(tmp_path / "bad" / "*.embed")).collect()


def test_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.TXT", "sub/b.md", "c.pdf", "noext"):
        (tmp_path / name).write_text("body of " + name)
    ok, skipped = transcripts.scan_transcripts(spark, str(tmp_path))
    assert sorted((r.filename, r.raw) for r in ok.collect()) == [("a.TXT", "body of a.TXT"), ("b.md", "body of sub/b.md")]
    assert skipped.count() == 2


def test_files_are_listed_by_tasks_as_spark_lists_them(spark, tmp_path):
    (tmp_path / "in" / "sub" / "deep er").mkdir(parents=True)
    (tmp_path / "in" / ".dark").mkdir()
    for name in ("a.TXT", "sub/b.md", "sub/deep er/c #1 %20 é.txt", "_x.txt", "_x=1.txt", ".y.txt", ".dark/z.txt", "noext"):
        (tmp_path / "in" / name).write_text("body of " + name)
    (tmp_path / "in" / "empty.txt").write_text("")
    cols = ["path", "modificationTime", "length", "content"]
    for path in (f"{tmp_path}/in", f"{tmp_path}/in/sub/b.md", f"{tmp_path}/in/s*", f"file://{tmp_path}/in/"):
        old = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(cols)
        new = transcripts.listed(spark, path).withColumn("content", transcripts.content("path")).select(cols)
        assert sorted(map(tuple, new.collect())) == sorted(map(tuple, old.collect()))
    ok, skipped = transcripts.scan_transcripts(spark, f"{tmp_path}/in")
    assert ok.count() == 4 and skipped.count() == 1
    assert not ok.inputFiles() and not skipped.inputFiles()  # the driver knows none of them


def test_noted_files_are_streamed_by_their_notes(spark, tmp_path):
    src, store, cp, noted = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "cp"), str(tmp_path / "noted")
    (src / "x").mkdir(parents=True)
    go = lambda: run(jobs.stream_ingest(jobs.file_stream(spark, str(src), 3, jobs.file_name, noted), store, cp))
    for i in range(8):
        (src / "x" / f"{i}.txt").write_text(f"Text {i}. More.")
        os.utime(src / "x" / f"{i}.txt", (10**9 - i, 10**9 - i))
    (src / "skip.pdf").write_text("no")
    go()
    batches = {r.source_file: r.batch for r in spark.read.parquet(f"{store}/uploads").filter("status = 'done'").collect()}
    assert batches == {f"{i}.txt": (7 - i) // 3 for i in range(8)}  # what was modified first comes first, three at a time
    sources = [line for f in os.scandir(f"{cp}/sources/0") if not f.name.startswith(".") for line in open(f.path)]
    assert sum(".parquet" in x for x in sources) == 3 and not any(".txt" in x for x in sources)
    (src / "y").mkdir()
    (src / "y" / "5.txt").write_text("Anew.")
    (src / "bad.txt").write_bytes(b"caf\xe9.")
    go()
    go()  # nothing new
    assert {r.source_file: r.status for r in jobs.latest_status(spark, store).collect()} == {f"{i}.txt": "done" for i in range(8)} | {"bad.txt": "failed"}
    assert [r.content for r in jobs.ingested(spark, store).filter("source_file = '5.txt'").collect()] == ["Anew."]
    assert spark.read.parquet(f"{store}/uploads").filter("step = 2").count() == 10


def test_index_versions(spark, tmp_path):
    d = spark.createDataFrame([("a", "cat dog"), ("b", "dog")], "chunk_id string, content string")
    q = spark.createDataFrame([(1, "cat dog")], "query_id long, text string")
    at = str(tmp_path)
    assert tables.load_index(spark, at) is None
    fresh = lx.build_bm25(d)
    tables.save_index(fresh, at)
    first = tables.read_text(spark, f"{at}/CURRENT")
    rows = lambda i: sorted((r.chunk_id, round(r.score, 9)) for r in lx.bm25_search(q, i, 0).collect())
    assert rows(tables.load_index(spark, at)) == rows(fresh)
    tables.save_index(lx.build_bm25(d.limit(1)), at)
    assert tables.read_text(spark, f"{at}/CURRENT") != first and tables.load_index(spark, at).doc_stats.count() == 1


def run(q):
    q.awaitTermination()


def test_ingest_replaces_and_replays(spark, tmp_path):
    src, store, cp = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "cp")
    src.mkdir()
    (src / "a.txt").write_text("First one. Second one.")
    (src / "empty.md").write_text("  \n ")
    (src / "skip.pdf").write_text("no")
    go = lambda: run(jobs.stream_ingest(jobs.file_stream(spark, str(src), source=jobs.file_name), store, cp))
    go()
    status = {r.source_file: (r.status, r.error) for r in jobs.latest_status(spark, store).collect()}
    assert status == {"a.txt": ("done", ""), "empty.md": ("failed", "empty transcript")}
    assert [r.content for r in jobs.ingested(spark, store).collect()] == ["First one. Second one."]
    go()  # nothing new: nothing changes
    assert jobs.ingested(spark, store).count() == 1
    (src / "again").mkdir()
    (src / "again" / "a.txt").write_text("Now other words. Really.")
    go()
    assert [r.content for r in jobs.ingested(spark, store).collect()] == ["Now other words. Really."]
    assert spark.read.parquet(f"{store}/chunks").count() == 2


def test_backfill_pauses_then_drains(spark, tmp_path):
    data = spark.createDataFrame([("a", "x y"), ("b", "z")], "chunk_id string, content string")
    data.write.parquet(str(tmp_path / "in"))
    flag = str(tmp_path / "ready")

    def model(texts, side):
        if not os.path.exists(flag):
            raise EmbedderNotReady("EmbedderNotReady")
        return [[float(len(t))] for t in texts]

    def start():
        stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
        return jobs.stream_backfill(stream, embedder(model), str(tmp_path / "out"), str(tmp_path / "cp"))

    assert jobs.drain(start) == "paused"
    open(flag, "w").close()
    assert jobs.drain(start) == "drained"
    got = {r.chunk_id: r.vec for r in spark.read.parquet(str(tmp_path / "out/vectors")).collect()}
    assert got == {"a": [3.0], "b": [1.0]}


def test_a_broken_file_fails_alone(spark, tmp_path):
    src, store = tmp_path / "src", str(tmp_path / "store")
    src.mkdir()
    (src / "good.txt").write_text("One. Two.")
    (src / "broken.txt").write_bytes(b"caf\xe9 and more.")
    (src / "blank.txt").write_text(" ")
    run(jobs.stream_ingest(jobs.file_stream(spark, str(src), source=jobs.file_name), store, str(tmp_path / "cp")))
    status = {r.source_file: (r.status, r.error) for r in jobs.latest_status(spark, store).collect()}
    assert status == {"good.txt": ("done", ""), "broken.txt": ("failed", "not a UTF-8 text"), "blank.txt": ("failed", "empty transcript")}
    assert [r.content for r in jobs.ingested(spark, store).collect()] == ["One. Two."]
    assert {r.error for r in spark.read.parquet(f"{store}/rejects").collect()} == {"not a UTF-8 text", "empty transcript"}
    (src / "again").mkdir()
    (src / "again" / "broken.txt").write_text("Now fine.")
    run(jobs.stream_ingest(jobs.file_stream(spark, str(src), source=jobs.file_name), store, str(tmp_path / "cp")))
    assert {r.source_file: r.status for r in jobs.latest_status(spark, store).collect()}["broken.txt"] == "done"
    steps = spark.read.parquet(f"{store}/uploads").filter("source_file = 'good.txt'").orderBy("step").collect()
    assert [(r.status, r.part) for r in steps] == [("pending", "begun"), ("transcribing", "begun"), ("done", "ended")]


def test_work_that_died_leaves_its_files_transcribing(spark, tmp_path, monkeypatch):
    src, store = tmp_path / "src", str(tmp_path / "store")
    src.mkdir()
    (src / "a.txt").write_text("One.")
    real = jobs.chunk_raw
    monkeypatch.setattr(jobs, "chunk_raw", lambda df: 1 / 0)
    go = lambda: run(jobs.stream_ingest(jobs.file_stream(spark, str(src)), store, str(tmp_path / "cp")))
    with pytest.raises(Exception, match="ZeroDivision"):
        go()
    assert [r.status for r in jobs.latest_status(spark, store).collect()] == ["transcribing"]
    monkeypatch.setattr(jobs, "chunk_raw", real)
    go()  # the same batch again
    assert [r.status for r in jobs.latest_status(spark, store).collect()] == ["done"]


def test_backfill_of_stored_rows_and_of_rows_that_failed(spark, tmp_path):
    schema, at = "chunk_id string, content string", str(tmp_path / "out")
    table = spark.createDataFrame([("old1", "x"), ("old2", "yy"), ("bad", "?")], schema)
    table.write.parquet(str(tmp_path / "table"))
    calls = str(tmp_path / "calls")

    def model(texts, side):
        with open(calls, "a") as f:
            f.writelines(t + "\n" for t in texts)
        return [[] if t == "?" else [float(len(t))] for t in texts]

    def batch(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        run(jobs.stream_backfill(stream, embedder(model), at, str(tmp_path / "cp"), stored=lambda s: s.read.parquet(str(tmp_path / "table")), attempts=2, patience=2))
        return {r.chunk_id: r.vec for r in jobs.current_vectors(spark, at).collect()}

    first = batch(("new1", "zzz"))
    assert first == {"old1": [1.0], "old2": [2.0], "new1": [3.0]}
    jobs.clear_vectors(table.filter("chunk_id = 'old1'"), at, 0)
    assert {r.chunk_id for r in jobs.current_vectors(spark, at).collect()} == {"old2", "new1"}
    assert batch(("new1", "zzz"))["old1"] == [1.0]  # embedded again; the one that failed is not due yet
    batch(("new2", "w"))  # the second and last attempt
    batch(("new3", "w"))
    asked = open(calls).read().split()
    assert asked.count("?") == 2 and asked.count("x") == 2 and asked.count("yy") == 1 and asked.count("zzz") == 1
    work = spark.read.parquet(f"{at}/work").filter("chunk_id = 'bad'").orderBy("batch", "part").collect()
    assert [(r.batch, r.state, r.attempt) for r in work] == [(0, "failed", 1), (0, "leased", 1), (2, "failed", 2), (2, "leased", 2)]


def test_repair_mends_each_arm_and_touches_few_buckets(spark, tmp_path):
    rows = [(f"c{i}", f"word{i} shared. More.", [float(i)] if i % 2 else None, None) for i in range(40)] + [("silent", "!!", None, None), ("dead", "gone", [1.0], "x")]
    chunks = spark.createDataFrame(rows, "chunk_id string, content string, vec array<float>, deleted_at string")
    at = str(tmp_path / "arms")
    repair.write_arms(chunks, at, 8)
    assert repair.reconcile(chunks, at).isEmpty()
    files = {arm: {r.f for r in repair.read_arm(spark, at, arm).select(F.input_file_name().alias("f")).distinct().collect()} for arm in repair.ARMS}
    now = chunks.filter("chunk_id <> 'c3'").unionByName(spark.createDataFrame([("c90", "fresh", [5.0], None)], chunks.schema))
    now = now.withColumn("content", F.when(F.col("chunk_id") == "c5", "changed").otherwise(F.col("content")))
    report = {(r.arm, r.chunk_id, r.problem) for r in repair.repair(now, at, 8).collect()}
    both = {(arm, *x) for arm in ("keyword", "passages") for x in (("c3", "extra"), ("c90", "missing"), ("c5", "stale"))}
    assert report == both | {("vectors", "c3", "extra"), ("vectors", "c90", "missing")}
    assert repair.reconcile(now, at).isEmpty() and repair.repair(now, at, 8).count() == 0
    left = {r.f for r in repair.read_arm(spark, at, "keyword").select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(files["keyword"] & left) >= len(files["keyword"]) / 2  # other buckets keep their files
    assert {r.term for r in repair.read_arm(spark, at, "keyword").filter("chunk_id = 'c5'").collect()} == {"changed"}


def test_arms_are_made_where_they_are_written(spark, tmp_path):
    rows = [("a", "one two two", None, None), ("a", "one two two", None, None), ("b", None, [1.0], None), ("c", "!!", None, None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, content string, vec array<float>, deleted_at string")
    plans = {arm: make(repair._dealt(repair._source(chunks, arm), 4))._jdf.queryExecution().optimizedPlan().toString() for arm, (_, _, make) in repair.ARMS.items()}
    assert not any("Join" in plan for plan in plans.values())  # rows of an arm aren't shuffled to their digests
    at = str(tmp_path / "arms")
    repair.write_arms(chunks, at, 4)
    assert repair.reconcile(chunks, at).isEmpty()
    assert sorted((r.chunk_id, r.term or "", r.tf, r.dl) for r in repair.read_arm(spark, at, "keyword").collect()) == [("a", "one", 1, 3)] * 2 + [("a", "two", 2, 3)] * 2 + [("b", "", 0, 0), ("c", "", 0, 0)]
    assert sorted((r.chunk_id, r.text or "") for r in repair.read_arm(spark, at, "passages").collect()) == [("a", "one two two")] * 2 + [("b", ""), ("c", "")]
    repair.repair(chunks.filter("chunk_id = 'b'"), at, 4)
    assert {r.chunk_id for arm in repair.ARMS for r in repair.read_arm(spark, at, arm).collect()} == {"b"}
    assert {p.name for p in (tmp_path / "arms").iterdir()} == set(repair.ARMS)


def test_streamed_index_drops_old_rows(spark, tmp_path):
    at = str(tmp_path / "store")
    schema = "chunk_id string, content string"
    for rows in ([("a", "cat " * 100), ("b", "dog")], [("a", "bird")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(jobs.stream_index_update(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), at, str(tmp_path / "cp")))
    assert {r.term for r in jobs.streamed_index(spark, at).postings.collect()} == {"bird", "dog"}
    assert {r.term for r in jobs.streamed_index(spark, at, "passage").postings.collect()} == {"bird", "dog"}


def test_streamed_index_drops_superseded_chunks(spark, tmp_path):
    """A source that comes again under new chunk ids leaves nothing of the old ones."""
    at = str(tmp_path / "store")
    schema = "chunk_id string, source_file string, content string"
    for rows in ([("a", "s", "cat"), ("b", "t", "dog")], [("c", "s", "bird")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(jobs.stream_index_update(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), at, str(tmp_path / "cp")))
    index = jobs.streamed_index(spark, at)
    assert {r.term for r in index.postings.collect()} == {"bird", "dog"} and index.doc_stats.count() == 2


def test_same_name_in_one_batch(spark, tmp_path):
    """Of two files of one source the one modified last is ingested, once."""
    import os

    for folder, text, when in (("x", "Old one. Old two.", 1_000_000_000), ("y", "New one. New two. New three.", 1_100_000_000)):
        os.makedirs(tmp_path / "src" / folder)
        path = tmp_path / "src" / folder / "talk.txt"
        path.write_text(text)
        os.utime(path, (when, when))
    store = str(tmp_path / "store")
    run(jobs.stream_ingest(jobs.file_stream(spark, str(tmp_path / "src"), source=jobs.file_name), store, str(tmp_path / "cp")))
    assert spark.read.parquet(f"{store}/segments").count() == 3
    assert all("New" in r.content for r in jobs.ingested(spark, store).collect())
    assert jobs.latest_status(spark, store).count() == 1


def test_append_is_one_commit(spark, tmp_path):
    c = spark.createDataFrame([(f"c{i}", f"s{i % 3}", "t") for i in range(30)], "chunk_id string, source_file string, content string")
    tables.append_chunks(c, str(tmp_path))
    tables.append_chunks(c.limit(3), str(tmp_path))
    assert tables.read_source(spark, str(tmp_path), "s1").count() >= 10
    assert spark.read.parquet(str(tmp_path)).agg(F.count_distinct("created_at").alias("n")).first().n == 2
