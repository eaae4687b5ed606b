import gzip
import json

import pytest
from pyspark.sql import functions as F

from corpuslake.sources import commits, readers, schemas, writers
from corpuslake.streaming import streams


def test_metadata_files(spark, tmp_path):
    meta = {"act_number": "1", "act_type": "updated", "timeline": [{"date": "01/01/2020", "project_id": "p", "log_type": "REPRINT", "pdf_url": "u"}], "subsidiary_legislation": [], "subsidiary_total": 0, "stub": True}
    (tmp_path / "1.json").write_text(json.dumps(meta, indent=1))
    acts, timeline, subsidiary = readers.read_act_metadata(spark, str(tmp_path))
    assert (acts.count(), timeline.first().log_type, subsidiary.count()) == (1, "REPRINT", 0)
    assert [r.act_number for r in readers.stubs(acts).collect()] == ["1"]


def test_listings(spark, tmp_path):
    (tmp_path / "u.json").write_text(json.dumps({"lgt_act_no": "56", "title": '<a href="?lang=BM">KETERANGAN</a><a href="?lang=BI">EVIDENCE</a>'}))
    (tmp_path / "r.json").write_text(json.dumps({"ILA_ACT_NO": "2", "TITLEBI": "OLD", "REPEALEDBY": "3"}))
    got = readers.read_act_listings(spark, {"updated": str(tmp_path / "u.json"), "repealed": str(tmp_path / "r.json")}).orderBy("act_number").collect()
    assert [(r.act_number, r.title_bm, r.title_en, r.repealed_by) for r in got] == [("2", "", "OLD", "3"), ("56", "KETERANGAN", "EVIDENCE", None)]


def test_words(spark, tmp_path):
    raw = {"document_id": "d", "document_sha256": "s", "pages": [{"page_number": 1, "width": 10.0, "height": 10.0, "words": [[1.5, 2, 3, 4, "word", 0, 1, 2]]}]}
    with gzip.open(tmp_path / "d.json.gz", "wt") as f:
        f.write(json.dumps(raw))
    docs = spark.createDataFrame([("d", "s")], "document_id string, sha256 string")
    row = readers.read_words(spark, str(tmp_path), docs).first()
    assert (row.page, row.n, row.x0, row.raw, row.line, row["word"]) == (1, 0, 1.5, "word", 1, 2)
    assert readers.read_words(spark, str(tmp_path), docs.withColumn("sha256", F.lit("other"))).count() == 0


def chunk(run, n, content="c"):
    return (run, f"d-{run}", n, content)


def test_chunks_are_replaced_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "chunks")
    schema = "extraction_id string, document_id string, chunk_ordinal int, content string"
    runs = spark.createDataFrame([("x", 2), ("y", 1)], "extraction_id string, chunk_count int")
    first = spark.createDataFrame([chunk("x", 0), chunk("x", 1), chunk("y", 0)], schema)
    writers.write_chunks(first, runs, path)
    writers.write_chunks(spark.createDataFrame([chunk("x", 0, "new"), chunk("x", 1, "new")], schema), runs, path)
    read = lambda: writers.chunk_store(spark, path).read("chunks")
    assert sorted((r.extraction_id, r.content) for r in read().collect()) == [("x", "new"), ("x", "new"), ("y", "c")]
    with pytest.raises(writers.CountMismatch):
        writers.write_chunks(spark.createDataFrame([chunk("x", 0)], schema), runs, path)
    assert read().count() == 3


def test_graph_tables_are_verified(spark, tmp_path):
    path = str(tmp_path / "graph")
    rows = spark.createDataFrame([("d", "a"), ("d", "b"), ("e", "a")], "document_id string, id string")
    tables = {"provisions": rows, "edges": rows, "unresolved": rows.limit(1)}
    writers.write_graph(*tables.values(), path)
    assert writers.verify_graph(writers.graph_marks(tables), path).count() == 0
    other = rows.withColumn("id", F.when(F.col("id") == "b", "c").otherwise(F.col("id")))
    expected = writers.graph_marks(tables | {"edges": other, "unresolved": rows.filter("document_id = 'd'")})
    got = {(r.document_id, r.part): (r.rows, r.stored_rows) for r in writers.verify_graph(expected, path).collect()}
    assert got == {("d", "edges"): (2, 2), ("d", "unresolved"): (2, 1)}  # as many edges, but another one


def test_readers_see_whole_versions(spark, tmp_path, monkeypatch):
    rows = lambda *names: spark.createDataFrame([(n, n * 2) for n in names], "id string, text string")
    content = lambda df: sorted((r.id, r.text) for r in df.collect())
    store = commits.Store(spark, str(tmp_path / "kept"), "id", buckets=4)
    with pytest.raises(KeyError):
        store.read("a")
    assert store.commit({"a": rows("k", "l", "m"), "b": rows("k")}) == 1
    before = store.read("a")
    assert store.commit({"a": rows("l")}, rows("k", "l")) == 2  # k goes from both tables
    assert content(before) == [("k", "kk"), ("l", "ll"), ("m", "mm")]  # a reader of the first version keeps seeing it
    assert (content(store.read("a")), content(store.read("b"))) == ([("l", "ll"), ("m", "mm")], [])
    assert content(store.read("b", version=1)) == [("k", "kk")]

    def dies(*_):
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(commits.Store, "_publish", dies)
        with pytest.raises(OSError):
            store.commit({"a": rows("z"), "b": rows("z")}, rows("l", "m"))
    assert (store.version(), content(store.read("a"))) == (2, [("l", "ll"), ("m", "mm")])

    # A writer that comes late finds its number taken.
    late = store.entry()
    store.commit({"b": rows("n")})
    with pytest.raises(commits.CommitConflict):
        store._publish(3, late)
    assert content(store.read("b")) == [("n", "nn")]
    assert store.commit({"b": rows("o")}, mark=("w", 5)) == 4 and store.commit({"b": rows("o")}, mark=("w", 5)) == 4
    assert content(store.read("b")) == [("n", "nn"), ("o", "oo")]
    assert store.vacuum(keep=1) >= 1
    assert (content(store.read("a")), content(store.read("b"))) == ([("l", "ll"), ("m", "mm")], [("n", "nn"), ("o", "oo")])


def test_full_buckets_are_written_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "MOST_FOLDERS", 3)
    store = commits.Store(spark, str(tmp_path / "kept"), "id", buckets=2)
    for i in range(8):
        store.commit({"a": spark.createDataFrame([(i,)], "id long").repartition(1)})
    assert max(map(len, store.entry()["tables"]["a"]["folders"].values())) <= 3
    assert sorted(r.id for r in store.read("a").collect()) == list(range(8))


def test_reports_are_written_in_order(spark, tmp_path):
    path = str(tmp_path / "report")
    writers.write_report(spark.createDataFrame([("b", 1), ("a", 2)], "code string, n int"), path, ["code"])
    lines = [line for f in sorted((tmp_path / "report").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines == ['{"code":"a","n":2}', '{"code":"b","n":1}']


def test_observations_are_taken_in_once(spark, tmp_path):
    schema = "document_id string, source_url string, observed_at timestamp, timeline_date string, timeline_type string"
    source, sink, bad, mark = (str(tmp_path / n) for n in ("in", "out", "bad", "mark"))
    row = lambda d, kind: spark.sql(f"SELECT '{d}' AS document_id, 'u' AS source_url, TIMESTAMP'2024-01-01' AS observed_at, '1' AS timeline_date, '{kind}' AS timeline_type")
    for part in (row("a", "R").union(row("a", "R")), row("a", "X").union(row("b", "R"))):
        part.coalesce(1).write.mode("append").parquet(source)
        streams.stream_observations(streams.read_stream(spark, source, schema), sink, bad, mark).awaitTermination()
    assert sorted((r.document_id, r.timeline_type) for r in spark.read.parquet(sink).collect()) == [("a", "R"), ("b", "R")]
    assert [(r.document_id, r.timeline_type) for r in spark.read.parquet(bad).collect()] == [("a", "X")]


def test_bad_bundles_block_no_other(spark, tmp_path):
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    import hashlib

    def bundle(run, count, text, said=None):
        item = {"content": text, "content_sha256": hashlib.sha256((said or text).encode()).hexdigest(), "extraction_id": run, "document_id": "d"}
        return json.dumps({"extraction": {"extraction_id": run, "document_id": "d", "chunk_count": count, "status": "ready"}, "chunks": [item]})

    (tmp_path / "in").mkdir()
    (tmp_path / "in/b.json").write_text("\n".join([bundle("x", 1, "fine"), bundle("y", 2, "fine"), bundle("z", 1, "changed", "fine"), bundle("v", 1, "one"), bundle("v", 1, "other")]))
    stream = lambda: spark.readStream.schema(schemas.BUNDLE).json(source)
    for _ in range(2):
        streams.stream_ingest(stream(), sink, mark).awaitTermination()
    read = lambda name: writers.chunk_store(spark, sink).read(name)
    assert [(r.extraction_id, r.content) for r in read("chunks").collect()] == [("x", "fine")]
    assert sorted((r.extraction_id, r.outcome) for r in read("rejected").collect()) == [("v", "conflict"), ("v", "conflict"), ("y", "invalid"), ("z", "invalid")]
    (tmp_path / "in/c.json").write_text("\n".join([bundle("x", 1, "new"), bundle("w", 1, "more")]))
    streams.stream_ingest(stream(), sink, mark).awaitTermination()
    (tmp_path / "in/d.json").write_text(bundle("x", 1, "fine"))
    streams.stream_ingest(stream(), sink, mark).awaitTermination()
    assert sorted((r.extraction_id, r.content) for r in read("chunks").collect()) == [("w", "more"), ("x", "fine")]  # what is stored stays
    assert read("rejected").filter("extraction_id = 'x'").count() == 1


def run_stream(spark, df, tmp_path, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_counts_of_a_stream_equal_the_batch(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = {(r.start, r.event_type): r.n for r in run_stream(spark, streams.counts(stream), tmp_path, "counted", "append")}
    want = {(r.start, r.event_type): r.n for r in streams.counts(rows).collect()}
    assert got and all(want[k] == n for k, n in got.items())
    assert max(k[0] for k in want) >= max(k[0] for k in got)


def test_activation_stream_equals_the_fold(spark, tmp_path):
    from corpuslake.operators import registry

    log = spark.createDataFrame([(str(k), "en", i, "rollback" if i % 3 == 2 else "activate", f"x{i}") for k in range(3) for i in range(8)], "act_number string, language string, seq long, action string, extraction_id string")
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    got = sorted(map(tuple, run_stream(spark, streams.stream_activation(stream), tmp_path, "activated", "append")))
    assert got == sorted(map(tuple, registry.activation_state(log).collect()))


def test_entries_in_any_order_are_taken_by_their_times(spark, tmp_path):
    import random
    from datetime import datetime, timedelta

    from corpuslake.operators import registry

    start, rng = datetime(2024, 1, 1), random.Random(6)
    rows = [(str(k), "en", i, "rollback" if i % 3 == 2 else "activate", f"x{i}", start + timedelta(minutes=10 * i + k)) for k in range(3) for i in range(12)]
    fields = "act_number string, language string, seq long, action string, extraction_id string, at timestamp"
    late = sorted(rows, key=lambda r: r[5] + timedelta(minutes=rng.randrange(50)))  # out of order by less than the lateness
    late.append(("end", "en", 0, "activate", "x", start + timedelta(days=2)))
    for i in range(0, len(late), 9):
        spark.createDataFrame(late[i : i + 9], fields).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.read_stream(spark, str(tmp_path / "in"), fields)
    got = sorted(tuple(r) for r in run_stream(spark, streams.stream_activation_in_order(stream), tmp_path, "in_order", "append") if r.act_number != "end")
    log = spark.createDataFrame(rows, fields).drop("at")
    assert got == sorted(map(tuple, registry.activation_state(log).collect()))


def test_history_stream_equals_the_trim(spark, tmp_path):
    from corpuslake.operators import memory

    rows = spark.createDataFrame([(t, p, "user" if p % 2 == 0 else "assistant", 7 + p) for t in range(3) for p in range(7)], "thread_id long, pos int, role string, tokens int")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = {r.thread_id: (r.kept_messages, r.kept_tokens) for r in run_stream(spark, streams.stream_history(stream, 40), tmp_path, "kept", "update")}
    want = {r.thread_id: (r.n, r.t) for r in memory.trim_history(rows, 40).groupBy("thread_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).collect()}
    assert got == want


def test_history_begins_once(spark, tmp_path):
    """A thread's first message is left out if it isn't the user's, a later one of the same kind not."""
    from corpuslake.operators import memory

    rows = [(1, 0, "assistant", 5), (1, 1, "assistant", 6), (1, 2, "user", 7), (2, 0, "assistant", 5), (3, 0, None, 2), (3, 1, "user", 3)]
    table = spark.createDataFrame(rows, "thread_id long, pos int, role string, tokens int")
    for pos in range(3):
        table.filter(f"pos = {pos}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.read_stream(spark, str(tmp_path / "in"), table.schema)  # a file, and so a message of each thread, at a time
    got = run_stream(spark, streams.stream_history(stream, 40), tmp_path, "begun", "update")
    assert len(got) == 6
    newest = {r.thread_id: (r.kept_messages, r.kept_tokens) for r in sorted(got, key=lambda r: r.last_pos)}
    want = {r.thread_id: (r.n, r.t) for r in memory.trim_history(table, 40).groupBy("thread_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).collect()}
    assert newest == want | {2: (0, 0)}
    whole = {r.thread_id: (r.kept_messages, r.kept_tokens) for r in streams.stream_history(table, 40).collect()}
    assert newest == whole


def test_flattened_words_are_not_grouped_one_by_one(spark):
    from twins import DATA

    from corpuslake import plans

    plan = plans.QUERIES["io4_flatten_words"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Join") == 1
