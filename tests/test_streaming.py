import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from modsift.streaming import ingest, state
from modsift.streaming import windows as W


def messages(folder, start, stop, name):
    folder.mkdir(exist_ok=True)
    lines = []
    for i in range(start, stop):
        body = {"id": str(i), "content": f"message number {i % 20} with enough text", "dataSource": "s", "labels": ["x"] if i % 2 else [], "createdAt": "2024-01-01T00:00:%02d" % (i % 60)}
        lines.append("not json" if i % 13 == 12 else json.dumps(body))
    (folder / name).write_text("\n".join(lines))


def test_stream_equals_batch_and_survives_restart(spark, tmp_path):
    src, out, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    messages(src, 0, 30, "a.txt")

    def run():
        stream = ingest.read_raw_text_stream(spark, str(src), per_trigger=1)
        ingest.process_stream(stream, out, ckpt).awaitTermination(120)

    run()
    first = {r.raw_text_id: r.content for r in spark.read.parquet(f"{out}/processed").collect()}
    run()
    assert spark.read.parquet(f"{out}/processed").count() == len(first), "nothing new, nothing doubled"
    messages(src, 30, 50, "b.txt")
    run()
    got = spark.read.parquet(f"{out}/processed").collect()
    batch = ingest.parse_messages(spark.read.text(str(src)).select("value"), "value")
    batch = ingest.process_messages(batch.where("parse_error IS NULL").dropDuplicates(["id"]))
    assert sorted(r.content for r in got) == sorted(r.cleaned for r in batch.where("success").collect())
    assert spark.read.parquet(f"{out}/features").count() == len(got)
    stream = ingest.read_raw_text_stream(spark, str(src), per_trigger=1)
    ingest.process_stream(stream, out, str(tmp_path / "fresh")).awaitTermination(120)
    assert spark.read.parquet(f"{out}/processed").count() == len(got), "a fresh checkpoint doubles nothing"


def test_errors_are_not_doubled_by_a_fresh_checkpoint(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    bodies = [{"id": str(i), "content": "short" if i % 3 else "a text that is long enough", "dataSource": "s"} for i in range(12)]
    (src / "a.txt").write_text("\n".join(map(json.dumps, bodies)))
    for checkpoint in ("first", "second"):
        ingest.process_stream(ingest.read_raw_text_stream(spark, str(src)), out, str(tmp_path / checkpoint)).awaitTermination(120)
        failed = [r.raw_text_id for r in spark.read.parquet(f"{out}/errors").collect()]
        assert sorted(failed) == sorted(str(i) for i in range(12) if i % 3)
        assert spark.read.parquet(f"{out}/processed").count() == 4


def test_unreadable_messages_are_failures(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    text = "a text that is long enough"
    bodies = [json.dumps({"id": "1", "content": text}), json.dumps({"id": "1"}), json.dumps({"content": text}), "not json", "not json", "[]"]
    (src / "a.txt").write_text("\n".join(bodies))
    for checkpoint in ("first", "second"):
        ingest.process_stream(ingest.read_raw_text_stream(spark, str(src)), out, str(tmp_path / checkpoint)).awaitTermination(120)
        failed = spark.read.parquet(f"{out}/errors").collect()
        assert sorted(r.raw_message for r in failed) == sorted(set(bodies[1:])), "each message once"
        assert {r.error for r in failed} == {"unreadable message"} and len({r.raw_text_id for r in failed}) == 4
        assert [r.raw_text_id for r in spark.read.parquet(f"{out}/processed").collect()] == ["1"]


@pytest.mark.parametrize("broken", ["features", "errors", "processed"])
def test_a_batch_that_failed_between_its_sinks_is_not_done(spark, tmp_path, monkeypatch, broken):
    src, out, write = tmp_path / "in", str(tmp_path / "out"), ingest.write_batch_folder
    src.mkdir()
    bodies = [{"id": str(i), "content": "short" if i % 3 else "a text that is long enough"} for i in range(12)]
    (src / "a.txt").write_text("\n".join(map(json.dumps, bodies)))

    def fails(df, path, run, batch_id):
        if path.endswith(broken):
            raise RuntimeError("the sink is away")
        write(df, path, run, batch_id)

    monkeypatch.setattr(ingest, "write_batch_folder", fails)
    with pytest.raises(StreamingQueryException):
        ingest.process_stream(ingest.read_raw_text_stream(spark, str(src)), out, str(tmp_path / "first"), attempts=1).awaitTermination(120)
    monkeypatch.setattr(ingest, "write_batch_folder", write)
    ingest.process_stream(ingest.read_raw_text_stream(spark, str(src)), out, str(tmp_path / "fresh")).awaitTermination(120)
    ids = lambda sink, key: sorted(r[0] for r in spark.read.parquet(f"{out}/{sink}").select(key).collect())
    good = sorted(str(i) for i in range(0, 12, 3))
    assert (ids("processed", "raw_text_id"), ids("features", "key")) == (good, good)
    assert ids("errors", "raw_text_id") == sorted(str(i) for i in range(12) if i % 3)


def test_parse_errors_go_to_dead_letters(spark, tmp_path):
    src = tmp_path / "in"
    messages(src, 0, 30, "a.txt")
    stream = ingest.read_raw_text_stream(spark, str(src))
    ingest.write_parse_errors(stream, str(tmp_path / "bad"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.json(str(tmp_path / "bad")).count() == 2


def test_micro_batches_retry(spark, tmp_path):
    src = tmp_path / "in"
    messages(src, 0, 5, "a.txt")
    seen, failures = [], []

    def handle(batch, batch_id):
        if not failures:
            failures.append(1)
            raise RuntimeError("first attempt fails")
        seen.append(batch.count())

    lines = spark.readStream.text(str(src))
    ingest.micro_batches(lines, handle, str(tmp_path / "c")).awaitTermination(120)
    assert sum(seen) == 5 and failures == [1]


def test_progress_stream(spark, tmp_path):
    src = tmp_path / "in"
    messages(src, 0, 12, "a.txt")
    lines = spark.readStream.text(str(src)).select(F.lit("t1").alias("task"))
    q = ingest.collect_progress(lines, "task", 24).writeStream.outputMode("update").format("memory").queryName("progress").option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    row = spark.table("progress").orderBy(F.desc("collected")).first()
    assert (row.task, row.collected, row.progress) == ("t1", 12, 50)


def test_windowed_rate_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:{s:02d}", "error" if (m + s) % 3 == 0 else "ok") for m in range(30) for s in (0, 20, 40)]
    df = spark.createDataFrame(rows, "ts STRING, kind STRING").select(F.col("ts").cast("timestamp").alias("ts"), "kind")
    df.write.parquet(str(tmp_path / "p"))
    batch = W.windowed_rate(df, "ts", F.col("kind") == "error", "5 minutes", "1 minute", 300, 0.02)
    stream = W.windowed_rate(spark.readStream.schema(df.schema).parquet(str(tmp_path / "p")), "ts", F.col("kind") == "error", "5 minutes", "1 minute", 300, 0.02)
    q = stream.writeStream.outputMode("append").format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(r.window_start, r.errors, r.breach) for r in batch.collect()}
    got = {(r.window_start, r.errors, r.breach) for r in spark.table("rates").collect()}
    assert got and got <= want, "windows closed by the watermark agree with the table form"


def test_sustained_breach(spark):
    rows = [(i, i in (1, 2, 3, 7, 8, 10)) for i in range(12)]
    w = spark.createDataFrame(rows, "i INT, breach BOOLEAN").select(F.timestamp_seconds(F.col("i") * 60).alias("window_start"), "breach")
    got = W.sustained_breach(w, [], 60, 120).orderBy("breach_start").collect()
    assert [r.windows for r in got] == [3, 2]


def test_quantile_interpolates(spark):
    df = spark.createDataFrame([(0.05,)] * 90 + [(0.4,)] * 10, "v DOUBLE").withColumn("ts", F.timestamp_seconds(F.lit(0)))
    r = W.windowed_quantile(df, "ts", "v", [0.1, 0.25, 0.5], 0.95, "5 minutes", "5 minutes", 0.3).first()
    assert abs(r.quantile - 0.375) < 1e-12 and r.breach


def test_forum_chain(spark):
    good = "这是一个很好的回答。内容很充分。值得阅读。" * 6
    rows = [("1", good, 120, 60, "answer"), ("2", "short", 120, 60, "answer"), ("3", good + "推广", 120, 60, "answer"), ("4", "plain words " * 10, 5, 0, "question")]
    df = spark.createDataFrame(rows, "id STRING, content STRING, vote_count INT, comment_count INT, type STRING")
    got = ingest.process_forum_records(df).collect()
    assert [r.id for r in got] == ["1"] and got[0].quality_label == 1 and got[0].is_answer


def run_folder(spark, df, folder, checkpoint):
    """Run a stream into a parquet folder, micro-batch after micro-batch, until its input is used up."""
    def sink(batch, batch_id):
        ingest.write_batch_folder(batch, folder, "r", batch_id)

    df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination(200)


def test_sustained_breach_alerts_equal_the_batch_islands(spark, tmp_path):
    import random

    rng = random.Random(1)
    events = []
    for minute in range(240):
        for host in ("a", "b"):
            bad = (minute // (17 if host == "a" else 29)) % 2 == 0
            if rng.random() > 0.1:  # some windows have no event
                events += [(host, minute * 60 + rng.randrange(60), bad and rng.random() > 0.05) for _ in range(3)]
    schema = "host STRING, seconds LONG, bad BOOLEAN"
    timed = lambda df: df.select("host", F.timestamp_seconds("seconds").alias("ts"), "bad")
    rate = lambda df: W.windowed_rate(df, "ts", F.col("bad"), "1 minute", "1 minute", 60, 1.5 / 60, ["host"])
    src = tmp_path / "in"
    for n in range(4):  # in the order of time, but not inside a file; with rows that come up to 5 minutes late
        part = [e for e in events if min(3, (e[1] + e[1] * 7919 % 300) // 3600) == n]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
    late = [("a", 60 * 60, True)] * 5 + [("a", 100_000, False), ("b", 100_000, False)]  # too late, and what moves the watermark on
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    out = str(tmp_path / "out")
    run_folder(spark, state.sustained_breach_alerts(rate(timed(stream)), ["host"], 60, 300), out, str(tmp_path / "c"))
    got = sorted((r.host, r.breach_start) for r in spark.read.parquet(out).collect())
    table = rate(timed(spark.createDataFrame(events, schema)))
    islands = W.sustained_breach(table, ["host"], 60, 300).collect()
    assert got == sorted((r.host, r.breach_start) for r in islands) and len(got) > 6
    at = {(r.host, r.breach_start): (r.alert_at - r.breach_start).total_seconds() for r in spark.read.parquet(out).collect()}
    assert set(at.values()) == {300.0}


def test_training_buffer_carries_over_batches_and_restarts(spark, tmp_path):
    src, out, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "c")
    schema = "id LONG, text STRING, score DOUBLE"

    def add(start, stop):
        rows = [(i, None if i % 7 == 0 else f"text {i}", None if i % 5 == 0 else i / 2) for i in range(start, stop)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
        run_folder(spark, state.training_batches_stream(stream, "id", 25, 2), out, ckpt)

    for start, stop in ((0, 40), (40, 95), (95, 130)):
        add(start, stop)
    run()
    run()  # nothing new
    first = spark.read.parquet(out).collect()
    add(130, 260)
    run()
    rows = spark.read.parquet(out).collect()
    ids = [r.id for r in rows]
    assert len(ids) == len(set(ids)) and len(first) < len(rows) and {r.id for r in first} < set(ids)
    sizes = {}
    for r in rows:
        assert r.text == (None if r.id % 7 == 0 else f"text {r.id}") and r.score == (None if r.id % 5 == 0 else r.id / 2)
        sizes[r.buffer, r.batch_no] = sizes.get((r.buffer, r.batch_no), 0) + 1
    assert set(sizes.values()) == {25} and 260 - len(ids) < 50
    for buffer in (0, 1):
        assert sorted(b for k, b in sizes if k == buffer) == list(range(sum(k == buffer for k, _ in sizes)))


def test_progress_is_flushed_at_every_tenth_text(spark, tmp_path):
    src, out, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "c")

    def add(counts):
        spark.createDataFrame([(t, f"x{i}") for t, n in counts.items() for i in range(n)], "task STRING, content STRING").coalesce(1).write.mode("append").parquet(str(src))

    def run():
        stream = spark.readStream.schema("task STRING, content STRING").option("maxFilesPerTrigger", 1).parquet(str(src))
        run_folder(spark, state.progress_flushes(stream, "task", 200), out, ckpt)

    for counts in ({"a": 7, "b": 31}, {"a": 7}, {"a": 2, "b": 9}):
        add(counts)
    run()
    add({"a": 5, "c": 3})
    run()
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("task", "collected", "progress").collect())
    assert got == [("a", 10, 5), ("a", 20, 10), ("b", 10, 5), ("b", 20, 10), ("b", 30, 15), ("b", 40, 20)]


def test_known_ids_go_before_repeats_are_looked_for(spark, tmp_path):
    """Ids of either target are skipped, and only what is left is grouped."""
    from modsift.streaming import ingest

    for name, ids in (("a", [(1,)]), ("b", [(2,)])):
        ingest.write_batch_folder(spark.createDataFrame(ids, "raw_text_id INT"), str(tmp_path / name), "first", 0)
    batch = spark.createDataFrame([(i % 4, "x") for i in range(8)], "id INT, content STRING")
    fresh = ingest.skip_processed(batch, [str(tmp_path / n) for n in ("a", "b", "none")], "second", 0)
    assert sorted(r.id for r in fresh.collect()) == [0, 3]
    plan = fresh._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Join")
