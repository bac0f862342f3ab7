"""Streams with state: jobs with leases and attempts, and frames that arrive in pieces."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import frames
from lodestrata.streaming import consumer, tokens

JOB = "job_id long, doc_id long, status string, attempts int, created_at timestamp_ntz, started_at timestamp_ntz, finished_at timestamp_ntz, error string"
DAY = dt.datetime(2024, 1, 1)


def test_jobs_with_lost_owners(spark, tmp_path):
    entered, root, seen = str(tmp_path / "in"), str(tmp_path / "consumer"), []
    put = lambda *rows: spark.createDataFrame(rows, JOB).write.mode("append").parquet(entered)

    def work(claimed):
        seen.extend((r["job_id"], r["attempts"]) for r in claimed.collect())
        # job 4 loses its first owner, job 5 all of them; job 2's document is bad
        done = claimed.where("job_id <> 5 and not (job_id = 4 and attempts = 1)")
        return done.select("job_id", F.col("attempts").alias("attempt"), F.when(F.col("doc_id") == 2, "bad").alias("error"))

    def run():
        stream = spark.readStream.schema(JOB).parquet(entered)
        consumer.run_until_settled(consumer.start_consumer(spark, stream, root, work, lease_ms=300, most_attempts=3), spark, root, 90)
        return {r["job_id"]: (r["status"], r["attempts"], r["error"]) for r in consumer.jobs(spark, root).collect()}

    put((1, 1, "queued", 0, DAY, None, None, None), (2, 2, "running", 1, DAY, DAY, None, None), (3, 3, "succeeded", 1, DAY, DAY, DAY, None), (4, 4, "queued", 0, DAY, None, None, None), (5, 5, "queued", 0, DAY, None, None, None))
    want = {1: ("succeeded", 1, None), 2: ("failed", 2, "bad"), 3: ("succeeded", 1, None), 4: ("succeeded", 2, None), 5: ("failed", 3, consumer.LOST)}
    assert run() == want
    ended = {r["job_id"]: (r["started_at"], r["finished_at"]) for r in consumer.jobs(spark, root).collect()}
    assert ended[3] == (DAY, DAY) and all(a <= b for a, b in ended.values())
    # from the checkpoint: known jobs aren't entered again, a new one is
    put((1, 1, "queued", 0, DAY, None, None, None), (6, 6, "running", 4, DAY, DAY, None, None))
    assert run() == want | {6: ("succeeded", 5, None)}
    assert sorted(seen) == [(1, 1), (2, 2), (4, 1), (4, 2), (5, 1), (5, 2), (5, 3), (6, 5)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != consumer._ROCKS


def test_an_error_of_the_work_is_raised_and_repaired(spark, tmp_path):
    entered, root, broken = str(tmp_path / "in"), str(tmp_path / "consumer"), [True]
    spark.createDataFrame([(i, i, "queued", 0, DAY, None, None, None) for i in range(20)], JOB).write.parquet(entered)

    def work(claimed):
        if broken[0]:
            raise RuntimeError("the work broke")
        return claimed.select("job_id", F.col("attempts").alias("attempt"), F.lit(None).cast("string").alias("error"))

    start = lambda: consumer.start_consumer(spark, spark.readStream.schema(JOB).parquet(entered), root, work)
    with pytest.raises(Exception, match="the work broke"):
        consumer.run_until_settled(start(), spark, root, 90)
    broken[0] = False
    consumer.run_until_settled(start(), spark, root, 90)  # the batch is done again
    rows = consumer.jobs(spark, root).collect()
    assert len(rows) == 20 and {(r["status"], r["attempts"]) for r in rows} == {("succeeded", 1)}


def test_a_batch_reads_what_came_and_what_is_running(spark, tmp_path):
    entered, root, plans = str(tmp_path / "in"), str(tmp_path / "consumer"), []
    rows = [(i, i, "queued" if i < 6 else "succeeded", 0, DAY, None, None, None) for i in range(40)] + [(None, 7, "running", 1, DAY, DAY, None, None)]
    spark.createDataFrame(rows, JOB).write.parquet(entered)

    def work(claimed):
        # two outcomes of one attempt, one of an attempt that never was, one of a job that never was
        done = claimed.select("job_id", F.col("attempts").alias("attempt"), F.when(F.col("job_id") == 2, "bad").alias("error"))
        wrong = spark.createDataFrame([(2, 1, None), (3, 9, "late"), (99, 1, None)], consumer.OUTCOME)
        return done.unionByName(wrong)

    query = consumer.start_consumer(spark, spark.readStream.schema(JOB).parquet(entered), root, work)
    while not query.recentProgress:
        query.awaitTermination(0.2)
    plans.append(query._jsq.explainInternal(False))
    consumer.run_until_settled(query, spark, root, 90)
    assert "Dedup" in plans[0] and "Python" not in plans[0] and "TransformWithState" not in plans[0]  # no job passes through Python
    got = {r["job_id"]: (r["status"], r["attempts"], r["error"]) for r in consumer.jobs(spark, root).collect()}
    want = {i: ("succeeded", int(i < 6), None) for i in range(40)} | {2: ("failed", 1, "bad"), None: ("succeeded", 2, None)}
    assert got == want
    tables = sorted(n.name for n in (tmp_path / "consumer" / "open").iterdir())
    assert tables == ["batch=0", "batch=1"]
    assert [spark.read.parquet(f"{root}/open/{n}").count() for n in tables] == [7, 7]  # never the jobs that had ended before
    changes = {n.name for n in (tmp_path / "consumer" / "changes").iterdir()}
    assert changes >= {"batch=0", "batch=1"} and not changes & {"batch=2", "batch=3"}  # idle batches leave nothing


STREAMS = {
    "plain": 'data: {"content":"a","stop":false}\n\nevent: x\n\ndata: {bad\n\n\n\ndata: {"content":"b"}\n\ndata: {"content":"!","stop":true}\n\ndata: {"content":"late"}\n\n',
    "open end": 'data: {"content":"é🙂"}\n\n data: {"content":"\\n\\n"}\n\ndata: {"content":5}\n\ndata: {"content":null}\n\ndata: {"content":"end"}',
    "empty": "",
    "nothing": "\n\n\n\nhello\n\n",
    "long": "".join(f'data: {{"content":"w{i} ü "}}\n\n' for i in range(300)),
}


def test_frames_cut_anywhere(spark, tmp_path):
    """Every cut gives the answers of whole streams: each byte alone, and random pieces in random order over several batches."""
    want = {r[0]: r[1] for r in spark.createDataFrame(list(STREAMS.items()), "k string, s string").select("k", frames.answer(F.col("s"))).collect()}
    rng, rows = random.Random(2), []
    for name, text in STREAMS.items():
        data = text.encode()
        for turn in range(6):
            cuts = range(1, len(data)) if turn == 0 and len(data) < 400 else sorted(rng.sample(range(1, len(data)), rng.randint(0, min(40, len(data) - 1)))) if len(data) > 1 else []
            places = [0, *cuts, len(data)]
            made = [(f"{name}/{turn}", i, data[a:b], b == len(data) and i == len(places) - 2) for i, (a, b) in enumerate(zip(places[:-1], places[1:], strict=True))]
            rows += made + rng.sample(made, len(made) // 5)  # some come twice
    rng.shuffle(rows)
    landing, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    run = lambda: tokens.start_joining(spark, spark.readStream.schema(tokens.PIECE).option("maxFilesPerTrigger", 1).parquet(landing), target, state).awaitTermination()
    for part in range(3):
        spark.createDataFrame(rows[part::3], tokens.PIECE).coalesce(1 + part % 2).write.mode("append").parquet(landing)
        run()  # from the checkpoint each time
    found = tokens.tokens(spark, target)
    got = {r["stream_id"]: r["answer"] for r in tokens.answers(found).collect()}
    assert {f"{k}/{i}": v for k, v in want.items() for i in range(6) if v} == {k: v for k, v in got.items() if v}
    assert found.count() == found.select("stream_id", "token").distinct().count()


def test_frames_are_joined_without_a_call_for_each_piece(spark, tmp_path):
    landing, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    text = b'data: {"content":"a"}\n\ndata: {"content":"b","stop":true}\n\n'
    cut = lambda name, *at: [(name, i, text[4 * i : 4 * i + 4], 4 * i + 4 >= len(text)) for i in at]
    n = -(-len(text) // 4)
    for part in ([*cut("x", *range(3, n)), *cut("y", *range(n))], [*cut("x", 0, 1), *cut("y", 0, 5)], cut("x", 2), cut("y", *range(n))):
        spark.createDataFrame(part, tokens.PIECE).coalesce(1).write.mode("append").parquet(landing)
        query = tokens.start_joining(spark, spark.readStream.schema(tokens.PIECE).parquet(landing), target, state)
        query.awaitTermination()
        assert "TransformWithState" not in query._jsq.explainInternal(False)
    assert {r["stream_id"]: r["answer"] for r in tokens.answers(tokens.tokens(spark, target)).collect()} == {"x": "ab", "y": "ab"}
    assert tokens.tokens(spark, target).count() == 4  # pieces behind the end don't begin the stream again
    tables = sorted((tmp_path / "state" / "streams").iterdir())
    assert [t.name for t in tables] == ["batch=2", "batch=3"]  # the last one, and the one it was made from
    assert spark.read.parquet(str(tables[1])).count() == 0  # ended streams are ids only
    assert {r[0] for r in spark.read.parquet(f"{state}/ended").select("stream_id").collect()} == {"x", "y"}


def test_the_sink_commits_a_batch_once(tmp_path):
    writer, path = tokens.TokenWriter(str(tmp_path)), tmp_path / "tokens"
    row = lambda i: {"stream_id": "s", "token": i, "content": "x", "stop": False}
    first, none = writer.write(iter([row(0), row(1)])), writer.write(iter([]))
    assert first.rows == 2 and none.file is None
    writer.commit([first, none, None], 0)
    again = writer.write(iter([row(0), row(1)]))
    assert len(list(path.iterdir())) == 2
    writer.commit([again], 0)  # the same batch after a crash: its new files go
    assert [f.name for f in path.iterdir()] == [first.file.split("/")[1]]
    lost = writer.write(iter([row(2)]))
    writer.abort([lost, None], 1)
    assert len(list(path.iterdir())) == 1 and [f.name for f in (tmp_path / "commits").iterdir()] == [f"{0:020d}.json"]
