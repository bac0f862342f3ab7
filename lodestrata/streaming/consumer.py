"""A consumer that works through jobs as they come: state for each job, leases for lost owners, attempts.

Two streams meet by job: jobs as they are entered, and outcomes of the work done on them. A job
that is queued, or that its last owner left running, is claimed: it is running, has one attempt
more and a lease. Each micro-batch hands its claimed jobs to the work, whose outcomes come back as
files of the second stream and end them. If none comes before the lease is over, the owner is
lost: the job is claimed again, or fails when its attempts are used up. An outcome counts for the
attempt that it belongs to alone, and a job that was entered before isn't entered again. Of several
outcomes of one attempt in a batch an error counts.

The jobs' ids are the stream's state (``dropDuplicates``). The jobs that are running are a table of
their own, written anew by each batch that changes one of them: a batch reads what came and what is
running, never the jobs that have ended. A third stream, of one row a batch, makes batches go on
when nothing comes, as leases end then too.

Changes are written batch by batch, under the batch's number, so a batch that is repeated after a
crash overwrites what it wrote. ``jobs`` tells the last state of each job.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingestion
from ..sources.shared import names_in, remove

OUTCOME = "job_id long, attempt int, error string"
_TIMES = ("created_at", "started_at", "finished_at")
_CHANGE = "part int, job_id long, doc_id long, status string, attempts int, created_at timestamp_ntz, started_at timestamp_ntz, finished_at timestamp_ntz, error string, change int"
_OPEN = f"{_CHANGE}, due long, claimed_in long, changed boolean"
_JOB, _OUTCOME, _TICK = 0, 1, 2  # what a row of a batch is (``part``)
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LOST = "the owner was lost"


@contextmanager
def with_rocks(spark: SparkSession) -> Iterator[None]:
    """A state store outside the heap, for a query started meanwhile (it takes the settings of its start)."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _running(spark: SparkSession, root: str, before: int | None = None) -> tuple[int, DataFrame] | None:
    """The newest table of running jobs, of the batches ``before`` one if it is given, and its batch."""
    numbers = [int(n.partition("=")[2]) for n in names_in(spark, f"{root}/open") if n.startswith("batch=")]
    newest = max((n for n in numbers if before is None or n < before), default=None)
    return None if newest is None else (newest, spark.read.schema(_OPEN).parquet(f"{root}/open/batch={newest}").where("status = 'running'"))


def _arrived(batch: DataFrame, now: Column) -> DataFrame:
    """A batch's jobs, claimed if they are queued or were left running, and its outcomes, as changes."""
    new = F.coalesce((F.col("part") == _JOB) & F.col("status").isin("queued", "running"), F.lit(False))
    kept = lambda c: F.when(~new, F.col(c)).alias(c)
    attempts = F.when(new, F.coalesce("attempts", F.lit(0)) + 1).otherwise(F.col("attempts")).alias("attempts")
    times = ("created_at", F.when(new, now).otherwise(F.col("started_at")).alias("started_at"), kept("finished_at"))
    return batch.where(F.col("part") != _TICK).select("part", "job_id", "doc_id", F.when(new, "running").otherwise(F.col("status")).alias("status"), attempts, *times, kept("error"), new.cast("int").alias("change"))


def _after(running: DataFrame, outcomes: DataFrame, number: int, ms: int, now: Column, lease_ms: int, most_attempts: int) -> DataFrame:
    """The running jobs after a batch: ended by an outcome, claimed again or failed behind their lease, or as they were (not ``changed``)."""
    told = outcomes.select("job_id", "attempts", F.col("error").alias("said"), F.lit(True).alias("told"))
    kept = ("doc_id", "created_at", "started_at", "change", "due", "claimed_in", "told")
    # not a join: null ids meet too, and no side is broadcast
    met = running.unionByName(told, allowMissingColumns=True).groupBy("job_id", "attempts").agg(*(F.max(c).alias(c) for c in kept), F.min("said").alias("said")).where("change is not null")
    ended = F.coalesce("told", F.lit(False))
    lost = ~ended & (F.col("due") <= ms)
    again = lost & (F.col("attempts") < most_attempts)
    given_up = lost & ~again
    status = F.when(given_up | (ended & (F.coalesce("said", F.lit("")) != "")), "failed").when(ended, "succeeded").otherwise("running")
    return met.select(
        F.lit(_JOB).alias("part"), "job_id", "doc_id", status.alias("status"), (F.col("attempts") + again.cast("int")).alias("attempts"), "created_at", F.when(again, now).otherwise(F.col("started_at")).alias("started_at"),
        F.when(ended | given_up, now).alias("finished_at"), F.when(given_up, LOST).otherwise(F.col("said")).alias("error"), (F.col("change") + (ended | lost).cast("int")).alias("change"),
        F.when(again, F.lit(ms + lease_ms)).otherwise(F.col("due")).alias("due"), F.when(again, F.lit(number)).otherwise(F.col("claimed_in")).cast("long").alias("claimed_in"), (ended | lost).alias("changed"),
    )


def ingesting(documents: DataFrame, content: DataFrame, embed: Callable[[DataFrame], DataFrame], dimension: int, now, keep: Callable[[DataFrame, DataFrame], None] | None = None) -> Callable[[DataFrame], DataFrame]:
    """Work that ingests the claimed jobs' documents, as ``ingestion.process`` does; ``keep`` gets each batch's chunks and vectors."""

    def work(claimed: DataFrame) -> DataFrame:
        empty = lambda kind: F.lit(None).cast(kind)
        queue = claimed.select("job_id", "doc_id", F.lit("queued").alias("status"), "attempts", empty("timestamp_ntz").alias("created_at"), empty("timestamp_ntz").alias("started_at"), empty("timestamp_ntz").alias("finished_at"), empty("string").alias("error"))
        out = ingestion.process(queue, documents, content, embed, dimension, now)
        if keep:
            keep(out.chunks, out.vectors)
        return out.jobs.select("job_id", (F.col("attempts") - 1).alias("attempt"), "error")

    return work


def start_consumer(
    spark: SparkSession, entered: DataFrame, root: str, work: Callable[[DataFrame], DataFrame], lease_ms: int = 600_000, most_attempts: int = 3, clock: str | None = None, **trigger
) -> StreamingQuery:
    """Start the query; its files and state are under ``root``.

    ``entered``: a stream of job_id, doc_id, status, attempts, created_at, started_at, finished_at,
    error. ``work``: from claimed jobs (job_id, doc_id, attempts) to outcomes (job_id, attempt, error);
    it may be called again for the same jobs. The query runs on, as leases end when nothing comes;
    ``run_until_settled`` stops it.
    """
    for name, columns in (("outcomes", OUTCOME), ("changes/batch=-1/step=0", _CHANGE)):  # the folders must be there
        spark.createDataFrame([], columns).write.mode("append").parquet(f"{root}/{name}")
    done = spark.readStream.schema(OUTCOME).option("recursiveFileLookup", "true").parquet(f"{root}/outcomes").select("job_id", F.col("attempt").alias("attempts"), "error", F.lit(_OUTCOME).alias("part"))
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load().select(F.lit(_TICK).alias("part"))
    jobs = entered.select("job_id", "doc_id", "status", F.col("attempts").cast("int").alias("attempts"), *(F.col(c).cast("timestamp_ntz").alias(c) for c in _TIMES), "error", F.lit(_JOB).alias("part"))
    rows = jobs.dropDuplicates(["job_id"]).unionByName(done, allowMissingColumns=True).unionByName(ticks, allowMissingColumns=True)

    def put(batch: DataFrame, number: int) -> None:
        session, ms = batch.sparkSession, int(time.time() * 1000)
        now = F.lit(clock or datetime.fromtimestamp(ms / 1000, UTC).replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
        path, held = f"{root}/changes/batch={number}", f"{root}/open/batch={number}"
        remove(session, path)
        _arrived(batch, now).write.parquet(f"{path}/step=0")
        arrived = session.read.schema(_CHANGE).parquet(f"{path}/step=0")
        last = _running(session, root, number)
        if arrived.isEmpty():
            remove(session, path)  # idle batches leave nothing behind
            if last is None or last[1].where(F.col("due") <= ms).isEmpty():
                return
            arrived = session.createDataFrame([], _CHANGE)
        running = arrived.where((F.col("part") == _JOB) & (F.col("status") == "running")).withColumns({"due": F.lit(ms + lease_ms), "claimed_in": F.lit(number).cast("long"), "changed": F.lit(False)})
        outcomes = arrived.where(F.col("part") == _OUTCOME)
        if last is not None:
            running = running.unionByName(last[1])
        if last is not None or not outcomes.isEmpty():
            running = _after(running, outcomes, number, ms, now, lease_ms, most_attempts)
        running.write.mode("overwrite").parquet(held)
        after = session.read.schema(_OPEN).parquet(held)
        after.where("changed").drop("due", "claimed_in", "changed").write.parquet(f"{path}/step=1")
        claimed = after.where((F.col("status") == "running") & (F.col("claimed_in") == number)).select("job_id", "doc_id", "attempts")
        if not claimed.isEmpty():
            # a name of its own for each batch and attempt: files that the stream has seen don't come again
            work(claimed).select("job_id", F.col("attempt").cast("int").alias("attempt"), "error").write.mode("overwrite").parquet(f"{root}/outcomes/batch={number}")
        for name in names_in(session, f"{root}/open"):  # if this batch is repeated it needs the last table, none needs an older one
            if last is not None and int(name.partition("=")[2]) < last[0]:
                remove(session, f"{root}/open/{name}")

    with with_rocks(spark):
        return rows.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(**(trigger or {"processingTime": "1 second"})).start()


def jobs(spark: SparkSession, root: str) -> DataFrame:
    """The last state of each job: job_id, doc_id, status, attempts, created_at, started_at, finished_at, error."""
    changes = spark.read.schema(_CHANGE).parquet(f"{root}/changes").where(F.col("part") == _JOB)
    names = ("doc_id", "status", "attempts", *_TIMES, "error")
    return changes.groupBy("job_id").agg(F.max_by(F.struct(*names), "change").alias("s")).select("job_id", *(F.col(f"s.{c}").alias(c) for c in names))


def run_until_settled(query: StreamingQuery, spark: SparkSession, root: str, seconds: float = 3600, pause: float = 0.3) -> None:
    """Let the query run until nothing more has come and no job is running; then stop it."""
    try:
        end = time.monotonic() + seconds
        while time.monotonic() < end:
            if query.awaitTermination(pause):  # it never ends by itself but by an error, which is raised here
                return
            # the first batch of a restart may be an old one again; leases make it go on with empty batches
            last = {p["batchId"]: sum(s["numInputRows"] for s in p["sources"] if "RatePerMicroBatch" not in s["description"]) for p in query.recentProgress[-2:]}
            if len(last) == 2 and not any(last.values()) and ((running := _running(spark, root)) is None or running[1].isEmpty()):
                return
        raise TimeoutError(f"jobs are still running after {seconds} seconds")
    finally:
        for _ in range(100):  # between two batches, if it may be, as a stop interrupts a batch
            if not query.isActive or not query.status["isTriggerActive"]:
                break
            time.sleep(0.05)
        query.stop()
