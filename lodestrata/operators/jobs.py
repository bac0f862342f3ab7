"""The ingestion queue as tables: claims, restarts, outcomes, and the newest state of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shuffled


def claim_oldest(jobs: DataFrame, now: Column) -> DataFrame:
    """The oldest queued job, now running; no row if none is queued. One owner takes jobs at a time."""
    oldest = jobs.where("status = 'queued'").orderBy("created_at", "job_id").limit(1)
    return _running(oldest, F.lit(True), now)


def _running(jobs: DataFrame, which: Column, now: Column) -> DataFrame:
    started = F.col("started_at") if "started_at" in jobs.columns else F.lit(None).cast("timestamp_ntz")
    return (
        jobs.withColumn("started_at", F.when(which, now).otherwise(started)).withColumn("attempts", F.col("attempts") + which.cast("int")).withColumn("status", F.when(which, "running").otherwise(F.col("status")))
    )


def after_claim(jobs: DataFrame, now: Column) -> DataFrame:
    """The whole table after the oldest queued job was claimed."""
    oldest = jobs.where("status = 'queued'").agg(F.min_by("job_id", F.struct("created_at", "job_id")).alias("_claimed"))
    marked = jobs.crossJoin(F.broadcast(oldest))  # one row
    return _running(marked, F.coalesce(F.col("job_id") == F.col("_claimed"), F.lit(False)), now).drop("_claimed")


def claim_all(jobs: DataFrame, now: Column) -> DataFrame:
    """The whole table after its one owner claimed every queued job, as a batch does."""
    return _running(jobs, F.col("status") == "queued", now)


def finish(jobs: DataFrame, errors: DataFrame, now: Column) -> DataFrame:
    """Running jobs succeed, or fail with the error of their document (doc_id, error); others stay as they are."""
    told = jobs.join(shuffled(errors.select("doc_id", F.col("error").alias("_error"))), "doc_id", "left")
    running, failed = F.col("status") == "running", F.col("_error").isNotNull()
    before = F.col("error") if "error" in jobs.columns else F.lit(None).cast("string")
    old = F.col("finished_at") if "finished_at" in jobs.columns else F.lit(None).cast("timestamp_ntz")
    told = told.withColumn("finished_at", F.when(running, now).otherwise(old)).withColumn("error", F.when(running, F.col("_error")).otherwise(before))
    told = told.withColumn("status", F.when(running & failed, "failed").when(running, "succeeded").otherwise(F.col("status")))
    return told.drop("_error")


def reap(jobs: DataFrame) -> DataFrame:
    """After a restart nothing is running: such jobs are queued again and not started, their attempts kept."""
    was = F.col("status") == "running"
    if "started_at" in jobs.columns:
        jobs = jobs.withColumn("started_at", F.when(~was, F.col("started_at")))
    return jobs.withColumn("status", F.when(was, "queued").otherwise(F.col("status")))


def state_of(log: DataFrame) -> DataFrame:
    """Each job's state from the log of its changes (job_id, at, status, error).

    status and error of the last change, attempts (times it ran), started_at (of the last run, null
    while it is queued again) and finished_at (null unless it ended).
    """
    newest = F.struct("at", F.array_position(F.array(*map(F.lit, ("queued", "running", "failed", "succeeded"))), F.col("status")))
    runs = F.col("status") == "running"
    state = log.groupBy("job_id").agg(F.max_by("status", newest).alias("status"), F.max_by("error", newest).alias("error"), F.count(F.when(runs, 1)).alias("attempts"), F.max(F.when(runs, F.col("at"))).alias("started_at"), F.max("at").alias("at"))
    ended = F.col("status").isin("failed", "succeeded")
    return state.select("job_id", "status", "error", "attempts", F.when(F.col("status") != "queued", F.col("started_at")).alias("started_at"), F.when(ended, F.col("at")).alias("finished_at"))


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def route(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs, documents) after processing: results are (job_id, doc_id, error); an error fails both."""
    failed = F.col("error").isNotNull()
    jobs = results.select("job_id", "doc_id", F.when(failed, "failed").otherwise("succeeded").alias("status"), "error")
    # a document is ready once any of its jobs succeeded
    documents = results.groupBy("doc_id").agg(F.when(F.bool_and(failed), "failed").otherwise("ready").alias("status"))
    return jobs, documents


def newest_status(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """The documents with ``job_status``: of their newest job, null without one."""
    newest = jobs.groupBy("doc_id").agg(F.max_by("status", F.struct("created_at", "job_id")).alias("job_status"))
    return documents.join(newest, "doc_id", "left")
