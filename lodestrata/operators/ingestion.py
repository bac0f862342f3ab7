"""Ingestion of queued jobs: chunks and vectors of whole documents, or a failed job and nothing else."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.blobs import lossy_text
from ..sources.shared import shuffled
from . import jobs as J

#: The error of a document without its bytes.
NO_BLOB = "the document's bytes are missing"


@dataclass(frozen=True)
class Outcome:
    """The tables after the batch: ``chunks`` and ``vectors`` to add, ``jobs`` and ``documents`` whole."""

    chunks: DataFrame
    vectors: DataFrame
    jobs: DataFrame
    documents: DataFrame


def process(jobs: DataFrame, documents: DataFrame, content: DataFrame, embed: Callable[[DataFrame], DataFrame], dimension: int, now: Column) -> Outcome:
    """All queued jobs, each whole or not at all; jobs left running by a lost owner are queued again first.

    ``jobs``: job_id, doc_id, status, attempts, created_at, started_at, finished_at, error.
    ``documents``: doc_id, department_id, status and more. ``content``: doc_id, content (bytes; null
    or no row: missing). ``embed`` adds ``embedding`` to chunks (doc_id, department_id, chunk_index,
    content, token_count). A document with one wrong vector fails as a whole.
    """
    claimed = J.claim_all(J.reap(jobs), now)
    wanted = claimed.where("status = 'running'").select("doc_id").distinct()
    texts = documents.join(shuffled(wanted), "doc_id", "left_semi").select("doc_id", "department_id").join(shuffled(content.where("content is not null").select("doc_id", lossy_text(F.col("content")).alias("text"))), "doc_id")
    chunks = embed(T.chunks(texts, "text").withColumn("token_count", T.token_count(F.col("content"))))
    size = F.coalesce(F.size("embedding"), F.lit(-1))
    wrong = chunks.where(size != dimension).groupBy("doc_id").agg(F.max(F.when(size >= 0, size)).alias("got"))
    said = F.concat(F.lit("embedding dimension "), F.coalesce(F.col("got").cast("string"), F.lit("none")), F.lit(f", expected {dimension}"))
    # a row for each wanted document; texts aren't shuffled for it
    there, held = documents.select("doc_id", F.lit(True).alias("_there")), content.where("content is not null").select("doc_id").distinct().withColumn("_held", F.lit(True))
    told = wanted.join(shuffled(there), "doc_id", "left").join(shuffled(held), "doc_id", "left").join(shuffled(wrong.select("doc_id", said.alias("_wrong"))), "doc_id", "left")
    told = told.select("doc_id", F.when(F.col("_there").isNull(), "no such document").when(F.col("_held").isNull(), NO_BLOB).otherwise(F.col("_wrong")).alias("error"))
    errors = told.where("error is not null")
    good = chunks.join(shuffled(errors.select("doc_id")), "doc_id", "left_anti")
    done = J.finish(claimed, errors, now)
    state = told.select("doc_id", F.when(F.col("error").isNull(), "ready").otherwise("failed").alias("_state"))
    after = documents.join(shuffled(state), "doc_id", "left").withColumn("status", F.coalesce("_state", "status")).drop("_state")
    return Outcome(good.drop("embedding"), good.select("doc_id", "department_id", "chunk_index", "embedding"), done, after)
