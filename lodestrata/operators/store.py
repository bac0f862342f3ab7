"""The document store: uploads, ingestion and deletions, each of them one commit of all its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import blobs
from ..sources.shared import passing_folder, shuffled
from ..sources.versions import Transaction, Versions
from . import ingestion, uploads
from .policy import PolicyError, ScopedCatalog

#: name -> (columns, keys, conditions)
TABLES = {
    "documents": ("doc_id long, department_id string, filename string, file_hash string, byte_size long, status string", [["doc_id"], ["department_id", "file_hash"]], {"a known status": "status in ('pending', 'ready', 'failed')"}),
    "jobs": ("job_id long, doc_id long, status string, attempts int, created_at timestamp_ntz, started_at timestamp_ntz, finished_at timestamp_ntz, error string", [["job_id"]], {"a known status": "status in ('queued', 'running', 'succeeded', 'failed')"}),
    "chunks": ("doc_id long, department_id string, chunk_index long, content string, token_count long", [["doc_id", "chunk_index"]], {"a chunk has text": "length(content) > 0"}),
    "vectors": ("doc_id long, department_id string, chunk_index long, embedding array<float>", [["doc_id", "chunk_index"]], {}),
}


class DocumentStore:
    """The tables under a folder. Readers see a whole commit or nothing of it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.tables = spark, Versions(spark, root)
        missing = [n for n in TABLES if n not in self.tables.newest().tables]
        if missing:
            self.tables.commit(lambda t: [t.create(n, *TABLES[n]) for n in missing if n not in t.base.tables])

    def read(self, name: str) -> DataFrame:
        return self.tables.read(name)

    def enter(self, documents: DataFrame, jobs: DataFrame) -> int:
        """Documents with their jobs; all of them or none."""

        def work(t: Transaction) -> None:
            t.append("documents", documents)
            t.append("jobs", jobs)

        return self.tables.commit(work)

    def upload(self, files: DataFrame, catalog: ScopedCatalog, blob_root: str, now: Column) -> DataFrame:
        """Enter uploads (upload_id, department_id, filename, mime_type, content) as pending documents with queued jobs, and tell what became of each, with the new documents' ids.

        The ids are long numbers derived from department and content. A caller who may not write to
        one of the departments gets an error, and nothing is entered.
        """
        told = None

        def work(t: Transaction) -> None:
            nonlocal told
            there = t.read("documents")
            told = uploads.outcomes(files, there.select("department_id", "file_hash"), catalog)
            told = told.withColumn("doc_id", F.xxhash64("document_id")).drop("document_id").withColumn("doc_id", F.when(F.col("outcome") == "queued", F.col("doc_id")))
            if not told.where("outcome = 'denied'").isEmpty():
                raise PolicyError("rows of a department that the caller is no member of")
            new = told.where("outcome = 'queued'")
            blobs.write_blobs(files.join(new.select("upload_id"), "upload_id", "left_semi"), blob_root)
            t.append("documents", new.select("doc_id", "department_id", "filename", "file_hash", "byte_size", F.lit("pending").alias("status")))
            t.append("jobs", new.select(F.xxhash64(F.lit("job"), "doc_id").alias("job_id"), "doc_id", F.lit("queued").alias("status"), F.lit(0).alias("attempts"), now.alias("created_at")))

        self.tables.commit(work)
        return told

    def ingest(self, content: DataFrame, embed: Callable[[DataFrame], DataFrame], dimension: int, now: Column) -> int:
        """Work through all queued jobs (and those that a lost owner left running). Chunks, vectors, jobs and documents' states come in one commit.

        ``content`` and ``embed`` as in ``ingestion.process``. Chunks are made and embedded once.
        """

        def once(chunks: DataFrame) -> DataFrame:
            made, path = embed(chunks), passing_folder(self.spark, "embedded")
            made.write.parquet(path)
            return self.spark.read.schema(made.schema).parquet(path)

        def work(t: Transaction) -> None:
            jobs, documents = t.read("jobs"), t.read("documents")
            out = ingestion.process(jobs, documents, content, once, dimension, now)
            open_ = jobs.where("status in ('queued', 'running')")
            t.replace("jobs", out.jobs.join(shuffled(open_.select("job_id")), "job_id", "left_semi"), ["job_id"])
            touched = open_.select("doc_id").distinct()
            t.replace("documents", out.documents.join(shuffled(touched), "doc_id", "left_semi"), ["doc_id"])
            for name, rows in (("chunks", out.chunks), ("vectors", out.vectors)):
                t.delete(name, touched)  # of an earlier run
                t.append(name, rows)

        return self.tables.commit(work)

    def delete(self, gone: DataFrame) -> int:
        """Delete documents (doc_id) with their jobs, chunks and vectors."""
        return self.tables.commit(lambda t: [t.delete(n, gone.select("doc_id")) for n in TABLES])
