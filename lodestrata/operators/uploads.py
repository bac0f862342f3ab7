"""Uploads: checked, hashed, kept once as blobs, and entered as documents with queued jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import blobs
from .policy import ScopedCatalog


def derived_id(*parts: Column) -> Column:
    """The id of a new row: a hash of what makes the row unique, so a repeated insert gets the same one."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *(p.cast("string") for p in parts)).cast("binary"), 256), 1, 32)


def inserted(incoming: DataFrame, key: list[str], name: str = "id") -> DataFrame:
    """The rows as they are inserted, with the id that each gets."""
    return incoming.withColumn(name, derived_id(*map(F.col, key)))


def outcomes(uploads: DataFrame, documents: DataFrame, catalog: ScopedCatalog) -> DataFrame:
    """What becomes of each upload (upload_id, department_id, filename, mime_type, content).

    ``denied``: the caller is no member of the department; ``duplicate``: the department has these
    bytes, in ``documents`` (department_id, file_hash) or in an earlier upload; else ``queued``.
    """
    told = uploads.select("upload_id", "department_id", "filename", T.mime_or_default(F.col("mime_type")).alias("mime_type"), F.sha2("content", 256).alias("file_hash"), F.octet_length("content").cast("long").alias("byte_size"))
    told = catalog.checked(told)
    same = ["department_id", "file_hash"]
    first = told.where("allowed").groupBy(*same).agg(F.min("upload_id").alias("_first"))
    there = documents.select(*same).distinct().withColumn("_there", F.lit(True))
    told = told.join(first, same, "left").join(there, same, "left")
    outcome = F.when(~F.col("allowed"), "denied").when(F.col("_there") | (F.col("_first") < F.col("upload_id")), "duplicate").otherwise("queued")
    told = told.withColumn("outcome", outcome).drop("allowed", "_first", "_there")
    return inserted(told, same, "document_id").withColumn("document_id", F.when(F.col("outcome") == "queued", F.col("document_id")))


def upload(uploads: DataFrame, documents: DataFrame, catalog: ScopedCatalog, blob_root: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(documents, jobs) that the uploads add; their blobs are written first, those of others never."""
    told = outcomes(uploads, documents, catalog).where("outcome = 'queued'")
    blobs.write_blobs(uploads.join(told.select("upload_id"), "upload_id", "left_semi"), blob_root)
    new = told.select("document_id", "department_id", "filename", "mime_type", "file_hash", "byte_size", F.lit("pending").alias("status"))
    jobs = told.select(derived_id(F.lit("job"), F.col("document_id")).alias("job_id"), "document_id", F.lit("queued").alias("status"), F.lit(0).alias("attempts"), now.alias("created_at"))
    return new, jobs
