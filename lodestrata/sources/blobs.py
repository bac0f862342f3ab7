"""Content-addressed blobs: bytes are kept under the SHA-256 of their content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import path_exists


def lossy_text(data: Column) -> Column:
    """Bytes as UTF-8 text; each malformed sequence becomes U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))


def file_hash(data: Column, path: Column) -> Column:
    """Hash of a file's bytes, or of its path where the file can't be read (null bytes)."""
    return F.coalesce(F.sha2(data, 256), F.concat(F.lit("path:"), F.sha2(path.cast("binary"), 256)))


def _prefix() -> Column:
    """The partition of a hash; the letter keeps it from being read as a number."""
    return F.concat(F.lit("h"), F.substring("file_hash", 1, 2))


def write_blobs(uploads: DataFrame, root: str) -> DataFrame:
    """Append each new content once, partitioned by the hash's first characters; returns (file_hash, byte_size).

    Two writers at once may both append a content; readers take one of equal ones.
    """
    spark = uploads.sparkSession
    blobs = uploads.where("content is not null").select(F.sha2("content", 256).alias("file_hash"), "content").dropDuplicates(["file_hash"]).withColumn("prefix", _prefix())
    if path_exists(spark, root):
        there = spark.read.schema("file_hash string, content binary, prefix string").parquet(root).select("file_hash", "prefix")
        blobs = blobs.join(there, ["prefix", "file_hash"], "left_anti")
    blobs.write.mode("append").partitionBy("prefix").parquet(root)
    return uploads.select(F.sha2("content", 256).alias("file_hash"), F.octet_length("content").cast("long").alias("byte_size"))


def read_blobs(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """The wanted rows (file_hash, ...) with ``content``; null where the blob is missing."""
    blobs = spark.read.schema("file_hash string, content binary, prefix string").parquet(root)
    blobs = blobs.join(wanted.select("file_hash").distinct().withColumn("prefix", _prefix()), ["prefix", "file_hash"], "left_semi").dropDuplicates(["prefix", "file_hash"])
    return wanted.withColumn("prefix", _prefix()).join(blobs, ["prefix", "file_hash"], "left").drop("prefix")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as (path, byte_size, content)."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("byte_size"), "content")
