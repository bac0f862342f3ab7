"""The engine's tables as views of the Parquet tables of one folder.

Every mapping is a pure function of the stored rows: departments are sources, each user belongs
to two departments, every seventeenth document is still pending, jobs are events, adapters are
parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


class Tables:
    """Lazy frames over ``sf_dir``; columns that a query doesn't use are never read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def documents(self) -> DataFrame:
        d = self.raw("documents")
        return d.select(
            "doc_id",
            F.col("source").alias("department_id"),
            F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, (".txt", ".pdf", ".docx", ".xls", ".PPTX", ".bin"))), F.pmod("doc_id", F.lit(6)).cast("int") + 1)).alias("filename"),
            F.when(F.col("doc_id") % 17 == 0, "pending").otherwise("ready").alias("status"),
            F.col("text"),
            F.col("n_chars"),
        )

    def departments(self) -> DataFrame:
        return self.raw("documents").select(F.col("source").alias("department_id")).distinct().withColumn("name", F.concat(F.lit("Department "), "department_id"))

    def users(self) -> DataFrame:
        return self.raw("events").select("user_id").distinct()

    def accounts(self) -> DataFrame:
        """The users with ``is_admin``: every fiftieth is an administrator."""
        return self.users().withColumn("is_admin", F.col("user_id") % 50 == 1)

    def audit_log(self) -> DataFrame:
        return self.raw("events").select("event_id", "user_id", F.col("event_type").alias("action"), "ts")

    def models(self) -> DataFrame:
        """Brands as embedding models, two of them active."""
        name = F.col("p_brand")
        return self.raw("part").select(name.alias("name"), F.lit(64).alias("dimension"), name.isin("Brand#12", "Brand#21").alias("is_active")).distinct()

    def members(self) -> DataFrame:
        users = self.users()
        shift = F.explode(F.array(F.lit(0), F.lit(7)))
        return users.select("user_id", shift.alias("k")).select("user_id", F.concat(F.lit("src"), ((F.col("user_id") + F.col("k")) % 20).cast("string")).alias("department_id"))

    def chunks(self) -> DataFrame:
        return T.document_chunks(self.documents()).select("chunk_id", "doc_id", "department_id", "filename", "status", "chunk_index", "content")

    def chunk_keys(self) -> DataFrame:
        """The chunks without their contents; the stored lengths tell them, and the texts aren't read."""
        docs = self.documents()
        n = T.chunk_count(F.col("n_chars"))
        rows = docs.where(n > 0).select("doc_id", "department_id", "status", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("chunk_index"))
        return rows.select(T.chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), "*")

    def embedded(self, chunks: DataFrame) -> DataFrame:
        """Chunks with a stored vector each, standing in for a model: the one with number doc_id + chunk_index, counted round."""
        vectors = self.raw("embeddings").select("vec_id", "embedding")
        count = vectors.agg(F.count(F.lit(1))).scalar()
        return chunks.withColumn("vec_id", (F.col("doc_id") + F.col("chunk_index")) % count).join(vectors, "vec_id", "left").drop("vec_id")

    def chunk_vectors(self) -> DataFrame:
        """Every chunk's vector."""
        return self.embedded(self.chunk_keys()).where("embedding is not null").select("chunk_id", "doc_id", "department_id", "status", "embedding")

    def jobs(self, events: DataFrame | None = None) -> DataFrame:
        """Events (also those of a stream) as jobs: clicks and unknown types are queued ones too, so none is left out."""
        kinds = {"view": "running", "purchase": "succeeded", "error": "failed"}
        status = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in kinds.items()), F.lit("queued"))
        events = (self.raw("events") if events is None else events).select("event_id", "ts", status.alias("status"))
        count = self.raw("documents").agg(F.count(F.lit(1))).scalar()
        ended, at = F.col("status").isin("succeeded", "failed"), F.col("ts")
        return events.select(
            F.col("event_id").alias("job_id"), (F.col("event_id") % count).alias("doc_id"), "status", F.when(F.col("status") == "queued", 0).otherwise(1).alias("attempts"), at.alias("created_at"),
            F.when(F.col("status") != "queued", at).alias("started_at"), F.when(ended, at).alias("finished_at"), F.when(F.col("status") == "failed", "unreadable").alias("error"),
        )

    def adapters(self) -> DataFrame:
        p = self.raw("part")
        path = F.concat(F.lit("models/"), F.regexp_replace("p_name", " ", "_"), F.lit("-"), F.col("p_partkey").cast("string"), F.lit(".gguf"))
        return p.select(F.col("p_partkey").alias("adapter_id"), path.alias("file_path"), F.sha2(path.cast("binary"), 256).alias("file_hash"), F.col("p_brand").alias("base_model"), (8 * (F.col("p_size") % 3 + 1)).alias("rank"), (F.col("p_partkey") % 3 != 0).alias("is_active"))

    def assignments(self) -> DataFrame:
        p = self.raw("part")
        return p.select(F.col("p_partkey").alias("assignment_id"), F.concat(F.lit("src"), (F.col("p_partkey") % 20).cast("string")).alias("department_id"), F.col("p_partkey").alias("adapter_id"), (F.col("p_size") % 3).cast("double").alias("scale"), (F.col("p_partkey") % 40 == F.col("p_partkey") % 20).alias("is_default"))
