"""Streaming ingestion: documents that land in a folder become chunks, and vectors if there is a model.

``foreachBatch`` runs at least once, so a batch replaces what an earlier attempt, or an earlier
arrival of its documents, left. Chunks, vectors and documents' states change in one commit:
readers never see half a batch. A document with a wrong vector fails as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import passing_folder
from ..sources.versions import Transaction, Versions

LANDING = "doc_id long, text string, lang string, source string, n_chars long"
TABLES = {
    "chunks": "doc_id long, department_id string, chunk_index long, content string, token_count long",
    "vectors": "doc_id long, department_id string, chunk_index long, embedding array<float>",
    "states": "doc_id long, department_id string, status string, error string",
}


def start_ingest(spark: SparkSession, landing: str, target: str, checkpoint: str, embed: Callable[[DataFrame], DataFrame] | None = None, dimension: int | None = None, schema: str = LANDING, **trigger):
    """Start the query; it stops by itself with ``availableNow=True``. ``embed`` adds ``embedding`` to chunks, of ``dimension`` numbers.

    Of several rows of one doc_id in a batch the one with the greatest text counts; null texts are
    empty, and rows without a doc_id are left out.
    """

    def put(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        tables = Versions(session, target)
        for name, columns in TABLES.items():
            tables.create(name, columns)
        docs = batch.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct(F.coalesce("text", F.lit("")).alias("text"), F.col("source").alias("department_id"))).alias("d")).select("doc_id", "d.department_id", "d.text")
        path = passing_folder(session, "ingested")
        T.chunks(docs, "text").withColumn("token_count", T.token_count(F.col("content"))).transform(embed or (lambda c: c)).write.parquet(f"{path}/chunks")
        docs.select("doc_id", "department_id").write.parquet(f"{path}/docs")
        made, keys = session.read.parquet(f"{path}/chunks"), session.read.parquet(f"{path}/docs")
        size = F.coalesce(F.size("embedding"), F.lit(-1)) if embed else F.lit(dimension)
        wrong = made.where(size != dimension).groupBy("doc_id").agg(F.max(size).alias("got")) if embed else made.select("doc_id", F.lit(0).alias("got")).where("false")
        error = F.concat(F.lit("embedding dimension "), F.when(F.col("got") >= 0, F.col("got").cast("string")).otherwise("none"), F.lit(f", expected {dimension}"))
        states = keys.join(wrong, "doc_id", "left").select("doc_id", "department_id", F.when(F.col("got").isNull(), "ready").otherwise("failed").alias("status"), F.when(F.col("got").isNotNull(), error).alias("error"))
        good = made.join(wrong, "doc_id", "left_anti")

        def work(t: Transaction) -> None:
            for name in ("chunks", "vectors"):
                t.delete(name, keys.select("doc_id"))
            t.append("chunks", good)
            if embed:
                t.append("vectors", good)
            t.replace("states", states, ["doc_id"])

        tables.commit(work)

    stream = spark.readStream.schema(schema).parquet(landing)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ingested(spark: SparkSession, target: str, name: str = "chunks") -> DataFrame:
    """The chunks (or vectors, or states) of all batches so far."""
    return Versions(spark, target).read(name)
