"""From documents to packed training sequences, in stages that each apply one operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again before the next one. All but the last return the columns of ``documents``.

Defined results: rows with a null, empty or wordless text pass every stage and are packed as a
piece with the end id alone; rows with a null doc_id pass unless their text is toxic or
contaminated; of rows with one doc_id the near-dedup keeps one; further columns pass through all
stages but the last; texts of any length are handled whole; an empty table gives an empty result.

The pseudonyms' key is the setting ``spark.lodestrata.pii.key``. Without it the example key is
taken, which is no secret: set it for any corpus whose pseudonyms must not be undone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import decontamination, near_dedup, packing, pii, toxicity
from lodestrata.llm.store import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't predict toxic."""
    return toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep_clean=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group linked at 0.8 of the five-word shingles."""
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten following words (or all of a shorter item) of the benchmark."""
    return decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_clean=True)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms for personal numbers, dates and addresses."""
    key = spark.conf.get("spark.lodestrata.pii.key", None) or spark.sparkContext.getConf().get("spark.lodestrata.pii.key") or pii.KEY
    return pii.pseudonymise(docs, key).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", pseudonymise),
    ("packing", pack),
]

#: SQL can express neither the trained classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
