"""Approximate nearest neighbours by several shifted Hilbert curves.

1. Equal vectors form a class; only one of each is indexed, with its smallest members.
2. For each of ``CURVES`` orderings the vectors are projected to ``DIMENSIONS`` random
   directions, shifted, and placed on a Hilbert curve. Mean and scale come from a bounded sample;
   every class is indexed. The table is range-partitioned by (curve, key) and ranks follow from
   the partitions' sizes.
3. A query looks at the classes whose rank is within a window of its own on any curve. The
   window is measured, not guessed: a bounded number of pilot vectors, which are no queries as
   long as there are others, is compared with every class, and the window takes in ``TARGET`` of
   their true neighbours on their best curve. On clustered vectors windows are short; on vectors
   without structure they are a fixed share of the table, and no cheaper than comparing with all.
4. Ranks are cut into blocks; a query goes to the blocks its window meets, whose products are
   taken at once, and the blocks' best are merged. Scores are cosines of the original vectors, in
   double precision, computed pair by pair for what is left of a block, so they don't depend on it.

Defined results: vectors that are null, empty, of another dimension than most rows, zero, or
hold a null or non-finite component take no part; so do rows with a null vec_id; repeated rows
are candidates of their own; with fewer candidates than k all are returned; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .hilbert import hilbert_keys
from .store import Scratch

CURVES, DIMENSIONS, BITS = 8, 8, 6
#: Share of the pilot's true neighbours that the windows must take in.
TARGET = 0.95
#: Bounds of the fit: vectors for mean and scale, and pilot queries.
SAMPLE_VECTORS, PILOT_QUERIES = 10_000, 128
#: Vectors in a block of ranks.
BLOCK = 2048


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part; doubles and long integers are not narrowed to floats."""
    narrow = rows.schema["embedding"].dataType.elementType.simpleString() in ("float", "smallint", "tinyint")
    vector = F.col("embedding").cast("array<float>" if narrow else "array<double>")
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where("vec_id is not null and vector is not null and size(vector) > 0")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = good.where(finite & F.exists("vector", lambda x: x != 0))
    common = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return good.where(F.size("vector") == (common[0]["n"] if common else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def _cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (q @ v.T) / np.outer(np.sqrt((q * q).sum(1)), np.sqrt((v * v).sum(1)))


def _pair_cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The cosine of each row of q with the same row of v; equal pairs give equal bits wherever they stand."""
    norm = lambda x: np.sqrt((x * x).sum(1))
    return (q * v).sum(1) / (norm(q) * norm(v))


class Curves:
    """Projections and shifts of all curves."""

    def __init__(self, sample: np.ndarray, curves: int, dimensions: int, bits: int, seed: int = 7):
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        random, size = np.random.default_rng(seed), unit.shape[1]
        self.mean, self.bits = unit.mean(0), bits
        self.axes = [np.linalg.qr(random.normal(size=(size, size)))[0][:, : min(dimensions, size)] for _ in range(curves)]
        self.scale = [np.maximum(((unit - self.mean) @ a).std(0), 1e-12) for a in self.axes]
        self.shift = [random.uniform(-0.125, 0.125, a.shape[1]) for a in self.axes]

    def keys(self, vectors: np.ndarray) -> list[np.ndarray]:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True) - self.mean
        last = (1 << self.bits) - 1
        return [hilbert_keys(np.clip(((unit @ a / s / 6 + 0.5 + t) * (last + 1)).astype(np.int64), 0, last), self.bits) for a, s, t in zip(self.axes, self.scale, self.shift, strict=True)]


def ranked_index(classes: DataFrame, curves: Curves, scratch: Scratch) -> DataFrame:
    """(curve, rank, class_id, vector), written in rank order."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(curves)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for curve, key in enumerate(shared.value.keys(_matrix(batch.column(1)))):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), curve, np.int32)), pa.array(key), batch.column(0), batch.column(1)], ["curve", "key", "class_id", "vector"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            yield batch.append_column("place", pa.array(np.arange(seen, seen + batch.num_rows)))
            seen += batch.num_rows

    schema = f"curve int, key long, class_id long, vector {classes.schema['vector'].dataType.simpleString()}"
    keyed = classes.mapInArrow(place, schema).repartitionByRange("curve", "key", "class_id").sortWithinPartitions("curve", "key", "class_id")
    # written before it is counted: a range partitioning may fall out differently when run again
    sorted_ = scratch.keep(keyed.mapInArrow(number, schema + ", place long").withColumn("part", F.spark_partition_id()), "sorted")
    # a row for each partition and curve
    sizes = sorted_.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = sizes.select("curve", "part", (F.sum("n").over(Window.partitionBy("curve").orderBy("part")) - F.col("n") - F.col("first")).alias("before"))
    return sorted_.join(before, ["curve", "part"]).select("curve", (F.col("before") + F.col("place")).alias("rank"), "class_id", "vector")


def pilot_window(classes: DataFrame, pilots: DataFrame, ranks: DataFrame, k: int, target: float) -> int:
    """The rank distance within which ``target`` of the pilots' true neighbours lie."""
    pilot = pilots.orderBy(F.xxhash64("class_id"), "class_id").limit(PILOT_QUERIES).collect()  # a bounded number
    if not pilot:
        return 0
    ids, vectors = np.array([r["class_id"] for r in pilot]), np.array([r["vector"] for r in pilot], np.float64)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = batch.column(0).to_numpy()
                score = _cosines(vectors, _matrix(batch.column(1)))
                score[ids[:, None] == own[None, :]] = -2
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                row = np.repeat(np.arange(len(ids)), top.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(own[top.ravel()]), pa.array(score[row, top.ravel()])], ["class_id", "other", "score"])

    best = Window.partitionBy("class_id").orderBy(F.desc("score"), "other")
    true = classes.mapInArrow(nearest, "class_id long, other long, score double").where("score > -2").withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("class_id", "other")
    true = F.broadcast(true)  # PILOT_QUERIES * k rows
    mine = true.join(ranks.select("class_id", "curve", F.col("rank").alias("r1")), "class_id")
    far = mine.join(ranks.select(F.col("class_id").alias("other"), "curve", F.col("rank").alias("r2")), ["other", "curve"])
    distances = np.array([r["d"] for r in far.groupBy("class_id", "other").agg(F.min(F.abs(F.col("r1") - F.col("r2"))).alias("d")).collect()])
    return int(np.quantile(distances, target, method="higher")) + 1 if len(distances) else 0


def nearest(rows: DataFrame, wanted: str, k: int = 5, curves: int = CURVES, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each row that meets ``wanted``."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "ann")
    rows = scratch.keep(usable(rows), "rows")
    few = Window.partitionBy("vector").orderBy("vec_id")
    # a class's smallest members: no more can be among any query's nearest
    members = rows.withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1)
    members = scratch.keep(members.withColumn("class_id", F.min("vec_id").over(Window.partitionBy("vector"))), "members")
    classes = scratch.keep(members.where("n = 1").select("class_id", "vector"), "classes")
    members = members.select("class_id", "vec_id")
    asked = rows.where(wanted).select(F.col("vec_id").alias("query_id"), "vector").join(classes, "vector").select("query_id", "class_id")
    asked = scratch.keep(asked, "asked")
    queries = classes.join(asked.select("class_id").distinct(), "class_id", "left_semi")

    sample = classes.orderBy(F.xxhash64("class_id"), "class_id").limit(SAMPLE_VECTORS).select("vector").collect()  # a bounded number
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = scratch.keep(ranked_index(classes, Curves(np.array([r["vector"] for r in sample], np.float64), curves, DIMENSIONS, BITS), scratch), "index")
    others = classes.join(asked.select("class_id").distinct(), "class_id", "left_anti")
    window = pilot_window(classes, queries if others.isEmpty() else others, index.select("class_id", "curve", "rank"), k, target)
    block = BLOCK
    blocks = index.withColumn("block", F.floor(F.col("rank") / block))
    looks = index.join(queries.select("class_id"), "class_id", "left_semi").select(F.col("curve").alias("on"), F.col("rank").alias("around"), F.col("class_id").alias("asking"), F.col("vector").alias("query"))
    met = F.sequence(F.floor(F.greatest(F.col("around") - window, F.lit(0)) / block), F.floor((F.col("around") + window) / block))
    looks = looks.withColumn("met", F.explode(met))

    def rerank(key: tuple, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if vectors.num_rows and queries.num_rows:
            v, ids, at = _matrix(vectors["vector"]), vectors["class_id"].to_numpy(), vectors["rank"].to_numpy()
            q, asking, around = _matrix(queries["query"]), queries["asking"].to_numpy(), queries["around"].to_numpy()
            for a in range(0, len(q), 256):
                score = _cosines(q[a : a + 256], v)
                score[(np.abs(around[a : a + 256, None] - at[None, :]) > window) | (asking[a : a + 256, None] == ids[None, :])] = -2
                score = np.round(score, 12)  # products of whole blocks differ in their last bits
                top = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k] if len(v) <= k else _top(score, ids, k)
                row, top = np.repeat(np.arange(len(score)), top.shape[1]), top.ravel()
                found = score[row, top] > -2
                row, top = row[found], top[found]
                for o, x in zip(out, (asking[a + row], ids[top], _pair_cosines(q[a + row], v[top])), strict=True):
                    o.append(x)
        made = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.table([pa.array(made[0], pa.int64()), pa.array(made[1], pa.int64()), pa.array(made[2], pa.float64())], ["asking", "class_id", "score"])

    found = blocks.groupBy("curve", "block").cogroup(looks.groupBy("on", "met")).applyInArrow(rerank, "asking long, class_id long, score double")
    found = found.groupBy("asking", "class_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("asking").orderBy(F.desc("score"), "class_id")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n")

    def with_itself(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(0), pa.array(_pair_cosines(v, v))], ["asking", "class_id", "score"])

    own = queries.select("class_id", "vector").mapInArrow(with_itself, "asking long, class_id long, score double")
    candidates = found.unionByName(own).join(members, "class_id").select("asking", "vec_id", "score")
    first = Window.partitionBy("asking").orderBy(F.desc("score"), "vec_id")
    candidates = candidates.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    # k + 1 rows for each class that asks; a query's own row is one of them or none
    answers = asked.join(candidates.groupBy("asking").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("list")), asked["class_id"] == F.col("asking"))
    answers = answers.select("query_id", F.posexplode(F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("rank", "hit"))
    return answers.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest scores of each row, ties to smaller ids."""
    bound = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
    out = np.empty((len(score), k), np.int64)
    for i, row in enumerate(score):
        maybe = np.flatnonzero(row >= bound[i])
        out[i] = maybe[np.lexsort((ids[maybe], -row[maybe]))[:k]]
    return out


def op8_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 50 = 0")
