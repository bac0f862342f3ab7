"""A stored index of vectors: inverted lists by k-means, written once and read by the lists that a query needs.

Each vector is kept with the centroid that is nearest by angle; a list is a folder, so a query's
other lists are never opened. For each list the widest angle between its centroid and a vector is
kept, too: no vector of it can be nearer to a query than the query's angle to the centroid less
that. So a search may stop exactly: it reads the nearest lists, and then those that may still hold
a nearer vector than the last it has. With ``probes`` it reads that many lists and no more, which
is faster and may miss some.

Vectors without a length, with an unknown component or of another dimension have no distance to
anything and aren't indexed. The centroids are fitted on at most ``SAMPLE`` vectors; every vector
is indexed. Lists, and the numbers in all centroids, are bounded, as each task holds the centroids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.versions import Versions
from . import retrieval as R

#: Vectors that the centroids are fitted on; lists, and numbers in all centroids, at most.
SAMPLE, MOST_LISTS, MOST_NUMBERS = 1 << 16, 4096, 1 << 22
#: Lists that a search reads first, and vectors that it wants to have seen then.
FIRST_LISTS, FIRST_VECTORS = 2, 100
_ROWS = "chunk_id long, doc_id long, department_id string, status string, embedding array<float>, angle double, list int"
TABLES = {"centroids": "list int, centroid array<double>", "lists": _ROWS, "borders": "list int, widest double, n long"}


@dataclass(frozen=True)
class Lists:
    """The centroids (unit vectors), the widest angle in each list and its number of vectors; all small."""

    centroids: np.ndarray
    widest: np.ndarray
    sizes: np.ndarray

    def angles(self, queries: np.ndarray) -> np.ndarray:
        """queries x lists."""
        with np.errstate(divide="ignore", invalid="ignore"):
            unit = queries / np.sqrt((queries * queries).sum(1))[:, None]
        return np.arccos(np.clip(np.nan_to_num(unit) @ self.centroids.T, -1, 1))

    def least_distance(self, angles: np.ndarray) -> np.ndarray:
        """No vector of a list is nearer; a little less, so that rounding loses none."""
        return 1 - np.cos(np.maximum(0, angles - self.widest - 1e-6)) - 1e-9

    def first(self, angles: np.ndarray, probes: int | None) -> np.ndarray:
        """Which lists each query reads first: the nearest ``probes``, or enough to have seen some vectors."""
        order = np.argsort(np.where(self.sizes > 0, angles, np.inf), axis=1, kind="stable")
        seen = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
        place = np.arange(len(self.sizes))
        wanted = (place < probes) if probes is not None else (place < FIRST_LISTS) | (seen < FIRST_VECTORS)
        out = np.zeros(angles.shape, bool)
        np.put_along_axis(out, order, np.broadcast_to(wanted, angles.shape), axis=1)
        return out & (self.sizes > 0)


class VectorIndex:
    """The index under a folder, in versioned tables."""

    def __init__(self, tables: Versions):
        self.tables, self.spark = tables, tables.spark
        #: Comparisons of a query with a vector in the last search, and lists that it read.
        self.scored, self.lists_read = 0, 0

    def build(self, vectors: DataFrame, lists: int | None = None, seed: int = 1) -> None:
        """Fit centroids and index the vectors (chunk_id, doc_id, department_id, status, embedding); replaces what is there."""
        unit = _unit(vectors)
        n, size = unit.count(), (unit.select(F.max(F.size("v"))).first()[0] or 1)
        most = max(1, min(MOST_LISTS, MOST_NUMBERS // size))
        k = min(most, lists or max(1, round(math.sqrt(n))))
        part = unit.where(F.size("v") == size).where(F.pmod(F.xxhash64(F.lit(seed), "chunk_id"), F.lit(1 << 30)) < (1 << 30) * min(1.0, SAMPLE / max(1, n)))
        part = part.select(array_to_vector("v").alias("features"))
        centroids = np.zeros((0, size))
        if n:
            found = KMeans(k=max(2, k), seed=seed, maxIter=10, distanceMeasure="cosine").fit(part).clusterCenters() if k > 1 and part.limit(2).count() > 1 else [np.ones(size)]
            centroids = np.array(found)
            centroids /= np.maximum(np.sqrt((centroids * centroids).sum(1)), 1e-300)[:, None]
        rows = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], TABLES["centroids"])
        placed = _placed(vectors, centroids)

        def work(t) -> None:
            for name, schema in TABLES.items():
                t.create(name, schema, parts=["list"] if name == "lists" else [])
                t.removed[name] = set(t.base.tables[name].folders) if name in t.base.tables else set()
            t.append("centroids", rows)
            _append(t, placed)

        self.tables.commit(work)

    def add(self, vectors: DataFrame) -> None:
        """Index more vectors, with the centroids that there are."""
        placed = _placed(vectors, self.lists().centroids)
        self.tables.commit(lambda t: _append(t, placed))

    def delete(self, chunks: DataFrame) -> None:
        """Take chunks (chunk_id) out. Lists stay as wide as they were, which loses nothing."""
        self.tables.commit(lambda t: t.delete("lists", chunks.select("chunk_id")))

    def lists(self) -> Lists:
        version = self.tables.newest()
        # as many rows as lists at most
        centroids = np.array([r["centroid"] for r in self.tables.read("centroids", version).orderBy("list").collect()])
        widest, sizes = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
        for r in self.tables.read("borders", version).groupBy("list").agg(F.max("widest").alias("widest"), F.sum("n").alias("n")).collect():
            widest[r["list"]], sizes[r["list"]] = r["widest"], r["n"]
        return Lists(centroids, widest, sizes)

    def search(self, query: list[float], limit: int = 2 * R.K, probes: int | None = None, where: str = "true") -> DataFrame:
        """chunk_id, distance, rank of the nearest ready vectors that meet ``where``; exact unless ``probes`` is given."""
        one = self.spark.createDataFrame([(0, [float(x) for x in query])], "query_id long, vector array<double>")
        return self.search_batch(one, limit, probes, where).drop("query_id")

    def search_batch(self, queries: DataFrame, limit: int = 2 * R.K, probes: int | None = None, where: str = "true") -> DataFrame:
        """query_id, chunk_id, distance, rank for queries (query_id, vector), block by block."""
        lists, out = self.lists(), None
        near = self.tables.read("lists").where("status = 'ready'").where(where).select("chunk_id", F.col("embedding").cast("array<double>").alias("v"), "list")
        self.scored = self.lists_read = 0
        for ids, asked in R.query_blocks(queries):
            if not len(lists.centroids) or asked.shape[1] != lists.centroids.shape[1]:
                continue
            angles = lists.angles(asked)
            first = lists.first(angles, probes)
            found = self._read(near, ids, asked, first, limit, lists)
            if probes is None:
                worst = np.full(len(ids), np.inf)
                place = {int(x): i for i, x in enumerate(ids)}
                for r in found.where(F.col("rank") == limit).collect():  # a row for each query of the block at most
                    worst[place[r["query_id"]]] = r["distance"]
                rest = ~first & (lists.sizes > 0) & (lists.least_distance(angles) <= worst[:, None])
                if rest.any():
                    more = self._read(near, ids, asked, rest, limit, lists)
                    found = R.ranked_by_query(found.drop("rank").unionByName(more.drop("rank")), limit)
            out = found if out is None else out.unionByName(found)
        return self.spark.createDataFrame([], f"{R.FOUND}, rank long") if out is None else out

    def _read(self, near: DataFrame, ids: np.ndarray, asked: np.ndarray, pairs: np.ndarray, limit: int, lists: Lists) -> DataFrame:
        """The nearest among the lists that ``pairs`` (queries x lists) names; other lists' folders aren't opened."""
        wanted = np.flatnonzero(pairs.any(0))
        self.lists_read += len(wanted)
        self.scored += int((pairs * lists.sizes).sum())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nearest = R.Nearest(asked, limit, 9)
            for batch in batches:
                at, chunk, v = R.rows_of_dimension(batch, asked.shape[1])
                which = batch.column("list").to_numpy(zero_copy_only=False)[at]
                for x in np.unique(which):
                    nearest.see(chunk[which == x], v[which == x], np.flatnonzero(pairs[:, x]))
            yield R.found_batch(ids, nearest)

        found = near.where(F.col("list").isin([int(x) for x in wanted])).mapInArrow(scan, R.FOUND)
        best = R.ranked_by_query(found, limit)
        return self.spark.createDataFrame(best.toArrow()) if len(ids) * limit <= 10_000 else best  # so few rows are read once


def _unit(vectors: DataFrame) -> DataFrame:
    """chunk_id and the vector as doubles, of those that have a direction."""
    v = F.col("embedding").cast("array<double>")
    size = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    return vectors.select("chunk_id", v.alias("v")).where((size > 0) & (size < float("inf")))


def _placed(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The vectors with their list and their angle to its centroid."""
    names = ["chunk_id", "doc_id", "department_id", "status", "embedding"]
    rows = vectors.select(*names, F.col("embedding").cast("array<double>").alias("v"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, _, v = R.rows_of_dimension(batch, centroids.shape[1])
            norm = np.sqrt((v * v).sum(1))
            good = np.isfinite(norm) & (norm > 0)
            at, v, norm = at[good], v[good], norm[good]
            best, cosine = np.zeros(len(v), np.int64), np.zeros(len(v))
            step = R.slice_rows(len(centroids))
            for x in range(0, len(v), step):
                part = np.clip(v[x : x + step] @ centroids.T / norm[x : x + step, None], -1, 1)
                best[x : x + step] = part.argmax(1)
                cosine[x : x + step] = part.max(1)
            left = batch.select(names).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*left.columns, pa.array(np.arccos(cosine), pa.float64()), pa.array(best, pa.int32())], [*names, "angle", "list"])

    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], _ROWS)
    return rows.mapInArrow(place, _ROWS)


def _append(t, placed: DataFrame) -> None:
    t.append("lists", placed.repartition("list", F.pmod(F.xxhash64("chunk_id"), F.lit(8))))  # few files a list, and a large list in several tasks
    new = t.versions._folders("lists", t.table("lists"), t.added.get("lists", [])[-1:])  # what was just written
    t.append("borders", new.groupBy("list").agg(F.max("angle").alias("widest"), F.count(F.lit(1)).alias("n")))
