"""Hybrid retrieval: a cosine leg and a full-text leg, fused by reciprocal ranks.

Both legs rank ids only and keep 2k of them; contents are fetched for the k that remain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexical as L
from ..functions import text as T
from ..functions.vectors import cosine_distance

K, SMOOTHING = 5, 60


def ranked(frame: DataFrame, order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows with their 1-based ``rank``; the limit comes before the numbering."""
    top = frame.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def dense_leg(vectors: DataFrame, query: list[float], limit: int = 2 * K) -> DataFrame:
    """chunk_id, distance, rank of the nearest ready chunks."""
    vector = F.array(*(F.lit(float(x)) for x in query))
    near = vectors.where("status = 'ready'").select("chunk_id", cosine_distance(F.col("embedding"), vector).alias("distance")).where("distance is not null")
    return ranked(near, ["distance", "chunk_id"], limit)


#: Numbers in a block of queries, 8 MB of them; each block is one pass over the vectors.
BLOCK_NUMBERS = 1 << 20
#: Numbers in a matrix of distances, 8 MB of them; a batch of vectors is compared slice by slice.
MATRIX_NUMBERS = 1 << 20


class Nearest:
    """The nearest vectors seen so far of each query of a block, by rounded cosine distance, then by chunk_id."""

    def __init__(self, queries: np.ndarray, limit: int, digits: int):
        self.queries, self.limit, self.digits = queries, limit, digits
        self.norms = np.sqrt((queries * queries).sum(1))
        self.worst = np.full(len(queries), np.inf)
        self.parts, self.pending, self.scored = [], 0, 0

    def see(self, chunk: np.ndarray, vectors: np.ndarray, which: np.ndarray | None = None) -> None:
        """Vectors (rows of the queries' dimension) that the queries ``which`` are compared with, all by default."""
        which = np.arange(len(self.queries)) if which is None else which
        if not len(chunk) or not len(which):
            return
        step = slice_rows(len(which))
        for at in range(0, len(chunk), step):
            self._see(chunk[at : at + step], vectors[at : at + step], which)

    def _see(self, chunk: np.ndarray, vectors: np.ndarray, which: np.ndarray) -> None:
        self.scored += len(chunk) * len(which)
        with np.errstate(divide="ignore", invalid="ignore"):
            distance = np.round(1 - (self.queries[which] @ vectors.T) / np.outer(self.norms[which], np.sqrt((vectors * vectors).sum(1))), self.digits) + 0.0
            q, v = np.nonzero(distance <= self.worst[which][:, None])  # a distance that isn't one is never less
        self.parts.append((which[q], chunk[v], distance[q, v]))
        self.pending += len(q)
        if self.pending > 4 * self.limit * len(self.queries) + 100_000:
            self.close()

    def close(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, chunk, distance) of the nearest."""
        q, chunk, distance = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((chunk, distance, q))
        q, chunk, distance = q[order], chunk[order], distance[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.limit - 1
        self.worst[q[last]] = distance[last]
        kept = place < self.limit
        self.parts = [(q[kept], chunk[kept], distance[kept])]
        self.pending = int(kept.sum())
        return self.parts[0]


def slice_rows(columns: int) -> int:
    """Rows of a matrix with so many columns that are worked out at once."""
    return max(1, MATRIX_NUMBERS // max(1, columns))


def rows_of_dimension(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, chunk_ids, vectors) of a batch's vectors of one dimension; columns chunk_id, v."""
    lists = batch.column("v")
    at = np.flatnonzero(pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False) == size)
    chosen = lists.take(pa.array(at))
    return at, batch.column("chunk_id").to_numpy(zero_copy_only=False)[at], chosen.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (query_ids, vectors) of queries (query_id, vector) of one dimension each; few are on the driver at once."""
    held: dict[int, list] = {}
    for row in queries.where("vector is not null").select("query_id", F.col("vector").cast("array<double>").alias("vector")).toLocalIterator():
        block = held.setdefault(len(row["vector"]), [])
        block.append((row["query_id"], [np.nan if x is None else x for x in row["vector"]]))
        if len(block) * max(1, len(row["vector"])) >= BLOCK_NUMBERS:
            yield _block(held.pop(len(row["vector"])))
    yield from (_block(b) for size, b in held.items() if size)


def _block(rows: list) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)


FOUND = "query_id long, chunk_id long, distance double"


def found_batch(ids: np.ndarray, nearest: Nearest) -> pa.RecordBatch:
    q, chunk, distance = nearest.close()
    return pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), pa.array(chunk, pa.int64()), pa.array(distance, pa.float64())], ["query_id", "chunk_id", "distance"])


def dense_leg_batch(vectors: DataFrame, queries: DataFrame, limit: int = 2 * K, digits: int = 9) -> DataFrame:
    """query_id, chunk_id, distance, rank for a set of queries (query_id, vector) of any size.

    The vectors stay where they are; each block of queries goes to all of them, each task hands on
    its best ``limit`` for each query, and the best of those are ranked.
    """
    near = vectors.where("status = 'ready' and embedding is not null").select("chunk_id", F.col("embedding").cast("array<double>").alias("v"))
    found = None
    for ids, asked in query_blocks(queries):

        def scan(batches: Iterator[pa.RecordBatch], ids=ids, asked=asked) -> Iterator[pa.RecordBatch]:
            nearest = Nearest(asked, limit, digits)
            for batch in batches:
                _, chunk, v = rows_of_dimension(batch, asked.shape[1])
                nearest.see(chunk, v)
            yield found_batch(ids, nearest)

        one = near.mapInArrow(scan, FOUND)
        found = one if found is None else found.unionByName(one)
    return ranked_by_query(vectors.sparkSession.createDataFrame([], FOUND) if found is None else found, limit)


def ranked_by_query(found: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)


def lexical_matches(chunks: DataFrame, query: str, analyzer: str = "simple") -> DataFrame:
    """chunk_id and cover-density ``score`` of the ready chunks that hold all terms."""
    terms = L.query_terms(query, analyzer)
    ready, low = chunks.where("status = 'ready'"), F.lower("content")
    for term in terms:  # a cheap test before the words are looked at; a stem but for its last letter begins all its words
        ready = ready.where(low.contains(term[:-1] if analyzer == "english" else term))
    token_array = L.english_tokens(F.col("content")) if analyzer == "english" else L.tokens(F.col("content"))
    if not terms:
        ready = ready.where(F.lit(False))
    # one lambda and one generator, so the plan has the tokens once; a match is a score above 0
    score = F.transform(F.array(token_array), lambda t: L.cover_density(t, terms))
    return ready.select("chunk_id", F.explode(F.filter(score, lambda s: s > 0)).alias("score"))


def lexical_leg(chunks: DataFrame, query: str, limit: int = 2 * K, analyzer: str = "simple") -> DataFrame:
    return ranked(lexical_matches(chunks, query, analyzer), [F.desc("score"), "chunk_id"], limit)


def fuse(*legs: DataFrame, smoothing: int = SMOOTHING, digits: int = 12, names: tuple[str, ...] = ()) -> DataFrame:
    """chunk_id and the sum of 1 / (smoothing + rank) over all occurrences.

    ``names``: also each leg's smallest rank, as ``<name>_rank``, null where a leg lacks the chunk.
    """
    tagged = [leg.select("chunk_id", "rank", F.lit(i).alias("leg")) for i, leg in enumerate(legs)]
    all_legs = tagged[0]
    for leg in tagged[1:]:
        all_legs = all_legs.unionByName(leg)
    ranks = [F.min(F.when(F.col("leg") == i, F.col("rank"))).alias(f"{name}_rank") for i, name in enumerate(names)]
    return all_legs.groupBy("chunk_id").agg(F.round(F.sum(1.0 / (smoothing + F.col("rank"))), digits).alias("score"), *ranks)


def retrieve(vectors: DataFrame, docs: DataFrame, query_vector: list[float], query_text: str, k: int = K) -> DataFrame:
    """rank, chunk_id, doc_id, filename, content, score: the k best of both legs.

    ``docs``: documents with their text; after the ranking only those of the k best are cut again.
    """
    best = ranked(fuse(dense_leg(vectors, query_vector, 2 * k), lexical_leg(T.document_chunks(docs), query_text, 2 * k)), [F.desc("score"), "chunk_id"], k)
    best = best.select("rank", "chunk_id", "score", F.floor(F.col("chunk_id") / T.CHUNK_IDS).alias("doc_id"))  # k rows
    content = T.chunk_content(F.col("text"), F.col("chunk_id") % T.CHUNK_IDS)
    return docs.join(F.broadcast(best), "doc_id").select("rank", "chunk_id", "doc_id", "filename", content.alias("content"), "score")


def sources(hits: DataFrame) -> DataFrame:
    return hits.select("rank", "doc_id", "filename", T.excerpt(F.col("content")).alias("excerpt"), "score")


def context(hits: DataFrame) -> DataFrame:
    """One row: the numbered hits as text, in rank order (k rows)."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("rank", "filename", "content"))), lambda h: F.concat(F.lit("[Source "), h["rank"].cast("string"), F.lit("] "), h["filename"], F.lit("\n"), h["content"]))
    return hits.agg(F.array_join(lines, "\n\n").alias("context"))


def prompt(context_row: DataFrame, question: str) -> DataFrame:
    """The context with an instruction before it and the question behind."""
    return context_row.select(F.concat(F.lit("Use only the sources below; if they don't suffice, say that.\n\nSources:\n"), "context", F.lit("\n\nQuestion: "), F.lit(question), F.lit("\n\nAnswer:")).alias("prompt"))
