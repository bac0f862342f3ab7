"""An inverted index of chunks: made at ingestion, changed by segments, and read by the parts that a query needs.

Words (or stems) are analysed once, when chunks are added. Each commit adds a segment. In it the
chunks are dealt into blocks, and a row has all places of one term in one block, with the most
places that any chunk of the block has. So a query reads its terms' rows alone, and of the blocks
whose best possible score can't reach the last row of the answer only those small numbers: a cover
begins at one of the query's n terms, and of the covers around one place of a term no two begin
with the same term, so a chunk has at most n times as many covers as places of its rarest term,
and each counts 1 at most.

Deleted documents are entered as dead in the segments that hold them; an update deletes and adds
in one commit. ``merge`` makes one of all segments, without the dead.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexical as L
from ..sources.shared import counted, shuffled
from ..sources.versions import Transaction, Versions
from . import retrieval as R

#: Folders that the terms of a segment are dealt into, and chunks in a block (more or less, as they are dealt by hash).
PARTS, BLOCK = 32, 64
#: Blocks that a search reads first.
FIRST_BLOCKS = 32
#: Chunks of a segment that a merge takes over as it is, if nothing of it is dead.
WHOLE = 100 * BLOCK
#: Words that a task makes postings of at once; those of a block stay together.
WORDS = 1 << 18
TABLES = {
    "postings": "segment string, term string, block long, best int, hits array<struct<chunk_id:bigint,doc_id:bigint,at:int>>, part int",
    "held": "segment string, doc_id long, chunks long",
    "dead": "segment string, doc_id long",
}


def _part(term):
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


class TextIndex:
    """The index under a folder, for one analyzer (``simple`` or ``english``)."""

    def __init__(self, tables: Versions, analyzer: str = "simple"):
        self.tables, self.spark, self.analyzer = tables, tables.spark, analyzer
        #: Blocks that have all terms of the last search, and those of them whose places were read.
        self.blocks, self.blocks_read = 0, 0
        missing = [n for n in TABLES if n not in tables.newest().tables]
        if missing:
            tables.commit(lambda t: [t.create(n, TABLES[n], parts=["part"] if n == "postings" else []) for n in missing if n not in t.base.tables])

    def add(self, chunks: DataFrame) -> None:
        """Index the ready chunks (chunk_id, doc_id, status, content) as a new segment."""
        self.tables.commit(lambda t: self._add(t, chunks))

    def delete(self, docs: DataFrame) -> None:
        """Take documents (doc_id) out."""
        self.tables.commit(lambda t: self._delete(t, docs))

    def update(self, docs: DataFrame, chunks: DataFrame) -> None:
        """The documents' chunks from now on, in place of what was there, in one commit."""

        def work(t: Transaction) -> None:
            self._delete(t, docs)
            self._add(t, chunks)

        self.tables.commit(work)

    def merge(self) -> None:
        """All segments as one, without the dead.

        Segments of ``WHOLE`` chunks and more without a dead document keep their blocks under other numbers, so their
        places stay where they are; those that are dead as a whole aren't read; the words of others are dealt anew.
        """

        def work(t: Transaction) -> None:
            dead, postings = t.read("dead"), t.read("postings")
            held = t.read("held").join(shuffled(dead), ["segment", "doc_id"], "left_anti")
            # segments, one for each commit since the last merge
            chunks = {r["segment"]: r["n"] for r in held.groupBy("segment").agg(F.sum("chunks").alias("n")).collect()}
            touched = {r["segment"] for r in dead.select("segment").distinct().collect()}
            whole = [s for s, n in sorted(chunks.items()) if n >= WHOLE and s not in touched]
            again = [s for s in chunks if s not in whole]
            segment = uuid.uuid4().hex
            n = sum(chunks[s] for s in again)
            rows = postings.where(F.col("segment").isin(again)).select("segment", "term", F.explode("hits").alias("h")).select("segment", "term", "h.*")
            rows = self._alive(rows, counted(dead.where(F.col("segment").isin(again))))
            t.overwrite("postings", _segment(_dealt(rows.drop("segment"), n), segment))
            if whole:
                last = {r["segment"]: r["last"] for r in postings.where(F.col("segment").isin(whole)).groupBy("segment").agg(F.max("block").alias("last")).collect()}
                first, numbers = _blocks(n), []
                for s in whole:
                    numbers += [F.lit(s), F.lit(first).cast("long")]
                    first += last.get(s, -1) + 1
                kept = postings.where(F.col("segment").isin(whole)).withColumn("block", F.element_at(F.create_map(*numbers), F.col("segment")) + F.col("block"))
                t.append("postings", kept.withColumn("segment", F.lit(segment)).sortWithinPartitions("part", "term", "block"))
            t.overwrite("held", held.groupBy("doc_id").agg(F.sum("chunks").alias("chunks")).withColumn("segment", F.lit(segment)))
            t.overwrite("dead", dead.where("false"))

        self.tables.commit(work)

    def _add(self, t: Transaction, chunks: DataFrame) -> None:
        segment = uuid.uuid4().hex
        ready = chunks.where("status = 'ready'")
        found = L.english_tokens(F.col("content")) if self.analyzer == "english" else L.tokens(F.col("content"))
        # the chunks are dealt into blocks as they are; their words are many times as many rows
        dealt = _dealt(ready.select("chunk_id", "doc_id", "content"), ready.count())
        words = dealt.select("chunk_id", "doc_id", "block", F.posexplode(found).alias("at", "term")).where("term <> ''")
        t.append("postings", _segment(words, segment))
        t.append("held", ready.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks")).withColumn("segment", F.lit(segment)))

    def _delete(self, t: Transaction, docs: DataFrame) -> None:
        # t.read has what was there before this transaction, so a segment that it adds stays alive
        t.append("dead", t.read("held").join(shuffled(docs.select("doc_id")), "doc_id", "left_semi").join(shuffled(t.read("dead")), ["segment", "doc_id"], "left_anti"))

    @staticmethod
    def _alive(hits: DataFrame, dead: DataFrame) -> DataFrame:
        return hits.join(dead, ["segment", "doc_id"], "left_anti")

    def _scores(self, rows: DataFrame, dead: DataFrame, terms: list[str]) -> DataFrame:
        """chunk_id, score of the chunks in postings rows that hold all terms."""
        number = F.array_position(F.array(*map(F.lit, terms)), F.col("term")).cast("int")
        hits = self._alive(rows.select("segment", number.alias("term"), F.explode("hits").alias("h")).select("segment", "term", "h.*"), dead)
        chunks = hits.groupBy("segment", "chunk_id").agg(F.count_distinct("term").alias("n"), F.sort_array(F.collect_list(F.struct("at", "term"))).alias("hits"))  # a chunk is short
        return chunks.where(F.col("n") == len(terms)).select("chunk_id", L.density_of_hits(F.col("hits"), len(terms)).alias("score"))

    def _rows(self, terms: list[str]) -> tuple[DataFrame, DataFrame]:
        """(postings of the terms, the dead); other terms' folders aren't opened."""
        version = self.tables.newest()
        parts = [r["part"] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(_part(F.col("term")).alias("part")).distinct().collect()]  # a query's terms
        return self.tables.read("postings", version).where(F.col("part").isin(parts) & F.col("term").isin(terms)), self.tables.read("dead", version)

    def matches(self, query: str) -> DataFrame:
        """chunk_id, score of all chunks that hold all terms of the query."""
        terms = L.query_terms(query, self.analyzer)
        if not terms:
            return self.spark.createDataFrame([], "chunk_id long, score double")
        return self._scores(*self._rows(terms), terms)

    def search(self, query: str, limit: int = 2 * R.K) -> DataFrame:
        """chunk_id, score, rank of the best chunks: blocks are left out once they can't reach the last of them."""
        order, terms = [F.desc("score"), "chunk_id"], L.query_terms(query, self.analyzer)
        self.blocks = self.blocks_read = 0
        if not terms:
            return R.ranked(self.matches(query), order, limit)
        rows, dead = self._rows(terms)
        # each term's best is a column apart from the places, so these aren't read yet
        blocks = rows.groupBy("segment", "block").agg(F.count(F.lit(1)).alias("n"), F.min("best").alias("best")).where(F.col("n") == len(terms))
        blocks = blocks.select("segment", "block", (F.col("best") * len(terms)).alias("bound"))
        self.blocks = blocks.count()
        first = blocks.orderBy(F.desc("bound"), "segment", "block").limit(FIRST_BLOCKS).collect()
        if not first:
            return R.ranked(self.spark.createDataFrame([], "chunk_id long, score double"), order, limit)
        here = [(r["segment"], r["block"]) for r in first]
        inside = F.struct("segment", "block").isin([F.struct(F.lit(s), F.lit(b).cast("long")) for s, b in here])
        best = self._scores(rows.where(F.col("block").isin([b for _, b in here])).where(inside), dead, terms)
        best = self.spark.createDataFrame(best.orderBy(*order).limit(limit).toArrow())  # as many rows as the answer has
        last = best.orderBy(*order).offset(limit - 1).first()
        rest = blocks.where(~inside) if last is None else blocks.where(~inside).where(F.col("bound") >= last["score"])
        more = rest.count()
        self.blocks_read = len(here) + more
        if more:
            best = best.unionByName(self._scores(rows.join(rest.select("segment", "block"), ["segment", "block"], "left_semi"), dead, terms))
        return R.ranked(best, order, limit)


def _blocks(n: int) -> int:
    """Blocks of about ``n`` chunks."""
    return max(1, -(-n // BLOCK))


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """Rows with the ``block`` of their chunk, of about ``n`` chunks, a block's rows together in one task."""
    tasks = max(1, min(256, n // 8192), n // 50_000)
    return rows.withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.lit(_blocks(n)))).repartition(tasks, "block").sortWithinPartitions("block")


def _segment(words: DataFrame, segment: str) -> DataFrame:
    """Postings of words (chunk_id, doc_id, block, at, term) in the order that ``_dealt`` left, so they need no further shuffle. A block bounds a row.

    Spark forgets how rows were dealt where Python makes a column, such as stems, and would shuffle them again for a ``groupBy``.
    """
    rows = words.select("chunk_id", "doc_id", "block", "at", "term").mapInArrow(_postings, "term string, block long, best int, hits array<struct<chunk_id:bigint,doc_id:bigint,at:int>>")
    return rows.select(F.lit(segment).alias("segment"), "term", "block", "best", "hits", _part(F.col("term")).alias("part")).sortWithinPartitions("part", "term", "block")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words that come block by block as rows of one term in one block, some blocks at a time."""
    held, n, most = [], 0, WORDS
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            words = pa.Table.from_batches(held)
            block = words.column("block").to_numpy()
            ended = int(np.flatnonzero(block != block[-1])[-1]) + 1 if block[0] != block[-1] else 0
            if ended:
                yield _rows_of(words.slice(0, ended))
            held, n = words.slice(ended).to_batches(), n - ended
            most = max(WORDS, 2 * n)
    if n:
        yield _rows_of(pa.Table.from_batches(held))


def _rows_of(words: pa.Table) -> pa.RecordBatch:
    """The postings of whole blocks."""
    words = words.combine_chunks()
    chunk, doc, block, at, term = (words.column(c).chunk(0) for c in ("chunk_id", "doc_id", "block", "at", "term"))
    terms = term.dictionary_encode()
    order = np.lexsort((at.to_numpy(), chunk.to_numpy(), terms.indices.to_numpy(), block.to_numpy()))
    blocks, codes, chunks = block.to_numpy()[order], terms.indices.to_numpy()[order], chunk.to_numpy()[order]
    new = np.ones(len(order), bool)  # where a row begins
    new[1:] = (blocks[1:] != blocks[:-1]) | (codes[1:] != codes[:-1])
    run = new.copy()  # where a row's places in another chunk begin
    run[1:] |= chunks[1:] != chunks[:-1]
    rows, runs = np.flatnonzero(new), np.flatnonzero(run)
    best = np.maximum.reduceat(np.diff(runs, append=len(order)), np.searchsorted(runs, rows))
    taken = pa.array(order)
    places = pa.StructArray.from_arrays([chunk.take(taken), doc.take(taken), at.take(taken)], ["chunk_id", "doc_id", "at"])
    hits = pa.ListArray.from_arrays(pa.array(np.append(rows, len(order)), pa.int32()), places)
    return pa.RecordBatch.from_arrays([terms.dictionary.take(pa.array(codes[rows])), pa.array(blocks[rows]), pa.array(best, pa.int32()), hits], ["term", "block", "best", "hits"])
