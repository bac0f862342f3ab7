"""Best-fit packing: token sequences of one size, filled best fit first, longest piece first.

Best-fit decreasing looks only at a piece's length, and lengths are at most the sequence size.
So the plan is made from the histogram of lengths (at most ``capacity`` rows, whatever the
input): a segment tree over remaining capacities finds the tightest open bin in logarithmic
time, and pieces of one length that meet bins of one capacity are placed in one step. The
outcome equals placing piece after piece. Spark then numbers the pieces of each length and
each piece looks up the step that holds its number.

Defined results: a null or empty text is one piece holding only the end id; a null doc_id is
carried through; repeated rows are packed as often as they occur; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words
from .store import Scratch, lean, small_batches

CAPACITY = 2048
#: Bytes of a Python worker's cache of tokenised words; a full cache is emptied, and it ends with its task.
CACHE_BYTES = 48 << 20


class CapacityTree:
    """A segment tree over remaining capacities 0..capacity with the number of open bins at each."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, remaining: int, bins: int) -> None:
        i = remaining + self.size
        while i:
            self.open[i] += bins
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity of at least ``need`` that an open bin has."""
        i = need + self.size
        if self.open[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return None
        while i < self.size:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.size


def best_fit_steps(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first piece, pieces, first bin, pieces a bin, offset in the bin) of best-fit decreasing."""
    tree, ranges, steps, bins = CapacityTree(capacity), {}, [], 0

    def leave(remaining: int, first: int, n: int) -> None:
        if remaining and n:
            ranges.setdefault(remaining, []).append((first, n))
            tree.add(remaining, n)

    for length in sorted(histogram, reverse=True):
        placed, left = 0, histogram[length]
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = ranges[remaining].pop()
                tree.add(remaining, -n)
            each = remaining // length
            full = min(n, left // each)
            if full:
                steps.append((length, placed, full * each, first, each, capacity - remaining))
                leave(remaining - each * length, first, full)
                placed, left = placed + full * each, left - full * each
            if full < n and left:  # fewer than a bin takes
                steps.append((length, placed, left, first + full, left, capacity - remaining))
                leave(remaining - left * length, first + full, 1)
                placed, left, full = placed + left, 0, full + 1
            if full < n:
                leave(remaining, first + full, n - full)
    return steps


class WordIds:
    """Token ids of words by the words' hash: an open-addressing table in numpy arrays."""

    def __init__(self, tokenizer, end_id: int):
        self.tokenizer, self.end_id = tokenizer, end_id
        self.clear()

    def clear(self, size: int = 1 << 17) -> None:
        self.key, self.at = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        self.n = 1  # entry 0 stands for the end of a document
        self.offset, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.ids[0], self.length[0], self.used = self.end_id, 1, 1

    def size(self) -> int:
        """Bytes of the arrays."""
        return sum(a.nbytes for a in (self.key, self.at, self.offset, self.length, self.ids))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        mask, out = np.uint64(len(self.key) - 1), np.full(len(h), -1, np.int32)
        slot, todo = (h & mask).astype(np.int64), None
        while True:
            k = self.key[slot]
            hit = k == (h if todo is None else h[todo])
            if todo is None:
                out[hit] = self.at[slot[hit]]
                todo = np.flatnonzero(~hit & (k != 0))
                slot = slot[todo]
            else:
                out[todo[hit]] = self.at[slot[hit]]
                on = ~hit & (k != 0)
                todo, slot = todo[on], slot[on]
            if not len(todo):
                return out
            slot = (slot + 1) & int(mask)

    def _put(self, h: np.ndarray, at: np.ndarray) -> None:
        mask = len(self.key) - 1
        slot = (h & np.uint64(mask)).astype(np.int64)
        while len(h):
            free = self.key[slot] == 0
            self.key[slot[free]] = h[free]
            won = free & (self.key[slot] == h)
            self.at[slot[won]] = at[won]
            h, at, slot = h[~won], at[~won], (slot[~won] + 1) & mask

    def add(self, h: np.ndarray, texts: list[str]) -> None:
        """Tokenise new words (distinct hashes) and enter them."""
        flat, counts = [], []
        for a in range(0, len(texts), 500):
            part = texts[a : a + 500]
            # white space is dropped by this tokenizer, so one call serves many words
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])])
            where = np.array([o[0] for o in got.offsets], np.int64)
            counts.append(np.diff(np.searchsorted(where, begin)))
            flat.append(np.array(got.ids, np.uint32))
        ids, count = np.concatenate(flat), np.concatenate(counts)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(h) > len(self.offset):
            self.offset, self.length = np.concatenate([self.offset, np.zeros_like(self.offset)]), np.concatenate([self.length, np.zeros_like(self.length)])
        new = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.ids[self.used : self.used + len(ids)] = ids
        self.offset[new] = self.used + np.cumsum(count) - count
        self.length[new] = count
        self.used, self.n = self.used + len(ids), self.n + len(h)
        while 2 * self.n > len(self.key):
            old, at = self.key[self.key != 0], self.at[self.key != 0]
            self.key, self.at = np.zeros(2 * len(self.key), np.uint64), np.zeros(2 * len(self.at), np.int32)
            self._put(old, at)
        self._put(h, new)


#: A closing punctuation mark behind an ASCII letter or digit is always a token word of its own.
_CLOSING = np.isin(np.arange(256), list(b".,;:!?"))
_PLAIN = np.array([chr(i).isalnum() and i < 128 for i in range(256)])


def token_units(block: words.Block, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash, first) of the words with closing punctuation split off."""
    stem = block.end.copy()
    for _ in range(3):
        stem -= _CLOSING[block.data[stem - 1]] & (stem - block.start > 1)
    cut = np.flatnonzero((stem < block.end) & _PLAIN[block.data[stem - 1]])
    start, end = np.insert(block.start, cut + 1, stem[cut]), block.end.copy()
    end[cut] = stem[cut]
    end = np.insert(end, cut + 1, block.end[cut])
    hashes = words.word_hashes(block.data, start, end, value)
    # special tokens have an exact case, so words that may hold one are told apart by case
    marks = np.flatnonzero((block.data[:-1] == 60) & (block.data[1:] == 124))
    if len(marks):
        special = np.unique(np.searchsorted(start, marks, "right") - 1)
        hashes[special] = words.mix(words.word_hashes(block.data, start[special], end[special], words.byte_class(words.SPACE, False)[1]) + np.uint64(1))
    return start, end, hashes, block.first + np.searchsorted(cut, block.first)


_tokenizers: dict = {}


def document_ids(column: pa.Array, cache: WordIds) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per block: (rows, borders of the documents' ids, all ids), each document closed by the end id."""
    _, value = words.byte_class(words.SPACE, True)
    for block in words.blocks(column, lower=True):
        start, end, hashes, first = token_units(block, value)
        if cache.size() > CACHE_BYTES:
            cache.clear()
        at = cache.find(hashes)
        if (missing := np.flatnonzero(at < 0)).size:
            new, where = np.unique(hashes[missing], return_index=True)
            where = missing[where]
            cache.add(new, [block.data[start[i] : end[i]].tobytes().decode("utf-8", "replace") for i in where])
            at[missing] = cache.find(hashes[missing])
        at = np.insert(at, first[1:], 0)
        n = cache.length[at].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = cache.ids[np.arange(upto[-1]) + np.repeat(cache.offset[at] - upto[:-1], n)]
        yield block.rows, upto[first + np.arange(len(first))], ids


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids.

    ``tokenizer``: path of a tokenizers file that lower-cases and drops white space, present on
    every executor.
    """
    small_batches(docs.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _tokenizers:
            from tokenizers import Tokenizer

            _tokenizers[tokenizer] = Tokenizer.from_file(tokenizer)
        cache = WordIds(_tokenizers[tokenizer], end_id)
        for batch in batches:
            doc_id = batch.column(0)
            for rows, border, ids in document_ids(batch.column(1), cache):
                size = np.diff(border)
                count = -(-size // capacity)
                of = np.repeat(np.arange(len(rows)), count)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(size[of] - start, capacity)
                a = border[of] + start
                crc = np.array([zlib.crc32(ids[x : x + n]) for x, n in zip(a.tolist(), length.tolist(), strict=True)], np.int64)
                columns = [doc_id.take(pa.array(rows[of])), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(a, border[-1]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(pieces), PIECES + (", ids array<int>" if with_ids else ""))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Every piece with its place: the columns of ``token_pieces`` and sequence_id, offset."""
    spark = docs.sparkSession
    pieces = Scratch(spark, "packing").keep(token_pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    # at most ``capacity`` rows
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    steps = np.array(best_fit_steps(histogram, capacity), np.int64).reshape(-1, 6)
    total = sum(histogram.values())
    buckets = max(1, isqrt(total))  # so neither buckets nor their list grow faster than the root
    # the number of a piece among those of its length: by bucket, then by place in the bucket
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece"))
    numbered = pieces.withColumn("inside", inside.cast("long") - 1).join(before, ["length", "bucket"])
    numbered = numbered.withColumn("number", F.col("before") + F.col("inside")).drop("before", "inside", "bucket")
    # the plan's size depends on the capacity, not on the input
    plan = spark.sparkContext.broadcast(steps[np.lexsort((steps[:, 1], steps[:, 0]))])
    scale = total + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = plan.value
        key = step[:, 0] * scale + step[:, 1]
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            row = step[np.searchsorted(key, length * scale + number, "right") - 1]
            nth = number - row[:, 1]
            out = {c: batch.column(c) for c in batch.schema.names if c != "number"}
            out["sequence_id"] = pa.array(row[:, 3] + nth // row[:, 4], pa.int64())
            out["offset"] = pa.array(row[:, 5] + nth % row[:, 4] * length, pa.int64())
            yield pa.RecordBatch.from_pydict(out)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.drop("number").schema)
    return numbered.mapInArrow(lean(place), schema + ", sequence_id long, offset long")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
